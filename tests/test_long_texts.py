"""Texts and pages of any length: the same pieces and links, in time by their length."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from fairtender.functions import text as tx
from fairtender.operators.chunks import chunk_text
from test_rules import one, plain_cuts


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 10, 19, 40, 100])
def test_pieces_of_random_texts(spark, n):
    rng = random.Random(n)
    texts = []
    for _ in range(150):
        often = rng.choice([0.0, 0.01, 0.1, 0.5, 1.0])
        words = [rng.choice(["a", "bb", "é", "x.y"]) + "." * (rng.random() < often) for _ in range(rng.randrange(0, rng.choice([5, 60, 500])))]
        texts.append("".join(w + rng.choice([" ", "  ", "\n", " "]) for w in words))
    df = spark.createDataFrame(list(enumerate([*texts, None, "", " . ", "..."])), "id int, text string")
    got = {}
    for r in chunk_text(df, "text", n).orderBy("id", "chunk").collect():
        got.setdefault(r.id, []).append(r.text)
    ends = {r.id: r.text for r in chunk_text(df, "text", n, "first_last").collect()}
    for i, text in enumerate([*texts, None, "", " . ", "..."]):
        words = (text or "").split()
        want = [" ".join(words[a:b]) for a, b in plain_cuts(words, n)]
        assert got.get(i, []) == want
        assert ends[i] == " ".join(want[:1] + want[-1:] if len(want) > 1 else want)


def seconds(run) -> float:
    times = []
    for _ in range(2):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return min(times)


@pytest.mark.parametrize("stop", ["w.", "w"])
def test_pieces_take_time_by_length(spark, stop):
    """Eight times the words take about eight times as long, and not sixty-four times."""
    def of(words):
        df = spark.createDataFrame([(i, " ".join(["word and more words here " + stop] * (words // 5))) for i in range(8)], "id int, text string").cache()
        df.count()
        return seconds(lambda: chunk_text(df, "text", 100).agg(F.sum(F.length("text"))).collect())

    of(5_000)
    small, large = of(40_000), of(320_000)
    assert large < 20 * small + 1


class Pieces:
    """A tokenizer of short runs, some of them without text."""

    decoded = 0

    def encode(self, text):
        return [t for t in re.findall(r"\w{1,3}|\W", text) for t in ([t, ""] if t == "x" else [t])]

    def decode(self, tokens):
        Pieces.decoded += len(tokens)
        return "".join(tokens)


def test_pieces_of_a_tokenizer(spark):
    from fairtender.operators.chunks import cut_points, sentence_ends

    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "x", ".", " ", "\n", "c"]) for _ in range(rng.randrange(120)))
        tokenizer, n = Pieces(), rng.randrange(4, 20)
        tokens = tokenizer.encode(text)
        bounds, start, low, high = [], 0, int(0.9 * n), int(1.1 * n)
        while start < len(tokens):
            reach = [e for e in range(min(start + high, len(tokens)), start + low, -1) if tokenizer.decode(tokens[start:e]).endswith((".", "\n"))]
            stop = reach[0] if reach else min(start + n, len(tokens)) if len(tokens) > start + low else len(tokens)
            bounds.append((start, stop))
            start = stop
        assert cut_points(len(tokens), sentence_ends(tokens, tokenizer.decode), n) == bounds
    tokens = Pieces().encode("some words. " * 20_000)
    Pieces.decoded = 0
    sentence_ends(tokens, Pieces().decode)
    assert Pieces.decoded < 100


# ---- pages -------------------------------------------------------------------------------

HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.I | re.S)
ANCHOR = re.compile(r"""<a\s(?:(?:[^>"']|"[^"]*"|'[^']*')*?\s)??href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


def plain_links(html):
    return [re.sub("^[\"']|[\"']$", "", m[1]).strip(" ") for m in ANCHOR.finditer(HIDDEN.sub(" ", html))]


def test_links_of_random_pages(spark):
    rng = random.Random(6)
    parts = ["<a ", "<a\n", "<A", " href=", "HREF = ", "href", "=", "'", '"', ">", "<", "x", " y ", "u.v", "<!--", "-->", "<script>", "</script>", "</script\n>", "<style ", "</style>", "<b>", "</a>", "title="]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    got = {r.id: r.links for r in df.select("id", tx.href_links(F.col("html")).alias("links")).collect()}
    for i, p in enumerate(pages):
        assert got[i] == plain_links(p), p


@pytest.mark.parametrize(
    "page",
    [
        '<a title=' + "x" * 1_000_000 + ' href="a.xlsx">',
        "<a " + "b=c " * 250_000 + ' href="a.xlsx">',
        "<a " + "b='<' " * 150_000 + " href=a.xlsx>",
        "<!--" * 10_000 + " <a href=a.xlsx> " + "<!-- x" * 10_000,
        "<script>" * 10_000 + "</style>" + " <a href=a.xlsx> " + "<style " * 10_000,
        "<!--" + "x" * 1_000_000 + "--> <a href=a.xlsx>" + "y" * 1_000_000,
        "<a href=a.xlsx>" + "<a title=" * 10_000,
    ],
)
def test_long_and_unclosed_pages(spark, page):
    start = time.perf_counter()
    assert one(spark, page, "string", tx.href_links) == ["a.xlsx"]
    assert time.perf_counter() - start < 30


def test_missing_page(spark):
    assert one(spark, None, "string", tx.href_links) is None and one(spark, "", "string", tx.href_links) == []
