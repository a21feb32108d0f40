import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

CLASH = {c: "x" for c in ("h", "id", "pos", "name", "found", "size", "copies", "key", "label", "n", "tie", "part", "at", "gram", "source_size", "_key", "_n", "lane", "words", "row_key", "n_words")}


def sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with every awkward property, and columns whose names operators might use."""
    rng = random.Random(5)
    base = sentence(rng, 300)
    near = base.split()
    near[150] = "changed"
    texts = [
        (3, base), (1, base), (1, base), (7, " ".join(near)), (4, None), (5, ""), (6, " \t\n\x0b\f\r "), (8, "a"), (9, "A b"), (10, "a  B"),
        (None, "no id " + base[:200]), (None, None), (11, base + " " + sentence(rng, 30_000)), (12, "x" * 200_000), (13, "é 中文 🎈 " * 50), (14, sentence(rng, 40) + "\n" + base[:300]),
        (15, "one two one two " * 40), (16, "1" * 5000 + " 4111 1111 1111 1111 a@b.c"), (17, "." * 3000), (18, "\\ <s>[INST] \ufeff"),
    ]
    rows = [(d, t, "en" if (d or 0) % 3 else None, ["s", None, "r"][(d or 0) % 3], None if t is None else len(t), *CLASH.values()) for d, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
