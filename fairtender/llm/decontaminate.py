"""Test items that occur in documents, exactly or within an error budget of words.

An item of W words with a budget of e word edits is cut into e + 1 pieces. A passage within
the budget holds one piece unchanged (pigeonhole), so exact hits of pieces (Aho-Corasick over
the whole text) give the places to look at, and Myers' bit-parallel distance verifies them. An item
too short for an edit is one piece and is found wherever it stands as it is.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairtender.llm.staging import keep
from fairtender.llm.words import PORTION, lean, text_portions

#: share of an item's words that may differ
BUDGET = 0.2
#: characters of items that one pass over the documents holds in every task
BLOCK_CHARS = 8_000_000

_OTHER = re.compile(r"[\W_]+")
#: scripts that are written without spaces (Thai to Tibetan, Burmese, Khmer, kana, Han): each sign is a word
_UNSPACED = re.compile("([\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def normal(text: str | None) -> str:
    """Small letters; all but letters and digits as single spaces; a space at both ends."""
    text = (text or "").lower()
    if not text.isascii():
        text = _UNSPACED.sub(r" \1 ", text)
    return " " + _OTHER.sub(" ", text).strip() + " "


def budget(words: int, share: float = BUDGET) -> int:
    """Edits allowed to an item: a share of its words, rounded down."""
    return int(words * share + 1e-9)


def _states(pattern: dict[str, int], m: int, words: list[str]) -> Iterator[int]:
    """After each word of the text, the least distance of the pattern to a passage ending there."""
    mask, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = mask, 0, m
    for w in words:
        eq = pattern.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (~(xh | up) & mask), up & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        up, down = mh | (~(xv | ph) & mask), ph & xv
        yield score


def best_passage(item: list[str], words: list[str]) -> tuple[int, int, int]:
    """Least word edits between ``item`` and a passage of ``words``, and the passage's bounds."""
    pattern: dict[str, int] = {}
    for i, w in enumerate(item):
        pattern[w] = pattern.get(w, 0) | 1 << i
    least, end = len(item), 0
    for j, score in enumerate(_states(pattern, len(item), words), 1):
        if score < least:
            least, end = score, j
    turned = {w: int(format(bits, f"0{len(item)}b")[::-1], 2) for w, bits in pattern.items()}
    start = end
    for j, score in enumerate(_states(turned, len(item), words[:end][::-1]), 1):
        if score == least:
            start = end - j
            break
    return least, start, end


@dataclass
class Matcher:
    """Items as (id, words) with the automaton of their pieces."""

    items: list[tuple[int, list[str]]]
    share: float = BUDGET
    automaton: object = None

    def build(self) -> Matcher:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for k, (_, words) in enumerate(self.items):
            pieces = budget(len(words), self.share) + 1
            cuts = [len(words) * p // pieces for p in range(pieces + 1)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                text = " " + " ".join(words[a:b]) + " "
                auto.add_word(text, (*auto.get(text, ()), (k, a, len(text))))
        if len(auto):
            auto.make_automaton()
            self.automaton = auto
        return self

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """Of each item within its budget: id, distance, budget, and the words' bounds in the
        normalized text. Of several passages the nearest, then the first, is given."""
        if self.automaton is None or not text:
            return []
        plain = normal(text)
        places: dict[int, set[int]] = {}
        spaces: list[int] = []
        for last, hits in self.automaton.iter(plain):
            if not spaces:
                spaces = [i for i, c in enumerate(plain) if c == " "]
            for k, a, size in hits:
                places.setdefault(k, set()).add(bisect_right(spaces, last - size + 1) - 1 - a)
        out = []
        words = plain.split() if places else []
        for k, starts in places.items():
            item_id, item = self.items[k]
            e = budget(len(item), self.share)
            best = None
            for at in sorted(starts):
                lo = max(0, at - e)
                d, s, t = best_passage(item, words[lo : at + len(item) + e])
                if d <= e and (best is None or d < best[0]):
                    best = (d, lo + s, lo + t)
                if d == 0:
                    break
            if best:
                out.append((item_id, best[0], e, best[1], best[2]))
        return sorted(out)

    def hit(self, text: str | None) -> bool:
        return bool(self.matches(text))


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", chars: int = BLOCK_CHARS, **limits) -> tuple[int, Iterator[Matcher]]:
    """How many blocks of about ``chars`` characters the items make, and a matcher for each.

    The items are the query set: every block goes over all documents. The driver holds one
    block at a time. Items without words match nothing.
    """
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).filter("text is not null").distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // chars)

    def matchers() -> Iterator[Matcher]:
        for k in range(blocks):
            own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
            words = [(r.item_id, normal(r.text).split()) for r in own]
            yield Matcher(sorted(((i, w) for i, w in words if w), key=lambda x: (x[0] is None, x[0] or 0, x[1])), **limits)

    return blocks, matchers()


_FOUND = "doc_id long, item_id long, distance int, budget int, first_word int, end_word int"


def _found(rows: DataFrame, matcher: Matcher) -> DataFrame:
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher.build()
        for pdf in frames:
            found = [(d, *m) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for m in matcher.matches(t if isinstance(t, str) else None)]
            frame = pd.DataFrame(found, columns=["doc_id", "item_id", "distance", "budget", "first_word", "end_word"])
            yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

    return rows.mapInPandas(search, _FOUND)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, distance, budget, first_word, end_word.

    Words are counted in the normalized text, the end exclusive; a sign of a script without spaces is a
    word. Documents without text hold nothing. Every row is searched by itself: repeated rows
    give repeated results. Nothing is shuffled. With several blocks of items the rows found for each
    are written before the next one is fetched.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks, matchers = item_blocks(items, **options)
    out = docs.sparkSession.createDataFrame([], _FOUND)
    for matcher in matchers:
        found = _found(rows, matcher)
        out = out.unionByName(found if blocks == 1 else keep(found, "leaks"))
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item within its budget."""
    blocks, matchers = item_blocks(items, **options)
    if not blocks:
        return docs
    if blocks == 1:
        matcher = next(matchers)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher.build()
            for b in text_portions(batches, text_col, PORTION):
                yield b.filter(pa.array([not matcher.hit(t) for t in b.column(text_col).to_pylist()], pa.bool_()))

        return docs.mapInArrow(lean(search), docs.schema)
    # numbered in a written table, so that a row keeps its number
    rows = keep(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("doc_id")), "numbered")
    hits = None
    for matcher in matchers:
        own = keep(_found(rows.select("doc_id", "text"), matcher).select("doc_id").distinct(), "leaks")
        hits = own if hits is None else hits.unionByName(own)
    return rows.join(hits, "doc_id", "left_anti").select("doc.*")
