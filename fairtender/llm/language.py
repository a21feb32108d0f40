"""Languages of texts and of spans in them.

Letters are cut into words. Script ranges narrow a word's candidate languages; hashed letter
trigrams and the hashed word give each candidate a log-probability; and a Viterbi path with a
penalty for each change of language labels the words of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtender.llm.words import lean, mix, portions, text_portions

BUCKETS = 1 << 15
#: labelled rows that a model is fitted on, at most about; drawn by a hash of the text
TRAIN_ROWS = 20_000
PENALTY, FLOOR = 6.0, -8.0
#: characters labelled at once, those cut and scored at once (at some 200 bytes each), and code points looked up at once
CHARS, PIECE, CODES = 1 << 20, 1 << 18, 1 << 14

# fixed values: first and last code point of the letters of a script
SCRIPTS = (
    (0x0041, 0x024F), (0x0370, 0x03FF), (0x0400, 0x052F), (0x0530, 0x058F), (0x0590, 0x05FF), (0x0600, 0x077F),
    (0x0900, 0x097F), (0x0980, 0x09FF), (0x0A00, 0x0A7F), (0x0A80, 0x0AFF), (0x0B00, 0x0B7F), (0x0B80, 0x0BFF),
    (0x0C00, 0x0C7F), (0x0C80, 0x0CFF), (0x0D00, 0x0D7F), (0x0D80, 0x0DFF), (0x0E00, 0x0E7F), (0x0E80, 0x0EFF),
    (0x1000, 0x109F), (0x10A0, 0x10FF), (0x1100, 0x11FF), (0x1200, 0x137F), (0x1780, 0x17FF), (0x1E00, 0x1EFF),
    (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF),
)

_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    """Per code point: ``letter`` (is it one), ``lower`` (its small letter), ``script``."""
    if not _tables:
        letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for at in range(0, 0x110000, CODES):
            chars = [chr(i) for i in range(at, at + CODES)]
            letter[at : at + CODES] = [c.isalpha() for c in chars]
            for i in np.flatnonzero(letter[at : at + CODES]):
                small = chars[i].lower()
                if len(small) == 1:
                    lower[at + i] = ord(small)
        _tables["letter"], _tables["lower"] = letter, lower
        script = np.zeros(0x110000, np.uint8)
        for k, (lo, hi) in enumerate(SCRIPTS, 1):
            script[lo : hi + 1] = k
        _tables["script"] = script
    return _tables[name]


@dataclass
class Cut:
    """Words of a list of texts: positions of their first letters and ends in the joined
    code points, hashed trigrams of all letters, hashed words, scripts, and each text's words."""

    start: np.ndarray
    end: np.ndarray
    tri: np.ndarray
    word: np.ndarray
    script: np.ndarray
    first: np.ndarray
    offset: np.ndarray

    @property
    def letters(self) -> np.ndarray:
        return self.end - self.start


def cut(texts: list) -> Cut:
    joined = " " + " ".join("" if t is None else t for t in texts) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _table("letter")[code]
    start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    script = _table("script")[code[start]]
    small = np.where(letter, _table("lower")[code], 32).astype(np.uint64)
    at = np.flatnonzero(letter)
    tri = mix((small[at - 1] << np.uint64(42)) | (small[at] << np.uint64(21)) | small[at + 1]) % np.uint64(BUCKETS)
    # a word as the sum of its letters' hashes at their places, cut at eight letters a place
    before = np.concatenate([[0], np.cumsum(letter)])
    place = (np.arange(len(at)) - np.repeat(before[start], end - start)).astype(np.uint64)
    letters = mix(small[at] * np.uint64(0x9E3779B97F4A7C15) + place)
    word = mix(np.add.reduceat(letters, before[start])) % np.uint64(BUCKETS) if len(start) else np.zeros(0, np.uint64)
    offset = 1 + np.cumsum([0, *[0 if t is None else len(t) for t in texts]]) + np.arange(len(texts) + 1)
    return Cut(start, end, tri.astype(np.int64), word.astype(np.int64), script, np.searchsorted(start, offset), offset)


@dataclass
class Model:
    """``langs``; log-probabilities of trigrams and words by language; languages by script."""

    langs: list[str]
    tri: np.ndarray
    word: np.ndarray
    fits: np.ndarray

    def scores(self, c: Cut) -> np.ndarray:
        """Log-probability of each language for each word, given its letters, from ``FLOOR`` to 0."""
        n = len(c.start)
        if not n or not self.langs:
            return np.zeros((n, len(self.langs)), np.float32)
        firsts = np.concatenate([[0], np.cumsum(c.letters)[:-1]])
        raw = np.add.reduceat(self.tri[c.tri], firsts, axis=0) + self.word[c.word]
        fits = self.fits[c.script]
        raw = np.where(fits | ~fits.any(1, keepdims=True), raw, -1e9)
        raw -= raw.max(1, keepdims=True)
        raw -= np.log(np.exp(raw).sum(1, keepdims=True))
        return np.maximum(raw, FLOOR).astype(np.float32)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Counts of trigrams, words and scripts by language over at most about ``rows`` labelled texts.

    Rows without text or language are left out. The sample takes all texts whose hash lies
    under a bound, so it does not depend on the partitioning. What comes to the driver is
    bounded by languages times ``BUCKETS``.
    """
    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    total = known.select("lang").count()
    share = min(1.0, rows / max(total, 1))
    sample = known.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in portions(frames, "text", PIECE):
            for lang, texts in pdf.groupby("lang")["text"]:
                own = sums.setdefault(lang, np.zeros(2 * BUCKETS + 256, np.int64))
                c = cut(list(texts))
                own[:BUCKETS] += np.bincount(c.tri, minlength=BUCKETS)
                own[BUCKETS : 2 * BUCKETS] += np.bincount(c.word, minlength=BUCKETS)
                own[2 * BUCKETS :] += np.bincount(c.script, minlength=256)
        for lang, own in sums.items():
            slot = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "slot": slot, "n": own[slot]})

    counts = sample.mapInPandas(lean(count), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((2 * BUCKETS + 256, len(langs)))
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        table[own["slot"], i] = own["n"]
    logs = lambda part: np.log((part + 0.5) / (part + 0.5).sum(0)).astype(np.float32)
    scripts = table[2 * BUCKETS :]
    fits = scripts >= np.maximum(1, 0.01 * scripts.sum(0))
    return Model(langs, logs(table[:BUCKETS]), logs(table[BUCKETS : 2 * BUCKETS]), fits)


def _best_gain(gain: np.ndarray) -> float:
    """The largest sum of consecutive rows in any column."""
    sums = np.cumsum(gain, axis=0)
    least = np.minimum(np.minimum.accumulate(sums, axis=0), 0)
    least = np.concatenate([np.zeros((1, gain.shape[1])), least[:-1]])
    return float((sums - least).max())


def viterbi(scores: list[np.ndarray], penalty: float = PENALTY) -> list[np.ndarray]:
    """The best labels of each sequence; a change of label costs ``penalty``.

    Where no other label gains more than half the penalty over any stretch of the best single
    label, that label alone is the best path. The other sequences go step by step, all at once.
    """
    out: list[np.ndarray] = [np.zeros(len(s), np.int16) for s in scores]
    hard = []
    for i, s in enumerate(scores):
        if len(s):
            best = int(s.sum(0, dtype=np.float64).argmax())
            out[i][:] = best
            if s.shape[1] > 1 and _best_gain(np.delete(s - s[:, best : best + 1], best, axis=1)) > penalty / 2:
                hard.append(i)
    hard.sort(key=lambda i: -len(scores[i]))
    if not hard:
        return out
    lengths = np.array([len(scores[i]) for i in hard])
    flat = np.concatenate([scores[i] for i in hard])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    changed, source = np.zeros(flat.shape, bool), np.zeros(len(flat), np.int16)
    value = flat[first].astype(np.float64)
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # sequences longer than t
    for t in range(1, lengths[0]):
        n = active[t]
        value = value[:n]
        top = value.argmax(1)
        high = value[np.arange(n), top] - penalty
        at = first[:n] + t
        worse = value < high[:, None]
        changed[at], source[at] = worse, top
        value = np.where(worse, high[:, None], value) + flat[at] - high[:, None]
        ends = np.flatnonzero(lengths[:n] == t + 1)
        if len(ends):
            source_end = value[ends].argmax(1)
            for e, label in zip(ends, source_end, strict=True):
                out[hard[e]][-1] = label
    for e in np.flatnonzero(lengths == 1):
        out[hard[e]][0] = flat[first[e]].argmax()
    for e, i in enumerate(hard):
        label, path = out[i][-1], out[i]
        lo = first[e]
        # only the places where something may change need a look
        moves = np.flatnonzero(changed[lo : lo + lengths[e]].any(1))[::-1]
        stop = lengths[e]
        for t in moves:
            if changed[lo + t, label]:
                path[t:stop] = label
                stop, label = t, source[lo + t]
        path[:stop] = label
    return out


def _groups(texts: list, chars: int) -> list[list[int]]:
    """Places of texts in groups of about ``chars`` characters."""
    groups, size = [[]], 0
    for i, t in enumerate(texts):
        if size > chars:
            groups.append([])
            size = 0
        groups[-1].append(i)
        size += 0 if t is None else len(t)
    return groups


def _scored(model: Model, texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text the scores of its words, their letters, and where they start and end in it."""
    for piece in _groups(texts, PIECE):
        c = cut([texts[i] for i in piece])
        e, letters = model.scores(c), c.letters
        for k in range(len(piece)):
            lo, hi = c.first[k], c.first[k + 1]
            yield e[lo:hi], letters[lo:hi], c.start[lo:hi] - c.offset[k], c.end[lo:hi] - c.offset[k]


def label(model: Model, texts: list, penalty: float = PENALTY) -> tuple[list[str], np.ndarray, list[list[tuple[int, int, str]]]]:
    """Per text: its language (``und`` without letters), a score, and spans (start, end, language)."""
    langs, scores, spans = [], np.zeros(len(texts)), []
    for group in _groups(texts, CHARS):
        scored = list(_scored(model, [texts[i] for i in group]))
        paths = viterbi([e for e, *_ in scored], penalty) if model.langs else []
        for k, i in enumerate(group):
            e, weight, start, end = scored[k]
            if not len(e) or not model.langs:
                langs.append("und")
                spans.append([])
                continue
            path = paths[k]
            share = np.bincount(path, weights=weight, minlength=len(model.langs))
            best = int(share.argmax())
            langs.append(model.langs[best])
            scores[i] = min(1.0, float((np.exp(e[:, best]) * weight).sum() / weight.sum()))
            turns = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(e)]])
            spans.append([(int(start[a]), int(end[b - 1]), model.langs[path[a]]) for a, b in zip(turns[:-1], turns[1:], strict=True)])
    return langs, scores, spans


def identify(docs: DataFrame, model: Model, keep: list[str | Column], text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """The columns ``keep`` and: ``lang_pred``, ``score``, ``lang_spans`` (start:end:language, comma-joined).

    A missing text, or one without letters, is ``und`` with score 0 and no spans. The score is
    the mean probability of the language over the letters of the text. Each row is judged by
    its text alone, so repeated rows get the same answer.
    """
    rows = docs.select(*keep, F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_portions(batches, "_text", CHARS):
            langs, scores, spans = label(model, b.column("_text").to_pylist(), penalty)
            own = [b.column(n) for n in b.schema.names if n != "_text"]
            names = [n for n in b.schema.names if n != "_text"]
            joined = [",".join(f"{s}:{e}:{x}" for s, e, x in some) for some in spans]
            yield pa.RecordBatch.from_arrays([*own, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(joined, pa.string())], [*names, "lang_pred", "score", "lang_spans"])

    head = rows.drop("_text").schema
    return rows.mapInArrow(lean(run), head.add("lang_pred", "string").add("score", "double").add("lang_spans", "string"))


def known_language(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is found with a score of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_portions(batches, text_col, CHARS):
            langs, scores, _ = label(model, b.column(text_col).to_pylist())
            yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
