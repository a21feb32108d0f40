"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return. The same word has the same hash in every task and every run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of words hashed at once, and of texts taken at once: a worker needs some 30 times as many, and keeps them
BLOCK, PORTION = 1 << 18, 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + (1 << 16))
        up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if n <= BLOCK + (1 << 16):  # those of one very long word are not kept
            _powers[0] = have
    return have


@dataclass
class Words:
    """Words of a list of texts: text ``d`` has the words ``first[d]`` to ``first[d + 1]``."""

    raw: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``k`` words and, for each, whether it lies in one text."""
        n = max(0, len(self.hash) - k + 1)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * _STEP + self.hash[j : j + n]
        text = np.repeat(np.arange(len(self.first) - 1), self.counts())[:n]
        return mix(out), np.arange(n) + k <= self.first[1:][text]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes that end with a space."""
    space = IS_SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    return np.flatnonzero(~space & before), np.flatnonzero(space & ~before)


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of runs of bytes that follow one another."""
    hashes = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # blocks of whole words, so that the tables stay small
        to = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK, "right")))
        lo, hi = start[at], end[to - 1]
        up, down = _power_tables(hi - lo)
        part = data[lo:hi]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[part] if lower else part] * up[: hi - lo], out=sums[1:])
        s, e = start[at:to] - lo, end[at:to] - lo
        hashes[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return hashes


def scan(texts: list, lower: bool = False) -> Words:
    """Words of texts (None: no words); ``lower`` takes A-Z as a-z."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b" ".join(raw) + b" "
    data = np.frombuffer(joined, np.uint8)
    start, end = word_bounds(data)
    hashes = run_hashes(data, start, end, lower)
    begins = np.cumsum([0, *[len(r) + 1 for r in raw]])
    return Words(joined, start, end, hashes, np.searchsorted(start, begins))


def give_back() -> None:
    """Return the memory that this process has freed to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, after which its Python worker, which waits for other tasks, holds no freed memory."""

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def text_or_none(value) -> str | None:
    return value if isinstance(value, str) else None


def portions(frames: Iterator[pd.DataFrame], text: str, chars: int = PORTION) -> Iterator[pd.DataFrame]:
    """Rows of an Arrow batch in portions of about ``chars`` characters, so that memory does
    not follow the length of a batch."""
    for pdf in frames:
        sizes = np.array([len(t) if isinstance(t, str) else 0 for t in pdf[text]]).cumsum()
        group = sizes // chars
        for g in np.unique(group) if len(pdf) else []:
            yield pdf[group == g]


def text_portions(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of record batches in portions of about ``size`` bytes of text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(lengths) // size)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                yield batch.slice(a, b - a)
