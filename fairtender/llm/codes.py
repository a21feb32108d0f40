"""Short codes for vectors: each part is named by the nearest entry of a learnt codebook.

The nearest entry is found with sliced bit masks. Per coordinate a codebook's entries are
sorted; the mask of the first k of them (a bit per entry) is kept for each k. A radius within
which the nearest entry must lie cuts a range out of each coordinate; the masks before and
after the range leave the entries inside it, and the AND over the coordinates leaves the
candidates, among which the nearest is found exactly. The radius is the distance to a
neighbour along some coordinate; it shrinks while the candidates' distances are summed.

Learning takes a pass over the vectors per round. Each task sums its rows per entry, Spark
adds the sums, and only codebooks (entries times width) come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairtender.llm.staging import keep
from fairtender.llm.vectors import blocks, steps, usable

ENTRIES, PARTS, ROUNDS = 256, 4, 4
#: rows per block, coordinates summed between two looks at the radius
ROWS, LOOK = 1024, 4
#: numbers up to this size have squared distances that fit into 64 bits
SMALL = 1 << 24


class Codebook:
    """Entries of one part position (rows by coordinates) with their masks per coordinate."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, width = entries.shape
        words = -(-n // 64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        self.order = order
        bit = np.zeros((n, words), np.uint64)
        bit[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        self.first = np.zeros((width, n + 1, words), np.uint64)
        for c in range(width):
            self.first[c, 1:] = np.bitwise_or.accumulate(bit[order[:, c]], axis=0)
        # the coordinates along which entries differ most tell most and go first
        self.telling = np.argsort(-np.ptp(entries.astype(float), axis=0), kind="stable")

    def _distance(self, parts: np.ndarray, rows: np.ndarray, picked: np.ndarray) -> np.ndarray:
        off = parts[rows] - self.entries[picked]
        return (off * off).sum(axis=1)

    def radius(self, parts: np.ndarray) -> np.ndarray:
        """Squared distance to the nearest of each row's neighbours along single coordinates."""
        n, rows = len(self.entries), np.arange(len(parts))
        least = None
        for c in self.telling:
            at = np.clip(np.searchsorted(self.sorted[:, c], parts[:, c]), 0, n - 1)
            found = self._distance(parts, rows, self.order[at, c])
            least = found if least is None else np.minimum(least, found)
        return least

    def candidates(self, parts: np.ndarray, squared: np.ndarray) -> np.ndarray:
        """Masks of the entries that lie within the radius in every coordinate."""
        reach = np.ceil(np.sqrt(squared.astype(float))).astype(np.int64) + 1
        if parts.dtype == object:
            reach = np.array([_root(int(s)) for s in squared], object)
        left = None
        for c in range(parts.shape[1]):
            lo = np.searchsorted(self.sorted[:, c], parts[:, c] - reach, "left")
            hi = np.searchsorted(self.sorted[:, c], parts[:, c] + reach, "right")
            inside = self.first[c, hi] ^ self.first[c, lo]
            left = inside if left is None else left & inside
        return left

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lower one of two as near) and its squared distance."""
        squared = self.radius(parts)
        masks = self.candidates(parts, squared)
        rows, picked = np.nonzero(np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little"))
        distance = np.zeros(len(rows), parts.dtype)
        across, entries = np.ascontiguousarray(parts.T), np.ascontiguousarray(self.entries.T)
        for at in range(0, parts.shape[1], LOOK):
            for c in self.telling[at : at + LOOK]:
                off = across[c].take(rows) - entries[c].take(picked)
                distance += off * off
            if at == 0:  # the entry that is nearest so far is near, so its distance is a smaller radius
                starts = np.flatnonzero(np.diff(rows, prepend=-1))
                least = np.repeat(np.minimum.reduceat(distance, starts), np.diff(starts, append=len(rows)))
                some = np.flatnonzero(distance == least)
                some = some[np.flatnonzero(np.diff(rows[some], prepend=-1))]
                squared = np.minimum(squared, self._distance(parts, rows[some], picked[some]))
            near = distance <= squared[rows]
            rows, picked, distance = rows[near], picked[near], distance[near]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))  # each row has its radius' entry at least
        least = np.minimum.reduceat(distance, starts)
        tied = distance == np.repeat(least, np.diff(starts, append=len(rows)))
        rows, picked = rows[tied], picked[tied]
        return picked[np.flatnonzero(np.diff(rows, prepend=-1))], least


def _root(value: int) -> int:
    """The square root, rounded up."""
    import math

    root = math.isqrt(value)
    return root + (root * root < value)


def _parts(column: pa.Array, width: int, parts: int, books: list[Codebook] | None = None) -> list[np.ndarray]:
    """Whole numbers of the vectors, cut into parts and filled up with zeros at the end."""
    numbers = steps(column, width)
    if len(numbers) and max(abs(int(numbers.max())), abs(int(numbers.min()))) >= SMALL or books and any(b.entries.dtype == object for b in books):
        numbers = numbers.astype(object)
    each = -(-width // parts)
    full = np.zeros((len(numbers), parts * each), numbers.dtype)
    full[:, :width] = numbers
    return [full[:, p * each : (p + 1) * each] for p in range(parts)]


def _assigned(column: pa.Array, width: int, books: list[Codebook]):
    return [(own, *book.nearest(own)) for own, book in zip(_parts(column, width, len(books), books), books, strict=True)]


def _sums(width: int, books: list[Codebook]):
    """Per part and entry the rows of a task and the sums of their coordinates."""
    each = books[0].entries.shape[1]
    number = pa.decimal128(38, 0)
    names = [f"s{c}" for c in range(each)]
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("rows", pa.int64()), *[(c, number) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.zeros(len(b.entries), np.int64) for b in books]
        sums = [np.zeros(b.entries.shape, object) for b in books]
        for batch in blocks(batches, ROWS):
            for p, (own, entry, _) in enumerate(_assigned(batch.column(0), width, books)):
                rows[p] += np.bincount(entry, minlength=len(rows[p]))
                order = np.argsort(entry, kind="stable")
                starts = np.flatnonzero(np.diff(entry[order], prepend=-1))
                sums[p][entry[order][starts]] += np.add.reduceat(own[order], starts, axis=0)
        for p in range(len(books)):
            some = np.flatnonzero(rows[p])
            if len(some):
                told = [pa.array([Decimal(int(v)) for v in sums[p][some, c]], number) for c in range(each)]
                yield pa.record_batch([pa.array(np.full(len(some), p, np.int32)), pa.array(some.astype(np.int32)), pa.array(rows[p][some]), *told], schema=schema)

    return run, "part int, entry int, rows bigint, " + ", ".join(f"{c} decimal(38,0)" for c in names), names


def _book(entries: np.ndarray) -> Codebook:
    small = not entries.size or max(abs(int(entries.max())), abs(int(entries.min()))) < SMALL
    return Codebook(entries.astype(np.int64 if small else object))


def learn(df: DataFrame, width: int, vec_col: str = "embedding", id_col: str = "vec_id", entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> list[Codebook]:
    """Codebooks of the part positions of usable vectors.

    They start as the parts of the ``entries`` rows of the smallest ids (missing ids last, rows
    of one id by their vectors). Each round assigns all parts and moves every entry to the
    mean of its parts, rounded down; an entry without parts stays.
    """
    vector = F.col(f"`{vec_col}`")
    rows = df.orderBy(F.col(f"`{id_col}`").asc_nulls_last(), vector).limit(entries).select(vector.alias("v"))
    if not width:
        return []
    first = _parts(rows.toArrow().column("v").combine_chunks(), width, parts)
    books = [_book(own) for own in first]
    for _ in range(rounds):
        run, schema, names = _sums(width, books)
        added = df.select(vector).mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in names])
        moved = [b.entries.astype(object) for b in books]
        for r in added.collect():  # parts times entries rows
            moved[r.part][r.entry] = [int(r[c]) // r.rows for c in names]
        books = [_book(m) for m in moved]
    return books


def _codes(width: int, books: list[Codebook], schema: pa.Schema):
    digits = len(f"{max(len(b.entries) for b in books) - 1:02x}")
    names = np.array([f"{i:0{digits}x}" for i in range(max(len(b.entries) for b in books))], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, ROWS):
            found = _assigned(batch.column(0), width, books)
            code = sum([names[entry] for _, entry, _ in found[1:]], names[found[0][1]])
            error = sum(d.astype(object) for _, _, d in found)
            yield pa.record_batch([*batch.columns[1:], pa.array(code, pa.string()), pa.array([Decimal(int(e)) if e < 10**38 else None for e in error], pa.decimal128(38, 0))], schema=schema)

    return run


def encode(df: DataFrame, books: list[Codebook], width: int, vec_col: str = "embedding", others: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """``code`` (an entry's number per part in hex) and ``error`` (squared distance to the
    entries, exact; null beyond 38 digits) of usable vectors, with the columns ``others``."""
    picked = df.select(F.col(f"`{vec_col}`").alias("_vector"), *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(others)])
    kinds = picked.drop("_vector")
    fields = [*kinds.limit(0).toArrow().schema, pa.field("_code", pa.string()), pa.field("_error", pa.decimal128(38, 0))]
    sql = ", ".join([*[f"{n} {k}" for n, k in kinds.dtypes], "_code string", "_error decimal(38,0)"])
    found = picked.mapInArrow(_codes(width, books, pa.schema(fields)), sql)
    return found.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(others)], F.col("_code").alias("code"), F.col("_error").alias("error"))


def digest(books: list[Codebook]) -> str:
    """A checksum of all entries' coordinates by part, entry and place."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for row in b.entries for v in row).encode()).hexdigest()


def compress(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label", **sizes: int) -> DataFrame:
    """Codes of all usable vectors by codebooks learnt from all of them.

    Returns the id, ``code``, ``error``, ``label_error`` (the errors of all rows of the label;
    rows without label are one group) and ``codebooks_sha256``. Vectors are left out by the rules of
    ``usable``. Rows of one id and equal rows are each coded by themselves; a missing id stays
    missing. A width that the number of parts does not divide is filled up with zeros, which
    changes no distance. With fewer rows than entries each row is an entry. Equal distances
    go to the lower entry. Other columns do not come back. An empty table gives no rows.
    """
    rows, width = usable(df.select(F.col(f"`{id_col}`"), F.col(f"`{vec_col}`"), F.col(f"`{label_col}`")), vec_col)
    books = learn(rows, width, vec_col, id_col, **sizes)
    if not books:
        of = dict(df.dtypes)
        shape = f"`{id_col}` {of[id_col]}, code string, error decimal(38,0), label_error decimal(38,0), codebooks_sha256 string"
        return df.sparkSession.createDataFrame([], shape)
    coded = keep(encode(rows, books, width, vec_col, (id_col, label_col)), "codes")
    sums = coded.groupBy(F.col(f"`{label_col}`").alias("_label")).agg(F.sum("error").alias("label_error"))
    both = coded.join(sums, F.col(f"`{label_col}`").eqNullSafe(F.col("_label")))
    return both.select(F.col(f"`{id_col}`"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
