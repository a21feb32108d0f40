"""Whitening of embeddings from exact cross products of bit planes.

Entries become whole numbers. In each block of rows a dimension's numbers, less the least of
them, are written as bit planes: one bit per row, 64 rows to a word. The cross product of two
dimensions is the sum over pairs of planes of the bits both have set, weighted by the planes'
values, so it is counted and not rounded. Blocks are summed by Spark, one row per pair of
dimensions and task. The sums are centred as whole numbers, and only then does the driver
take the eigenvectors of the matrix, whose size is that of a vector squared whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtender.llm.staging import keep
from fairtender.llm.vectors import blocks, steps, usable

#: rows per block of bit planes, and dimensions compared with each other at a time
ROWS, DIMS = 8192, 64
#: added to each entry's whole number
SHIFT = 100_000
#: whole numbers up to this size have cross products of a block that fit into 64 bits
SMALL = 1 << 22
#: eigenvalues below this part of their sum count as none; along them there is nothing to whiten
NONE = 1e-12
_LOW = (1 << 32) - 1


@dataclass(frozen=True)
class Whitening:
    """Rows, sums per dimension (exact), and the leading components with their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def _shifted(column: pa.Array, width: int) -> np.ndarray:
    return steps(column, width) + SHIFT


def bit_planes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes (words of 64 rows) of the columns of ``numbers`` (rows by dimensions, uint64),
    with the dimension and the bit of each; planes without any bit are left out."""
    rows, dims = numbers.shape
    top = max(1, int(numbers.max(initial=0)).bit_length())
    across = np.ascontiguousarray(numbers.T)
    packed = np.zeros((dims, top, -(-rows // 64) * 8), np.uint8)
    for b in range(top):
        bits = ((across >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        packed[:, b, : -(-rows // 8)] = np.packbits(bits, axis=1)
    words = packed.view(np.uint64).reshape(dims * top, -1)
    some = words.any(axis=1)
    return words[some], np.repeat(np.arange(dims), top)[some], np.tile(np.arange(top), dims)[some]


def _counted(a: tuple, b: tuple, dims: tuple[int, int], kind: type) -> np.ndarray:
    """Cross products of two groups of dimensions from their planes."""
    out = np.zeros(dims, kind)
    (wa, da, ba), (wb, db, bb) = a, b
    if not len(wa) or not len(wb):
        return out
    starts, own = np.flatnonzero(np.diff(db, prepend=-1)), db[np.flatnonzero(np.diff(db, prepend=-1))]
    weight = np.array([1 << int(x) for x in bb], kind)
    for plane, dim, bit in zip(wa, da, ba, strict=True):
        both = np.bitwise_count(plane & wb).sum(axis=1, dtype=np.int64).astype(kind)
        out[dim, own] += np.add.reduceat(both * weight, starts) * (1 << int(bit))
    return out


def cross_products(numbers: np.ndarray) -> np.ndarray:
    """Exact sums over the rows of products of each two columns, from bit planes."""
    rows, dims = numbers.shape
    least = numbers.min(axis=0)
    rest = numbers.astype(np.uint64) - least.astype(np.uint64)  # modulo 2**64, so always right
    kind = np.int64 if max(int(rest.max()), abs(int(numbers.max())), abs(int(least.min()))) < SMALL else object
    groups = [range(at, min(at + DIMS, dims)) for at in range(0, dims, DIMS)]
    planes = [bit_planes(rest[:, g.start : g.stop]) for g in groups]
    out = np.zeros((dims, dims), kind)
    for i, g in enumerate(groups):
        for h, other in zip(groups[i:], planes[i:], strict=True):
            part = _counted(planes[i], other, (len(g), len(h)), kind)
            out[g.start : g.stop, h.start : h.stop] = part
            out[h.start : h.stop, g.start : g.stop] = part.T
    low, total = least.astype(kind), _sums(rest, kind)
    lean = np.multiply.outer(low, total)
    return out + lean + lean.T + rows * np.multiply.outer(low, low)


def _sums(numbers: np.ndarray, kind: type) -> np.ndarray:
    return numbers.astype(kind).sum(axis=0) if len(numbers) else np.zeros(numbers.shape[1], kind)


_PARTIAL = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("high", pa.decimal128(38, 0)), ("low", pa.int64())])


def _halves(values: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Whole numbers as multiples of 2**32 and rests, whose sums fit where theirs might not."""
    high, low = values >> 32, (values & _LOW).astype(np.int64)
    if values.dtype == object:
        return pa.array([Decimal(int(h)) for h in high], pa.decimal128(38, 0)), pa.array(low)
    return pa.array(high).cast(pa.decimal128(38, 0)), pa.array(low)


def _scatter(width: int):
    """Sums of products of dimensions ``i <= j``; ``j = -1``: sums; ``i = -1``: rows."""
    rows_i, rows_j = np.triu_indices(width)
    i = np.concatenate([rows_i, np.arange(width), [-1]]).astype(np.int32)
    j = np.concatenate([rows_j, np.full(width, -1), [-1]]).astype(np.int32)

    def told(both: np.ndarray, sums: np.ndarray, n: int) -> pa.RecordBatch:
        values = np.concatenate([both[rows_i, rows_j], sums, np.array([n], both.dtype)])
        high, low = _halves(values)
        return pa.record_batch([pa.array(i), pa.array(j), high, low], schema=_PARTIAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, sums, n, bound = None, None, 0, 0
        for part in blocks(batches, ROWS):
            numbers = _shifted(part.column(0), width)
            cross = cross_products(numbers)
            size = part.num_rows * int(np.abs(numbers.astype(object)).max() if cross.dtype == object else np.abs(numbers).max()) ** 2
            if both is not None and (both.dtype != cross.dtype or bound + size >= 1 << 62):
                yield told(both, sums, n)
                both = None
            if both is None:
                both, sums, n, bound = cross, _sums(numbers, cross.dtype.type), part.num_rows, size
            else:
                both, sums, n, bound = both + cross, sums + _sums(numbers, cross.dtype.type), n + part.num_rows, bound + size
        if both is not None:
            yield told(both, sums, n)

    return run


def scatter(df: DataFrame, vec_col: str, width: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums and cross products of the dimensions of usable vectors, as whole numbers."""
    parts = df.select(F.col(f"`{vec_col}`")).mapInArrow(_scatter(width), "i int, j int, high decimal(38,0), low bigint")
    summed = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    n, sums, both = 0, [0] * width, [[0] * width for _ in range(width)]
    for r in summed.collect():  # width squared rows
        value = (int(r.high) << 32) + r.low
        if r.i < 0:
            n = value
        elif r.j < 0:
            sums[r.i] = value
        else:
            both[r.i][r.j] = both[r.j][r.i] = value
    return n, sums, both


def fit(df: DataFrame, vec_col: str, width: int, top: int = 8) -> Whitening:
    """The ``top`` leading components of usable vectors (as many as there are dimensions)."""
    n, sums, both = scatter(df, vec_col, width)
    if not n:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0)
    centred = np.array([[(n * both[i][j] - sums[i] * sums[j]) / (n * n) for j in range(width)] for i in range(width)])
    values, vectors = np.linalg.eigh(centred)
    order = np.argsort(-values, kind="stable")[:top]
    return Whitening(n, tuple(sums), vectors[:, order].T.copy(), values[order], float(np.trace(centred)))


def _deviations(rest: np.ndarray, remainder: list[int], n: int) -> list[Decimal | None]:
    """Exact sums of squares of ``n * rest - remainder`` per row; None beyond 38 digits."""
    most = n * (abs(int(rest.max(initial=0))) + abs(int(rest.min(initial=0))) + 1)
    kind = np.int64 if rest.shape[1] * most**2 < 1 << 62 else object
    off = rest.astype(kind) * n - np.array(remainder, kind)
    return [Decimal(int(v)) if v < 10**38 else None for v in (off * off).sum(axis=1)]


def _projected(model: Whitening, names: list[str], schema: pa.Schema):
    width = len(model.sums)
    whole = np.array([s // model.n for s in model.sums], object)
    remainder = [s % model.n for s in model.sums]
    fraction = np.array([r / model.n for r in remainder])
    real = model.eigenvalues > NONE * model.trace
    scaled = np.where(real[:, None], model.components, 0.0) / np.sqrt(np.where(real, model.eigenvalues, 1.0))[:, None]
    base = whole.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, ROWS):
            rest = _shifted(part.column(0), width) - base
            values = (rest - fraction) @ scaled.T
            lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(scaled)).cast(pa.list_(pa.float64()))
            told = pa.array(_deviations(rest, remainder, model.n), pa.decimal128(38, 0))
            yield pa.record_batch([*[part.column(c) for c in names], told, lists], schema=schema)

    return run


def project(df: DataFrame, model: Whitening, vec_col: str, id_col: str) -> DataFrame:
    """Per usable vector its id, ``deviation`` (of the rows' number times the vector from the
    sums, squared and summed, exact; null beyond 38 digits) and ``whitened``, an array."""
    ids = df.select(F.col(f"`{id_col}`")).schema[0]
    picked = df.select(F.col(f"`{vec_col}`").alias("_vector"), F.col(f"`{id_col}`").alias("_row"))
    names = picked.select("_row").limit(0).toArrow().schema.field("_row").type
    schema = pa.schema([("_row", names), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])
    sql = f"_row {ids.dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"
    return picked.mapInArrow(_projected(model, ["_row"], schema), sql).withColumnRenamed("_row", id_col)


def identity_error(projected: DataFrame, model: Whitening) -> float:
    """The largest entry by which the covariance of the whitened rows differs from the identity."""
    real = [k for k in range(len(model.eigenvalues)) if model.eigenvalues[k] > NONE * model.trace]
    w = lambda k: F.element_at("whitened", k + 1)
    pairs = [(a, b) for a in real for b in real if a <= b]
    if not pairs:
        return 0.0
    means = projected.agg(*[F.avg(w(a)).alias(f"m{a}") for a in real]).first()
    off = lambda a: w(a) - F.lit(means[f"m{a}"])
    spread = projected.agg(*[F.avg(off(a) * off(b)).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(spread[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", top: int = 8) -> DataFrame:
    """Whitened coordinates of vectors along their leading components, a row per component.

    Returns the id, ``component`` (from 1, by falling eigenvalue), ``n`` (vectors fitted),
    ``deviation``, ``whitened``, ``explained`` (part of the whole variance) and
    ``identity_error``. Vectors are left out by the rules of ``usable``; every other row comes
    back, also those of one id or equal vectors, each by itself, and a missing id stays missing.
    Where the rows do not vary along a component (fewer rows than dimensions, equal rows)
    ``whitened`` is null and ``identity_error`` passes it over; ``explained`` is null if
    nothing varies at all. Vectors of fewer than ``top`` entries have as many components.
    Other columns do not come back. An empty table gives no rows.
    """
    usable_rows, width = usable(df.select(F.col(f"`{id_col}`"), F.col(f"`{vec_col}`")), vec_col)
    model = fit(usable_rows, vec_col, width, top)
    if not model.n:
        shape = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
        kind = df.select(F.col(f"`{id_col}`")).dtypes[0][1]
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, {shape}")
    rows = keep(project(usable_rows, model, vec_col, id_col), "whitened")
    error = identity_error(rows, model)
    real = model.eigenvalues > NONE * model.trace
    told: Column = F.array(*[F.lit(float(e / model.trace)) if model.trace else F.lit(None).cast("double") for e in model.eigenvalues])
    known = F.array(*[F.lit(bool(r)) for r in real])
    each = rows.select(F.col(f"`{id_col}`"), "deviation", F.posexplode("whitened").alias("_at", "_value"))
    return each.select(
        F.col(f"`{id_col}`"),
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        F.when(known[F.col("_at")], F.col("_value")).alias("whitened"),
        told[F.col("_at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
