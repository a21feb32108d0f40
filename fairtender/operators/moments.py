"""Weighted cross products for least squares, summed over the rows by many tasks.

A task turns its rows into one small matrix per model and replicate (BLAS on Arrow
batches); the matrices are added up in Spark. Rows never multiply by the number of
replicates, and what is shuffled does not grow with the rows, except for the rows
themselves, once, if a factor is absorbed.

The long result is (model, rep, part, kind, i, j, s, x) with ``i <= j`` numbering the
columns constant, terms, outcome:

====  ==================================================================================
kind  content
====  ==================================================================================
0     s: sum of w * v_i * v_j; x: what the absorbed factors explain of it
1     s: sum of w * v_i over a level ``part`` that was split over tasks
2     the same for the first level, which gives the constant
3     s: number of other levels
4     s: effect of the first levels on column i, where these were solved for
====  ==================================================================================
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairtender.functions.draws import replicate_weights
from fairtender.operators.skew import HOT_ROWS, same_key

LONG = "model string, rep int, part string, kind int, i int, j int, s double, x double"
KEYS = ["model", "rep", "part", "kind", "i", "j"]
ORDINARY, HOT, FIRST = 0, 1, 2
# a level with a smaller part of the rows is no burden to one task
LARGE_PART = 10_000
# doubles of weights worked on at once, so that they stay in the cache, and of products of columns
WORK, PRODUCTS = 200_000, 4_000_000


def _long(
    model: str, kind: int, cube: np.ndarray, part: str | None = None, pairs=None, explained: np.ndarray | None = None
) -> pd.DataFrame:
    """Rows of a (replicate, cell) array."""
    reps, cells = cube.shape
    i, j = pairs if pairs is not None else (np.arange(cells), np.full(cells, -1))
    return pd.DataFrame(
        {
            "model": model,
            "rep": np.repeat(np.arange(reps, dtype="int32"), cells),
            "part": part,
            "kind": np.int32(kind),
            "i": np.tile(i.astype("int32"), reps),
            "j": np.tile(j.astype("int32"), reps),
            "s": cube.ravel(),
            "x": np.zeros(cube.size) if explained is None else explained.ravel(),
        }
    )


def rows_at_once(width: int, reps: int) -> int:
    """So few that neither their weights nor the products of their columns take much memory."""
    return max(64, min(WORK // (reps + 1), PRODUCTS // (width * (width + 1) // 2)))


class _Sums:
    """Running sums of one model in one task."""

    def __init__(self, model: str, width: int, reps: int, absorb: bool):
        self.model, self.width, self.reps, self.absorb = model, width, reps, absorb
        self.upper = np.triu_indices(width)
        self.raw = np.zeros((reps + 1, len(self.upper[0])))
        self.explained = np.zeros((reps + 1, width, width))
        self.levels = 0
        self.level, self.role, self.open = None, ORDINARY, None
        self.parts: list[pd.DataFrame] = []

    def add(self, values: np.ndarray, hashes: np.ndarray, levels: np.ndarray | None, roles: np.ndarray | None) -> None:
        weights = replicate_weights(hashes, 0, self.reps)
        self.raw += weights.T @ (values[:, self.upper[0]] * values[:, self.upper[1]])
        if not self.absorb:
            return
        starts = np.flatnonzero(np.r_[True, levels[1:] != levels[:-1]])
        sums = np.stack([np.add.reduceat(weights * values[:, [c]], starts, axis=0) for c in range(self.width)], axis=2)
        if self.open is not None and levels[0] == self.level:
            sums[0] += self.open
        elif self.open is not None:
            self._close(self.open[None], np.array([self.role]), np.array([self.level], dtype=object))
        self._close(sums[:-1], roles[starts[:-1]], levels[starts[:-1]])
        self.open, self.level, self.role = sums[-1], levels[starts[-1]], roles[starts[-1]]

    def _close(self, sums: np.ndarray, roles: np.ndarray, levels: np.ndarray) -> None:
        """Levels that are complete in this task are projected out; the others are passed on as sums."""
        whole = sums[roles == ORDINARY]
        if len(whole):
            scaled = whole / np.sqrt(whole[:, :, :1])
            self.explained += np.matmul(scaled.transpose(1, 2, 0), scaled.transpose(1, 0, 2))
            self.levels += len(whole)
        for k in np.flatnonzero(roles != ORDINARY):
            self.parts.append(_long(self.model, FIRST if roles[k] == FIRST else HOT, sums[k], str(levels[k])))

    def rows(self) -> Iterator[pd.DataFrame]:
        if self.open is not None:
            self._close(self.open[None], np.array([self.role]), np.array([self.level], dtype=object))
        yield _long(self.model, 0, self.raw, None, self.upper, self.explained[:, self.upper[0], self.upper[1]])
        if self.absorb:
            yield _long(self.model, 3, np.full((self.reps + 1, 1), float(self.levels)))
        yield from self.parts


def matrix(batch: pa.RecordBatch, width: int, name: str = "v") -> np.ndarray:
    """The arrays of a batch as rows of one matrix, without copying row by row."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def texts(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def arrow_rows(rows: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(rows, schema, preserve_index=False)


def _accumulate(width: int, reps: int, absorb: bool):
    chunk = rows_at_once(width, reps)
    schema = pa.schema(
        [("model", pa.string()), ("rep", pa.int32()), ("part", pa.string()), ("kind", pa.int32())]
        + [("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64()), ("x", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Sums | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            models, values = texts(batch, "model"), matrix(batch, width)
            hashes = batch.column("hash").to_numpy()
            levels = texts(batch, "level") if absorb else None
            roles = batch.column("role").to_numpy() if absorb else None
            cuts = np.flatnonzero(np.r_[True, models[1:] != models[:-1]])
            for a, b in zip(cuts, [*cuts[1:], len(models)]):
                if current is None or current.model != models[a]:
                    if current is not None:
                        yield from (arrow_rows(r, schema) for r in current.rows())
                    current = _Sums(models[a], width, reps, absorb)
                for at in range(a, b, chunk):
                    to = min(b, at + chunk)
                    current.add(
                        values[at:to], hashes[at:to], levels[at:to] if absorb else None, roles[at:to] if absorb else None
                    )
        if current is not None:
            yield from (arrow_rows(r, schema) for r in current.rows())

    return run


def add_up(long: DataFrame) -> DataFrame:
    return long.groupBy(*KEYS).agg(F.sum("s").alias("s"), F.sum("x").alias("x"))


def cross_products(design: DataFrame, width: int, reps: int, absorb: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Sums for ``design`` (model, hash, array ``v``, and ``level`` if a factor is absorbed)."""
    if not absorb:
        # replicates cost far more than moving a row once, so their work is dealt out evenly
        dealt = design.repartition("hash") if reps else design
        ordered = dealt.sortWithinPartitions("model")
        return add_up(ordered.mapInArrow(_accumulate(width, reps, False), LONG))

    return add_up(place_by_level(design, hot_rows).mapInArrow(_accumulate(width, reps, True), LONG))


def place_by_level(design: DataFrame, hot_rows: int) -> DataFrame:
    """Rows sorted by model and level with the level's ``role``.

    A level's rows meet in one task, unless it is hot: then it is spread, and its sums
    are brought together later. At most LARGE_PART levels are, plus one first level, per model.
    """
    sizes = design.groupBy("model", "level").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy(F.col("model").alias("_m")).agg(F.min("level").alias("_first"), F.sum("n").alias("_rows"))
    is_first = F.col("level") == F.col("_first")
    is_hot = F.col("n") > F.greatest(F.lit(hot_rows), F.floor(F.col("_rows") / LARGE_PART))
    special = sizes.join(whole, F.expr("model = _m")).filter(is_first | is_hot).select(
        "_m", F.col("level").alias("_l"), F.when(is_first, FIRST).otherwise(HOT).alias("role")
    )
    marked = design.join(
        special, same_key(design, special, [("model", "_m"), ("level", "_l")]), "left"
    ).withColumn("role", F.coalesce("role", F.lit(ORDINARY)))
    spread = F.when(F.col("role") == ORDINARY, 0).otherwise(F.pmod(F.col("hash"), F.lit(1009)))
    return marked.drop("_m", "_l").repartition("model", "level", spread).sortWithinPartitions("model", "level")
