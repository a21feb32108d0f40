"""Least squares by orthogonal factors of a tall table, without cross products.

Cross products square the condition of a design: of two columns that differ by a part in a
million nothing is left to tell them apart. Here every task turns its rows into a triangular
factor (QR), and factors are stacked and factored again in a tree, so that columns are kept or
left out by how much of them the earlier ones leave, and coefficients are as exact as those of
the rows.

With a factor absorbed, a level's rows are factored with the constant first; without its first
row and column that factor is that of the deviations from the level's means, also where
the level's rows lie in many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairtender.functions.draws import replicate_weights
from fairtender.operators.moments import FIRST, ORDINARY, matrix, place_by_level, texts
from fairtender.session import stage

#: part of a column's size that must be left of it
RANK_TOLERANCE = 1e-9
#: numbers that are factored at once, and factors that meet in one task
NUMBERS, TOGETHER = 4_000_000, 64
# kinds of factors: of all rows less their level's means, of a level's rows (a hot one; the first), of the raw rows (constant and outcome)
WITHIN, LEVEL, LOWEST, RAW = 0, 1, 2, 3
_FACTORS = pa.schema([("model", pa.string()), ("rep", pa.int32()), ("kind", pa.int32()), ("level", pa.string()), ("rows", pa.float64()), ("levels", pa.float64()), ("r", pa.binary())])
FACTORS_SQL = "model string, rep int, kind int, level string, rows double, levels double, r binary"
KEYS = ["model", "rep", "kind", "level"]


def triangle(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of rows, square whatever their number."""
    width = rows.shape[1]
    if len(rows) < width:
        rows = np.concatenate([rows, np.zeros((width - len(rows), width))])
    return np.linalg.qr(rows, mode="r")


class _Stack:
    """The factor of all rows added so far."""

    def __init__(self, width: int):
        self.width, self.held, self.size = width, [], 0

    def add(self, rows: np.ndarray) -> None:
        self.held.append(rows)
        self.size += len(rows)
        if self.size * self.width >= NUMBERS // 8:
            self.held = [self.factor()]
            self.size = self.width

    def factor(self) -> np.ndarray:
        return triangle(np.concatenate(self.held)) if self.held else np.zeros((self.width, self.width))


def _row(model: str, rep: int, kind: int, level: str | None, rows: float, levels: float, r: np.ndarray) -> pa.RecordBatch:
    values = (model, rep, kind, level, rows, levels, np.ascontiguousarray(r).tobytes())
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _FACTORS, strict=True)], schema=_FACTORS)


class _Task:
    """Factors of one model's rows in one task, for every replicate."""

    def __init__(self, model: str, width: int, reps: int, absorb: bool):
        self.model, self.width, self.reps, self.absorb = model, width, reps, absorb
        self.stacks = [_Stack(width) for _ in range(reps + 1)]
        self.raw = [_Stack(2) for _ in range(reps + 1)]
        self.rows = self.levels = 0
        self.level, self.role, self.own = None, ORDINARY, None

    def add(self, values: np.ndarray, hashes: np.ndarray, level: str | None, role: int) -> Iterator[pa.RecordBatch]:
        roots = np.sqrt(replicate_weights(hashes, 0, self.reps))
        self.rows += len(values)
        if self.absorb and (self.own is None or level != self.level):
            yield from self.close()
            self.level, self.role, self.own = level, role, [_Stack(self.width) for _ in range(self.reps + 1)]
        for k in range(self.reps + 1):
            scaled = roots[:, [k]] * values
            self.raw[k].add(scaled[:, [0, -1]])
            (self.own if self.absorb else self.stacks)[k].add(scaled)

    def close(self) -> Iterator[pa.RecordBatch]:
        """A level's end: its deviations are added, or its factor is passed on if it has rows elsewhere."""
        if self.own is None:
            return
        if self.role == ORDINARY:
            self.levels += 1
            for stack, own in zip(self.stacks, self.own, strict=True):
                deviations = own.factor()
                deviations[0], deviations[:, 0] = 0.0, 0.0
                stack.add(deviations)
        else:
            for k, own in enumerate(self.own):
                yield _row(self.model, k, LOWEST if self.role == FIRST else LEVEL, self.level, 0.0, 0.0, own.factor())
        self.own = None

    def told(self) -> Iterator[pa.RecordBatch]:
        yield from self.close()
        for k in range(self.reps + 1):
            yield _row(self.model, k, WITHIN, None, float(self.rows), float(self.levels), self.stacks[k].factor())
            yield _row(self.model, k, RAW, None, 0.0, 0.0, self.raw[k].factor())


def _factored(width: int, reps: int, absorb: bool):
    chunk = max(64, NUMBERS // 16 // (width * (reps + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task: _Task | None = None
        for batch in batches:
            models, values, hashes = texts(batch, "model"), matrix(batch, width), batch.column("hash").to_numpy()
            levels = texts(batch, "level") if absorb else models
            roles = batch.column("role").to_numpy() if absorb else np.zeros(len(models), int)
            cuts = np.flatnonzero(np.r_[True, (models[1:] != models[:-1]) | (levels[1:] != levels[:-1])]) if len(models) else []
            for a, b in zip(cuts, [*cuts[1:], len(models)]):
                if task is None or task.model != models[a]:
                    if task is not None:
                        yield from task.told()
                    task = _Task(models[a], width, reps, absorb)
                for i in range(a, b, chunk):
                    yield from task.add(values[i : min(b, i + chunk)], hashes[i : min(b, i + chunk)], levels[a], int(roles[a]))
        if task is not None:
            yield from task.told()

    return run


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors of one key, which follow one another, as one."""
    key, held, rows, levels, width = None, None, 0.0, 0.0, 0
    for batch in batches:
        for r in batch.to_pylist():
            now = tuple(r[c] for c in KEYS)
            factor = np.frombuffer(r["r"])
            factor = factor.reshape(math.isqrt(len(factor)), -1)
            if now != key:
                if key is not None:
                    yield _row(*key, rows, levels, held.factor())
                key, held, rows, levels = now, _Stack(len(factor)), 0.0, 0.0
            held.add(factor)
            rows, levels = rows + r["rows"], levels + r["levels"]
    if key is not None:
        yield _row(*key, rows, levels, held.factor())


def merge_factors(factors: DataFrame) -> DataFrame:
    """One factor per key, by a tree: no task gets more than about ``TOGETHER`` factors of a key."""
    found = stage(factors)
    while True:
        most = found.groupBy(*KEYS).count().agg(F.max("count")).first()[0] or 0
        groups = -(-most // TOGETHER)
        deal = F.pmod(F.xxhash64("r"), F.lit(groups)) if groups > 1 else F.lit(0)
        dealt = found.withColumn("_deal", deal)
        merged = dealt.repartition(*KEYS, "_deal").sortWithinPartitions(*KEYS, "_deal").drop("_deal").mapInArrow(_stacked, FACTORS_SQL)
        if groups <= 1:
            return merged
        found = stage(merged)


def solve_triangle(r: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Coefficients, their spreads (before the residual variance), the squares left, and the columns kept.

    The last column is the outcome; columns before ``first`` take no part. A column that
    earlier ones explain is left out.
    """
    work, width = r.copy(), r.shape[1]
    sizes = np.sqrt((r**2).sum(axis=0))
    kept, at = [], 0
    for c in range(first, width - 1):
        rest = work[at:, c]
        left = np.sqrt((rest**2).sum())
        if not left > RANK_TOLERANCE * sizes[c]:
            continue
        mirror = rest.copy()
        mirror[0] += math.copysign(left, rest[0])
        mirror /= np.sqrt((mirror**2).sum())
        work[at:] -= 2.0 * np.outer(mirror, mirror @ work[at:])
        kept.append(c)
        at += 1
    upper = work[:at][:, kept]
    coef, spread = np.full(width - 1, np.nan), np.full(width - 1, np.nan)
    if kept:
        inverse = np.linalg.solve(upper, np.eye(at))
        coef[kept] = inverse @ work[:at, -1]
        spread[kept] = (inverse**2).sum(axis=1)
    mask = np.zeros(width - 1, bool)
    mask[kept] = True
    return coef, spread, float((work[at:, -1] ** 2).sum()), mask


def _solved(width: int, absorb: bool):
    def one(cells: pd.DataFrame) -> dict:
        square = lambda b: np.frombuffer(b).reshape(math.isqrt(len(b) // 8), -1)
        within, raw = cells[cells["kind"] == WITHIN].iloc[0], square(cells[cells["kind"] == RAW].iloc[0]["r"])
        levels, lowest = within["levels"], cells[cells["kind"] == LOWEST]
        first = None
        if len(lowest):
            own = square(lowest.iloc[0]["r"])
            first = own[0] / own[0, 0]  # the level's means
        coef, spread, rss, kept = solve_triangle(square(within["r"]), 1 if absorb else 0)
        n, total = within["rows"], raw[1, 1] ** 2
        df_m = int(kept[1:].sum() + (levels - 1 if absorb else 0))
        df_r = n - df_m - 1
        if absorb:
            coef[0] = np.nan if first is None else first[-1] - np.where(kept[1:], coef[1:], 0.0) @ first[1:-1]
        stderr = np.sqrt(spread * rss / df_r) if df_r > 0 else np.full(width - 1, np.nan)
        return {"coef": coef, "stderr": stderr, "N": n, "r2": 1.0 - rss / total if total > 0 else math.nan, "df_m": float(df_m), "df_r": float(df_r)}

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": key[0], "rep": key[1], "pos": np.arange(width - 1, dtype="int32"), **one(cells)})

    return run


def _as_deviations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors of levels whose rows lay in several tasks, as factors of their deviations."""
    for batch in batches:
        for r in batch.to_pylist():
            factor = np.frombuffer(r["r"])
            factor = factor.reshape(math.isqrt(len(factor)), -1).copy()
            if r["kind"] != LEVEL:
                yield _row(*[r[c] for c in KEYS], r["rows"], r["levels"], factor)
            if r["kind"] in (LEVEL, LOWEST):
                factor[0], factor[:, 0] = 0.0, 0.0
                yield _row(r["model"], r["rep"], WITHIN, None, 0.0, 1.0, factor)


def coefficients(design: DataFrame, width: int, reps: int, absorb: bool, hot_rows: int) -> DataFrame:
    """Coefficients per model, replicate and position of a design (model, hash, ``v``, and ``level`` if absorbed)."""
    placed = place_by_level(design, hot_rows) if absorb else design.sortWithinPartitions("model")
    merged = merge_factors(placed.mapInArrow(_factored(width, reps, absorb), FACTORS_SQL))
    if absorb:
        merged = merge_factors(merged.mapInArrow(_as_deviations, FACTORS_SQL))
    # three factors per model and replicate at most
    return merged.groupBy("model", "rep").applyInPandas(_solved(width, absorb), "model string, rep int, pos int, coef double, stderr double, N double, r2 double, df_m double, df_r double")
