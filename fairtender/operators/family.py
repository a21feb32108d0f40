"""Families of models from one pass over the rows, and statistics that can be added up.

The columns of every model of a family are sums of columns of one design, so its cross products
are sums of entries of one matrix: nested models take a part of it, and a break after each of
several periods is the sum over the later periods. The rows are read once whatever the number
of models.

Rows with a missing value are kept apart by which columns are missing, so that each model
uses just the rows that are complete in its own columns.

``statistics`` keeps the sums in a table (one row of packed numbers per level of the absorbed
factor). ``merged`` adds tables up, for instance those of earlier and of appended rows;
``solve`` turns them into coefficients without the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtender.functions.draws import key_hash, replicate_weights
from fairtender.operators.moments import FIRST, HOT, LONG, add_up, arrow_rows, cross_products, matrix, place_by_level, rows_at_once, texts
from fairtender.operators.regress import COEFS, Term, cell_columns, normal_equations, summarise
from fairtender.operators.skew import HOT_ROWS
from fairtender.operators.solve import least_squares

#: the mark of rows without a missing value
WHOLE = ""


@dataclass(frozen=True)
class Model:
    """A model of a family: its label, its terms by name, each the sum of the design's terms
    of the names behind it, and whether the factor is absorbed."""

    label: str
    terms: tuple[tuple[str, tuple[str, ...]], ...]
    absorbed: bool = False


def model(label: str, names: Sequence[str], absorbed: bool = False) -> Model:
    """A model of terms of the design as they are."""
    return Model(label, tuple((n, (n,)) for n in names), absorbed)


def breaks(before: Sequence[str], cuts: Sequence, parts: Sequence[tuple[str, Sequence[str]]], absorbed: bool = True) -> list[Model]:
    """A model per cut: the terms ``before``, and for each of ``parts`` (name, the design's
    terms by period, the k-th for the period after the k-th cut) the sum over the periods after it."""
    out = []
    for k, cut in enumerate(cuts):
        later = [(name, tuple(by_period[k:])) for name, by_period in parts]
        out.append(Model(str(cut), (*((n, (n,)) for n in before), *later), absorbed))
    return out


def period(time: Column, cuts: Sequence) -> Column:
    """How many of the cuts a time is after; a missing time is after all."""
    return sum([F.coalesce(time > F.lit(c), F.lit(True)).cast("int") for c in sorted(cuts)], F.lit(0))


def design(df: DataFrame, y: str, terms: Sequence[Term], absorb: str | None = None, key: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Rows as (model, hash, level, v): ``model`` is the mark of missing columns, whose place in ``v`` is 0."""
    columns = [F.lit(1.0), *[c.cast("double") for _, c in terms], F.col(y).cast("double")]
    level = [F.col(absorb).cast("string").alias("level")] if absorb else []
    spread = key_hash(seed, key) if key else F.xxhash64(*([absorb] if absorb else []), F.array(*columns))
    raw = df.select(spread.alias("hash"), *level, F.array(*columns).alias("v"))
    lacking = F.exists("v", lambda v: v.isNull())
    if absorb:
        lacking = lacking | F.col("level").isNull()
    bits = F.array_join(F.transform("v", lambda v: v.isNull().cast("int").cast("string")), "")
    mark = F.when(lacking, F.concat(F.col("level").isNull().cast("int").cast("string") if absorb else F.lit("0"), bits)).otherwise(WHOLE)
    known = F.transform("v", lambda v: F.coalesce(v, F.lit(0.0)))
    return raw.select(mark.alias("model"), "hash", *([F.coalesce("level", F.lit("")).alias("level")] if absorb else []), known.alias("v"))


# ---- statistics that can be added up -----------------------------------------------------

_STATS = pa.schema([("model", pa.string()), ("level", pa.string()), ("values", pa.binary())])
STATS_SQL = "model string, level string, values binary"


def _packed(width: int, reps: int, by_level: bool):
    """Per task, mark and, with ``by_level``, level: sums of the columns; without a level: their cross products."""
    upper = np.triu_indices(width)
    chunk = rows_at_once(width, reps)

    def row(name: str, level: str | None, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((name, level, values.tobytes()), _STATS, strict=True)], schema=_STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        at, sums = None, None
        for batch in batches:
            marks, values, hashes = texts(batch, "model"), matrix(batch, width), batch.column("hash").to_numpy()
            levels = texts(batch, "level") if by_level else marks
            cuts = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]) | (levels[1:] != levels[:-1])]) if len(marks) else []
            for a, b in zip(cuts, [*cuts[1:], len(marks)]):
                if by_level and at != (marks[a], levels[a]):
                    if at is not None:
                        yield row(*at, sums)
                    at, sums = (marks[a], levels[a]), np.zeros((reps + 1, width))
                for i in range(a, b, chunk):
                    part = values[i : min(b, i + chunk)]
                    weights = replicate_weights(hashes[i : min(b, i + chunk)], 0, reps)
                    products = weights.T @ (part[:, upper[0]] * part[:, upper[1]])
                    grams[marks[a]] = grams.get(marks[a], 0.0) + products
                    if by_level:
                        sums += weights.T @ part
        if at is not None:
            yield row(*at, sums)
        for name, products in grams.items():
            yield row(name, None, products)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of packed rows of one mark and level, which follow one another."""
    at, total = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*at, total.tobytes()), _STATS, strict=True)], schema=_STATS)

    for batch in batches:
        for r in batch.to_pylist():
            now, values = (r["model"], r["level"]), np.frombuffer(r["values"])
            if now != at:
                if at is not None:
                    yield told()
                at, total = now, values
            else:
                total = total + values
    if at is not None:
        yield told()


def merged(*tables: DataFrame) -> DataFrame:
    """Statistics of all rows of several tables of statistics of the same design."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.repartition("model", "level").sortWithinPartitions("model", "level").mapInArrow(_added, STATS_SQL)


def statistics(df: DataFrame, y: str, terms: Sequence[Term], absorb: str | None = None, key: Sequence[str] = (), reps: int = 0, seed: int = 42, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The sums of a design that all models on it need: (model, level, values).

    Per mark of missing columns a row of cross products (``level`` missing), and per level of
    ``absorb`` a row of sums; ``values`` are numbers by replicate. Replicate weights depend on
    the row's ``key`` only, so statistics of parts add up to those of the whole. Write the
    table where it is to be used again.
    """
    rows = design(df, y, terms, absorb, key, seed)
    width = len(terms) + 2
    placed = place_by_level(rows, hot_rows) if absorb else rows.repartition("hash").sortWithinPartitions("model")
    return merged(placed.mapInArrow(_packed(width, reps, bool(absorb)), STATS_SQL))


def _long_of(width: int, reps: int):
    """Packed statistics to sums as those of ``cross_products``."""
    upper = np.triu_indices(width)
    schema = pa.schema([("model", pa.string()), ("rep", pa.int32()), ("part", pa.string()), ("kind", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64()), ("x", pa.float64())])

    def long(name: str, kind: int, values: np.ndarray, x: np.ndarray | None = None, i=None, j=None, part: str | None = None) -> pa.RecordBatch:
        reps_, cells = values.shape
        i, j = (np.arange(cells), np.full(cells, -1)) if i is None else (i, j)
        told = {"model": name, "rep": np.repeat(np.arange(reps_, dtype="int32"), cells), "part": part, "kind": np.int32(kind)}
        told |= {"i": np.tile(i.astype("int32"), reps_), "j": np.tile(j.astype("int32"), reps_), "s": values.ravel(), "x": 0.0 if x is None else x.ravel()}
        return arrow_rows(pd.DataFrame(told), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained: dict[str, np.ndarray] = {}
        levels: dict[str, int] = {}
        for batch in batches:
            for r in batch.to_pylist():
                values = np.frombuffer(r["values"]).reshape(reps + 1, -1)
                if r["level"] is None:
                    yield long(r["model"], 0, values, None, *upper)
                elif r["level"] == r["first"]:
                    yield long(r["model"], FIRST, values, part=r["level"])
                else:
                    scaled = values / np.sqrt(values[:, :1])
                    explained[r["model"]] = explained.get(r["model"], 0.0) + scaled[:, upper[0]] * scaled[:, upper[1]]
                    levels[r["model"]] = levels.get(r["model"], 0) + 1
        for name, x in explained.items():
            yield long(name, 0, np.zeros_like(x), x, *upper)
            yield long(name, 3, np.full((reps + 1, 1), float(levels[name])))

    return run


def sums_of(stats: DataFrame, width: int, reps: int) -> DataFrame:
    """Sums as those of ``cross_products`` from a table of statistics."""
    firsts = stats.groupBy("model").agg(F.min("level").alias("first"))
    rows = stats.join(firsts, "model").select("model", "level", "values", "first")
    return add_up(rows.mapInArrow(_long_of(width, reps), LONG))


# ---- solving -----------------------------------------------------------------------------


def _combination(m: Model, place: dict[str, int], width: int) -> np.ndarray:
    """The design's columns to the model's: constant, terms, outcome."""
    out = np.zeros((width, len(m.terms) + 2))
    out[0, 0] = out[width - 1, -1] = 1.0
    for at, (_, parts) in enumerate(m.terms, 1):
        for p in parts:
            out[place[p], at] = 1.0
    return out


def _fits(mark: str, use: np.ndarray, absorbed: bool) -> bool:
    """Whether rows of a mark are complete in the columns a model uses."""
    return mark == WHOLE or (not (absorbed and mark[0] == "1") and not any(c == "1" and u for c, u in zip(mark[1:], use, strict=True)))


def _solver(models: Sequence[Model], names: Sequence[str], absorb: bool):
    width = len(names) + 2
    place = {n: i for i, n in enumerate(names, 1)}
    ways = [(m, _combination(m, place, width)) for m in models]
    schema = pa.schema([("model", pa.string()), ("var", pa.string()), ("rep", pa.int32()), ("pos", pa.int32())] + [(c, pa.float64()) for c in ("coef", "stderr", "N", "r2", "df_m", "df_r")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cells = cell_columns(batch.column("cells")[k])
                marks = cells["mark"].unique()
                of_mark = {mark: normal_equations(cells[cells["mark"] == mark], width, absorb) for mark in marks}
                for m, way in ways:
                    own = [mark for mark in marks if _fits(mark, way.any(axis=1), m.absorbed)]
                    if not own:
                        continue
                    if m.absorbed and own != [WHOLE]:
                        raise ValueError(f"model {m.label}: rows that lack columns it does not use cannot be absorbed with the others; fit it alone")
                    raw = way.T @ sum(of_mark[mark][0] for mark in own) @ way
                    explained, first, levels = None, None, 0.0
                    if m.absorbed:
                        _, explained, first, levels = of_mark[WHOLE]
                        explained, first = way.T @ explained @ way, first @ way
                    out = least_squares(raw, explained, first, levels)
                    head = {"model": m.label, "var": ["_cons", *[n for n, _ in m.terms]], "rep": np.int32(batch.column("rep")[k].as_py())}
                    yield pa.RecordBatch.from_pandas(pd.DataFrame({**head, "pos": np.arange(len(m.terms) + 1, dtype="int32"), **out}), schema, preserve_index=False)

    return run


def solve(sums: DataFrame, terms: Sequence[Term] | Sequence[str], models: Sequence[Model], absorb: bool, reps: int = 0) -> DataFrame:
    """Tidy coefficients of the models from the design's sums; ``terms`` are those of the design."""
    names = [t if isinstance(t, str) else t[0] for t in terms]
    cell = F.struct(F.col("model").alias("mark"), "part", "kind", "i", "j", "s", "x")
    # at most width * (width + parts) numbers per mark; marks are few
    cells = sums.groupBy("rep").agg(F.collect_list(cell).alias("cells"))
    coefs = cells.mapInArrow(_solver(models, names, absorb), COEFS.replace("rep int", "var string, rep int"))
    return summarise(coefs, reps)


def fit_family(df: DataFrame, y: str, terms: Sequence[Term], models: Sequence[Model], absorb: str | None = None, key: Sequence[str] = (), reps: int = 0, seed: int = 42, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Tidy coefficients of all models of a family, as of separate fits, from one pass over the rows.

    Models with the factor absorbed must use every column that can be missing; others may use any.
    """
    if reps and not key:
        raise ValueError("replicate weights need a row key")
    sums = cross_products(design(df, y, terms, absorb, key, seed), len(terms) + 2, reps, bool(absorb), hot_rows)
    return solve(sums, terms, models, bool(absorb), reps)


def solve_statistics(stats: DataFrame, terms: Sequence[Term] | Sequence[str], models: Sequence[Model], absorb: bool, reps: int = 0) -> DataFrame:
    """The same from a table of statistics."""
    return solve(sums_of(stats, len(terms) + 2, reps), terms, models, absorb, reps)
