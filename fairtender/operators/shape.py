"""Unions, long and wide layouts, integer codes, shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtender.operators.skew import HOT_ROWS, dealt, lookup, number_rows


def union_marked(first: DataFrame, second: DataFrame, mark: str | None = None) -> DataFrame:
    """Stack two tables by column name; absent columns are missing; ``mark`` is 0 or 1 by source."""
    if mark:
        first = first.withColumn(mark, F.lit(0))
        second = second.withColumn(mark, F.lit(1))
    return first.unionByName(second, allowMissingColumns=True)


def to_wide(
    df: DataFrame, index: Sequence[str], level: str, values: Sequence[str], levels: Sequence
) -> DataFrame:
    """One row per ``index``; a column ``{value}{level}`` for each value and stated level."""
    cells = [
        F.max(F.when(F.col(level) == F.lit(lv), F.col(v))).alias(f"{v}{lv}") for v in values for lv in levels
    ]
    return df.groupBy(*index).agg(*cells)


def to_wide_banded(
    df: DataFrame,
    index: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    width: int,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Repeated rows of ``index`` laid side by side, ``width`` to a row.

    A group of up to ``width`` rows gives one row (``band`` 0); a larger one goes on in
    further bands, so nothing is cut off and no row grows with its group.
    """
    slim = dealt(df.select(*index, *dict.fromkeys([*order, *values])), index, hot_rows)
    numbered = number_rows(slim, index, order, "_j", hot_rows)
    placed = numbered.withColumn("band", F.floor((F.col("_j") - 1) / width)).withColumn(
        "_slot", (F.col("_j") - 1) % width + 1
    )
    return to_wide(placed, [*index, "band"], "_slot", values, range(1, width + 1))


def to_long(df: DataFrame, index: Sequence[str], columns: Sequence[str], position: str, value: str) -> DataFrame:
    """Repeated columns to one row per (index, position), missing values included."""
    return df.select(*index, F.posexplode(F.array(*columns)).alias("_at", value)).select(
        *index, (F.col("_at") + 1).alias(position), value
    )


def array_to_long(df: DataFrame, index: Sequence[str], values: str, position: str, value: str) -> DataFrame:
    """An array column to one row per element; an empty or missing array gives one missing row."""
    return df.select(*index, F.posexplode_outer(values).alias("_at", value)).select(
        *index, (F.coalesce("_at", F.lit(0)) + 1).alias(position), value
    )


def encode(df: DataFrame, column: str, out: str, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Replace strings by 1..k in alphabetical order: the coded table and its (code, label) table."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    labels = number_rows(values, [], [column], out, hot_rows)
    return lookup(df, labels, [column], hot_rows=hot_rows), labels.select(out, F.col(column).alias("label"))


def group_id(df: DataFrame, columns: Sequence[str], out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Dense ids over the sorted combinations of ``columns``; missing where any part is."""
    present = [F.col(c).isNotNull() for c in columns]
    whole = present[0]
    for p in present[1:]:
        whole = whole & p
    tuples = df.select(*columns).filter(whole).distinct()
    return lookup(df, number_rows(tuples, [], columns, out, hot_rows), columns, hot_rows=hot_rows)


def share_of_total(df: DataFrame, parts: Sequence[str], total: str, shares: Sequence[str]) -> DataFrame:
    """Row total of ``parts`` and the share of each; a missing part makes the total missing."""
    whole: Column = F.col(parts[0])
    for p in parts[1:]:
        whole = whole + F.col(p)
    df = df.withColumn(total, whole)
    return df.select("*", *[F.try_divide(F.col(p).cast("double"), F.col(total)).alias(s) for p, s in zip(parts, shares)])


def move_first(df: DataFrame, first: Sequence[str]) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def columns_like(df: DataFrame, prefix: str = "", contains: str = "") -> list[str]:
    """Names that start with ``prefix`` and contain ``contains``."""
    return [c for c in df.columns if c.startswith(prefix) and contains in c]


def all_but(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]
