"""Row filters, indicators, defaults, column-wide checks and per-stratum samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairtender.operators.skew import HOT_ROWS, attach_stats, lookup, order_struct


def present(column: str) -> Column:
    """Neither missing nor blank."""
    return F.col(column).isNotNull() & (F.col(column) != "")


def at_most(numerator: str, denominator: str, limit: float) -> Column:
    """Ratio within ``limit``; a missing ratio counts as above it, so it fails."""
    return F.coalesce(F.try_divide(F.col(numerator), F.col(denominator)) <= F.lit(limit), F.lit(False))


def above(column: str, limit) -> Column:
    """0/1 for ``column > limit``, a missing value being above every limit."""
    return F.coalesce(F.col(column) > F.lit(limit), F.lit(True)).cast("int")


def indicator(condition: Column) -> Column:
    """0/1, never missing."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def count_missing(df: DataFrame) -> DataFrame:
    """One row: the number of missing values of each column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def drop_all_missing(df: DataFrame) -> DataFrame:
    """Leave out columns that are missing in every row (one pass decides)."""
    filled = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if filled[c] is False])


def panel_filter(df: DataFrame, unit: str, post: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Keep units with rows on both sides of the break ``post`` (0/1); ``hot_rows`` as in ``attach_stats``."""
    marked = attach_stats(
        df, [unit], {"_after": F.sum(post), "_before": F.sum(F.abs(1 - F.col(post)))}, hot_rows
    )
    return marked.filter("_after > 0 AND _before > 0").drop("_after", "_before")


def panel_mark(df: DataFrame, unit: str, post: str, out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same as a 0/1 column, dropping nothing."""
    marked = attach_stats(
        df, [unit], {"_after": F.sum(post), "_before": F.sum(F.abs(1 - F.col(post)))}, hot_rows
    )
    return marked.withColumn(out, indicator(F.expr("_after > 0 AND _before > 0"))).drop("_after", "_before")


def drop_empty_if_filled(df: DataFrame, by: Sequence[str], value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Drop rows with a missing value from groups that also have filled ones."""
    counted = attach_stats(df, by, {"_filled": F.count(value)}, hot_rows)
    return counted.filter(F.col(value).isNotNull() | (F.col("_filled") == 0)).drop("_filled")


def first_flag(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """1 on one row of each group, the first in ``order``, else 0.

    ``order`` must tell the rows of a group apart.
    """
    marked = attach_stats(df, by, {"_first": F.min(order_struct(order))}, hot_rows)
    return marked.withColumn(out, (order_struct(order) == F.col("_first")).cast("int")).drop("_first")


def draw_text(seed: int, key: Sequence[str]) -> Column:
    """A repeatable draw per key: hex digits that do not depend on the partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))


def sample_n_by(
    df: DataFrame, n: int, strata: Sequence[str], key: Sequence[str], seed: int = 42, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exactly ``n`` rows of each stratum (all, if it has fewer): those with the lowest draws.

    Draws fall evenly into 65,536 ordered bins. The rows per (stratum, bin) tell in which
    bin the n-th row lies, and only rows up to that bin are sorted, so the sort sees about
    n plus a 65,536th of the stratum.
    """
    drawn = df.withColumn("_draw", draw_text(seed, key)).withColumn("_bin", F.substring("_draw", 1, 4))
    bins = drawn.groupBy(*strata, "_bin").agg(F.count(F.lit(1)).alias("_rows"))
    upto = Window.partitionBy(*strata).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    needed = bins.withColumn("_before", F.coalesce(F.sum("_rows").over(upto), F.lit(0)))
    last = needed.filter(F.col("_before") < n).groupBy(*strata).agg(F.max("_bin").alias("_last"))
    near = lookup(drawn, last, strata, hot_rows=hot_rows).filter("_bin <= _last")
    place = Window.partitionBy(*strata).orderBy("_draw", *key)
    return near.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= n).select(*df.columns)
