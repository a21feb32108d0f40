"""Places of rows in a total order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairtender.llm.staging import keep


def positions(df: DataFrame, order: list[Column], out: str = "pos") -> DataFrame:
    """Add the place of each row, from 0, in ``order``.

    Rows are dealt out by ranges and sorted there; a row's place is its place in its range
    plus the rows of the ranges before. One row per range meets in one task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = keep(ranged.withColumn("_id", F.monotonically_increasing_id()), "order")
    placed = placed.select(*df.columns, F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_in"))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(starts, "_range").select(*df.columns, (F.col("_before") + F.col("_in")).alias(out))
