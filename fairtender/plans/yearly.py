"""Yearly tables behind the charts, and the column dictionary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtender.operators.shape import share_of_total, to_wide
from fairtender.operators.skew import order_struct

GROUPS = (1, 2, 3, 4)


def contract_counts(
    items: DataFrame, group: Column, contract: str, order: Sequence[str], year: str = "year_suscripcion"
) -> DataFrame:
    """Contracts per year and procedure group, a column per group.

    A contract counts where its first item is; a (year, group) that has items but no
    first one is 0, one without items is missing.
    """
    grouped = items.withColumn("_g", group).filter(F.col("_g").isNotNull())
    cell = F.struct(F.col(year).alias("y"), F.col("_g").alias("g"))
    # per contract: the cell of its first item, and the few cells its items lie in
    firsts = grouped.groupBy(contract).agg(
        F.min(F.struct(order_struct(order).alias("o"), cell.alias("c"))).alias("f"), F.collect_set(cell).alias("seen")
    )
    marked = firsts.select(F.col("f.c").alias("first"), F.explode("seen").alias("c")).select(
        "c.y", "c.g", (F.col("c") == F.col("first")).cast("long").alias("n")
    )
    counts = marked.groupBy("y", "g").agg(F.sum("n").alias("num_contratos"))
    return to_wide(counts, ["y"], "g", ["num_contratos"], GROUPS).withColumnRenamed("y", year)


def contract_shares(counts: DataFrame) -> DataFrame:
    """Adds the yearly total and each group's share."""
    return share_of_total(
        counts, [f"num_contratos{g}" for g in GROUPS], "total_contratos", [f"share{g}" for g in GROUPS]
    )


def mean_by_year(df: DataFrame, value: str, by: str = "contratacion", year: str = "year_suscripcion") -> DataFrame:
    """Yearly means of ``value``, a column for each of 0 and 1 of ``by``."""
    means = df.groupBy(year, by).agg(F.avg(value).alias(value))
    return to_wide(means, [year], by, [value], (0, 1))


def variable_dictionary(df: DataFrame) -> DataFrame:
    """One row per column: name, label (its ``comment``) and number of filled rows."""
    labels = {f.name: f.metadata.get("comment", "") for f in df.schema.fields}
    filled = df.agg(*[F.count(c).alias(c) for c in df.columns])
    long = filled.unpivot([], df.columns, "varname", "n_filled")
    varlabel = F.create_map(*[x for n, l in labels.items() for x in (F.lit(n), F.lit(l))])
    return long.select("varname", varlabel[F.col("varname")].alias("varlabel"), "n_filled")
