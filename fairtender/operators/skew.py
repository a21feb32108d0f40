"""Group-wise operators that hold when one group has a third of all rows.

A window or a shuffled join puts a whole key into one task. The operators here first count
the rows per key, pre-aggregated on the map side. A key with more than ``hot_rows`` rows is
*hot*; at most rows / hot_rows keys can be, and that bounds every broadcast below. Without
hot keys the plain window or join runs, one shuffle and no more. Hot keys are handled apart:
their statistics and lookup rows are broadcast to where the rows stand, and their running
numbers come from a sort over many tasks.

Counting runs a job when the operator is built, so a costly input should be staged first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairtender.session import stage

HOT_ROWS = 5_000_000
#: rows of ordinary keys that one task is to sort or group
TASK_ROWS = 1_000_000


def same_key(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Equality of keys in which a missing key equals a missing key."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def total_order(cols: Sequence[str]) -> list[Column]:
    """Ascending with missing values last."""
    return [F.col(c).asc_nulls_last() for c in cols]


def order_struct(cols: Sequence[str]) -> Column:
    """A comparable struct in which a missing value sorts above every value."""
    parts = []
    for i, c in enumerate(cols):
        parts += [F.col(c).isNull().alias(f"m{i}"), F.col(c).alias(f"v{i}")]
    return F.struct(*parts)


def renamed(df: DataFrame, cols: Sequence[str], prefix: str) -> list[Column]:
    return [df[c].alias(f"{prefix}{i}") for i, c in enumerate(cols)]


def hot_keys(df: DataFrame, by: Sequence[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame | None, int]:
    """The hot keys (columns ``_h0``…) and the rows they have, or None and 0."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    if largest <= hot_rows:
        return None, 0
    hot = stage(sizes.filter(F.col("_n") > hot_rows).select(*renamed(sizes, by, "_h"), "_n"))
    return hot, int(hot.agg(F.sum("_n")).first()[0])


def dealt(df: DataFrame, by: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows laid out by key over as many tasks as their number needs, for group-wise steps that follow.

    The session's shuffle partitions are the least; if they do, or a key is hot, ``df`` is left as it is.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    largest, rows = sizes.agg(F.max("_n"), F.sum("_n")).first()
    tasks = -(-(rows or 0) // TASK_ROWS)
    if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) or largest > hot_rows:
        return df
    return df.repartition(tasks, *by)


def split_hot(df: DataFrame, by: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys and rows of hot keys, without a shuffle."""
    keys = hot.drop("_n")
    match = same_key(df, keys, [(c, f"_h{i}") for i, c in enumerate(by)])
    return df.join(F.broadcast(keys), match, "left_anti"), df.join(F.broadcast(keys), match, "left_semi")


def _broadcast_join(rows: DataFrame, side: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join with a side of at most one row per hot key."""
    extra = [c for c in side.columns if c not in on]
    keyed = side.select(*renamed(side, on, "_k"), *extra)
    joined = rows.join(F.broadcast(keyed), same_key(rows, keyed, [(c, f"_k{i}") for i, c in enumerate(on)]), how)
    return joined.select(*[rows[c] for c in rows.columns], *[keyed[c] for c in extra])


def attach_stats(
    df: DataFrame, by: Sequence[str], stats: dict[str, Column], hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Add to every row aggregates of its group; ``hot_rows`` None: no key is known to be hot."""
    hot = None if hot_rows is None else hot_keys(df, by, hot_rows)[0]
    window = Window.partitionBy(*by)
    over = [c.over(window).alias(k) for k, c in stats.items()]
    if hot is None:
        return df.select("*", *over)
    calm, crowded = split_hot(df, by, hot)
    side = crowded.groupBy(*by).agg(*[c.alias(k) for k, c in stats.items()])
    return calm.select("*", *over).unionByName(_broadcast_join(crowded, side, by, "left"))


def lookup(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Join many rows to one (``right`` has one row per key), ``how`` is ``left`` or ``inner``."""
    hot, _ = hot_keys(left, on, hot_rows)
    if hot is None:
        return _plain_join(left, right, on, how)
    calm, crowded = split_hot(left, on, hot)
    _, wanted = split_hot(right, on, hot)
    return _plain_join(calm, right, on, how).unionByName(_broadcast_join(crowded, wanted, on, how))


def _plain_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    extra = [c for c in right.columns if c not in on]
    keyed = right.select(*renamed(right, on, "_k"), *extra)
    joined = left.join(keyed, same_key(left, keyed, [(c, f"_k{i}") for i, c in enumerate(on)]), how)
    return joined.select(*[left[c] for c in left.columns], *[keyed[c] for c in extra])


def many_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join many rows to many; ``how`` is ``inner``, ``left``, ``right`` or ``full``.

    A key that is hot on either side is laid out as a grid: its left rows are dealt into rows of
    the grid and copied to each column, its right rows into columns and copied to each
    row, so that every pair meets once and a cell has at most about ``hot_rows`` rows of either
    side. A hot key that one side lacks needs no join. Key columns of both sides come back
    as those of the left, or of the right where the left is missing.
    """
    sizes = [df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")) for df in (left, right)]
    first, second = (s.select(*renamed(s, on, p), F.col("n").alias(f"_{p}n")) for s, p in zip(sizes, ("_h", "_k"), strict=True))
    match = reduce(lambda a, b: a & b, [first[f"_h{i}"].eqNullSafe(second[f"_k{i}"]) for i in range(len(on))])
    both = first.join(second, match, "full").filter((F.col("__hn") > hot_rows) | (F.col("__kn") > hot_rows))
    key = [F.when(F.col("__hn").isNull(), F.col(f"_k{i}")).otherwise(F.col(f"_h{i}")).alias(f"_h{i}") for i in range(len(on))]
    # at most rows / hot_rows keys of either side
    hot = stage(both.select(*key, F.ceil(F.col("__hn") / hot_rows).cast("int").alias("_rows"), F.ceil(F.col("__kn") / hot_rows).cast("int").alias("_cols")))
    if hot.isEmpty():
        return _plain_many(left, right, on, how)
    keys = hot.select(*[f"_h{i}" for i in range(len(on))], F.lit(1).alias("_n"))
    calm = _plain_many(split_hot(left, on, keys)[0], split_hot(right, on, keys)[0], on, how)
    out = calm.unionByName(_grid(left, right, on, hot.filter("_rows is not null and _cols is not null")))
    for side, other, lone, kept in ((left, right, "_cols is null", ("left", "full")), (right, left, "_rows is null", ("right", "full"))):
        if how in kept:
            _, single = split_hot(side, on, hot.filter(lone).select(*[f"_h{i}" for i in range(len(on))], F.lit(1).alias("_n")))
            missing = [F.lit(None).cast(other.schema[c].dataType).alias(c) for c in other.columns if c not in on]
            out = out.unionByName(single.select("*", *missing).select(out.columns))
    return out


def _plain_many(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    extra = [c for c in right.columns if c not in on]
    keyed = right.select(*renamed(right, on, "_k"), *extra, F.lit(1).alias("_right"))
    base = left.withColumn("_left", F.lit(1))
    joined = base.join(keyed, same_key(base, keyed, [(c, f"_k{i}") for i, c in enumerate(on)]), how)
    own = {c: F.when(F.col("_left").isNull(), keyed[f"_k{i}"]).otherwise(base[c]).alias(c) for i, c in enumerate(on)}
    return joined.select(*[own.get(c, base[c]) for c in left.columns], *[keyed[c] for c in extra])


def _grid(left: DataFrame, right: DataFrame, on: Sequence[str], hot: DataFrame) -> DataFrame:
    extra = [c for c in right.columns if c not in on]

    def dealt(df: DataFrame, own: str, copies: str, place: str, at: str) -> DataFrame:
        keyed = df.join(F.broadcast(hot), same_key(df, hot, [(c, f"_h{i}") for i, c in enumerate(on)]))
        # equal rows are told apart by their place, so that they do not all go the same way
        number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(own)).cast("int")
        numbered = keyed.select(*[df[c] for c in df.columns], number.alias(place), copies)
        return numbered.withColumn(at, F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).drop(copies)

    some = dealt(left, "_rows", "_cols", "_r", "_c")
    many = dealt(right, "_cols", "_rows", "_c", "_r")
    keyed = many.select(*renamed(many, on, "_k"), *extra, F.col("_r").alias("_r2"), F.col("_c").alias("_c2"))
    cell = (some["_r"] == keyed["_r2"]) & (some["_c"] == keyed["_c2"])
    joined = some.join(keyed, same_key(some, keyed, [(c, f"_k{i}") for i, c in enumerate(on)]) & cell)
    return joined.select(*[some[c] for c in left.columns], *[keyed[c] for c in extra])


def number_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    out: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Number the rows of each group 1, 2, … in ``order`` (missing last).

    ``by`` may be empty, which numbers the whole table, always sorted over many tasks. So is a
    hot group: its rows carry their position in the sorted table, and a row's number is that
    less the group's first position in the partition plus the group's rows in earlier
    partitions.
    """
    if not by:
        return _number_sorted(df, by, order, out, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot, rows = hot_keys(df, by, hot_rows)
    window = Window.partitionBy(*by).orderBy(*total_order(order))
    numbered = F.row_number().over(window).cast("long").alias(out)
    if hot is None:
        return df.select("*", numbered)
    calm, crowded = split_hot(df, by, hot)
    return calm.select("*", numbered).unionByName(_number_sorted(crowded, by, order, out, max(2, -(-4 * rows // hot_rows))))


def _number_sorted(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str, parts: int) -> DataFrame:
    ranged = [*[F.col(c) for c in by], *total_order(order)]
    # written once, so that the positions cannot change if an executor is lost
    placed = stage(
        df.repartitionByRange(parts, *ranged)
        .sortWithinPartitions(*ranged)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )
    # at most one row per hot group and one more per partition
    spans = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1
    starts = spans.select(*by, "_part", shift.alias("_shift"))
    joined = _broadcast_join(placed, starts, [*by, "_part"], "inner")
    return joined.select(*df.columns, (F.col("_at") + F.col("_shift")).alias(out))
