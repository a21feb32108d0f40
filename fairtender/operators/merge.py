"""Key checks, joins with origin markers, and first-of-key selection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtender.operators.skew import HOT_ROWS, lookup, many_join, order_struct, same_key
from fairtender.session import stage

#: digests that are sent to all tasks, at 16 bytes and some overhead each
SENT_DIGESTS = 1_000_000


class NotAKey(ValueError):
    """Raised by a strict check when the columns do not identify the rows."""


def check_unique(df: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """The key values that occur more than once; with ``strict`` their presence raises."""
    copies = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    if strict and not copies.isEmpty():
        raise NotAKey(f"{list(keys)} is not a key")
    return copies


def report_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per number of copies: how many rows, and how many of them are surplus."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return per_key.groupBy("copies").agg(
        F.sum("copies").alias("observations"),
        F.sum(F.col("copies") - 1).alias("surplus"),
    )


def distinct_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order``; ties are settled by the other columns.

    An aggregate, so copies collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = [*order, *[c for c in rest if c not in order]]
    first = df.groupBy(*keys).agg(F.min(order_struct(ranked)).alias("_first"))
    place = {c: F.col(f"_first.v{i}").alias(c) for i, c in enumerate(ranked)}
    return first.select(*[F.col(c) if c in keys else place[c] for c in df.columns])


def _digest(columns: Sequence[str]) -> Column:
    """128 bits of a row; missing values and their places count."""
    values = F.struct(*[F.col(f"`{c}`") for c in columns])
    lacking = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in columns])
    return F.struct(F.xxhash64(values, lacking).alias("a"), F.xxhash64(lacking, F.lit(1), values).alias("b"))


def distinct_rows(df: DataFrame, digest: Column | None = None, sent: int = SENT_DIGESTS) -> DataFrame:
    """Each different row once, with little moved if most rows differ.

    Digests of the rows are counted first. Rows whose digest occurs once are different from
    all others and stay where they are; only rows of repeated digests are moved and compared
    in full, so a clash of digests loses no row. Which digests are repeated is sent to all tasks up to
    ``sent`` of them; if there are more, all rows are moved. Counting is a job when
    the operator is built, so a costly input should be staged first.
    """
    marked = df.withColumn("_digest", _digest(df.columns) if digest is None else digest)
    counts = marked.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"))
    again = stage(counts.filter("_n > 1").select("_digest"))
    if again.limit(sent + 1).count() > sent:
        return df.distinct()
    match = ["_digest"]
    single = marked.join(F.broadcast(again), match, "left_anti").select(df.columns)
    return single.unionByName(marked.join(F.broadcast(again), match, "left_semi").select(df.columns).distinct())


def merge_all(first: DataFrame, others: Sequence[tuple[DataFrame, Sequence[str], str | None]], on: Sequence[str]) -> DataFrame:
    """A chain of full 1:1 merges on one key, with one exchange whatever its length.

    Each of ``others`` is a table, the columns taken from it, and a name for its origin marker
    (1 only in those before, 2 only in it, 3 both) or None. The tables are stacked and every
    key's rows brought together once, in place of a join after each other. Of columns in
    several tables the first one that has a row of the key wins. A missing key matches a
    missing key. A key that occurs twice in a table raises an error when the rows are read.
    """
    tables = [(first, [c for c in first.columns if c not in on], None), *[(t, list(c), m) for t, c, m in others]]
    kinds = [{c: t.schema[c].dataType for c in cols} for t, cols, _ in tables]
    stacked = None
    for k, (t, cols, _) in enumerate(tables):
        row = F.struct(F.lit(1).alias("_in"), *[F.col(f"`{c}`") for c in cols])
        empty = [F.lit(None).cast(_row_type(kinds[j])).alias(f"_t{j}") for j in range(len(tables)) if j != k]
        part = t.select(*on, row.cast(_row_type(kinds[k])).alias(f"_t{k}"), *empty)
        stacked = part if stacked is None else stacked.unionByName(part)
    own = [F.first(f"_t{k}", ignorenulls=True).alias(f"_t{k}") for k in range(len(tables))]
    times = [F.count(f"_t{k}").alias(f"_n{k}") for k in range(len(tables))]
    found = stacked.groupBy(*on).agg(*own, *times)
    several = F.greatest(*[F.col(f"_n{k}") for k in range(len(tables))]) > 1
    found = found.filter(F.when(several, F.raise_error(F.lit(f"{list(on)} is not a key"))).otherwise(F.lit(True)))
    has = [F.col(f"_n{k}") > 0 for k in range(len(tables))]
    order = list(dict.fromkeys(c for _, cols, _ in tables for c in cols))
    columns = []
    for c in order:
        value = None
        for k in reversed(range(len(tables))):
            if c in kinds[k]:
                own_value = F.col(f"_t{k}.`{c}`")
                value = own_value if value is None else F.when(has[k], own_value).otherwise(value)
        columns.append(value.alias(c))
    before = has[0]
    for k, (_, _, marker) in enumerate(tables[1:], 1):
        if marker:
            columns.append(F.when(before & has[k], 3).when(before, 1).when(has[k], 2).alias(marker))
        before = before | has[k]
    return found.select(*on, *columns)


def _row_type(kinds: dict) -> str:
    return "struct<_in:int" + "".join(f",`{c}`:{k.simpleString()}" for c, k in kinds.items()) + ">"


def merge(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    kind: str = "1:1",
    keep: Iterable[int] = (1, 2, 3),
    keepusing: Sequence[str] | None = None,
    marker: str | None = None,
    strict: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join two tables on ``on``.

    ``kind`` states on which side ``on`` is a key (``1:1``, ``m:1``, ``m:m``) and is
    checked when ``strict``. ``keep`` lists the origins kept: 1 only left, 2 only right,
    3 both; ``marker`` names a column to hold it. Of columns in both tables the left one
    wins where the left row exists. A missing key matches a missing key.
    """
    keep = frozenset(keep)
    if keepusing is not None:
        right = right.select(*on, *keepusing)
    if strict and kind in ("1:1", "m:1"):
        check_unique(right, on, strict=True)
    if strict and kind == "1:1":
        check_unique(left, on, strict=True)
    rest_left = [c for c in left.columns if c not in on]
    shared = [c for c in right.columns if c not in on and c in rest_left]
    only_right = [c for c in right.columns if c not in on and c not in rest_left]

    if kind == "m:1" and keep <= {1, 3}:
        side = right.select(*on, *only_right, F.lit(1).alias("_both"))
        out = lookup(left, side, on, "inner" if keep == {3} else "left", hot_rows)
        origin = F.when(F.col("_both").isNull(), F.lit(1)).otherwise(F.lit(3))
        if keep == {1}:
            out = out.filter(F.col("_both").isNull())
        mark = [origin.alias(marker)] if marker else []
        return out.select(*left.columns, *only_right, *mark)

    base = left.withColumn("_in_left", F.lit(1))
    how = {
        frozenset({3}): "inner",
        frozenset({1, 3}): "left",
        frozenset({2, 3}): "right",
    }.get(keep, "full")
    mine = F.lit(1).alias("_in_right")
    if kind == "m:m":
        # the only kind in which a hot key meets a hot key
        side = right.select(*on, *[F.col(c).alias(f"_r_{c}") for c in right.columns if c not in on], mine)
        joined = many_join(base, side, on, how, hot_rows).withColumns({f"_r_{c}": F.col(c) for c in on})
    else:
        side = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns], mine)
        joined = base.join(side, same_key(base, side, [(c, f"_r_{c}") for c in on]), how)
    has_left, has_right = F.col("_in_left").isNotNull(), F.col("_in_right").isNotNull()
    origin = F.when(has_left & has_right, 3).when(has_left, 1).otherwise(2)
    if how == "full" and keep != {1, 2, 3}:
        joined = joined.filter(origin.isin(*sorted(keep)))
    either = {c: F.when(has_left, F.col(c)).otherwise(F.col(f"_r_{c}")).alias(c) for c in [*on, *shared]}
    return joined.select(
        *[either.get(c, F.col(c)) for c in left.columns],
        *[F.col(f"_r_{c}").alias(c) for c in only_right],
        *([origin.alias(marker)] if marker else []),
    )
