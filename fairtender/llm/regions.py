"""Joining sets inside Voronoi regions, exactly, by their differences from the pivot.

For sets x, y and a pivot P the difference of x and y is the difference of their differences
from P. So near its pivot a set is as good as its difference from it, which is small, and two
sets link when these differences agree in all but a few n-grams. A set that does not link with
the pivot differs from it in more than a link allows, hence shares n-grams of its difference
with every partner (at least ``o``), and one of the ``size - o + 1`` rarest n-grams of it is
among them. Far from all its pivots a set stands for itself, as if the pivot were empty.

Distances to the pivot tell near from far. By the triangle inequality a partner of a near set
is not much farther than it, and one of a far set not much nearer: sets in these windows,
on the boundary, are put into both joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtender.llm.staging import keep, release
from fairtender.llm.words import lean

#: part of the sizes of set and pivot up to which their difference counts as near
NEAR = 0.5
#: pairs of members compared at once, and pairs held before they are sent
AT_ONCE, HELD = 2_000_000, 500_000


def is_near(least: int, out_of: int) -> tuple[Column, Column, Column]:
    """Of members (n, apart: their difference from the pivot, pivot_n): whether they are near, and
    whether they can be partners of near and of far ones."""
    n, apart, pivot_n = (F.col(c).cast("double") for c in ("n", "apart", "pivot_n"))
    ratio, theta = out_of / least, (out_of - least) / (out_of + least)
    near = apart <= NEAR * (n + pivot_n)
    slack = theta * n * (1 + ratio) + 1e-6
    with_near = apart <= NEAR * (n * ratio + pivot_n) + slack
    with_far = apart >= NEAR * (n / ratio + pivot_n) - slack
    return near, with_near, with_far


def exploded(column: str):
    """A row per n-gram of packed arrays: pivot, name, gram."""
    schema = pa.schema([("pivot", pa.int64()), ("name", pa.int64()), ("gram", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.frombuffer(b, np.int64) for b in batch.column(column).to_pylist()]
            sizes = [len(g) for g in grams]
            if sum(sizes):
                heads = [np.repeat(batch.column(c).to_numpy(), sizes) for c in ("pivot", "name")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*heads, np.concatenate(grams))], schema=schema)

    return run


def ordered_grams(members: DataFrame, column: str) -> DataFrame:
    """Members' n-grams that others of the pivot have, too: pivot, name, gram, pos.

    ``pos`` is the place in the order from the rarest to the most frequent n-gram of the pivot's members;
    n-grams nobody else has come first and are counted only. ``members`` has pivot, name,
    size and the packed n-grams.
    """
    rows = members.mapInArrow(lean(exploded(column)), "pivot long, name long, gram long")
    shared = rows.groupBy("pivot", "gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    held = rows.join(shared, ["pivot", "gram"]).groupBy("pivot", "name").agg(F.sort_array(F.collect_list(F.struct("c", "gram"))).alias("grams"))
    sized = held.join(members.select("pivot", "name", "size"), ["pivot", "name"])
    each = sized.select("pivot", "name", (F.col("size") - F.size("grams")).alias("alone"), F.posexplode("grams").alias("_at", "_g"))
    return each.select("pivot", "name", F.col("_g.gram").alias("gram"), (F.col("alone") + F.col("_at")).cast("int").alias("pos"))


_PAIRS = pa.schema([("pivot", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_ROW = ["pivot", "gram", "name", "label", "n", "size", "pos", "reach"]


def _met(least: int, out_of: int, heads: bool):
    """Pairs of differently labelled members that may link, from the n-grams they share.

    A member with a ``reach`` asks, within that many of its rarest n-grams. At the first n-gram
    that two have in common, in their order, the places tell how many more there can be.
    """
    both_of, theta = out_of + least, out_of - least

    def pairs(g: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        asks = np.flatnonzero(g["pos"] < g["reach"])
        if heads and len(asks):
            asks = asks[np.lexsort((g["name"][asks], g["size"][asks]))[:1]]
        step = max(1, AT_ONCE // max(1, len(g["name"])))
        left = g["size"] - g["pos"]
        for at in range(0, len(asks), step):
            some = asks[at : at + step]
            x = {c: v[some][:, None] for c, v in g.items()}
            fits = (x["label"] != g["label"]) & (np.minimum(x["n"], g["n"]) * out_of >= np.maximum(x["n"], g["n"]) * least)
            most = np.minimum(left[some][:, None], left)
            fits &= 2 * most * both_of >= (x["size"] + g["size"]) * both_of - theta * (x["n"] + g["n"])
            i, j = np.nonzero(fits)
            yield g["name"][some[i]], g["name"][j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, held, size = None, [], [], 0

        def sent() -> pa.RecordBatch:
            rows = np.unique(np.concatenate(held), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], schema=_PAIRS)

        def group() -> None:
            nonlocal size
            g = {c: np.concatenate([p[c] for p in parts]) for c in _ROW}
            if (g["label"] != g["label"][0]).any():
                for a, b in pairs(g):
                    low, high = np.minimum(a, b), np.maximum(a, b)
                    held.append(np.column_stack([np.full(len(low), key[0]), low, high]))
                    size += len(low)

        for batch in batches:
            columns = {c: batch.column(c).to_numpy() for c in _ROW}
            pivots, grams = columns["pivot"], columns["gram"]
            cuts = np.flatnonzero(np.r_[True, (pivots[1:] != pivots[:-1]) | (grams[1:] != grams[:-1])]) if len(pivots) else []
            for a, b in zip(cuts, [*cuts[1:], len(pivots)]):
                now = (pivots[a], grams[a])
                if now != key and parts:
                    group()
                    parts = []
                    if size > HELD:
                        yield sent()
                        held, size = [], 0
                key = now
                parts.append({c: v[a:b] for c, v in columns.items()})
        if parts:
            group()
        if size:
            yield sent()

    return run


def placed_members(members: DataFrame, column: str, reach: Column, all_ask: bool = False) -> DataFrame:
    """Members by the n-grams they share with others of the pivot, written: one row per member and n-gram.

    ``members`` has pivot, name, n, size and packed n-grams; ``reach`` is how many of its
    rarest n-grams a member must ask with (0: it only answers, with all of its own). If
    ``all_ask``, every member's reach holds an n-gram of any partner's reach, and no more is looked at.
    """
    asked = keep(members.withColumn("reach", reach.cast("int")), "members")
    rows = ordered_grams(asked, column).join(asked.select("pivot", "name", "n", "size", "reach"), ["pivot", "name"])
    placed = keep(rows.filter("pos < reach") if all_ask else rows, "placed")
    release(asked)
    return placed


def meeting_pairs(placed: DataFrame, labels: DataFrame, least: int, out_of: int, heads: bool) -> DataFrame:
    """Pairs (pivot, a, b: names) of members of a pivot with different labels that may link.

    With ``heads`` only those of each n-gram's members with one of them; linked members get one
    label that way, so that fewer pairs are left.
    """
    own = placed.join(labels.select("name", "label"), "name", "left").withColumn("label", F.coalesce("label", "name"))
    dealt = own.select(*_ROW).repartition("pivot", "gram").sortWithinPartitions("pivot", "gram")
    return keep(dealt.mapInArrow(lean(_met(least, out_of, heads)), "pivot long, a long, b long").distinct(), "pairs")


def near_reach(least: int, out_of: int) -> Column:
    """Of near members that do not link with the pivot: how many of the rarest n-grams of their difference they ask with."""
    both_of = out_of + least
    shared = F.ceil((F.col("apart") * both_of - (out_of - least) * (F.col("n") + F.col("pivot_n"))) / (2 * both_of))
    return F.col("apart") - F.greatest(shared, F.lit(1)) + 1


def far_reach(least: int, out_of: int) -> Column:
    """Of whole sets: how many of their rarest n-grams, one of which any partner has."""
    return F.col("n") - F.ceil(F.col("n") * least / out_of) + 1
