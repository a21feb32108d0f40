"""Exact quantiles by rank selection: rounds of ever narrower ranges of values, no range gathered until it is small.

A sketch proposes a range of values around each rank; exact counts below and inside it tell
whether the rank lies there. The next sketch looks inside. Each round is one aggregate over all
columns and ranks, combined on the map side, and leaves a few thousandths of a range. What meets
in one task at the end are the values of ranges of at most ``FEW`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rows of a range that is sorted at once, and the sketch's accuracy (ranks are off by a part in so many)
FEW, ACCURACY = 50_000, 5_000


@dataclass
class _Range:
    """Where the value of ``rank`` (from 0) lies: between ``low`` and ``high``, both included."""

    column: str
    rank: int
    low: float
    high: float
    below: int
    inside: int
    accuracy: int = ACCURACY

    def settled(self) -> bool:
        return _same(self.low, self.high)

    def span(self) -> tuple:
        return self.column, self.low, self.high


def _same(a: float, b: float) -> bool:
    return a == b or (math.isnan(a) and math.isnan(b))


def _after(a: float, b: float) -> bool:
    """Greater, not-a-number being the greatest."""
    return not _same(a, b) and (math.isnan(a) or a > b)


def _within(r: _Range) -> Column:
    x = F.col(f"`{r.column}`")
    return (x >= F.lit(r.low)) & (x <= F.lit(r.high))


def _narrowed(df: DataFrame, open_: list[_Range]) -> None:
    """One round: a sketch inside each range, then exact counts for what it proposes."""
    # ranks that lie in one range share its sketch
    spans: dict[tuple, list[_Range]] = {}
    for r in open_:
        spans.setdefault((*r.span(), r.accuracy), []).append(r)
    asked = []
    for k, shared in enumerate(spans.values()):
        edges = []
        for r in shared:
            at, slack = (r.rank - r.below + 0.5) / r.inside, 2.0 / r.accuracy
            edges += [F.lit(max(0.0, at - slack)), F.lit(min(1.0, at + slack))]
        first = shared[0]
        asked.append(F.percentile_approx(F.when(_within(first), F.col(f"`{first.column}`")), F.array(*edges), F.lit(first.accuracy)).alias(f"p{k}"))
    proposed = df.agg(*asked).first()
    open_ = [r for shared in spans.values() for r in shared]
    ends = [tuple(proposed[f"p{k}"][2 * i : 2 * i + 2]) for k, shared in enumerate(spans.values()) for i in range(len(shared))]
    counts = []
    for k, (r, (a, b)) in enumerate(zip(open_, ends, strict=True)):
        x = F.col(f"`{r.column}`")
        counts += [F.count_if(_within(r) & (x < F.lit(a))).alias(f"b{k}"), F.count_if(_within(r) & (x >= F.lit(a)) & (x <= F.lit(b))).alias(f"i{k}")]
    found = df.agg(*counts).first()
    for k, (r, (a, b)) in enumerate(zip(open_, ends, strict=True)):
        before, below, inside = r.span(), r.below + found[f"b{k}"], found[f"i{k}"]
        if r.rank < below:  # the sketch was off: the value is smaller than its range, or greater
            r.high, r.inside = a, below - r.below
        elif r.rank >= below + inside:
            r.low, r.inside, r.below = b, r.inside - (below + inside - r.below), below + inside
        else:
            r.low, r.high, r.below, r.inside = a, b, below, inside
        if r.span() == before:
            r.accuracy = min(4 * r.accuracy, 1 << 24)


def select_ranks(df: DataFrame, ranks: dict[str, Sequence[int]], few: int = FEW) -> dict[tuple[str, int], float]:
    """The values of the stated ranks (from 0, missing values left out) of double columns.

    ``df`` is read once per round: stage it first.
    """
    ranks = {c: r for c, r in ranks.items() if len(r)}
    if not ranks:
        return {}
    edges = df.agg(*[f(f"`{c}`").alias(f"{n}{k}") for k, c in enumerate(ranks) for n, f in (("n", F.count), ("low", F.min), ("high", F.max))]).first()
    every = []
    for k, (c, wanted) in enumerate(ranks.items()):
        n = edges[f"n{k}"]
        every += [_Range(c, r, edges[f"low{k}"], edges[f"high{k}"], 0, n) for r in sorted(set(wanted)) if 0 <= r < n]
    while True:
        open_ = [r for r in every if not r.settled() and r.inside > few]
        if not open_:
            break
        _narrowed(df, open_)
    short = [r for r in every if not r.settled()]
    if short:
        values = [F.sort_array(F.collect_list(F.when(_within(r), F.col(f"`{r.column}`"))))[r.rank - r.below].alias(f"v{k}") for k, r in enumerate(short)]
        found = df.agg(*values).first()
        for k, r in enumerate(short):
            r.low = found[f"v{k}"]
    return {(r.column, r.rank): r.low for r in every}


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], few: int = FEW) -> dict[str, list[float | None]]:
    """Exact quantiles, linear between the two nearest ranks; None where a column has no value."""
    sizes = df.agg(*[F.count(f"`{c}`").alias(f"n{k}") for k, c in enumerate(columns)]).first()
    places = {c: [p * (sizes[f"n{k}"] - 1) if sizes[f"n{k}"] else None for p in probabilities] for k, c in enumerate(columns)}
    wanted = {c: [r for at in places[c] if at is not None for r in (math.floor(at), math.ceil(at))] for c in columns}
    value = select_ranks(df, wanted, few)

    def between(c: str, at: float | None) -> float | None:
        if at is None:
            return None
        low, high = math.floor(at), math.ceil(at)
        a, b = value[c, low], value[c, high]
        return a if low == high or _same(a, b) else (high - at) * a + (at - low) * b

    return {c: [between(c, at) for at in places[c]] for c in columns}
