"""Exact quantiles against sorted values, with small ranges so that many rounds are needed."""

import math
import random

import pytest

from fairtender.operators import quantiles as qt

PROBABILITIES = (0.0, 0.1, 0.5, 1.0)


def plain(values, q):
    values = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    if not values:
        return None
    at = q * (len(values) - 1)
    low, high = math.floor(at), math.ceil(at)
    if low == high or values[low] == values[high]:
        return values[low]
    return (high - at) * values[low] + (at - low) * values[high]


def tables():
    rng = random.Random(3)
    n = 4000
    yield "uniform", [rng.random() for _ in range(n)]
    yield "wide", [math.copysign(10.0 ** rng.uniform(-200, 200), rng.random() - 0.5) for _ in range(n)]
    yield "one value with most rows", [7.0 if rng.random() < 0.7 else rng.gauss(0, 100) for _ in range(n)]
    yield "counts", [float(rng.randrange(12)) for _ in range(n)]
    yield "missing", [None if rng.random() < 0.3 else rng.gauss(0, 1) for _ in range(n)]
    yield "not numbers", [rng.choice([math.nan, math.inf, -math.inf, 1.0, 2.0, 0.0, -0.0]) for _ in range(2000)]
    yield "one", [3.5]
    yield "equal", [2.0] * 5000
    yield "none", [None, None]


@pytest.mark.parametrize("name,values", list(tables()), ids=[n for n, _ in tables()])
@pytest.mark.parametrize("few", [300, 10**6])
def test_quantiles(spark, name, values, few):
    df = spark.createDataFrame([(v, None) for v in values], "x double, y double").repartition(4).cache()
    got = qt.quantiles(df, ["x", "y"], PROBABILITIES, few=few)
    assert got["y"] == [None] * len(PROBABILITIES)
    for q, v in zip(PROBABILITIES, got["x"], strict=True):
        want = plain(values, q)
        assert (v is None and want is None) or v == want or (math.isnan(v) and math.isnan(want)), (q, v, want)


def test_a_poor_sketch_is_mended(spark, monkeypatch):
    """Counts, not sketches, decide where a rank lies."""
    monkeypatch.setattr(qt, "ACCURACY", 3)
    monkeypatch.setattr(qt._Range.__init__, "__defaults__", (3,))
    rng = random.Random(4)
    values = [rng.gauss(0, 1) ** 5 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3).cache()
    ranks = [0, 1500, 2998]
    assert qt.select_ranks(df, {"x": [*ranks, 5000]}, few=300) == {("x", r): sorted(values)[r] for r in ranks}


def test_millions_of_values(spark):
    """Millions of different doubles: nothing but ranges of few rows is sorted."""
    n = 3_000_000
    df = spark.range(n).selectExpr(f"cast((id * 7919) % {n} as double) / 3 as x")
    assert qt.quantiles(df, ["x"], (0.1, 0.5, 0.9)) == {"x": [plain_rank(q, n) for q in (0.1, 0.5, 0.9)]}


def plain_rank(q, n):
    at = q * (n - 1)
    low, high = math.floor(at), math.ceil(at)
    return low / 3 if low == high else (high - at) * (low / 3) + (at - low) * (high / 3)
