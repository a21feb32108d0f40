"""Group-wise operators with hot keys must give what they give without."""

import random

import pytest
from pyspark.sql import functions as F

from fairtender.operators import rows as rw
from fairtender.operators import shape
from fairtender.operators import skew as sk
from fairtender.operators.merge import NotAKey, check_unique, distinct_first, merge
from fairtender.operators.skew import attach_stats, lookup, number_rows


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    # one key has a third of the rows, one key is missing
    keys = [0] * 200 + [rng.randrange(1, 60) for _ in range(380)] + [None] * 20
    data = [(k, rng.randrange(5), i, rng.choice([None, 1.5, 2.0]), rng.randrange(2)) for i, k in enumerate(keys)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k int, o int, id int, v double, d int").cache()


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot_rows", [10, 50, 5_000_000])
@pytest.mark.parametrize("parts", [1, 7])
def test_number_rows(table, hot_rows, parts):
    data, df = table
    seen, expected = {}, []
    for k, o, i, _, _ in sorted(data, key=lambda r: (r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        expected.append((k, i, seen[k]))
    out = number_rows(df.repartition(parts), ["k"], ["o", "id"], "j", hot_rows)
    assert collected(out, "k", "id", "j") == sorted(expected, key=repr)
    assert dict(out.dtypes)["j"] == "bigint"


@pytest.mark.parametrize("hot_rows", [10, 5_000_000])
def test_number_whole_table(table, hot_rows):
    _, df = table
    out = number_rows(df, [], ["id"], "j", hot_rows)
    assert collected(out, "id", "j") == sorted(((i, i + 1) for i in range(600)), key=repr)


@pytest.mark.parametrize("hot_rows", [10, 50, 5_000_000])
def test_attach_stats(table, hot_rows):
    data, df = table
    groups = {}
    for k, *_, v, _ in data:
        n, s = groups.get(k, (0, 0.0))
        groups[k] = (n + 1, s + (v or 0.0))
    out = attach_stats(df, ["k"], {"n": F.count(F.lit(1)), "s": F.sum("v")}, hot_rows)
    assert out.count() == 600
    for r in out.collect():
        assert (r["n"], r["s"] or 0.0) == pytest.approx(groups[r["k"]])


@pytest.mark.parametrize("hot_rows", [10, 5_000_000])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup(spark, table, hot_rows, how):
    data, df = table
    names = {k: f"n{k}" for k in range(0, 60, 2)}
    right = spark.createDataFrame([*names.items(), (None, "none")], "k int, name string")
    out = lookup(df, right, ["k"], how, hot_rows)
    known = {**names, None: "none"}
    expected = [(i, known.get(k)) for k, _, i, _, _ in data if how == "left" or k in known]
    assert collected(out, "id", "name") == sorted(expected, key=repr)


@pytest.mark.parametrize("hot_rows", [10, 5_000_000])
def test_operators_agree(spark, table, hot_rows):
    _, df = table
    plain = 5_000_000
    pairs = [
        (rw.panel_filter(df, "k", "d", hot_rows), rw.panel_filter(df, "k", "d", plain)),
        (rw.drop_empty_if_filled(df, ["k"], "v", hot_rows), rw.drop_empty_if_filled(df, ["k"], "v", plain)),
        (rw.first_flag(df, ["k"], ["o", "id"], "f", hot_rows), rw.first_flag(df, ["k"], ["o", "id"], "f", plain)),
        (rw.sample_n_by(df, 30, ["k"], ["id"], 42, hot_rows), rw.sample_n_by(df, 30, ["k"], ["id"], 42, plain)),
        (shape.group_id(df, ["k", "o"], "g", hot_rows), shape.group_id(df, ["k", "o"], "g", plain)),
        (
            shape.to_wide_banded(df, ["k"], ["o", "id"], ["id"], 16, hot_rows),
            shape.to_wide_banded(df, ["k"], ["o", "id"], ["id"], 16, plain),
        ),
    ]
    for a, b in pairs:
        assert collected(a, *b.columns) == collected(b, *b.columns)


def test_sample_sizes(table):
    data, df = table
    out = rw.sample_n_by(df, 30, ["k"], ["id"], 42)
    sizes = {r["k"]: r["count"] for r in out.groupBy("k").count().collect()}
    for k in {r[0] for r in data}:
        assert sizes[k] == min(30, sum(r[0] == k for r in data))
    again = rw.sample_n_by(df.repartition(13), 30, ["k"], ["id"], 42)
    assert collected(out, "id") == collected(again, "id")


def test_wide_bands_keep_every_row(table):
    data, df = table
    wide = shape.to_wide_banded(df, ["k"], ["o", "id"], ["id"], 16)
    seen = [r[f"id{j}"] for r in wide.collect() for j in range(1, 17) if r[f"id{j}"] is not None]
    assert sorted(seen) == list(range(600))


def test_distinct_first_is_first(table):
    data, df = table
    out = distinct_first(df, ["k"], ["v", "id"])
    for r in out.collect():
        group = [x for x in data if x[0] == r["k"]]
        # a missing value sorts last
        best = min(group, key=lambda x: (x[3] is None, x[3] or 0.0, x[2]))
        assert r["id"] == best[2]


def test_merge_origins_and_missing_keys(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "b", None), (None, "c", 30)], "k int, l string, s int")
    right = spark.createDataFrame([(2, "x", 99), (3, "y", 98), (None, "z", 97)], "k int, r string, s int")
    full = {r["k"]: (r["l"], r["r"], r["s"], r["m"]) for r in merge(left, right, ["k"], marker="m", strict=True).collect()}
    # the left value stays, even a missing one; a missing key meets a missing key
    assert full == {1: ("a", None, 10, 1), 2: ("b", "x", None, 3), 3: (None, "y", 98, 2), None: ("c", "z", 30, 3)}
    for keep, ids in (({1, 3}, {1, 2, None}), ({3}, {2, None}), ({1}, {1}), ({2}, {3})):
        for kind in ("1:1", "m:1"):
            got = merge(left, right, ["k"], kind, keep).collect()
            assert {r["k"] for r in got} == ids, (keep, kind)


def test_strict_merge_refuses_copies(spark):
    left = spark.createDataFrame([(1,), (1,)], "k int")
    right = spark.createDataFrame([(1, 2)], "k int, v int")
    assert merge(left, right, ["k"], "m:1", {1, 3}, strict=True).count() == 2
    with pytest.raises(NotAKey):
        merge(left, right, ["k"], "1:1", strict=True)
    assert check_unique(left, ["k"]).first()["copies"] == 2


def test_empty_table(spark):
    empty = spark.createDataFrame([], "k int, o int, v double, d int")
    assert number_rows(empty, ["k"], ["o"], "j").count() == 0
    assert attach_stats(empty, ["k"], {"n": F.count("v")}).count() == 0
    assert rw.panel_filter(empty, "k", "d").count() == 0
    assert rw.sample_n_by(empty, 5, ["k"], ["o"]).count() == 0


def test_rows_are_dealt_over_as_many_tasks_as_they_need(spark, monkeypatch):
    """More rows than the session's partitions should sort go to more tasks, unless a key is hot."""
    df = spark.range(400).selectExpr("id % 90 AS k", "id AS v")
    monkeypatch.setattr(sk, "TASK_ROWS", 20)
    assert sk.dealt(df, ["k"]).rdd.getNumPartitions() == 20
    assert sk.dealt(df, ["k"], hot_rows=2).rdd.getNumPartitions() == df.rdd.getNumPartitions()
    wide = shape.to_wide_banded(df, ["k"], ["v"], ["v"], 3)
    assert wide.rdd.getNumPartitions() == 20
    assert sorted(v for r in wide.collect() for v in r[2:] if v is not None) == list(range(400))
