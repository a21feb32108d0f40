"""Joins of many rows with many, chains of merges, distinct rows by digest, tables laid out by a key."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from fairtender.operators.layout import bucketed, forget
from fairtender.operators.merge import distinct_rows, merge, merge_all
from fairtender.operators.skew import _grid, many_join


def sides(spark):
    """A key with a third of both sides, one hot on the left only, one on the right only, missing keys."""
    rng = random.Random(1)
    left = [(0, "a", i) for i in range(60)] + [(1, "a", i) for i in range(40)] + [(None, "b", i) for i in range(30)] + [(rng.randrange(5, 30), rng.choice("ab"), i) for i in range(60)]
    right = [(0, "a", -i) for i in range(50)] + [(2, "a", -i) for i in range(45)] + [(None, "b", -i) for i in range(20)] + [(rng.randrange(5, 30), rng.choice("ab"), -i) for i in range(50)]
    left += left[:5]  # repeated rows
    return left, right, spark.createDataFrame(left, "k int, g string, x int").repartition(3), spark.createDataFrame(right, "k int, g string, y int").repartition(4)


def plain(left, right, how):
    out = [(*a, b[2]) for a, b in product(left, right) if a[:2] == b[:2]]
    if how in ("left", "full"):
        out += [(*a, None) for a in left if not any(a[:2] == b[:2] for b in right)]
    if how in ("right", "full"):
        out += [(*b[:2], None, b[2]) for b in right if not any(a[:2] == b[:2] for a in left)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("hot_rows", [7, 42, 5_000_000])
def test_many_to_many(spark, how, hot_rows):
    left, right, a, b = sides(spark)
    got = many_join(a, b, ["k", "g"], how, hot_rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(left, right, how)


@pytest.mark.parametrize("keep,how", [({3}, "inner"), ({1, 3}, "left"), ({2, 3}, "right"), ({1, 2, 3}, "full")])
def test_merge_with_hot_keys(spark, keep, how):
    left, right, a, b = sides(spark)
    plain_way, hot_way = (merge(a, b.withColumn("x", F.lit(9)), ["k", "g"], "m:m", keep, marker="_m", hot_rows=n) for n in (5_000_000, 9))
    rows = sorted((tuple(r) for r in hot_way.collect()), key=repr)
    assert rows == sorted((tuple(r) for r in plain_way.collect()), key=repr) and len(rows) == len(plain(left, right, how))


def test_a_hot_key_lies_in_many_tasks(spark):
    n, hot_rows = 3000, 100
    a = spark.range(n).selectExpr("case when id % 3 = 0 then 0 else id end k", "id x")
    b = spark.range(n).selectExpr("case when id % 3 = 0 then 0 else -id end k", "id y")
    hot = spark.createDataFrame([(0, 10, 10)], "_h0 long, _rows int, _cols int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as it is, it would be put together
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = _grid(a, b, ["k"], hot).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["count"] for r in cells) == 1000 * 1000
    assert len(cells) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in cells) < 300_000
    assert many_join(a, b, ["k"], "inner", hot_rows).count() == 1000 * 1000


# ---- chains ------------------------------------------------------------------------------


def chain(spark):
    first = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (3, None)], "k int, v string")
    second = spark.createDataFrame([(2, 20, "x"), (4, 40, "y"), (None, 50, "z")], "k int, n int, v string")
    third = spark.createDataFrame([(1, 1.5), (4, None), (5, 2.5)], "k int, d double")
    return first, second, third


def test_chain_equals_merges(spark):
    first, second, third = chain(spark)
    step = merge(first, second, ["k"], marker="m1")
    want = merge(step, third, ["k"], marker="m2")
    got = merge_all(first, [(second, ["n", "v"], "m1"), (third, ["d"], "m2")], ["k"])
    cols = ["k", "v", "n", "d", "m1", "m2"]
    assert sorted(map(repr, got.select(cols).collect())) == sorted(map(repr, want.select(cols).collect()))


def test_chain_moves_each_table_once(spark):
    first, second, third = chain(spark)
    plan = merge_all(first, [(second, ["n"], None), (third, ["d"], None), (third.withColumnRenamed("d", "e"), ["e"], None)], ["k"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_chain_wants_a_key(spark):
    first, second, third = chain(spark)
    with pytest.raises(Exception, match="is not a key"):
        merge_all(first, [(second.unionByName(second), ["n"], None)], ["k"]).collect()


def test_laid_out_tables_stay_where_they_are(spark):
    a = bucketed(spark.range(500).selectExpr("id % 50 k", "id x"), ["k"], 4)
    b = bucketed(spark.range(60).selectExpr("id k", "-id y"), ["k"], 4)
    c = bucketed(spark.range(60).selectExpr("id k", "-id z"), ["k"], 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.join(b, "k", "left").join(c, "k", "left").groupBy("k").agg(F.sum("x").alias("x"), F.min("y").alias("y"), F.min("z").alias("z"))
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, joined.collect())) == [(k, sum(range(k, 500, 50)), -k, -k) for k in range(50)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    names = {t.name for t in spark.catalog.listTables()}
    for t in (a, b, c):
        forget(t)
    left = {t.name for t in spark.catalog.listTables()}
    assert len(names - left) == 3 and a.count() == 500


# ---- distinct rows -----------------------------------------------------------------------


def wide(spark):
    rng = random.Random(2)
    rows = [(i if i % 7 else None, "text " * 200 + str(i) if i % 5 else None, float(i) if i % 3 else None) for i in range(300)]
    rows += rng.sample(rows, 40) * 3 + [(None, None, None)] * 9
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "a int, b string, c double").repartition(6)


@pytest.mark.parametrize("sent", [10**6, 10])
def test_distinct_rows(spark, sent):
    rows, df = wide(spark)
    assert sorted(map(repr, (tuple(r) for r in distinct_rows(df, sent=sent).collect()))) == sorted(map(repr, set(rows)))
    assert distinct_rows(df.limit(0)).count() == 0


def test_clashing_digests_lose_no_row(spark):
    rows, df = wide(spark)
    got = distinct_rows(df, digest=F.coalesce(F.col("a") % 3, F.lit(9)))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, set(rows)))


def test_rows_that_differ_do_not_move(spark, tmp_path):
    """Of wide texts a tenth of the bytes at most is shuffled."""
    spark.range(4000).selectExpr("id", "concat_ws(' ', transform(sequence(1, 300), i -> sha2(cast(id * 1000 + i as string), 256))) t").write.parquet(str(tmp_path / "w"))
    df = spark.read.parquet(str(tmp_path / "w"))

    def shuffled(make):
        tracker = spark.sparkContext._jsc.sc().statusStore()
        seen = {s.stageId() for s in _stages(tracker)}
        make().agg(F.sum(F.length("t"))).collect()
        return sum(s.shuffleWriteBytes() for s in _stages(tracker) if s.stageId() not in seen)

    assert 10 * shuffled(lambda: distinct_rows(df)) < shuffled(df.distinct)


def _stages(store):
    found = store.stageList(None)
    return [found.apply(i) for i in range(found.size())]
