"""Families of models from one pass, and statistics that add up, against separate fits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairtender.checks.standin import saved_base
from fairtender.operators import family as fam
from fairtender.operators import regress as rg
from fairtender.plans import estimates as es
from fairtender.session import stage


@pytest.fixture(scope="module")
def rows(spark):
    """Rows with missing values of every kind, a hot level and a rare one."""
    rng = np.random.default_rng(5)
    n = 900
    data = []
    for i in range(n):
        lack = lambda share, value: None if rng.random() < share else value
        data.append((i, lack(0.03, "hot" if i % 3 else f"e{i % 37}"), lack(0.05, float(rng.normal())), lack(0.05, float(rng.normal())), float(i % 7), lack(0.02, float(rng.normal() + i % 7)), lack(0.1, 100 + i % 9)))
    return spark.createDataFrame(data, "k long, e string, a double, b double, c double, y double, t int").repartition(5)


def terms_of():
    return rg.numeric("a", "b", "c")


def tidy(df):
    return df.toPandas().sort_values(["model", "pos"]).reset_index(drop=True)


def alike(one, other, rtol=1e-8):
    a, b = tidy(one), tidy(other)
    assert a[["model", "pos", "var"]].equals(b[["model", "pos", "var"]])
    for c in ("coef", "stderr", "pval", "N", "r2", "df_m"):
        np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=rtol, atol=1e-9, equal_nan=True)


MODELS = [fam.model("1", ["a"]), fam.model("2", ["c", "b"]), fam.model("3", ["a", "b", "c"], absorbed=True)]


@pytest.mark.parametrize("reps,hot_rows", [(0, 10**6), (4, 10**6), (4, 20)])
def test_family_equals_separate_fits(rows, reps, hot_rows):
    """Each model uses the rows that are complete in its own columns."""
    run = dict(key=["k"], reps=reps, hot_rows=hot_rows)
    alone = rg.tidy_models(
        rg.fit(rows, "y", rg.numeric("a"), model="1", **run),
        rg.fit(rows, "y", rg.numeric("c", "b"), model="2", **run),
        rg.fit(rows, "y", terms_of(), ["e"], model="3", **run),
    )
    alike(fam.fit_family(rows, "y", terms_of(), MODELS, "e", ["k"], reps, hot_rows=hot_rows), alone)
    assert len({r.N for r in alone.collect()}) == 3


def test_absorbed_models_of_other_rows_are_refused(rows):
    with pytest.raises(Exception, match="fit it alone"):
        fam.fit_family(rows, "y", terms_of(), [fam.model("1", ["a"], absorbed=True)], "e").collect()


@pytest.mark.parametrize("absorb,reps", [("e", 3), ("e", 0), (None, 3)])
def test_update_equals_refit(rows, absorb, reps):
    """Statistics of parts that were made apart, written and added up."""
    models = MODELS if absorb else MODELS[:2]
    parts = [stage(fam.statistics(rows.filter(F.col("k") % 3 == r), "y", terms_of(), absorb, ["k"], reps, hot_rows=50)) for r in range(3)]
    updated = stage(fam.merged(stage(fam.merged(parts[0], parts[1])), parts[2]))
    alike(fam.solve_statistics(updated, terms_of(), models, bool(absorb), reps), fam.fit_family(rows, "y", terms_of(), models, absorb, ["k"], reps), 1e-7)
    assert updated.filter("level is null").count() == updated.select("model").distinct().count()


def test_statistics_of_no_rows(rows):
    none = fam.statistics(rows.limit(0), "y", terms_of(), "e", ["k"], 2)
    assert none.count() == 0 and fam.solve_statistics(none, terms_of(), MODELS, True, 2).count() == 0
    alike(fam.solve_statistics(fam.merged(none, fam.statistics(rows, "y", terms_of(), "e", ["k"], 2)), terms_of(), MODELS, True, 2), fam.fit_family(rows, "y", terms_of(), MODELS, "e", ["k"], 2))


def test_breaks_equal_copies_of_the_rows(rows):
    """A break after each of several times, from periods, as from a copy of the rows per break."""
    cuts, lists = [101, 103, 106], rows.filter("k % 11 <> 0")
    copies = rg.falsification(lists, "t", cuts)
    d = F.col("d_test").cast("double")
    terms = [*rg.numeric("a", "c"), ("d", d), ("c#d", F.col("c") * d)]
    want = rg.fit(copies, "y", terms, ["e"], F.col("cut"), key=["k"])
    timed = lists.withColumn("_p", fam.period(F.col("t"), cuts))
    after = [(f"p{k}", (F.col("_p") == k).cast("double")) for k in (1, 2, 3)]
    direct = [(f"c#{n}", F.col("c") * x) for n, x in after]
    models = fam.breaks(["a", "c"], cuts, [("d", [n for n, _ in after]), ("c#d", [n for n, _ in direct])])
    got = fam.fit_family(timed, "y", [*rg.numeric("a", "c"), *after, *direct], models, "e", ["k"])
    alike(got, want)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_base_is_read_once(spark, sf):
    base = saved_base(spark, sf)
    swept = plan(es.falsification_models(base, range(470, 481)))
    assert "Generate" not in swept and "Expand" not in swept
    # once for the rows; the sizes of levels, which come first, are used twice
    assert plan(es.report_models(base, 3)).count("Relation [") == swept.count("Relation [") == 3


def test_reporting_updates(spark, sf):
    base = saved_base(spark, sf)
    terms, models = es.report_design(base)
    early, late = (stage(es.report_statistics(base.filter(c), terms, 4)) for c in ("year_suscripcion < 2000", "year_suscripcion >= 2000"))
    both = fam.solve_statistics(fam.merged(early, late), terms, models, True, 4)
    a, b = tidy(both), tidy(es.report_models(base, 4))
    keep = ~pd.isna(b.coef)
    np.testing.assert_allclose(a.coef[keep], b.coef[keep], rtol=1e-5, atol=1e-9)
    np.testing.assert_allclose(a.stderr[keep], b.stderr[keep], rtol=1e-4, atol=1e-9)
