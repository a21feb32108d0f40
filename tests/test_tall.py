"""Least squares by orthogonal factors against numpy, where cross products fail and where they do not."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairtender.functions.draws import key_hash, replicate_weights
from fairtender.operators import regress as rg
from fairtender.operators import tall


@pytest.fixture(scope="module")
def local():
    rng = np.random.default_rng(8)
    n = 1500
    a = rng.normal(size=n) * 1000 + 5000
    frame = pd.DataFrame({"k": np.arange(n), "a": a, "near": a + rng.normal(size=n) * 1e-3, "c": rng.normal(size=n), "f": [f"hot" if i % 3 else f"l{i % 41}" for i in range(n)]})
    frame["same"] = 2 * frame.a - frame.c
    frame["y"] = 3 * frame.a - 2 * frame.near + frame.c + rng.normal(size=n)
    return frame


@pytest.fixture(scope="module")
def rows(spark, local):
    return spark.createDataFrame(local).repartition(9).cache()


def by_pos(tidy):
    return tidy.toPandas().sort_values("pos").reset_index(drop=True)


def design(local, absorb):
    x = np.column_stack([np.ones(len(local)), local.a, local.near, local.c])
    return np.column_stack([x, pd.get_dummies(local.f, drop_first=True).to_numpy(float)]) if absorb else x


def scaled_lstsq(x, y, w=None):
    s = np.sqrt(np.ones(len(y)) if w is None else w)
    size = np.sqrt((x**2).sum(axis=0))
    return np.linalg.lstsq(x / size * s[:, None], y * s, rcond=1e-15)[0] / size


@pytest.mark.parametrize("hot_rows", [10**6, 30])
@pytest.mark.parametrize("absorb", [[], ["f"]])
def test_nearly_collinear_terms(rows, local, absorb, hot_rows):
    """Two terms that differ by a part in a million: kept, with the coefficients of the rows."""
    out = by_pos(rg.fit(rows, "y", rg.numeric("a", "near", "c"), absorb, hot_rows=hot_rows, method="qr"))
    x = design(local, absorb)
    b = scaled_lstsq(x, local.y.to_numpy())
    np.testing.assert_allclose(out.coef[1:], b[1:4], rtol=1e-5)
    r = local.y - x @ b
    df_m = np.linalg.matrix_rank(x / np.sqrt((x**2).sum(axis=0)), tol=1e-9) - 1
    assert out.df_m[0] == df_m and out.N[0] == len(local)
    assert out.r2[0] == pytest.approx(1 - (r @ r) / ((local.y - local.y.mean()) ** 2).sum(), rel=1e-9)
    deviations = x[:, 1:4] - (local.groupby("f")[["a", "near", "c"]].transform("mean").to_numpy() if absorb else x[:, 1:4].mean(axis=0))
    q = np.linalg.inv(np.linalg.qr(deviations, mode="r"))
    se = np.sqrt((r @ r) / (len(local) - df_m - 1) * (q**2).sum(axis=1))
    np.testing.assert_allclose(out.stderr[1:], se, rtol=1e-4)
    assert np.isnan(by_pos(rg.fit(rows, "y", rg.numeric("a", "near", "c"), absorb)).coef[2])  # cross products lose it


@pytest.mark.parametrize("absorb", [[], ["f"]])
def test_the_same_as_cross_products(rows, absorb):
    """Where terms are well apart both ways agree, constant, left-out terms and replicate errors included."""
    terms = rg.numeric("a", "c", "same")
    for reps in (0, 3):
        one, other = (by_pos(rg.fit(rows, "y", terms, absorb, key=["k"], reps=reps, hot_rows=50, method=m)) for m in ("qr", "gram"))
        assert np.isnan(one.coef[3]) and np.isnan(other.coef[3])
        for c in ("coef", "stderr", "pval", "N", "r2", "df_m"):
            np.testing.assert_allclose(one[c].to_numpy(float), other[c].to_numpy(float), rtol=1e-5, equal_nan=True)


def test_replicates(rows, local):
    out = by_pos(rg.fit(rows, "y", rg.numeric("a", "near", "c"), key=["k"], reps=3, method="qr"))
    w = replicate_weights(rows.select("k", key_hash(42, ["k"]).alias("h")).toPandas().sort_values("k").h.to_numpy(), 1, 3)
    coefs = np.array([scaled_lstsq(design(local, []), local.y.to_numpy(), w[:, r]) for r in range(3)])
    np.testing.assert_allclose(out.stderr[1:], coefs.std(axis=0)[1:], rtol=1e-3)


def test_models_and_missing_rows(rows):
    lacking = rows.withColumn("c", F.when(F.col("k") % 10 == 0, None).otherwise(F.col("c")))
    joint = rg.fit(lacking, "y", rg.numeric("a", "c"), model=F.col("k") % 3, method="qr").toPandas()
    for m in range(3):
        alone = by_pos(rg.fit(lacking.filter(F.col("k") % 3 == m), "y", rg.numeric("a", "c"), method="qr"))
        np.testing.assert_allclose(joint[joint.model == str(m)].sort_values("pos").coef, alone.coef, rtol=1e-9)
    with pytest.raises(ValueError):
        rg.fit(rows, "y", rg.numeric("a"), method="svd")


def test_factors_merge_in_a_tree(spark, monkeypatch):
    """Many factors of one key: the same as of all rows, and none meets more than a few others at a time."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 5))
    parts = [("m", 0, tall.WITHIN, None, 3.0, 1.0, bytearray(np.ascontiguousarray(tall.triangle(x[i : i + 3])).tobytes())) for i in range(0, 900, 3)]
    monkeypatch.setattr(tall, "TOGETHER", 7)
    made = tall.merge_factors(spark.createDataFrame(parts, tall.FACTORS_SQL).repartition(5)).collect()
    assert len(made) == 1 and made[0].rows == 900 and made[0].levels == 300
    r = np.frombuffer(made[0].r).reshape(5, 5)
    np.testing.assert_allclose(r.T @ r, x.T @ x, rtol=1e-9)


def test_solve_triangle():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 6))
    x[:, 3] = x[:, 1] - 2 * x[:, 2]
    coef, _, rss, kept = tall.solve_triangle(tall.triangle(x), 0)
    assert kept.tolist() == [True, True, True, False, True]
    b = np.linalg.lstsq(x[:, [0, 1, 2, 4]], x[:, 5], rcond=None)[0]
    np.testing.assert_allclose(coef[kept], b)
    assert rss == pytest.approx(((x[:, 5] - x[:, [0, 1, 2, 4]] @ b) ** 2).sum())
