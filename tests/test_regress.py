"""Least squares against explicit dummies solved in numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairtender.checks.standin import contract_items
from fairtender.functions.draws import key_hash, replicate_weights
from fairtender.operators import regress as rg
from fairtender.operators import twoway as tw
from fairtender.operators.solve import normal_p, student_p

KEY = ["n_cod_contrato", "n_item", "codigoitem", "ruc_proveedor", "monto_contratado_item"]
Y = "monto_contratado_item"


@pytest.fixture(scope="module")
def items(spark, sf):
    return contract_items(spark, sf).filter("n_cod_contrato % 4 = 0").cache()


@pytest.fixture(scope="module")
def local(items):
    return items.withColumn("h", key_hash(42, KEY)).toPandas()


def columns(pdf, *factors):
    c, p = pdf.contratacion.to_numpy(float), pdf.d_pandemia.to_numpy(float)
    cols = [np.ones(len(pdf)), c, p, c * p, pdf.monto_contratado_total.to_numpy(float)]
    for f in factors:
        cols.append(pd.get_dummies(pdf[f].astype(str), drop_first=True).to_numpy(float))
    return np.column_stack(cols)


def solve(x, y, w=None):
    w = np.ones(len(y)) if w is None else w
    s = np.sqrt(w)
    b = np.linalg.lstsq(x * s[:, None], y * s, rcond=None)[0]
    r = y - x @ b
    return b, r


TERMS = lambda: [*rg.did_terms(), *rg.numeric("monto_contratado_total")]


def by_pos(tidy):
    return tidy.toPandas().sort_values("pos").reset_index(drop=True)


@pytest.mark.parametrize("absorb", [(), ("codigoentidad",), ("codigoentidad", "codigoitem")])
def test_coefficients_and_r2(items, local, absorb):
    out = by_pos(rg.fit(items, Y, TERMS(), absorb))
    x, y = columns(local, *absorb), local[Y].to_numpy(float)
    b, r = solve(x, y)
    np.testing.assert_allclose(out.coef, b[:5], rtol=1e-5)
    r2 = 1 - (r @ r) / ((y - y.mean()) @ (y - y.mean()))
    assert out.r2[0] == pytest.approx(r2, rel=1e-6)
    assert out.N[0] == len(y)
    # random pairs of factors are connected: one level of each is lost
    assert out.df_m[0] == np.linalg.matrix_rank(x) - 1
    if len(absorb) < 2:
        s2 = (r @ r) / (len(y) - np.linalg.matrix_rank(x))
        se = np.sqrt(s2 * np.diag(np.linalg.inv(x.T @ x)))[1:5]
        np.testing.assert_allclose(out.stderr[1:], se, rtol=1e-5)
        p = [student_p(t, len(y) - x.shape[1]) for t in b[1:5] / se]
        np.testing.assert_allclose(out.pval[1:], p, rtol=1e-4)


@pytest.mark.parametrize(
    "absorb,hot_rows",
    [((), 5_000_000), (("codigoentidad",), 5_000_000), (("codigoentidad",), 50), (("codigoentidad", "codigoitem"), 30)],
)
def test_bootstrap_errors(items, local, absorb, hot_rows):
    reps = 3
    out = by_pos(rg.fit(items, Y, TERMS(), absorb, key=KEY, reps=reps, hot_rows=hot_rows))
    x, y = columns(local, *absorb), local[Y].to_numpy(float)
    w = replicate_weights(local.h.to_numpy(), 1, reps)
    coefs = np.array([solve(x, y, w[:, r])[0][:5] for r in range(reps)])
    np.testing.assert_allclose(out.coef, solve(x, y)[0][:5], rtol=1e-5)
    np.testing.assert_allclose(out.stderr, coefs.std(axis=0), rtol=1e-4)
    np.testing.assert_allclose(out.pval, [normal_p(z) for z in out.coef / out.stderr], rtol=1e-9)


@pytest.mark.parametrize("hot_rows", [5_000_000, 30])
def test_two_large_factors(items, local, hot_rows, monkeypatch):
    """With no room for dummies both factors are projected out step by step."""
    monkeypatch.setattr(rg, "MAX_CELLS", 0)
    few = items.filter("n_cod_contrato % 16 = 0")
    part = local[local.n_cod_contrato % 16 == 0]
    out = by_pos(rg.fit(few, Y, TERMS(), ("codigoentidad", "tipoentidad"), key=KEY, reps=2, hot_rows=hot_rows))
    x, y = columns(part, "codigoentidad"), part[Y].to_numpy(float)
    w = replicate_weights(part.h.to_numpy(), 1, 2)
    coefs = np.array([solve(x, y, w[:, r])[0][1:5] for r in range(2)])
    np.testing.assert_allclose(out.coef[1:], solve(x, y)[0][1:5], rtol=1e-5)
    np.testing.assert_allclose(out.stderr[1:], coefs.std(axis=0), rtol=1e-4)


def test_crossed_large_factors(items, local, monkeypatch):
    monkeypatch.setattr(rg, "MAX_CELLS", 0)
    out = by_pos(rg.fit(items, Y, TERMS(), ("codigoentidad", "ruc_proveedor")))
    x, y = columns(local, "codigoentidad", "ruc_proveedor"), local[Y].to_numpy(float)
    b, r = solve(x, y)
    np.testing.assert_allclose(out.coef, b[:5], rtol=1e-5)
    assert out.r2[0] == pytest.approx(1 - (r @ r) / ((y - y.mean()) @ (y - y.mean())), rel=1e-6)


def test_factor_dummies_and_omitted_terms(items, local):
    months = rg.dummies("monthyear_suscripcion", rg.factor_levels(items, "monthyear_suscripcion"))
    out = by_pos(rg.fit(items, Y, [*months, *TERMS()], ["codigoentidad"]))
    x = columns(local, "codigoentidad", "monthyear_suscripcion")
    # months settle the break, so its main effect is left out
    b, _ = solve(np.delete(x, 2, axis=1), local[Y].to_numpy(float))
    got = out.set_index("var").coef
    assert math.isnan(got["1.d_pandemia"])
    for name, k in (("1.contratacion", 1), ("1.contratacion#1.d_pandemia", 2), ("monto_contratado_total", 3), ("_cons", 0)):
        assert got[name] == pytest.approx(b[k], rel=1e-5)
    first = local.monthyear_suscripcion.min()
    assert math.isnan(got[f"{first}.monthyear_suscripcion"])
    assert out.df_m[0] == np.linalg.matrix_rank(x) - 1


def test_models_by_label_are_separate_fits(items):
    joint = rg.fit(items, Y, TERMS(), ["codigoentidad"], F.col("objetocontractual"), KEY, 4).toPandas()
    for label in ("Bien", "Servicio", "Obra"):
        alone = by_pos(rg.fit(items.filter(F.col("objetocontractual") == label), Y, TERMS(), ["codigoentidad"], key=KEY, reps=4))
        part = joint[joint.model == label].sort_values("pos")
        np.testing.assert_allclose(part.coef, alone.coef, rtol=1e-8)
        np.testing.assert_allclose(part.stderr, alone.stderr, rtol=1e-8)


def test_same_errors_for_any_partitioning(items):
    runs = [by_pos(rg.fit(items.repartition(n), Y, TERMS(), key=KEY, reps=5)) for n in (1, 7, 64)]
    for other in runs[1:]:
        np.testing.assert_allclose(runs[0].stderr, other.stderr, rtol=1e-9)


def test_rows_with_missing_values_are_left_out(spark):
    rows = [(1.0, 1.0), (2.0, 2.0), (3.0, None), (None, 4.0), (4.0, 3.0)]
    out = by_pos(rg.fit(spark.createDataFrame(rows, "y double, x double"), "y", rg.numeric("x")))
    assert out.N[0] == 3
    assert out.coef[1] == pytest.approx(1.5)


def test_units_hold_every_row_once(spark):
    """Units are bounded, also where one pair has most of the rows, and hold one model each."""
    rows = [("m" if i % 3 else "k", "hot" if i % 4 else f"a{i % 9}", "hot" if i % 5 else f"b{i % 7}", i, [1.0, float(i)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "model string, level string, level2 string, hash long, v array<double>")
    order = ["model", "level", "hash"]
    made = df.repartitionByRange(4, *order).sortWithinPartitions(*order).mapInArrow(tw._units(2, 100), tw.UNIT_SQL).collect()
    assert len({r.unit for r in made}) == len(made)
    seen = []
    for r in made:
        unit = tw.Unit(r.asDict(), 2)
        assert 0 < len(unit.hash) <= 100 and (np.diff(unit.level) >= 0).all()
        seen += [(r.model, unit.levels[a], unit.nodes[b], int(h), float(v[1])) for a, b, h, v in zip(unit.level, unit.node, unit.hash, unit.v)]
    assert sorted(seen) == sorted((m, a, b, h, v[1]) for m, a, b, h, v in rows)


def test_two_factors_of_many_models_in_units(spark):
    """Small models in one unit each, a large one in many: the same as fits of their own."""
    rng = np.random.default_rng(11)
    rows = [("big" if i < 400 else f"s{i % 3}", f"a{rng.integers(40) if i % 3 else 0}", f"b{rng.integers(30) if i % 4 else 0}", float(rng.normal()), float(rng.normal()), i) for i in range(520)]
    df = spark.createDataFrame(rows, "m string, f string, g string, x double, y double, k long")
    design = df.select(F.col("m").alias("model"), rg.key_hash(42, ["k"]).alias("hash"), F.col("f").alias("level"), F.col("g").alias("level2"), F.array(F.lit(1.0), "x", "y").alias("v"))
    together = tw.cross_products_two(design, 3, 2, hot_rows=60).toPandas()
    alone = pd.concat([tw.cross_products_two(design.filter(F.col("model") == m), 3, 2).toPandas() for m in ("big", "s0", "s1", "s2")])
    keys = ["model", "rep", "kind", "i", "j"]
    both = together.merge(alone, on=keys, how="outer")
    assert len(both) == len(together) == len(alone)
    np.testing.assert_allclose(both.s_x, both.s_y, rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(both.x_x, both.x_y, rtol=1e-6, atol=1e-6)


def two_groups(spark):
    """Rows whose level pairs fall into two unconnected parts, and a long chain of pairs."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(15):
        rows += [(f"a{i}", f"b{i}"), (f"a{i}", f"b{i + 1}")]
    rows += [(f"c{i % 4}", f"d{i % 3}") for i in range(30)]
    data = [(a, b, float(x), float(y), k) for k, ((a, b), x, y) in enumerate(zip(rows * 2, rng.normal(size=120), rng.normal(size=120)))]
    return spark.createDataFrame(data, "f string, g string, x double, y double, k long")


def test_two_factors_agree_either_way(spark, monkeypatch):
    """Step by step and with dummies: the same coefficients, errors and degrees of freedom."""
    df = two_groups(spark)
    pdf = df.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf.x, pd.get_dummies(pdf.f).to_numpy(float), pd.get_dummies(pdf.g).to_numpy(float)])
    b = np.linalg.lstsq(x, pdf.y.to_numpy(), rcond=None)[0]
    ways = []
    # by elimination, by conjugate gradients in one unit and over many, and with dummies
    for cells, direct, hot_rows in ((0, 1500, 10**6), (0, 0, 10**6), (0, 0, 7), (rg.MAX_CELLS, 0, 10**6)):
        monkeypatch.setattr(rg, "MAX_CELLS", cells)
        monkeypatch.setattr(tw, "DIRECT", direct)
        ways.append(by_pos(rg.fit(df, "y", rg.numeric("x"), ("f", "g"), hot_rows=hot_rows)))
    for out in ways:
        assert out.coef[1] == pytest.approx(b[1], rel=1e-6)
        assert out.df_m[0] == np.linalg.matrix_rank(x) - 1
    for other in ways[1:]:
        assert ways[0].stderr[1] == pytest.approx(other.stderr[1], rel=1e-6)
        np.testing.assert_allclose(ways[0].coef, other.coef, rtol=1e-6)


def test_no_progress_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(rg, "MAX_CELLS", 0)
    monkeypatch.setattr(tw, "PATIENCE", 0)
    monkeypatch.setattr(tw, "TOLERANCE", 0.0)
    monkeypatch.setattr(tw, "DIRECT", 0)
    with pytest.raises(RuntimeError):
        rg.fit(two_groups(spark).limit(60), "y", rg.numeric("x"), ("f", "g"))


def test_hot_level_of_a_binary_outcome(spark):
    """Its rows go to many tasks although the outcome has two values."""
    rows = [("hot" if i % 3 else f"l{i % 50}", float(i % 2), float(i % 7), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "f string, y double, x double, k long")
    hashes = [c for c in (rg.key_hash(42, ["k"]),)]
    assert df.filter("f = 'hot'").select(F.pmod(hashes[0], F.lit(1009))).distinct().count() > 500
    plain, split = (by_pos(rg.fit(df, "y", rg.numeric("x"), ["f"], key=["k"], hot_rows=n)) for n in (5_000_000, 50))
    np.testing.assert_allclose(plain.coef, split.coef)
    np.testing.assert_allclose(plain.stderr[1:], split.stderr[1:])


def test_weights_average_one(items):
    out = rg.scaled_weights(rg.boot_weights(items, KEY, 7), reps=7).select("rw").toPandas()
    w = np.array(out.rw.tolist())
    np.testing.assert_allclose(w.mean(axis=0), 1.0, rtol=1e-9)
    assert abs(w.std() - 1) < 0.05
    assert abs(np.corrcoef(w.T)[0, 1]) < 0.08


@pytest.mark.parametrize("t,df,p", [(2.0, 10, 0.0733880), (0.5, 3, 0.6514480), (12.7062, 1, 0.05), (1.95996, 1e7, 0.05), (0.0, 5, 1.0)])
def test_student(t, df, p):
    assert student_p(t, df) == pytest.approx(p, rel=1e-4)


def test_falsification_rows(spark):
    rows = spark.createDataFrame([(708,), (709,), (None,)], "m int")
    got = {(r["m"], r["cut"]): r["d_test"] for r in rg.falsification(rows, "m", [708, 709]).collect()}
    assert got == {(708, 708): 0, (708, 709): 0, (709, 708): 1, (709, 709): 0, (None, 708): 1, (None, 709): 1}


def test_adjusted_r2_and_table(spark):
    tidy = spark.createDataFrame(
        [("1", 0, "_cons", 2.0, 0.5, 0.001, 101.0, 101.0, 0.5, 1.0), ("2", 1, "x", None, None, None, 101.0, 101.0, 0.5, 1.0)],
        "model string, pos int, var string, coef double, stderr double, pval double, N double, N_pop double, r2 double, df_m double",
    )
    assert rg.adj_r2(tidy).first()["r2_a"] == pytest.approx(1 - 0.5 * 100 / 100)
    table = {r["var"]: r for r in rg.coef_table(tidy, ["x", "_cons"], ["1", "2"]).collect()}
    assert table["_cons"]["coef_1"] == 2.0 and table["_cons"]["coef_2"] == 0.0
    assert table["x"]["row"] == 1 and table["x"]["coef_2"] == 0.0


def test_unconnected_parts_need_no_steps_over_all_units(spark, monkeypatch):
    """Parts of a model that fit into units are solved there, whatever the number of rows."""
    rng = np.random.default_rng(5)
    rows = [(f"a{i % 7}-{i % 9}", f"b{i % 7}-{rng.integers(6)}", float(rng.normal()), float(rng.normal()), i) for i in range(420)]
    df = spark.createDataFrame(rows, "f string, g string, x double, y double, k long")
    monkeypatch.setattr(rg, "MAX_CELLS", 0)
    once = by_pos(rg.fit(df, "y", rg.numeric("x"), ("f", "g"), key=["k"], reps=3))
    monkeypatch.setattr(tw, "_solved_together", None)
    parts = by_pos(rg.fit(df, "y", rg.numeric("x"), ("f", "g"), key=["k"], reps=3, hot_rows=70))
    pdf = df.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf.x, pd.get_dummies(pdf.f).to_numpy(float), pd.get_dummies(pdf.g).to_numpy(float)])
    assert parts.coef[1] == pytest.approx(np.linalg.lstsq(x, pdf.y.to_numpy(), rcond=None)[0][1], rel=1e-6)
    assert parts.df_m[0] == np.linalg.matrix_rank(x) - 1
    np.testing.assert_allclose(parts[["coef", "stderr", "df_m"]], once[["coef", "stderr", "df_m"]], rtol=1e-6)


def test_sums_of_weights_go_by_batch(spark):
    """One row per replicate and task, and a row without weights does not count."""
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 5.0],), (None,)], "rw array<double>").coalesce(1)
    out = rg.weight_sums(df, reps=2).orderBy("rep").collect()
    assert [tuple(r) for r in out] == [(0, 2, 4.0, 10.0, 3.0), (1, 2, 7.0, 29.0, 5.0)]
    assert [r.rw for r in rg.scaled_weights(df, reps=2).collect()] == [[0.5, 2 / 3.5], [1.5, 5 / 3.5], None]


def test_products_of_many_columns_take_little_memory():
    """A batch of wide rows is worked on in parts also without replicates."""
    from fairtender.operators.moments import PRODUCTS, rows_at_once

    for width in (3, 75, 130):
        assert 64 <= rows_at_once(width, 0) <= PRODUCTS // (width * (width + 1) // 2)
    assert rows_at_once(3, 300) == 664


def test_steps_over_units_send_blocks_of_levels(spark, monkeypatch):
    """A connected part in many units: vectors lie in blocks, not in a row per level, and rows stay in their units."""
    rng = np.random.default_rng(9)
    rows = [(f"a{rng.integers(15)}", f"b{rng.integers(12)}", float(rng.normal()), float(rng.normal()), i) for i in range(600)]
    df = spark.createDataFrame(rows + [("c0", f"d{i % 2}", float(i), float(i % 3), 600 + i) for i in range(8)], "f string, g string, x double, y double, k long")
    monkeypatch.setattr(rg, "MAX_CELLS", 0)
    once = by_pos(rg.fit(df, "y", rg.numeric("x"), ("f", "g"), key=["k"], reps=2))
    seen, stage = [], tw.stage
    monkeypatch.setattr(tw, "stage", lambda t: seen.append(stage(t)) or seen[-1])
    monkeypatch.setattr(tw, "BLOCK_LEVELS", 20)
    steps = by_pos(rg.fit(df, "y", rg.numeric("x"), ("f", "g"), key=["k"], reps=2, hot_rows=150))
    np.testing.assert_allclose(steps[["coef", "stderr", "df_m"]], once[["coef", "stderr", "df_m"]], rtol=1e-6)
    vectors = [t for t in seen if "q" in t.columns]
    assert len(vectors) > 3 and {t.count() for t in vectors[:2]} <= {2, 3, 4}


def test_two_factors_read_their_rows_once(spark, monkeypatch):
    """What leads to the rows may be long, so levels are counted on what was written of it."""
    monkeypatch.setattr(rg, "MAX_CELLS", 0)
    read = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = two_groups(spark)
    rg.fit(df.mapInArrow(through, df.schema), "y", rg.numeric("x"), ("f", "g")).collect()
    assert read.value == df.count()
