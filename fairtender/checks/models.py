"""Regressions. Where a model has few terms, SQL solves its normal equations step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairtender.checks.registry import query
from fairtender.checks.standin import computers, contract_items, saved, saved_base, saved_prices, sql
from fairtender.operators import regress as rg
from fairtender.plans import estimates as es

KEY = ["n_cod_contrato", "n_item", "codigoitem", "ruc_proveedor"]
CUTS = range(470, 481)
REPS = 300
DID = {
    "1.contratacion": "contratacion",
    "1.d_pandemia": "d_pandemia",
    "1.contratacion#1.d_pandemia": "contratacion * d_pandemia",
}
AMOUNT = {"monto_contratado_total": "monto_contratado_total"}
SYSTEM = {f"{v}.sistema_contratacion": f"CASE WHEN sistema_contratacion = '{v}' THEN 1 ELSE 0 END" for v in "PO"}
SUPPLIER = {"antiguo_proveedor": "antiguo_proveedor"}


def solve_sql(
    source: str, y: str, terms: dict[str, str], absorb: str | None = None, by: str = "'1'", p: str = "", second: str | None = None, rounds: int = 12
) -> dict[str, str]:
    """Views that end in ``tidy`` (model, var, coef, stderr, N, r2, df_m): cross products, then one elimination per term.

    With ``absorb`` the columns are first taken as deviations from the factor's means; with a
    ``second`` factor as deviations from either's means in turn, ``rounds`` times (whose levels
    must be connected). ``p`` is put before the names of the views.
    """
    exprs = ([] if absorb else ["1.0"]) + list(terms.values()) + [y]
    names = ([] if absorb else ["_cons"]) + list(terms)
    w = len(exprs)
    raw = ", ".join(f"CAST({e} AS DOUBLE) AS u{i}" for i, e in enumerate(exprs))
    level = f"CAST({absorb} AS VARCHAR) AS lev," if absorb else ""
    level += f"CAST({second} AS VARCHAR) AS lev2," if second else ""
    views = {f"{p}rows0": f"SELECT CAST({by} AS VARCHAR) AS model, {level} {raw} FROM {source}"}
    mean = "- avg(u{0}) OVER (PARTITION BY model, lev)" if absorb else ""
    before = f"{p}rows0"
    for k in range(rounds if second else 0):
        for lev in ("lev", "lev2"):
            views[f"{p}turn{k}{lev}"] = "SELECT model, lev, lev2, " + ", ".join(f"u{i} - avg(u{i}) OVER (PARTITION BY model, {lev}) AS u{i}" for i in range(w)) + f" FROM {before}"
            before = f"{p}turn{k}{lev}"
    views[f"{p}rows1"] = "SELECT model, " + ", ".join(f"u{i} {mean.format(i)} AS v{i}" for i in range(w)) + f" FROM {before}"
    cells = [(i, j) for i in range(w) for j in range(w)]
    views[f"{p}step0"] = "SELECT model, " + ", ".join(f"sum(v{i} * v{j}) AS a{i}_{j}" for i, j in cells) + f" FROM {p}rows1 GROUP BY model"
    for k in range(w - 1):
        def cell(i: int, j: int, k: int = k) -> str:
            pivot = f"a{k}_{k}"
            if i == k and j == k:
                return f"1 / {pivot}"
            if i == k:
                return f"a{k}_{j} / {pivot}"
            if j == k:
                return f"-a{i}_{k} / {pivot}"
            return f"a{i}_{j} - a{i}_{k} * a{k}_{j} / {pivot}"

        views[f"{p}step{k + 1}"] = "SELECT model, " + ", ".join(f"{cell(i, j)} AS a{i}_{j}" for i, j in cells) + f" FROM {p}step{k}"
    levels = "count(DISTINCT lev)" if absorb else "1"
    levels += " + count(DISTINCT lev2) - 1" if second else ""
    last = w - 1
    views[f"{p}sizes"] = f"SELECT model, count(*) AS n, var_pop(u{last}) * count(*) AS total, {levels} AS levels FROM {p}rows0 GROUP BY model"
    df_m = f"{len(terms)} + levels - 1"
    views[f"{p}tidy"] = " UNION ALL ".join(
        f"""SELECT model, '{name}' AS var, a{i}_{last} AS coef, sqrt(a{i}_{i} * a{last}_{last} / (n - 1 - ({df_m}))) AS stderr,
        CAST(n AS DOUBLE) AS n_obs, 1 - a{last}_{last} / total AS r2, CAST({df_m} AS DOUBLE) AS df_m FROM {p}step{w - 1} JOIN {p}sizes USING (model)"""
        for i, name in enumerate(names)
    )
    return views


def shown(tidy, names, *rounded):
    """The stated terms, with columns rounded to the stated decimals."""
    return tidy.filter(F.col("var").isin(*names)).select("model", "var", *[F.round(c, d).alias(o) for c, d, o in rounded])


def quoted(names):
    return ", ".join(f"'{n}'" for n in names)


# ---- least squares on the items ----------------------------------------------------------

@query(
    "did_cells",
    sql(
        """SELECT round(m00, 4) AS cons, round(m10 - m00, 4) AS contratacion, round(m01 - m00, 4) AS d_pandemia,
          round(m11 - m10 - m01 + m00, 4) AS interaction FROM m""",
        "contract_items",
        m="SELECT " + ", ".join(
            f"avg(CASE WHEN contratacion = {c} AND d_pandemia = {p} THEN monto_contratado_item END) AS m{c}{p}" for c in (0, 1) for p in (0, 1)
        ) + " FROM contract_items",
    ),
)
def did_cells(spark, sf):
    cells = rg.did_cells(contract_items(spark, sf), "monto_contratado_item")
    return cells.select(*[F.round(c, 4).alias(c) for c in cells.columns])


ITEM_TERMS = {**DID, **AMOUNT, **SYSTEM}


def _item_model(spark, sf):
    items = contract_items(spark, sf)
    terms = [*rg.did_terms(), *rg.numeric("monto_contratado_total"), *rg.dummies("sistema_contratacion", ["F", "O", "P"])]
    return rg.fit(items, "monto_contratado_item", terms)


@query(
    "ols",
    sql(
        "SELECT model, var, round(coef, 3) AS coef, round(r2, 6) AS r2 FROM tidy",
        "contract_items", **solve_sql("contract_items", "monto_contratado_item", ITEM_TERMS),
    ),
)
def ols(spark, sf):
    return shown(_item_model(spark, sf), ["_cons", *ITEM_TERMS], ("coef", 3, "coef"), ("r2", 6, "r2"))


@query(
    "ols_classic_se",
    sql(
        "SELECT model, var, round(stderr, 3) AS stderr, n_obs AS n, df_m FROM tidy",
        "contract_items", **solve_sql("contract_items", "monto_contratado_item", ITEM_TERMS),
    ),
)
def ols_classic_se(spark, sf):
    return shown(_item_model(spark, sf), ["_cons", *ITEM_TERMS], ("stderr", 3, "stderr"), ("N", 0, "n"), ("df_m", 0, "df_m"))


FE_TERMS = {**AMOUNT, "contratacion": "contratacion"}


NEARLY = {"monto_contratado_total": "monto_contratado_total", "contratacion": "contratacion"}


@query(
    "ols_nearly_collinear",
    sql(
        """SELECT CASE WHEN var = 'contratacion' THEN 'nearly_total' ELSE 'total' END AS var,
          round(CASE WHEN var = 'contratacion' THEN coef ELSE coef - (SELECT coef FROM tidy WHERE var = 'contratacion') END, 3) AS coef, round(r2, 6) AS r2
        FROM tidy WHERE var <> '_cons'""",
        "contract_items", **solve_sql("contract_items", "monto_contratado_item", NEARLY),
    ),
)
def ols_nearly_collinear(spark, sf):
    """Two terms that differ in a few parts in a million; SQL knows their difference."""
    total = F.col("monto_contratado_total")
    terms = [("total", total), ("nearly_total", total + F.col("contratacion"))]
    tidy = rg.fit(contract_items(spark, sf), "monto_contratado_item", terms, method="qr")
    return tidy.filter("var <> '_cons'").select("var", F.round("coef", 3).alias("coef"), F.round("r2", 6).alias("r2"))


@query(
    "ols_absorb_fe",
    sql(
        "SELECT model, var, round(coef, 5) AS coef, round(stderr, 5) AS stderr, df_m FROM tidy",
        "contract_items", **solve_sql("contract_items", "monto_contratado_item", FE_TERMS, "codigoentidad"),
    ),
)
def ols_absorb_fe(spark, sf):
    tidy = rg.fit(contract_items(spark, sf), "monto_contratado_item", rg.numeric(*FE_TERMS), ["codigoentidad"])
    return shown(tidy, list(FE_TERMS), ("coef", 5, "coef"), ("stderr", 5, "stderr"), ("df_m", 0, "df_m"))


@query(
    "ols_absorb_two",
    sql(
        "SELECT model, var, round(coef, 5) AS coef, round(stderr, 5) AS stderr, df_m FROM tidy",
        "contract_items", **solve_sql("contract_items", "monto_contratado_item", FE_TERMS, "codigoentidad", second="codigoitem", rounds=16),
    ),
)
def ols_absorb_two(spark, sf):
    """Entity and item effects at once."""
    tidy = rg.fit(contract_items(spark, sf), "monto_contratado_item", rg.numeric(*FE_TERMS), ["codigoentidad", "codigoitem"])
    return shown(tidy, list(FE_TERMS), ("coef", 5, "coef"), ("stderr", 5, "stderr"), ("df_m", 0, "df_m"))


QUARTER = "quarteryear_suscripcion"


@query(
    "interaction_terms",
    sql(
        f"""SELECT '1.contratacion' AS term, CAST(sum(contratacion) AS DOUBLE) AS total FROM contract_items
        UNION ALL SELECT concat({QUARTER}, '.{QUARTER}'), CAST(count(*) AS DOUBLE) FROM contract_items GROUP BY {QUARTER}
        UNION ALL SELECT concat('1.contratacion#', {QUARTER}, '.{QUARTER}'), CAST(sum(contratacion) AS DOUBLE) FROM contract_items GROUP BY {QUARTER}""",
        "contract_items",
    ),
)
def interaction_terms(spark, sf):
    items = contract_items(spark, sf)
    terms = rg.crossed(rg.flag("contratacion"), rg.dummies(QUARTER, rg.factor_levels(items, QUARTER)))
    sums = items.agg(*[F.sum(c).alias(f"t{i}") for i, (_, c) in enumerate(terms)])
    named = sums.toDF(*[n.replace(".", "_") for n, _ in terms])
    long = named.unpivot([], named.columns, "term", "total")
    names = F.create_map(*[x for n, _ in terms for x in (F.lit(n.replace(".", "_")), F.lit(n))])
    return long.select(names[F.col("term")].alias("term"), "total")


# ---- bootstrap ---------------------------------------------------------------------------

MIXED = {
    "hashes": """SELECT contratacion, d_pandemia, monto_contratado_item, CAST(concat('0x', substr(md5(concat_ws('|', 42,
      n_cod_contrato, n_item, codigoitem, ruc_proveedor)), 1, 15)) AS UBIGINT) AS h FROM contract_items""",
    "mix0": f"""SELECT *, CAST((CAST(h AS UHUGEINT) + CAST(rep AS UHUGEINT) * 11400714819323198485) % 18446744073709551616 AS UBIGINT) AS z
      FROM hashes, range(1, {REPS + 1}) r(rep)""",
    "mix1": "SELECT * REPLACE (CAST((CAST(xor(z, z >> 30) AS UHUGEINT) * 13787848793156543929) % 18446744073709551616 AS UBIGINT) AS z) FROM mix0",
    "mix2": "SELECT * REPLACE (CAST((CAST(xor(z, z >> 27) AS UHUGEINT) * 10723151780598845931) % 18446744073709551616 AS UBIGINT) AS z) FROM mix1",
    "weights": """SELECT CAST(rep AS INT) AS rep, contratacion, d_pandemia, monto_contratado_item,
      -ln((CAST(xor(z, z >> 31) >> 11 AS DOUBLE) + 0.5) / 9007199254740992.0) AS w FROM mix2""",
}


@query(
    "bayes_boot_weights",
    sql(
        """SELECT rep, count(*) AS n, round(sum(w / m) / count(*), 6) AS mean_w, round(sum((w / m) * (w / m)), 3) AS squares,
          round(max(w / m), 6) AS largest FROM (SELECT rep, w, avg(w) OVER (PARTITION BY rep) AS m FROM weights) t GROUP BY rep""",
        "contract_items", **MIXED,
    ),
)
def bayes_boot_weights(spark, sf):
    drawn = rg.scaled_weights(rg.boot_weights(contract_items(spark, sf), KEY, REPS), reps=REPS)
    sums = rg.weight_sums(drawn, reps=REPS)
    return sums.select(
        (F.col("rep") + 1).alias("rep"), "n", F.round(F.col("total") / F.col("n"), 6).alias("mean_w"),
        F.round("squares", 3).alias("squares"), F.round("largest", 6).alias("largest"),
    )


@query(
    "bayes_boot_se",
    sql(
        """SELECT unnest(['_cons', '1.contratacion', '1.d_pandemia', '1.contratacion#1.d_pandemia']) AS var, round(unnest([
          stddev_pop(m00), stddev_pop(m10 - m00), stddev_pop(m01 - m00), stddev_pop(m11 - m10 - m01 + m00)]), 3) AS stderr FROM cells""",
        "contract_items", **MIXED,
        cells="SELECT rep, " + ", ".join(
            f"sum(w * monto_contratado_item) FILTER (WHERE contratacion = {c} AND d_pandemia = {p}) / sum(w) FILTER (WHERE contratacion = {c} AND d_pandemia = {p}) AS m{c}{p}"
            for c in (0, 1) for p in (0, 1)
        ) + " FROM weights GROUP BY rep",
    ),
)
def bayes_boot_se(spark, sf):
    tidy = rg.fit(contract_items(spark, sf), "monto_contratado_item", rg.did_terms(), key=KEY, reps=REPS)
    return tidy.select("var", F.round("stderr", 3).alias("stderr"))


# ---- models of the base ------------------------------------------------------------------

SHOWN = [*DID]
DIGITS = (("coef", 6, "coef"), ("stderr", 6, "stderr"), ("N", 0, "n"), ("r2", 6, "r2"))
DIGITS_SQL = "round(coef, 6) AS coef, round(stderr, 6) AS stderr, n_obs AS n, round(r2, 6) AS r2"


def _two_models(spark, sf):
    base = saved_base(spark, sf)
    terms = [*rg.did_terms(), *rg.numeric("monto_contratado_total"), *rg.dummies("sistema_contratacion", ["F", "O", "P"]), *rg.numeric("antiguo_proveedor")]
    return rg.tidy_models(rg.fit(base, "reporte", rg.did_terms(), model="1"), rg.fit(base, "reporte", terms, model="2"))


def _two_sql(body):
    first = solve_sql("base", "reporte", DID)
    second = solve_sql("base", "reporte", {**DID, **AMOUNT, **SYSTEM, **SUPPLIER}, by="'2'", p="second_")
    both = {"both_models": "SELECT * FROM tidy UNION ALL SELECT * FROM second_tidy"}
    return sql(body, "base", **first, **second, **both)


@query("tidy_models", _two_sql(f"SELECT model, var, {DIGITS_SQL} FROM both_models WHERE var IN ('_cons', {quoted(DID)})"))
def tidy_models(spark, sf):
    return shown(_two_models(spark, sf), ["_cons", *DID], *DIGITS)


@query(
    "adj_r2",
    _two_sql("SELECT DISTINCT model, round(1 - (1 - r2) * (n_obs - 1) / (n_obs - df_m), 6) AS r2_a FROM both_models"),
)
def adj_r2(spark, sf):
    return rg.adj_r2(_two_models(spark, sf)).select("model", F.round("r2_a", 6).alias("r2_a")).distinct()


@query(
    "coef_table",
    _two_sql(
        f"""SELECT CAST(list_position([{quoted(es.TABLE_TERMS)}], var) AS BIGINT) AS row, var,
          round(coalesce(max(CASE WHEN model = '1' THEN coef END), 0), 6) AS coef_1, round(coalesce(max(CASE WHEN model = '2' THEN coef END), 0), 6) AS coef_2,
          round(coalesce(max(CASE WHEN model = '1' THEN stderr END), 0), 6) AS stderr_1, round(coalesce(max(CASE WHEN model = '2' THEN stderr END), 0), 6) AS stderr_2
        FROM both_models WHERE var IN ({quoted(es.TABLE_TERMS)}) GROUP BY var"""
    ),
)
def coef_table(spark, sf):
    wide = rg.coef_table(_two_models(spark, sf), es.TABLE_TERMS, ["1", "2"])
    return wide.select("row", "var", *[F.round(f"{s}_{m}", 6).alias(f"{s}_{m}") for s in ("coef", "stderr") for m in (1, 2)])


@query("report_models")
def report_models(spark, sf):
    return es.report_models(saved_base(spark, sf), REPS)


@query("printed_table")
def printed_table(spark, sf):
    return es.printed_table(es.report_models(saved_base(spark, sf), REPS), ["1", "2", "3"])


@query("subset_models")
def subset_models(spark, sf):
    return es.subset_models(saved_base(spark, sf), "objetocontractual", REPS)


@query("subset_models_subsector")
def subset_models_subsector(spark, sf):
    return es.subset_models(saved_base(spark, sf), "subsector", REPS)


ENTITY_TERMS = {**DID, **AMOUNT, **SYSTEM, **SUPPLIER}


@query(
    "subset_models_entity",
    sql(
        "SELECT model, var, round(coef, 6) AS coef, n_obs AS n, round(r2, 6) AS r2 FROM tidy",
        "base", **solve_sql("base", "reporte", ENTITY_TERMS, "codigoentidad", "objetocontractual"),
    ),
)
def subset_models_entity(spark, sf):
    """The subset models without month effects, which SQL can follow."""
    tidy = es.subset_models(saved_base(spark, sf), "objetocontractual", 0, months=False)
    return shown(tidy, list(ENTITY_TERMS), ("coef", 6, "coef"), ("N", 0, "n"), ("r2", 6, "r2"))


PLACEBO = {**AMOUNT, **SYSTEM, "1.contratacion": "contratacion", "1.d_test": "d_test", "1.contratacion#1.d_test": "contratacion * d_test"}
PLACEBO_ROWS = f"""SELECT *, CASE WHEN monthyear_suscripcion > cut THEN 1 ELSE 0 END AS d_test FROM base, range({CUTS[0]}, {CUTS[-1] + 1}) c(cut)
          WHERE d_pandemia = 0"""
FULL_PLACEBO = {k: v for k, v in PLACEBO.items() if k != "1.d_test"}


@query(
    "falsification_sweep",
    sql(
        """SELECT model, var, round(coef, 6) AS coef, round(stderr, 6) AS stderr, n_obs AS n, round(r2, 6) AS r2, df_m FROM tidy WHERE var LIKE '1.%'
        UNION ALL SELECT model, '1.d_test', NULL, NULL, n_obs, round(r2, 6), df_m FROM tidy WHERE var = '1.contratacion'""",
        "base", placebo=PLACEBO_ROWS, **solve_sql("placebo", "reporte", FULL_PLACEBO, "codigoentidad", "cut", second="monthyear_suscripcion"),
    ),
)
def falsification_sweep(spark, sf):
    """Months settle the placebo break, so its main effect is left out."""
    tidy = es.falsification_models(saved_base(spark, sf), CUTS)
    told = ["1.contratacion", "1.d_test", "1.contratacion#1.d_test"]
    return shown(tidy, told, ("coef", 6, "coef"), ("stderr", 6, "stderr"), ("N", 0, "n"), ("r2", 6, "r2"), ("df_m", 0, "df_m"))


@query(
    "falsification_entity",
    sql(
        "SELECT model, var, round(coef, 6) AS coef, round(stderr, 6) AS stderr, n_obs AS n FROM tidy WHERE var LIKE '%d_test'",
        "base",
        placebo=PLACEBO_ROWS,
        **solve_sql("placebo", "reporte", PLACEBO, "codigoentidad", "cut"),
    ),
)
def falsification_entity(spark, sf):
    """The sweep without month effects, which SQL can follow."""
    tidy = es.falsification_models(saved_base(spark, sf), CUTS, months=False)
    return shown(tidy, ["1.d_test", "1.contratacion#1.d_test"], ("coef", 6, "coef"), ("stderr", 6, "stderr"), ("N", 0, "n"))


@query("parallel_trends")
def parallel_trends(spark, sf):
    return es.trend_terms(es.report_trend(saved_base(spark, sf)), "1[0-9][0-9]")


@query("parallel_trends_price")
def parallel_trends_price(spark, sf):
    return es.trend_terms(es.price_trend(saved_prices(spark, sf)), "1[0-9][0-9]")


@query("price_models")
def price_models(spark, sf):
    return es.price_models(saved_prices(spark, sf), REPS)


@query("computer_models")
def computer_models(spark, sf):
    return es.computer_models(saved(spark, sf, "computers", lambda: computers(spark, sf)), REPS)
