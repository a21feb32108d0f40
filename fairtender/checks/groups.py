"""Group-wise numbering, panels, samples, unions and reshapes, prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairtender.checks.registry import query
from fairtender.checks.standin import (
    BASE_YEARS,
    CONTRACT,
    ITEM_ORDER,
    answers,
    base,
    catalogue_codes,
    catalogue,
    contract_items,
    computers,
    price_table,
    saved_base,
    selected_items,
    sql,
    table,
)
from fairtender.functions import codes, prices as pr
from fairtender.operators import rows, shape
from fairtender.operators.merge import distinct_first, merge
from fairtender.operators.skew import attach_stats, number_rows
from fairtender.plans import contracts as pl
from fairtender.session import stage

KEY = [CONTRACT, *ITEM_ORDER]
KEY_SQL = "n_cod_contrato, n_item, codigoitem, ruc_proveedor, monto_contratado_item"
ORDER_SQL = "n_item, codigoitem, ruc_proveedor, monto_contratado_item"


@query(
    "win_row_number",
    sql(f"SELECT {KEY_SQL}, row_number() OVER (PARTITION BY codigoconvocatoria, n_cod_contrato ORDER BY {ORDER_SQL}) AS j FROM contract_items", "contract_items"),
)
def win_row_number(spark, sf):
    items = contract_items(spark, sf).select("codigoconvocatoria", *KEY)
    return number_rows(items, ["codigoconvocatoria", CONTRACT], ITEM_ORDER, "j").drop("codigoconvocatoria")


@query("win_group_size", sql(f"SELECT {KEY_SQL}, count(*) OVER (PARTITION BY n_cod_contrato) AS n FROM contract_items", "contract_items"))
def win_group_size(spark, sf):
    return attach_stats(contract_items(spark, sf).select(*KEY), [CONTRACT], {"n": F.count(F.lit(1))})


@query(
    "win_total_cond",
    sql(
        """SELECT n_cod_contrato, identified_price_id, CAST(sum(CASE WHEN unit_price IS NOT NULL THEN 1 ELSE 0 END)
          OVER (PARTITION BY n_cod_contrato) AS BIGINT) AS count_nonempty FROM prices""",
        "prices",
    ),
)
def win_total_cond(spark, sf):
    long = price_table(spark, sf).select(CONTRACT, "identified_price_id", "unit_price")
    return attach_stats(long, [CONTRACT], {"count_nonempty": F.count_if(F.col("unit_price").isNotNull())}).drop("unit_price")


@query(
    "win_drop_empty_if_full",
    sql(
        """SELECT n_cod_contrato, identified_price_id, unit_price FROM (SELECT *, count(unit_price) OVER (
          PARTITION BY n_cod_contrato) AS filled FROM prices) t WHERE unit_price IS NOT NULL OR filled = 0""",
        "prices",
    ),
)
def win_drop_empty_if_full(spark, sf):
    long = price_table(spark, sf).select(CONTRACT, "identified_price_id", "unit_price")
    return rows.drop_empty_if_filled(long, [CONTRACT], "unit_price")


@query(
    "win_prices_extracted",
    sql(
        """SELECT n_cod_contrato, identified_price_id, CAST(CASE WHEN unit_price IS NULL THEN 0
          ELSE count(*) OVER (PARTITION BY n_cod_contrato) END AS BIGINT) AS n_prices_extracted FROM prices""",
        "prices",
    ),
)
def win_prices_extracted(spark, sf):
    long = price_table(spark, sf).select(CONTRACT, "identified_price_id", "unit_price")
    sized = attach_stats(long, [CONTRACT], {"_all": F.count(F.lit(1))})
    extracted = F.when(F.col("unit_price").isNull(), F.lit(0).cast("long")).otherwise(F.col("_all"))
    return sized.select(CONTRACT, "identified_price_id", extracted.alias("n_prices_extracted"))


ITEM_GROUP = """SELECT n_cod_contrato, pos AS identified_price_id, CASE WHEN item_count > total AND unit_price IS NOT NULL THEN i
    ELSE CAST(ceil(CAST(i AS DOUBLE) / nullif(floor(CAST(total AS DOUBLE) / nullif(item_count, 0)), 0)) AS BIGINT) END AS item_group
  FROM (SELECT *, row_number() OVER (PARTITION BY n_cod_contrato ORDER BY pos) AS i,
      count(*) OVER (PARTITION BY n_cod_contrato) AS total
    FROM (SELECT *, count(unit_price) OVER (PARTITION BY n_cod_contrato) AS filled FROM (
      SELECT n_cod_contrato, item_count, unit_price, min(identified_price_id) AS pos FROM prices
      GROUP BY n_cod_contrato, item_count, unit_price) d) k WHERE unit_price IS NOT NULL OR filled = 0) x"""


@query("win_item_group", sql(ITEM_GROUP, "prices"))
def win_item_group(spark, sf):
    once = distinct_first(price_table(spark, sf), [CONTRACT, "item_count", "unit_price"], ["identified_price_id"])
    placed = pl.item_groups(rows.drop_empty_if_filled(once, [CONTRACT], "unit_price"))
    return placed.select(CONTRACT, "identified_price_id", F.col("item_group").cast("long").alias("item_group"))


def _panel_sql(unit):
    return sql(
        f"""SELECT {KEY_SQL} FROM (SELECT *, sum(d_pandemia) OVER (PARTITION BY {unit}) AS a,
          sum(1 - d_pandemia) OVER (PARTITION BY {unit}) AS b FROM contract_items) t WHERE a > 0 AND b > 0""",
        "contract_items",
    )


@query("win_panel_entity", _panel_sql("codigoentidad"))
def win_panel_entity(spark, sf):
    items = contract_items(spark, sf).select(*KEY, "codigoentidad", "d_pandemia")
    return rows.panel_filter(items, "codigoentidad", "d_pandemia").select(*KEY)


@query("win_panel_item", _panel_sql("codigoitem"))
def win_panel_item(spark, sf):
    return rows.panel_filter(contract_items(spark, sf).select(*KEY, "d_pandemia"), "codigoitem", "d_pandemia").select(*KEY)


@query(
    "win_first_in_group",
    sql(f"SELECT {KEY_SQL}, CAST(CASE WHEN row_number() OVER (PARTITION BY n_cod_contrato ORDER BY {ORDER_SQL}) = 1 THEN 1 ELSE 0 END AS INT) AS num_contratos FROM contract_items", "contract_items"),
)
def win_first_in_group(spark, sf):
    return rows.first_flag(contract_items(spark, sf).select(*KEY), [CONTRACT], ITEM_ORDER, "num_contratos")


@query(
    "group_id",
    sql(f"SELECT {KEY_SQL}, dense_rank() OVER (ORDER BY codigoentidad, ruc_proveedor) AS pareja FROM contract_items", "contract_items"),
)
def group_id(spark, sf):
    items = contract_items(spark, sf).select(*KEY, "codigoentidad")
    return shape.group_id(items, ["codigoentidad", "ruc_proveedor"], "pareja").drop("codigoentidad")


@query(
    "encode",
    """SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) AS dummytipoentidad,
      dense_rank() OVER (ORDER BY c_name) AS dummyentidad FROM customer""",
)
def encode(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name")
    coded, _ = shape.encode(customers, "c_mktsegment", "dummytipoentidad")
    coded, _ = shape.encode(coded, "c_name", "dummyentidad")
    return coded.select("c_custkey", "dummytipoentidad", "dummyentidad")


@query("sort_stable", sql(f"SELECT codigoconvocatoria, {KEY_SQL} FROM contract_items ORDER BY ALL", "contract_items"))
def sort_stable(spark, sf):
    return contract_items(spark, sf).select("codigoconvocatoria", *KEY).orderBy("codigoconvocatoria", *KEY)


def _sample_sql(n):
    return f"""SELECT o_orderkey, y FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, row_number() OVER (
      PARTITION BY year(o_orderdate) ORDER BY md5(concat('42|', o_orderkey)), o_orderkey) AS r FROM orders) t WHERE r <= {n}"""


@query("sample_n_by", _sample_sql(100))
def sample_n_by(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    return rows.sample_n_by(orders, 100, ["y"], ["o_orderkey"], 42)


@query("sample_n_by_main", _sample_sql(1500))
def sample_n_by_main(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    return rows.sample_n_by(orders, 1500, ["y"], ["o_orderkey"], 42)


# ---- unions and reshapes -----------------------------------------------------------------

@query(
    "union_marked",
    """SELECT o_orderkey, o_orderstatus, NULL AS o_totalprice, CAST(0 AS INT) AS temp_1 FROM orders
    UNION ALL SELECT o_orderkey, NULL, o_totalprice, CAST(1 AS INT) FROM orders WHERE year(o_orderdate) = 1999""",
)
def union_marked(spark, sf):
    orders = table(spark, sf, "orders")
    again = orders.filter(F.year("o_orderdate") == 1999).select("o_orderkey", "o_totalprice")
    return shape.union_marked(orders.select("o_orderkey", "o_orderstatus"), again, "temp_1")


@query("union_catalogue", sql("SELECT itemcubso, objetocontractual, codigoproducto, codigoitem FROM catalogue", "catalogue"))
def union_catalogue(spark, sf):
    return catalogue(spark, sf)


@query(
    "union_then_distinct",
    """SELECT DISTINCT * FROM (SELECT l_orderkey, l_linenumber, l_returnflag, CAST(0 AS INT) AS temp_1 FROM lineitem UNION ALL
      SELECT l_orderkey, l_linenumber, l_returnflag, CAST(1 AS INT) FROM lineitem WHERE l_returnflag = 'R') u""",
)
def union_then_distinct(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return shape.union_marked(lines, lines.filter("l_returnflag = 'R'"), "temp_1").distinct()


WIDTH = 8


def _wide_sql():
    cells = ", ".join(
        f"max(CASE WHEN (j - 1) % {WIDTH} = {k - 1} THEN {v} END) AS {v}{k}"
        for v in ("n_item", "ruc_proveedor") for k in range(1, WIDTH + 1)
    )
    return sql(
        f"""SELECT codigoconvocatoria, n_cod_contrato, urlcontrato, CAST((j - 1) // {WIDTH} AS BIGINT) AS band, {cells} FROM (
          SELECT *, row_number() OVER (PARTITION BY codigoconvocatoria, n_cod_contrato, urlcontrato ORDER BY {ORDER_SQL}) AS j
          FROM contract_items WHERE urlcontrato <> '') t GROUP BY ALL""",
        "contract_items",
    )


@query("reshape_wide_items", _wide_sql())
def reshape_wide_items(spark, sf):
    items = contract_items(spark, sf).filter(rows.present("urlcontrato"))
    return shape.to_wide_banded(
        items, ["codigoconvocatoria", CONTRACT, "urlcontrato"], ITEM_ORDER, ["n_item", "ruc_proveedor"], WIDTH
    )


@query(
    "reshape_wide_year",
    sql(
        """SELECT year_suscripcion, max(CASE WHEN contratacion = 0 THEN m END) AS total0, max(CASE WHEN contratacion = 1 THEN m END) AS total1
        FROM (SELECT year_suscripcion, contratacion, CAST(count(*) AS BIGINT) AS m FROM contract_items GROUP BY 1, 2) t GROUP BY 1""",
        "contract_items",
    ),
)
def reshape_wide_year(spark, sf):
    counts = contract_items(spark, sf).groupBy("year_suscripcion", "contratacion").agg(F.count(F.lit(1)).alias("total"))
    return shape.to_wide(counts, ["year_suscripcion"], "contratacion", ["total"], (0, 1))


@query(
    "reshape_long",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(1 AS INT) AS identified_price_id, l_extendedprice AS unit_price FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 2, nullif(l_discount, 0) FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 3, l_tax FROM lineitem""",
)
def reshape_long(spark, sf):
    wide = table(spark, sf, "lineitem").withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    return shape.to_long(wide, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_extendedprice", "l_discount", "l_tax"], "identified_price_id", "unit_price")


@query(
    "share_of_total",
    """SELECT l_orderkey, round(a + b, 6) AS total, round(a / nullif(a + b, 0), 6) AS share1, round(b / nullif(a + b, 0), 6) AS share2
    FROM (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS a,
      max(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS b FROM lineitem GROUP BY 1) t""",
)
def share_of_total(spark, sf):
    flags = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "N", 2).alias("g"), "l_quantity")
    wide = shape.to_wide(flags, ["l_orderkey"], "g", ["l_quantity"], (1, 2))
    shared = shape.share_of_total(wide, ["l_quantity1", "l_quantity2"], "total", ["share1", "share2"])
    return shared.select("l_orderkey", *[F.round(c, 6).alias(c) for c in ("total", "share1", "share2")])


# ---- prices ------------------------------------------------------------------------------

@query(
    "price_clean_main",
    sql("SELECT n_cod_contrato, regexp_replace(regexp_replace(gpt_unit_prices, '[^0-9;.,-]', '', 'g'), '\\.+', '.', 'g') AS cleaned FROM answers", "answers"),
)
def price_clean_main(spark, sf):
    return answers(spark, sf).select(CONTRACT, pr.price_clean(F.col("gpt_unit_prices")).alias("cleaned"))


@query("price_clean_computers", sql("SELECT n_cod_contrato, regexp_replace(gpt_unit_prices, '[^0-9;.]', '', 'g') AS cleaned FROM answers", "answers"))
def price_clean_computers(spark, sf):
    return answers(spark, sf).select(CONTRACT, pr.price_clean(F.col("gpt_unit_prices"), "computers").alias("cleaned"))


@query(
    "price_split",
    sql(
        """SELECT n_cod_contrato, CAST(unnest(range(1, len(p) + 1)) AS INT) AS position, unnest(p) AS piece FROM (
          SELECT n_cod_contrato, string_split_regex(regexp_replace(regexp_replace(gpt_unit_prices, '[^0-9;.,-]', '', 'g'),
            '\\.+', '.', 'g'), '[;,-]') AS p FROM answers) t""",
        "answers",
    ),
)
def price_split(spark, sf):
    pieces = answers(spark, sf).select(CONTRACT, pr.price_split(pr.price_clean(F.col("gpt_unit_prices"))).alias("p"))
    return shape.array_to_long(pieces, [CONTRACT], "p", "position", "piece")


def _cast_sql(clean, cut):
    return sql(
        f"""SELECT n_cod_contrato, CAST(unnest(range(1, len(p) + 1)) AS INT) AS position,
          unnest(list_transform(p, lambda x: TRY_CAST(x AS DOUBLE))) AS unit_price FROM (
          SELECT n_cod_contrato, string_split_regex({clean}, '{cut}') AS p FROM answers) t""",
        "answers",
    )


@query("price_cast", _cast_sql("regexp_replace(regexp_replace(gpt_unit_prices, '[^0-9;.,-]', '', 'g'), '\\.+', '.', 'g')", "[;,-]"))
def price_cast(spark, sf):
    parsed = answers(spark, sf).select(CONTRACT, pr.parse_prices(F.col("gpt_unit_prices")).alias("p"))
    return shape.array_to_long(parsed, [CONTRACT], "p", "position", "unit_price")


@query("price_cast_computers", _cast_sql("regexp_replace(gpt_unit_prices, '[^0-9;.]', '', 'g')", ";"))
def price_cast_computers(spark, sf):
    parsed = answers(spark, sf).select(CONTRACT, pr.parse_prices(F.col("gpt_unit_prices"), "computers").alias("p"))
    return shape.array_to_long(parsed, [CONTRACT], "p", "position", "unit_price")


@query(
    "count_nonmissing_row",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST((CASE WHEN l_discount = 0 THEN 0 ELSE 1 END)
      + (CASE WHEN l_tax = 0 THEN 0 ELSE 1 END) + 1 AS INT) AS item_count FROM lineitem""",
)
def count_nonmissing_row(spark, sf):
    values = F.array(F.nullif("l_discount", F.lit(0.0)), F.nullif("l_tax", F.lit(0.0)), F.col("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", pr.count_nonmissing(values).alias("item_count"))


@query("spread_prices", sql("SELECT n_cod_contrato, item_group, round(mean_unit_price, 4) AS mean_unit_price FROM spread_first", "spread_first"))
def spread_prices(spark, sf):
    spread = pl.answer_prices(answers(spark, sf), pl.item_counts(selected_items(spark, sf)), "gpt_unit_prices")
    return spread.withColumn("mean_unit_price", F.round("mean_unit_price", 4))


SPREAD_LONG = f"""SELECT n_cod_contrato, item_group, round(avg(unit_price), 4) AS mean_unit_price FROM (
  SELECT g.n_cod_contrato, item_group, p.unit_price, p.item_count FROM ({ITEM_GROUP}) g
  JOIN prices p ON p.n_cod_contrato = g.n_cod_contrato AND p.identified_price_id = g.identified_price_id) t
WHERE item_group <= item_count GROUP BY 1, 2"""


@query("spread_prices_long", sql(SPREAD_LONG, "prices"))
def spread_prices_long(spark, sf):
    spread = pl.spread_long(price_table(spark, sf))
    return spread.select(CONTRACT, F.col("item_group").cast("long").alias("item_group"), F.round("mean_unit_price", 4).alias("mean_unit_price"))


@query("join_inner_group", sql(f"SELECT {KEY_SQL}, item_group, round(mean_unit_price, 4) AS mean_unit_price FROM priced_first", "priced_first"))
def join_inner_group(spark, sf):
    items = stage(selected_items(spark, sf))
    spread = pl.answer_prices(answers(spark, sf), pl.item_counts(items), "gpt_unit_prices")
    return pl.attach_prices(items, spread).select(*KEY, "item_group", F.round("mean_unit_price", 4).alias("mean_unit_price"))


@query(
    "responses_join",
    sql("SELECT doc_id AS n_cod_contrato, lang, gpt_unit_prices FROM documents LEFT JOIN answers ON doc_id = n_cod_contrato", "answers"),
)
def responses_join(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias(CONTRACT), "lang")
    return merge(texts, answers(spark, sf), [CONTRACT], keep={1, 3}, keepusing=["gpt_unit_prices"])


# ---- codes, dates, history ---------------------------------------------------------------

@query("to_number", "SELECT p_partkey, TRY_CAST(p_brand AS BIGINT) AS a, TRY_CAST(substr(p_brand, 7) AS BIGINT) AS b FROM part")
def to_number(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", codes.to_number(F.col("p_brand")).alias("a"), codes.to_number(F.substring("p_brand", 7, 20)).alias("b")
    )


@query("to_text", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS codigo, TRY_CAST(substr(CAST(p_partkey AS VARCHAR), 1, 2) AS INT) AS codigoclase2 FROM part")
def to_text(spark, sf):
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(key, codes.to_text(key).alias("codigo"), codes.code_prefix(key, 2).alias("codigoclase2"))


@query(
    "code_parts",
    sql(
        """SELECT code, substr(code, 1, 8) AS codigoproducto, TRY_CAST(regexp_replace(substr(code, 9, 17), '^0+', '') AS BIGINT) AS codigoitem,
          TRY_CAST(substr(code, 1, 6) AS INT) AS codigoclase FROM catalogue_codes""",
        "catalogue_codes",
    ),
)
def code_parts(spark, sf):
    code = F.col("code")
    product = codes.product_code(code)
    return catalogue_codes(spark, sf).select(
        code, product.alias("codigoproducto"), codes.item_code(code).alias("codigoitem"), codes.class_code(product).alias("codigoclase")
    )


@query("year_gap", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN year(l_shipdate) - year(o_orderdate) >= 1 THEN 1 ELSE 0 END AS INT) AS gap FROM lineitem LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS o_orderdate FROM orders) o ON l_orderkey = o_orderkey")
def year_gap(spark, sf):
    # every third order has no date
    orders = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("o_orderdate"))
    joined = table(spark, sf, "lineitem").join(orders, F.expr("l_orderkey = o_orderkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", codes.year_gap(F.col("l_shipdate"), F.col("o_orderdate")).alias("gap"))


@query(
    "period_index",
    """SELECT o_orderkey, CAST((year(o_orderdate) - 1960) * 12 + month(o_orderdate) - 1 AS INT) AS month_no,
      CAST((year(o_orderdate) - 1960) * 4 + quarter(o_orderdate) - 1 AS INT) AS quarter_no FROM orders""",
)
def period_index(spark, sf):
    day = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", codes.month_index(day).alias("month_no"), codes.quarter_index(day).alias("quarter_no"))


@query(
    "old_supplier",
    sql(
        f"""SELECT {KEY_SQL}, CAST(CASE WHEN year(fecha_suscripcion_contrato) - year(m) >= 1 THEN 1 ELSE 0 END AS INT) AS antiguo_proveedor
        FROM contract_items i LEFT JOIN (SELECT codigoentidad AS e, ruc_proveedor AS r, min(fecha_suscripcion_contrato) AS m FROM contract_items
          WHERE year_suscripcion IN (1996, 1997) GROUP BY 1, 2) h ON e = codigoentidad AND r = ruc_proveedor""",
        "contract_items",
    ),
)
def old_supplier(spark, sf):
    items = contract_items(spark, sf).select(*KEY, "codigoentidad", "fecha_suscripcion_contrato", "year_suscripcion")
    dated = pl.old_supplier(items, "codigoentidad", "ruc_proveedor", "fecha_suscripcion_contrato", "year_suscripcion", BASE_YEARS)
    return dated.select(*KEY, "antiguo_proveedor")


@query(
    "regression_base",
    sql(
        f"""SELECT {KEY_SQL}, CAST(temp_1 AS INT) AS temp_1, subsector, reporte, antiguo_proveedor,
        round(mean_unit_price, 4) AS mean_unit_price FROM base""",
        "base",
    ),
)
def regression_base(spark, sf):
    return base(spark, sf).select(
        *KEY, "temp_1", "subsector", "reporte", "antiguo_proveedor", F.round("mean_unit_price", 4).alias("mean_unit_price")
    )


@query(
    "price_sample",
    sql(f"SELECT {KEY_SQL}, CAST(temp_1 AS INT) AS temp_1, round(mean_unit_price, 4) AS mean_unit_price FROM price_sample", "price_sample"),
)
def price_sample(spark, sf):
    return pl.price_sample(saved_base(spark, sf)).select(*KEY, "temp_1", F.round("mean_unit_price", 4).alias("mean_unit_price"))


@query("computer_base", sql(f"SELECT {KEY_SQL}, panel, round(mean_unit_price, 4) AS mean_unit_price FROM computers", "computers"))
def computer_base(spark, sf):
    return computers(spark, sf).select(*KEY, "panel", F.round("mean_unit_price", 4).alias("mean_unit_price"))
