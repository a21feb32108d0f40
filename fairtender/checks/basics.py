"""Filters, projections, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairtender.checks.registry import query
from fairtender.checks.standin import (
    CLASSES,
    CONTRACT,
    OBJECTS,
    PROCEDURES,
    SECTOR,
    YEARS,
    catalogue,
    contract_items,
    price_table,
    sql,
    table,
)
from fairtender.functions.codes import PROCEDURE_LABELS, label_table, procedure_group, subsector
from fairtender.operators import merge as mg
from fairtender.operators import rows, shape
from fairtender.plans.contracts import contract_table, computer_items, select_items

KEY = [CONTRACT, "n_item", "codigoitem", "ruc_proveedor"]
KEY_SQL = "n_cod_contrato, n_item, codigoitem, ruc_proveedor"


def _items_query(name, where, condition):
    @query(name, sql(f"SELECT {KEY_SQL} FROM contract_items WHERE {where}", "contract_items"))
    def run(spark, sf):
        return contract_items(spark, sf).filter(condition()).select(*KEY)

    return run


_items_query("filter_eq", "sector = 'ASIA'", lambda: F.col("sector") == SECTOR)
_items_query(
    "filter_or",
    "objetocontractual = 'Bien' OR objetocontractual = 'Servicio'",
    lambda: F.col("objetocontractual").isin(*OBJECTS),
)
_items_query(
    "filter_year_range",
    "year_suscripcion >= 1996 AND year_suscripcion <= 2000",
    lambda: F.col("year_suscripcion").between(*YEARS),
)
_items_query("filter_nonblank", "urlcontrato <> ''", lambda: rows.present("urlcontrato"))


@query(
    "filter_missing_high",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    WHERE l_tax / nullif(l_discount, 0) <= 0.85 AND l_discount / nullif(l_tax, 0) <= 5.0""",
)
def filter_missing_high(spark, sf):
    near = rows.at_most("l_tax", "l_discount", 0.85) & rows.at_most("l_discount", "l_tax", 5.0)
    return table(spark, sf, "lineitem").filter(near).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("filter_nonmissing", sql("SELECT n_cod_contrato, identified_price_id, unit_price FROM prices WHERE unit_price IS NOT NULL", "prices"))
def filter_nonmissing(spark, sf):
    return price_table(spark, sf).filter(F.col("unit_price").isNotNull()).select(CONTRACT, "identified_price_id", "unit_price")


@query(
    "filter_prefix_split",
    "SELECT doc_id, CASE WHEN source LIKE 'w%' THEN 'validation' ELSE 'training' END AS part FROM documents WHERE source IS NOT NULL",
)
def filter_prefix_split(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = F.col("source").startswith("w")
    return (
        docs.filter(held_out).select("doc_id", F.lit("validation").alias("part"))
        .unionByName(docs.filter(~held_out).select("doc_id", F.lit("training").alias("part")))
    )


@query("filter_regex", "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, 'Brand#2[0-9]')")
def filter_regex(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_brand").rlike("Brand#2[0-9]")).select("p_partkey", "p_brand")


@query("filter_substring", "SELECT p_partkey, p_name FROM part WHERE NOT contains(p_name, 'ring')")
def filter_substring(spark, sf):
    return table(spark, sf, "part").filter(~F.col("p_name").contains("ring")).select("p_partkey", "p_name")


@query(
    "project_keep",
    sql("SELECT codigoconvocatoria, n_cod_contrato, n_item, ruc_proveedor, urlcontrato FROM contract_items", "contract_items"),
)
def project_keep(spark, sf):
    return contract_items(spark, sf).select("codigoconvocatoria", CONTRACT, "n_item", "ruc_proveedor", "urlcontrato")


@query("project_drop", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def project_drop(spark, sf):
    return table(spark, sf, "supplier").drop("s_acctbal")


@query("project_reorder", "SELECT c_mktsegment, c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def project_reorder(spark, sf):
    return shape.move_first(table(spark, sf, "customer"), ["c_mktsegment", "c_custkey"])


@query("project_rename", "SELECT o_orderkey AS n_cod_contrato, o_totalprice AS monto_contratado_total FROM orders")
def project_rename(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").withColumnsRenamed(
        {"o_orderkey": CONTRACT, "o_totalprice": "monto_contratado_total"}
    )


@query("project_pattern", "SELECT n_cod_contrato, unit_price_1, unit_price_2 FROM (SELECT l_orderkey AS n_cod_contrato, l_extendedprice AS unit_price_1, l_tax AS unit_price_2 FROM lineitem) t")
def project_pattern(spark, sf):
    wide = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias(CONTRACT), F.col("l_quantity").alias("product_1"),
        F.col("l_extendedprice").alias("unit_price_1"), F.col("l_tax").alias("unit_price_2"),
    )
    return wide.select(CONTRACT, *shape.columns_like(wide, prefix="unit_price_"))


@query("project_except", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def project_except(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select(*shape.all_but(orders, "o_totalprice", "o_orderdate"))


@query("drop_all_missing", "SELECT s_suppkey, s_name FROM supplier")
def drop_all_missing(spark, sf):
    supplier = table(spark, sf, "supplier").select(
        "s_suppkey", F.nullif("s_nationkey", "s_nationkey").alias("ruc_proveedor9"), "s_name",
        F.nullif("s_name", "s_name").alias("n_item9"),
    )
    return rows.drop_all_missing(supplier)


@query("indicator", sql("SELECT n_cod_contrato, identified_price_id, CAST(CASE WHEN unit_price IS NOT NULL THEN 1 ELSE 0 END AS INT) AS reporte FROM prices", "prices"))
def indicator(spark, sf):
    return price_table(spark, sf).select(CONTRACT, "identified_price_id", rows.indicator(F.col("unit_price").isNotNull()).alias("reporte"))


CASE_SUBSECTOR = """CASE WHEN k = 7 THEN 7 WHEN k = 6 THEN 6 WHEN k = 5 OR k = 4 THEN 5 WHEN k = 3 THEN 4
  WHEN k = 2 THEN 3 WHEN k = 1 THEN 2 WHEN k = 0 THEN 1 END"""


@query(
    "case_subsector",
    f"SELECT p_partkey, CAST({CASE_SUBSECTOR} AS INT) AS subsector FROM (SELECT p_partkey, p_partkey % 9 AS k FROM part) t",
)
def case_subsector(spark, sf):
    codes = F.array(*[F.lit(int(c)) for c in CLASSES])
    code = F.element_at(codes, (F.col("p_partkey") % 9 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", subsector(code).alias("subsector"))


@query(
    "case_procedure_group",
    """SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
      ELSE 4 END AS INT) AS grupo FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'""",
)
def case_procedure_group(spark, sf):
    grouped = table(spark, sf, "orders").select("o_orderkey", procedure_group(F.col("o_orderpriority"), PROCEDURES).alias("grupo"))
    return grouped.filter(F.col("grupo").isNotNull())


@query(
    "fill_default",
    """SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(l_lang, 'NA') AS lang FROM (
      SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN NULL ELSE d.lang END AS l_lang
      FROM documents d LEFT JOIN labels l USING (doc_id)) t""",
)
def fill_default(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    gaps = joined.withColumn("lang", F.when(F.col("quality").isNotNull(), F.col("lang")))
    return gaps.fillna({"quality": 0, "lang": "NA"}).select("doc_id", "quality", "lang")


@query(
    "label_codes",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Direct deal' WHEN '2-HIGH' THEN 'Licitación Publica'
      WHEN '3-MEDIUM' THEN 'Adjudicación Simplificada' WHEN '5-LOW' THEN 'Subasta Inversa Electronica' END AS label FROM orders""",
)
def label_codes(spark, sf):
    coded = table(spark, sf, "orders").select("o_orderkey", procedure_group(F.col("o_orderpriority"), PROCEDURES).alias("code"))
    # a fixed table of four rows
    return coded.join(F.broadcast(label_table(spark, PROCEDURE_LABELS)), "code", "left").select("o_orderkey", "label")


# ---- joins -------------------------------------------------------------------------------

@query(
    "join_full_1to1",
    """SELECT coalesce(o_orderkey, doc_id) AS n_cod_contrato, o_orderstatus, lang,
      CAST(CASE WHEN doc_id IS NULL THEN 1 WHEN o_orderkey IS NULL THEN 2 ELSE 3 END AS INT) AS merge_texts
    FROM (SELECT o_orderkey + 50 AS o_orderkey, o_orderstatus FROM orders) o FULL JOIN documents ON o_orderkey = doc_id""",
)
def join_full_1to1(spark, sf):
    # keys are shifted, so that either side has unmatched rows
    contracts = table(spark, sf, "orders").select((F.col("o_orderkey") + 50).alias(CONTRACT), "o_orderstatus")
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias(CONTRACT), "lang")
    return mg.merge(contracts, texts, [CONTRACT], marker="merge_texts", strict=True)


@query(
    "join_full_flags",
    """SELECT coalesce(o_orderkey, doc_id) AS n_cod_contrato, CAST(coalesce(quality, 0) AS INT) AS failed_download,
      CAST(coalesce(toxic, 0) AS INT) AS broken_pdf FROM orders FULL JOIN labels ON o_orderkey = doc_id""",
)
def join_full_flags(spark, sf):
    contracts = table(spark, sf, "orders").select(F.col("o_orderkey").alias(CONTRACT))
    labels = table(spark, sf, "labels")
    failed = labels.select(F.col("doc_id").alias(CONTRACT), F.col("quality").alias("failed_download"))
    broken = labels.select(F.col("doc_id").alias(CONTRACT), F.col("toxic").alias("broken_pdf"))
    out = mg.merge_all(contracts, [(failed, ["failed_download"], None), (broken, ["broken_pdf"], None)], [CONTRACT])
    return out.fillna(0, ["failed_download", "broken_pdf"])


@query(
    "join_keepusing",
    "SELECT coalesce(doc_id, o_orderkey) AS n_cod_contrato, lang, o_totalprice FROM documents FULL JOIN orders ON o_orderkey = doc_id",
)
def join_keepusing(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias(CONTRACT), "lang")
    return mg.merge(texts, table(spark, sf, "orders").withColumnRenamed("o_orderkey", CONTRACT), [CONTRACT], keepusing=["o_totalprice"])


@query(
    "join_dates_1to1",
    sql(
        """SELECT codigoconvocatoria, n_cod_contrato, urlcontrato, fecha_suscripcion_contrato, year_suscripcion,
          count(n_item) AS item_count FROM contract_items WHERE urlcontrato <> '' GROUP BY ALL""",
        "contract_items",
    ),
)
def join_dates_1to1(spark, sf):
    contracts = contract_table(contract_items(spark, sf))
    return shape.move_first(contracts, ["codigoconvocatoria", CONTRACT, "urlcontrato", "fecha_suscripcion_contrato", "year_suscripcion"])


@query(
    "join_left_m1",
    sql(
        f"""SELECT {KEY_SQL}, itemcubso, codigoproducto, CAST(CASE WHEN c.codigoproducto IS NULL THEN 1 ELSE 3 END AS INT) AS merge_item
        FROM contract_items LEFT JOIN catalogue c USING (codigoitem, objetocontractual)""",
        "contract_items", "catalogue",
    ),
)
def join_left_m1(spark, sf):
    items = contract_items(spark, sf).select(*KEY, "objetocontractual")
    out = mg.merge(items, catalogue(spark, sf), ["codigoitem", "objetocontractual"], "m:1", {1, 3}, ["itemcubso", "codigoproducto"], "merge_item")
    return out.drop("objetocontractual")


COMPUTER_CODES = "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_size < 10"


@query(
    "join_semi_m1",
    sql(f"SELECT {KEY_SQL} FROM contract_items WHERE objetocontractual = 'Bien' AND codigoitem IN ({COMPUTER_CODES})", "contract_items"),
)
def join_semi_m1(spark, sf):
    codes = table(spark, sf, "part").filter("p_type = 'ECONOMY' AND p_size < 10").select(F.col("p_partkey").alias("codigoitem"))
    return computer_items(contract_items(spark, sf), codes).select(*KEY)


@query(
    "join_inner_text",
    "SELECT page_id, p.lang AS lang, l.quality FROM (SELECT doc_id AS page_id, lang FROM documents) p JOIN labels l ON page_id = doc_id",
)
def join_inner_text(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "lang")
    review = table(spark, sf, "labels").withColumnRenamed("doc_id", "page_id").select("page_id", "quality")
    return mg.merge(texts, review, ["page_id"], "m:m", {3})


@query(
    "distinct_wide_rows",
    "SELECT md5(text) AS text_md5, lang, source FROM (SELECT DISTINCT text, lang, source FROM documents) d",
)
def distinct_wide_rows(spark, sf):
    """Texts move only where their digests are repeated."""
    return mg.distinct_rows(table(spark, sf, "documents").select("text", "lang", "source")).select(F.md5("text").alias("text_md5"), "lang", "source")


@query(
    "check_unique",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def check_unique(spark, sf):
    return mg.check_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "report_duplicates",
    """SELECT copies, CAST(sum(copies) AS BIGINT) AS observations, CAST(sum(copies - 1) AS BIGINT) AS surplus FROM (
      SELECT count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber) t GROUP BY copies""",
)
def report_duplicates(spark, sf):
    return mg.report_duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---- aggregates --------------------------------------------------------------------------

@query(
    "agg_mean",
    sql("SELECT year_suscripcion, contratacion, round(avg(monto_contratado_item), 4) AS mean_amount FROM contract_items GROUP BY 1, 2", "contract_items"),
)
def agg_mean(spark, sf):
    return contract_items(spark, sf).groupBy("year_suscripcion", "contratacion").agg(
        F.round(F.avg("monto_contratado_item"), 4).alias("mean_amount")
    )


@query(
    "agg_sum",
    sql("SELECT n_cod_contrato, round(coalesce(sum(unit_price), 0), 2) AS total_price FROM prices GROUP BY 1", "prices"),
)
def agg_sum(spark, sf):
    return price_table(spark, sf).groupBy(CONTRACT).agg(F.round(F.coalesce(F.sum("unit_price"), F.lit(0.0)), 2).alias("total_price"))


@query(
    "agg_min",
    sql(
        """SELECT codigoentidad, ruc_proveedor, min(fecha_suscripcion_contrato) AS min_fecha FROM contract_items
        WHERE year_suscripcion IN (1996, 1997) GROUP BY 1, 2""",
        "contract_items",
    ),
)
def agg_min(spark, sf):
    return contract_items(spark, sf).filter(F.col("year_suscripcion").isin(1996, 1997)).groupBy("codigoentidad", "ruc_proveedor").agg(
        F.min("fecha_suscripcion_contrato").alias("min_fecha")
    )


@query(
    "agg_by_stats",
    """SELECT l_returnflag, round(avg(l_extendedprice), 4) AS price, round(avg(l_discount), 8) AS discount,
      round(avg(l_tax), 8) AS tax FROM lineitem GROUP BY ROLLUP (l_returnflag)""",
)
def agg_by_stats(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag").agg(
        F.round(F.avg("l_extendedprice"), 4).alias("price"),
        F.round(F.avg("l_discount"), 8).alias("discount"),
        F.round(F.avg("l_tax"), 8).alias("tax"),
    )


@query(
    "agg_count_if",
    sql(
        """SELECT CAST(count(*) FILTER (WHERE n_cod_contrato IS NULL) AS BIGINT) AS n_cod_contrato,
          CAST(count(*) FILTER (WHERE unit_price IS NULL) AS BIGINT) AS unit_price FROM prices""",
        "prices",
    ),
)
def agg_count_if(spark, sf):
    return rows.count_missing(price_table(spark, sf).select(CONTRACT, "unit_price"))


@query(
    "distinct_key_first",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (
      PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS j FROM lineitem) t WHERE j = 1""",
)
def distinct_key_first(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return mg.distinct_first(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("distinct_rows", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def distinct_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").distinct()


@query("select_items", sql(f"SELECT {KEY_SQL} FROM selected", "selected"))
def selected(spark, sf):
    return select_items(contract_items(spark, sf), SECTOR, OBJECTS, YEARS).select(*KEY)
