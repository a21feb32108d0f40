"""The procurement tables as seen through the test tables, as DataFrames and as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairtender.functions.codes import item_code, month_index, product_code, quarter_index
from fairtender.operators.shape import union_marked
from fairtender.operators.skew import attach_stats, dealt, number_rows
from fairtender.plans.contracts import (
    CONTRACT,
    ITEM_ORDER,
    computer_base,
    computer_items,
    price_sample,
    regression_base,
    select_items,
)
from fairtender.session import stage

SECTOR, OBJECTS, YEARS = "ASIA", ("Bien", "Servicio"), (1996, 2000)
BASE_YEARS = (1996, 1997)
BREAK = "2000-03-01"
PROCEDURES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "5-LOW": 4}
CLASSES = ["721214", "851218", "851017", "921015", "512345", "121419", "421322", "422318", "999999"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    read = spark.read.parquet(f"{sf}/{name}.parquet")
    # one file of long texts: the work per row is worth moving it
    return read


def contract_items(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    # the smallest tables first, so that no row of lineitem moves more than once
    regions = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    entities = table(spark, sf, "customer").join(regions, F.expr("c_nationkey = n_nationkey"))
    signed = table(spark, sf, "orders").join(entities, F.expr("o_custkey = c_custkey"))
    joined = table(spark, sf, "lineitem").join(signed, F.expr("l_orderkey = o_orderkey"))
    return joined.select(
        F.col("o_custkey").alias("codigoconvocatoria"),
        F.col("o_orderkey").alias(CONTRACT),
        F.col("l_linenumber").alias("n_item"),
        F.col("l_suppkey").alias("ruc_proveedor"),
        F.when(F.col("o_orderkey") % 10 == 0, "")
        .otherwise(F.concat(F.lit("http://contracts.example/"), F.col("o_orderkey").cast("string")))
        .alias("urlcontrato"),
        day.alias("fecha_suscripcion_contrato"),
        F.year(day).alias("year_suscripcion"),
        month_index(day).alias("monthyear_suscripcion"),
        quarter_index(day).alias("quarteryear_suscripcion"),
        F.col("r_name").alias("sector"),
        F.when(F.col("l_returnflag") == "R", "Bien")
        .when(F.col("l_returnflag") == "N", "Servicio")
        .otherwise("Obra")
        .alias("objetocontractual"),
        F.col("o_orderpriority").alias("tipoprocesoseleccion"),
        F.col("o_orderstatus").alias("sistema_contratacion"),
        F.col("o_custkey").alias("codigoentidad"),
        F.col("c_mktsegment").alias("tipoentidad"),
        F.col("l_partkey").alias("codigoitem"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("contratacion"),
        F.when(F.col("o_orderdate") >= F.lit(BREAK).cast("timestamp"), 1).otherwise(0).alias("d_pandemia"),
        F.col("l_extendedprice").alias("monto_contratado_item"),
        F.col("o_totalprice").alias("monto_contratado_total"),
    )


CONTRACT_ITEMS = """
SELECT o_custkey AS codigoconvocatoria, o_orderkey AS n_cod_contrato,
  l_linenumber AS n_item, l_suppkey AS ruc_proveedor,
  CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat('http://contracts.example/', o_orderkey) END AS urlcontrato,
  CAST(o_orderdate AS DATE) AS fecha_suscripcion_contrato,
  CAST(year(o_orderdate) AS INT) AS year_suscripcion,
  CAST((year(o_orderdate) - 1960) * 12 + month(o_orderdate) - 1 AS INT) AS monthyear_suscripcion,
  CAST((year(o_orderdate) - 1960) * 4 + quarter(o_orderdate) - 1 AS INT) AS quarteryear_suscripcion,
  r_name AS sector,
  CASE l_returnflag WHEN 'R' THEN 'Bien' WHEN 'N' THEN 'Servicio' ELSE 'Obra' END AS objetocontractual,
  o_orderpriority AS tipoprocesoseleccion, o_orderstatus AS sistema_contratacion,
  o_custkey AS codigoentidad, c_mktsegment AS tipoentidad, l_partkey AS codigoitem,
  CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS INT) AS contratacion,
  CAST(CASE WHEN o_orderdate >= TIMESTAMP '2000-03-01 00:00:00' THEN 1 ELSE 0 END AS INT) AS d_pandemia,
  l_extendedprice AS monto_contratado_item, o_totalprice AS monto_contratado_total
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def selected_items(spark: SparkSession, sf: str) -> DataFrame:
    return select_items(contract_items(spark, sf), SECTOR, OBJECTS, YEARS)


SELECTED = """
SELECT * FROM contract_items WHERE sector = 'ASIA' AND objetocontractual IN ('Bien', 'Servicio')
  AND year_suscripcion BETWEEN 1996 AND 2000"""


def price_table(spark: SparkSession, sf: str) -> DataFrame:
    """Long prices: every third item number unreported, every seventh contract without answer."""
    items = dealt(contract_items(spark, sf).select(CONTRACT, *ITEM_ORDER), [CONTRACT])
    counted = attach_stats(items, [CONTRACT], {"item_count": F.count(F.lit(1))})
    numbered = number_rows(counted, [CONTRACT], ITEM_ORDER, "identified_price_id")
    price = F.when((F.col("n_item") % 3 == 0) | (F.col(CONTRACT) % 7 == 0), None).otherwise(
        F.col("monto_contratado_item")
    )
    return numbered.select(CONTRACT, "item_count", "identified_price_id", price.alias("unit_price"))


PRICES = """
SELECT n_cod_contrato, item_count, pos AS identified_price_id,
  CASE WHEN n_item % 3 = 0 OR n_cod_contrato % 7 = 0 THEN NULL ELSE monto_contratado_item END AS unit_price
FROM (SELECT n_cod_contrato, n_item, monto_contratado_item,
        count(*) OVER (PARTITION BY n_cod_contrato) AS item_count,
        row_number() OVER (PARTITION BY n_cod_contrato
          ORDER BY n_item, codigoitem, ruc_proveedor, monto_contratado_item) AS pos
      FROM contract_items) t"""


def answers(spark: SparkSession, sf: str, shift: int = 0) -> DataFrame:
    """A model answer per contract: up to five prices, some blank, some equal, some with a thousands comma."""
    key = F.col("o_orderkey")
    whole = F.floor(F.col("o_totalprice"))

    def price(j: int):
        divisor = F.when(key % 17 == 0, F.lit(10)).otherwise(F.lit(10 * j))
        return F.concat(F.floor(whole / divisor).cast("string"), F.lit(".50"))

    pieces = [price(1)] + [
        F.when((key + shift) % 5 >= j - 1, F.concat(F.lit("; "), price(j))).otherwise("") for j in range(2, 6)
    ]
    comma = F.when(key % 13 == 0, "1,").otherwise("")
    text = F.concat(F.lit("S/ "), comma, *pieces)
    answer = F.when(key % 7 == 0, "").when(key % 11 == 0, "No Match").otherwise(text)
    return table(spark, sf, "orders").select(key.alias(CONTRACT), answer.alias("gpt_unit_prices"))


def answers_sql(shift: int = 0) -> str:
    def price(j: int) -> str:
        return (
            f"concat(CAST(CAST(floor(floor(o_totalprice) / CASE WHEN o_orderkey % 17 = 0 THEN 10 ELSE {10 * j} END) "
            "AS BIGINT) AS VARCHAR), '.50')"
        )

    tail = ", ".join(
        f"CASE WHEN (o_orderkey + {shift}) % 5 >= {j - 1} THEN concat('; ', {price(j)}) ELSE '' END" for j in range(2, 6)
    )
    return f"""
SELECT o_orderkey AS n_cod_contrato, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'No Match'
  ELSE concat('S/ ', CASE WHEN o_orderkey % 13 = 0 THEN '1,' ELSE '' END, {price(1)}, {tail}) END AS gpt_unit_prices
FROM orders"""


def catalogue_codes(spark: SparkSession, sf: str) -> DataFrame:
    """(code, name): 8 characters of product and 17 of item number."""
    key = F.col("p_partkey")
    names = F.array(*[F.lit(c) for c in CLASSES])
    product = F.concat(F.element_at(names, (key % 9 + 1).cast("int")), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    return table(spark, sf, "part").select(
        F.concat(product, F.lpad(key.cast("string"), 17, "0")).alias("code"), F.col("p_name").alias("name"), key.alias("part")
    )


CATALOGUE_CODES = f"""
SELECT concat(list_extract([{", ".join(f"'{c}'" for c in CLASSES)}], CAST(p_partkey % 9 + 1 AS INT)),
    lpad(CAST(p_size AS VARCHAR), 2, '0'), lpad(CAST(p_partkey AS VARCHAR), 17, '0')) AS code,
  p_name AS name, p_partkey AS part FROM part"""


OTHER_ITEMS = 10**12


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Goods sheet and services sheet, one above the other."""
    codes = catalogue_codes(spark, sf)

    def sheet(kind: str, missing: int) -> DataFrame:
        # every tenth item number is another one, so that some contract items have no match
        number = item_code(F.col("code"))
        return codes.select(
            F.col("name").alias("itemcubso"),
            F.lit(kind).alias("objetocontractual"),
            product_code(F.col("code")).alias("codigoproducto"),
            F.when(F.col("part") % 10 == missing, number + OTHER_ITEMS).otherwise(number).alias("codigoitem"),
        )

    return union_marked(sheet("Servicio", 4), sheet("Bien", 3))


CATALOGUE = "UNION ALL".join(
    f"""
SELECT name AS itemcubso, '{kind}' AS objetocontractual, substr(code, 1, 8) AS codigoproducto,
  TRY_CAST(regexp_replace(substr(code, 9, 17), '^0+', '') AS BIGINT) + CASE WHEN part % 10 = {missing} THEN {OTHER_ITEMS} ELSE 0 END AS codigoitem
FROM catalogue_codes """
    for kind, missing in (("Servicio", 4), ("Bien", 3))
)


def base(spark: SparkSession, sf: str) -> DataFrame:
    """The regression base: all selected years, and one year extracted a second time."""
    items = stage(selected_items(spark, sf))
    again = items.filter("year_suscripcion = 1999")
    return regression_base(
        [(items, answers(spark, sf)), (again, answers(spark, sf, 2))], catalogue(spark, sf), BASE_YEARS
    )


_SAVED: dict = {}


def saved(spark: SparkSession, sf: str, name: str, make) -> DataFrame:
    """A table made once per session and data folder, then read back by every model that uses it."""
    at = (spark.sparkContext.applicationId, sf, name)
    if at not in _SAVED:
        _SAVED[at] = stage(make())
    return _SAVED[at]


def saved_base(spark: SparkSession, sf: str) -> DataFrame:
    return saved(spark, sf, "base", lambda: base(spark, sf))


def saved_prices(spark: SparkSession, sf: str) -> DataFrame:
    return saved(spark, sf, "prices", lambda: price_sample(saved_base(spark, sf)))


def computers(spark: SparkSession, sf: str) -> DataFrame:
    codes = table(spark, sf, "part").filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("codigoitem"))
    return computer_base(stage(computer_items(contract_items(spark, sf), codes)), answers(spark, sf))


PARSED = """
SELECT {src}.n_cod_contrato, item_count, unnest(range(1, len(pieces) + 1)) AS identified_price_id,
  unnest(list_transform(pieces, lambda x: TRY_CAST(x AS DOUBLE))) AS unit_price
FROM (SELECT n_cod_contrato, string_split_regex(regexp_replace(regexp_replace(gpt_unit_prices,
    '[^0-9;.,-]', '', 'g'), '\\.+', '.', 'g'), '[;,-]') AS pieces FROM {answers}) {src}
  JOIN (SELECT n_cod_contrato, count(n_item) AS item_count FROM {items} WHERE urlcontrato <> ''
    GROUP BY n_cod_contrato) c USING (n_cod_contrato)"""

SPREAD = """
SELECT n_cod_contrato, item_group, avg(unit_price) AS mean_unit_price FROM (
  SELECT n_cod_contrato, item_count, unit_price,
    CASE WHEN item_count > total AND unit_price IS NOT NULL THEN CAST(i AS BIGINT)
      ELSE CAST(ceil(CAST(i AS DOUBLE) / nullif(floor(CAST(total AS DOUBLE) / nullif(item_count, 0)), 0)) AS BIGINT)
    END AS item_group
  FROM (SELECT *, row_number() OVER (PARTITION BY n_cod_contrato ORDER BY pos) AS i,
          count(*) OVER (PARTITION BY n_cod_contrato) AS total
        FROM (SELECT *, count(unit_price) OVER (PARTITION BY n_cod_contrato) AS filled
              FROM (SELECT n_cod_contrato, item_count, unit_price, min(identified_price_id) AS pos
                    FROM {prices} GROUP BY n_cod_contrato, item_count, unit_price) d) k
        WHERE NOT (unit_price IS NULL AND filled > 0)) x) g
WHERE item_group <= item_count GROUP BY n_cod_contrato, item_group"""

PRICED = """
SELECT i.*, s.mean_unit_price, {mark} AS temp_1 FROM (
  SELECT *, row_number() OVER (PARTITION BY n_cod_contrato
    ORDER BY n_item, codigoitem, ruc_proveedor, monto_contratado_item) AS item_group FROM {items}) i
JOIN {spread} s ON i.n_cod_contrato = s.n_cod_contrato AND i.item_group = s.item_group"""

SUBSECTOR = """CASE WHEN codigoclase IN (422318) THEN 7 WHEN codigoclase IN (421322) THEN 6
  WHEN codigoclase IN (121419) OR CAST(codigoclase AS VARCHAR) LIKE '51%' THEN 5 WHEN codigoclase IN (921015) THEN 4
  WHEN codigoclase IN (851017) THEN 3 WHEN codigoclase IN (851218) THEN 2 WHEN codigoclase IN (721214) THEN 1 END"""

BASE = f"""
SELECT * FROM (
  SELECT q.*, CAST({SUBSECTOR} AS INT) AS subsector, CAST(CASE WHEN mean_unit_price IS NULL THEN 0 ELSE 1 END AS INT) AS reporte,
    sum(d_pandemia) OVER (PARTITION BY codigoentidad) AS after_n,
    sum(1 - d_pandemia) OVER (PARTITION BY codigoentidad) AS before_n
  FROM (SELECT p.*, c.codigoproducto, TRY_CAST(substr(c.codigoproducto, 1, 6) AS INT) AS codigoclase,
      min_fecha, CAST(CASE WHEN year(fecha_suscripcion_contrato) - year(min_fecha) >= 1 THEN 1 ELSE 0 END AS INT)
        AS antiguo_proveedor
    FROM (SELECT DISTINCT * FROM (SELECT * FROM priced_first UNION ALL SELECT * FROM priced_again) u) p
    LEFT JOIN (SELECT codigoentidad, ruc_proveedor, min(fecha_suscripcion_contrato) AS min_fecha
        FROM (SELECT * FROM priced_first UNION ALL SELECT * FROM priced_again) u2
        WHERE year_suscripcion IN (1996, 1997) GROUP BY codigoentidad, ruc_proveedor) h
      ON p.codigoentidad = h.codigoentidad AND p.ruc_proveedor = h.ruc_proveedor
    LEFT JOIN catalogue c ON p.codigoitem = c.codigoitem AND p.objetocontractual = c.objetocontractual) q) z
WHERE after_n > 0 AND before_n > 0"""

PRICE_SAMPLE = """
SELECT * FROM (
  SELECT *, sum(d_pandemia) OVER (PARTITION BY codigoitem) AS item_after,
    sum(1 - d_pandemia) OVER (PARTITION BY codigoitem) AS item_before
  FROM base WHERE reporte = 1 AND objetocontractual = 'Bien'
    AND mean_unit_price / nullif(monto_contratado_item, 0) <= 0.85
    AND mean_unit_price / nullif(monto_contratado_total, 0) <= 0.85) t
WHERE item_after > 0 AND item_before > 0"""

PARSED_COMPUTERS = """
SELECT a.n_cod_contrato, item_count, unnest(range(1, len(pieces) + 1)) AS identified_price_id,
  unnest(list_transform(pieces, lambda x: TRY_CAST(x AS DOUBLE))) AS unit_price
FROM (SELECT n_cod_contrato, string_split(regexp_replace(gpt_unit_prices, '[^0-9;.]', '', 'g'), ';') AS pieces FROM answers) a
  JOIN (SELECT n_cod_contrato, count(n_item) AS item_count FROM goods WHERE urlcontrato <> ''
    GROUP BY n_cod_contrato) c USING (n_cod_contrato)"""

COMPUTERS = """
SELECT * FROM (SELECT *, CAST(CASE WHEN sum(d_pandemia) OVER (PARTITION BY codigoentidad) > 0
    AND sum(1 - d_pandemia) OVER (PARTITION BY codigoentidad) > 0 THEN 1 ELSE 0 END AS INT) AS panel
  FROM priced_goods) t WHERE mean_unit_price IS NOT NULL"""

VIEWS = {
    "contract_items": CONTRACT_ITEMS,
    "prices": PRICES,
    "selected": SELECTED,
    "answers": answers_sql(),
    "answers_again": answers_sql(2),
    "catalogue_codes": CATALOGUE_CODES,
    "catalogue": CATALOGUE,
    "selected_again": "SELECT * FROM selected WHERE year_suscripcion = 1999",
    "parsed_first": PARSED.format(src="a", answers="answers", items="selected"),
    "parsed_again": PARSED.format(src="a", answers="answers_again", items="selected_again"),
    "spread_first": SPREAD.format(prices="parsed_first"),
    "spread_again": SPREAD.format(prices="parsed_again"),
    "priced_first": PRICED.format(items="selected", spread="spread_first", mark="0"),
    "priced_again": PRICED.format(items="selected_again", spread="spread_again", mark="1"),
    "base": BASE,
    "price_sample": PRICE_SAMPLE,
    "goods": """SELECT * FROM contract_items WHERE objetocontractual = 'Bien'
  AND codigoitem IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')""",
    "parsed_goods": PARSED_COMPUTERS,
    "spread_goods": SPREAD.format(prices="parsed_goods"),
    "priced_goods": PRICED.format(items="goods", spread="spread_goods", mark="0"),
    "computers": COMPUTERS,
}
NEEDS = {
    "prices": ["contract_items"],
    "selected": ["contract_items"],
    "catalogue": ["catalogue_codes"],
    "selected_again": ["selected"],
    "parsed_first": ["answers", "selected"],
    "parsed_again": ["answers_again", "selected_again"],
    "spread_first": ["parsed_first"],
    "spread_again": ["parsed_again"],
    "priced_first": ["selected", "spread_first"],
    "priced_again": ["selected_again", "spread_again"],
    "base": ["priced_first", "priced_again", "catalogue"],
    "price_sample": ["base"],
    "goods": ["contract_items"],
    "parsed_goods": ["answers", "goods"],
    "spread_goods": ["parsed_goods"],
    "priced_goods": ["goods", "spread_goods"],
    "computers": ["priced_goods"],
}


def sql(body: str, *views: str, **extra: str) -> str:
    """``body`` with the named views, and those they need, in front; ``extra`` adds further ones."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    parts = [f"{v} AS ({VIEWS[v]})" for v in order] + [f"{k} AS MATERIALIZED ({q})" for k, q in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
