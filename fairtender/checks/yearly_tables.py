"""Yearly tables and the column dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairtender.checks.registry import query
from fairtender.checks.standin import CONTRACT, ITEM_ORDER, PROCEDURES, contract_items, saved_base, saved_prices, sql
from fairtender.functions.codes import procedure_group
from fairtender.plans import yearly
from fairtender.sources.tables import blank_to_missing

ORDER_SQL = "n_item, codigoitem, ruc_proveedor, monto_contratado_item"
COUNTS = f"""SELECT y AS year_suscripcion, {", ".join(f"CAST(max(CASE WHEN g = {g} THEN n END) AS BIGINT) AS num_contratos{g}" for g in (1, 2, 3, 4))}
  FROM (SELECT y, g, sum(first_row) AS n FROM (SELECT year_suscripcion AS y, CASE tipoprocesoseleccion WHEN '1-URGENT' THEN 1
      WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 4 END AS g,
      CASE WHEN row_number() OVER (PARTITION BY n_cod_contrato ORDER BY {ORDER_SQL}) = 1 THEN 1 ELSE 0 END AS first_row
    FROM contract_items WHERE tipoprocesoseleccion <> '4-NOT SPECIFIED') f GROUP BY y, g) s GROUP BY y"""
SHARES = f"""SELECT *, {", ".join(f"round(CAST(num_contratos{g} AS DOUBLE) / nullif(total_contratos, 0), 6) AS share{g}" for g in (1, 2, 3, 4))}
  FROM (SELECT *, num_contratos1 + num_contratos2 + num_contratos3 + num_contratos4 AS total_contratos FROM ({COUNTS}) c) t"""


def _counts(spark, sf):
    # stated as a list, so that the scan can skip what belongs to no group
    items = contract_items(spark, sf).filter(F.col("tipoprocesoseleccion").isin(*PROCEDURES))
    return yearly.contract_counts(items, procedure_group(F.col("tipoprocesoseleccion"), PROCEDURES), CONTRACT, ITEM_ORDER)


@query("yearly_contract_counts", sql(COUNTS, "contract_items"))
def yearly_contract_counts(spark, sf):
    return _counts(spark, sf)


@query("yearly_contract_shares", sql(SHARES, "contract_items"))
def yearly_contract_shares(spark, sf):
    shares = yearly.contract_shares(_counts(spark, sf))
    return shares.select(*[F.round(c, 6).alias(c) if c.startswith("share") else F.col(c) for c in shares.columns])


def _mean_sql(value, view):
    return sql(
        f"""SELECT year_suscripcion, round(avg(CASE WHEN contratacion = 0 THEN {value} END), 4) AS {value}0,
          round(avg(CASE WHEN contratacion = 1 THEN {value} END), 4) AS {value}1 FROM {view} GROUP BY 1""",
        view,
    )


@query("yearly_mean_price", _mean_sql("mean_unit_price", "price_sample"))
def yearly_mean_price(spark, sf):
    means = yearly.mean_by_year(saved_prices(spark, sf), "mean_unit_price")
    return means.select("year_suscripcion", *[F.round(f"mean_unit_price{k}", 4).alias(f"mean_unit_price{k}") for k in (0, 1)])


@query("yearly_report_rate", _mean_sql("reporte", "base"))
def yearly_report_rate(spark, sf):
    means = yearly.mean_by_year(saved_base(spark, sf), "reporte")
    return means.select("year_suscripcion", *[F.round(f"reporte{k}", 4).alias(f"reporte{k}") for k in (0, 1)])


DICTIONARY = {"n_cod_contrato": "contract", "urlcontrato": "link", "codigoitem": "item code"}


@query(
    "variable_dictionary",
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS varname, '{label}' AS varlabel, CAST(count(nullif(CAST({c} AS VARCHAR), '')) AS BIGINT) AS n_filled FROM contract_items"
            for c, label in DICTIONARY.items()
        ),
        "contract_items",
    ),
)
def variable_dictionary(spark, sf):
    items = blank_to_missing(contract_items(spark, sf).select(*DICTIONARY))
    for name, label in DICTIONARY.items():
        items = items.withMetadata(name, {"comment": label})
    return yearly.variable_dictionary(items)
