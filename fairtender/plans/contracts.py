"""From contract items and model answers to the regression base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairtender.functions.codes import class_code, subsector, year_gap
from fairtender.functions.prices import item_prices, kept_prices, parse_prices, spread_prices
from fairtender.operators.merge import distinct_first, merge
from fairtender.operators.rows import at_most, drop_empty_if_filled, indicator, panel_filter, panel_mark, present
from fairtender.operators.shape import union_marked
from fairtender.operators.skew import HOT_ROWS, attach_stats, hot_keys, lookup, number_rows, total_order
from fairtender.session import stage

CONTRACT = "n_cod_contrato"
ITEM_ORDER = ("n_item", "codigoitem", "ruc_proveedor", "monto_contratado_item")


def select_items(
    items: DataFrame, sector: str | None, objects: Sequence[str], years: tuple[int, int] | None
) -> DataFrame:
    """Items of one sector, of the stated objects, signed in the stated years."""
    keep = F.col("objetocontractual").isin(*objects)
    if sector is not None:
        keep = keep & (F.col("sector") == sector)
    if years is not None:
        keep = keep & F.col("year_suscripcion").between(*years)
    return items.filter(keep)


def contract_table(items: DataFrame) -> DataFrame:
    """One row per contract with a document: link, signing date and year, number of items.

    The item count stands for the repeated item columns of a wide layout.
    """
    linked = items.filter(present("urlcontrato"))
    contracts = linked.groupBy("codigoconvocatoria", CONTRACT, "urlcontrato").agg(F.count("n_item").alias("item_count"))
    dates = distinct_first(
        linked.select("urlcontrato", "fecha_suscripcion_contrato", "year_suscripcion"),
        ["urlcontrato"],
        ["fecha_suscripcion_contrato"],
    )
    return merge(contracts, dates, ["urlcontrato"])


def item_counts(items: DataFrame) -> DataFrame:
    """Items per contract with a document, which is all the prices need of the contract table."""
    return items.filter(present("urlcontrato")).groupBy(CONTRACT).agg(F.count("n_item").alias("item_count"))


def answer_prices(answers: DataFrame, contracts: DataFrame, answer: str, dialect: str = "main") -> DataFrame:
    """(contract, item_group, mean_unit_price) out of the model's answers.

    An answer without a contract has no item to go to, so the join keeps the contracts.
    """
    joined = merge(contracts.select(CONTRACT, "item_count"), answers, [CONTRACT], keep={1, 3}, keepusing=[answer])
    groups = spread_prices(parse_prices(F.col(answer), dialect), F.col("item_count"))
    return joined.select(CONTRACT, F.inline(groups))


def spread_long(prices: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same from a long table (contract, item_count, identified_price_id, unit_price)."""
    once = distinct_first(prices, [CONTRACT, "item_count", "unit_price"], ["identified_price_id"])
    kept = drop_empty_if_filled(once, [CONTRACT], "unit_price", hot_rows)
    placed = item_groups(kept, hot_rows)
    means = placed.groupBy(CONTRACT, "item_group").agg(
        F.avg("unit_price").alias("mean_unit_price"), F.avg("item_count").alias("item_count")
    )
    return means.filter("item_group <= item_count").drop("item_count")


def item_groups(kept: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Which item each price of a contract belongs to, missing where that cannot be told."""
    numbered = number_rows(kept, [CONTRACT], ["identified_price_id"], "i", hot_rows)
    sized = attach_stats(numbered, [CONTRACT], {"total_obs": F.count("i")}, hot_rows)
    block = F.floor(F.try_divide(F.col("total_obs").cast("double"), F.col("item_count")))
    few = (F.col("item_count") > F.col("total_obs")) & F.col("unit_price").isNotNull()
    return sized.withColumn(
        "item_group",
        F.when(few, F.col("i")).otherwise(F.ceil(F.try_divide(F.col("i").cast("double"), block.cast("double")))),
    )


def attach_prices(items: DataFrame, spread: DataFrame, order: Sequence[str] = ITEM_ORDER, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number the items of each contract and keep those whose number has a price group."""
    numbered = number_rows(items, [CONTRACT], order, "item_group", hot_rows)
    return numbered.join(spread, [CONTRACT, "item_group"], "inner")


def priced_items(items: DataFrame, answers: DataFrame, answer: str, dialect: str = "main", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Items with the price of their number in the contract's answer, full copies removed.

    Items are moved once, by contract, to be counted, numbered, priced and compared. If a contract is
    hot, its items meet its prices by contract and number.
    """
    if hot_keys(items, [CONTRACT], hot_rows)[0] is not None:
        return attach_prices(items, answer_prices(answers, item_counts(items), answer, dialect), hot_rows=hot_rows).distinct()
    whole = Window.partitionBy(CONTRACT)
    numbered = items.filter(F.col(CONTRACT).isNotNull()).select(
        "*",
        F.row_number().over(whole.orderBy(*total_order(ITEM_ORDER))).cast("long").alias("item_group"),
        F.count(F.when(present("urlcontrato"), F.col("n_item"))).over(whole).alias("_count"),
    )
    # an answer is read once, not once per item; no item with a document, no price
    read = answers.select(CONTRACT, kept_prices(parse_prices(F.col(answer), dialect)).alias("_kept"))
    joined = numbered.filter("_count > 0").join(read, [CONTRACT], "left")
    rest = [c for c in numbered.columns if c not in (CONTRACT, "item_group", "_count")]
    own = F.explode(item_prices(F.col("_kept"), F.col("_count"), F.col("item_group"))).alias("mean_unit_price")
    return joined.select(CONTRACT, "item_group", *rest, own).distinct()


def old_supplier(
    df: DataFrame, entity: str, supplier: str, date: str, year: str, base_years: Sequence[int], hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """1 if the pair first dealt in the base years, at least a calendar year before."""
    first = F.min(F.when(F.col(year).isin(*base_years), F.col(date)))
    dated = attach_stats(df, [entity, supplier], {"min_fecha": first}, hot_rows)
    return dated.withColumn("antiguo_proveedor", year_gap(F.col(date), F.col("min_fecha")))


def add_subsector(items: DataFrame, catalogue: DataFrame, on: Sequence[str], classes=None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Product code from the catalogue, its class and subsector."""
    coded = lookup(items, catalogue.select(*on, "itemcubso", "codigoproducto"), on, hot_rows=hot_rows)
    coded = coded.withColumn("codigoclase", class_code(F.col("codigoproducto")))
    return coded.withColumn("subsector", subsector(F.col("codigoclase"), classes))


def regression_base(
    sources: Sequence[tuple[DataFrame, DataFrame]],
    catalogue: DataFrame,
    base_years: Sequence[int],
    answer: str = "gpt_unit_prices",
    dialect: str = "main",
    catalogue_on: Sequence[str] = ("codigoitem", "objetocontractual"),
    classes=None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Items with prices, supplier history, subsector and the reporting mark, panel entities only.

    ``sources`` are (items, answers) pairs, stacked with a source mark ``temp_1`` when
    there are two; full copies within a source are removed. The items are read several
    times, so stage them first; the priced items are staged here. Wide rows are moved three times:
    by contract, by entity, and by item code.
    """
    parts = [priced_items(items, answers, answer, dialect, hot_rows) for items, answers in sources]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = union_marked(stacked, part, "temp_1")
    # two sources differ by their mark
    priced = stage(stacked if len(parts) < 3 else stacked.distinct())
    calm = hot_keys(priced, ["codigoentidad"], hot_rows)[0] is None
    # what is done by entity and supplier needs no other layout than that by entity
    laid, own_rows = (priced.repartition("codigoentidad"), None) if calm else (priced, hot_rows)
    dated = old_supplier(
        laid, "codigoentidad", "ruc_proveedor", "fecha_suscripcion_contrato", "year_suscripcion", base_years, own_rows
    )
    panel = stage(panel_filter(dated, "codigoentidad", "d_pandemia", own_rows))
    coded = add_subsector(panel, catalogue, list(catalogue_on), classes, hot_rows)
    return coded.withColumn("reporte", indicator(F.col("mean_unit_price").isNotNull()))


def price_sample(base: DataFrame, limit: float = 0.85, good: str = "Bien", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Priced goods whose price is a plausible part of the item and contract amounts, panel items only."""
    priced = base.filter((F.col("reporte") == 1) & (F.col("objetocontractual") == good))
    plausible = priced.filter(
        at_most("mean_unit_price", "monto_contratado_item", limit)
        & at_most("mean_unit_price", "monto_contratado_total", limit)
    )
    return panel_filter(plausible, "codigoitem", "d_pandemia", hot_rows)


def computer_items(items: DataFrame, codes: DataFrame, good: str = "Bien") -> DataFrame:
    """Goods whose item code is in a code list."""
    goods = items.filter(F.col("objetocontractual") == good)
    return lookup(goods, codes.select("codigoitem").distinct(), ["codigoitem"], "inner")


def computer_base(
    goods: DataFrame, answers: DataFrame, answer: str = "gpt_unit_prices", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Computers with their prices; entities on one side of the break are marked, not dropped."""
    spread = answer_prices(answers, item_counts(goods), answer, "computers")
    priced = attach_prices(goods, spread, hot_rows=hot_rows)
    reported = priced.withColumn("reporte", indicator(F.col("mean_unit_price").isNotNull()))
    marked = panel_mark(reported, "codigoentidad", "d_pandemia", "panel", hot_rows)
    return marked.filter(F.col("mean_unit_price").isNotNull())
