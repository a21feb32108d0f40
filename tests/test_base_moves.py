"""The regression base moves wide rows by contract, by entity and by item code, and no more."""

import re

from pyspark.sql import functions as F

from fairtender.plans import contracts as pl

ITEMS = "n_cod_contrato long, n_item long, codigoitem long, ruc_proveedor long, monto_contratado_item double, urlcontrato string, note string"
ANSWERS = "n_cod_contrato long, gpt_unit_prices string"


def _plain(items, answers):
    """The steps one after the other, as they are for hot contracts."""
    spread = pl.answer_prices(answers, pl.item_counts(items), "gpt_unit_prices")
    return pl.attach_prices(items, spread).distinct()


def test_priced_items_move_once(spark):
    rows = [
        (c, n, 10 * (n or 9), 7, 5.0 * (n or 8), None if c % 4 == 0 else "" if c % 5 == 0 and n > 1 else f"u{c}", "x")
        for c in range(1, 25)
        for n in [*range(1, 1 + c % 5), *([None, 1] if c % 6 == 0 else [])]
    ]
    rows += [(None, 1, 10, 7, 5.0, "u", "x"), (30, None, 1, 1, 1.0, "u30", None), (31, 1, 1, 1, 1.0, "u31", None)]
    said = [(c, ["1.5;2.5;3", "4", "", "9;9;1;2;3;4", "no"][c % 5]) for c in range(1, 25) if c % 7] + [(None, "3"), (3, "8;9"), (3, "8;7"), (7, None)]
    items, answers = spark.createDataFrame(rows, ITEMS), spark.createDataFrame(said, ANSWERS)
    got, want = pl.priced_items(items, answers, "gpt_unit_prices"), _plain(items, answers)
    order = lambda df: sorted(map(repr, df.collect()))
    assert got.columns == want.columns
    assert order(got) == order(want) != []
    small = order(pl.priced_items(items, answers, "gpt_unit_prices", hot_rows=2))
    assert small == order(want)

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pl.priced_items(items, answers, "gpt_unit_prices")._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2  # items and answers
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got.filter(F.col("n_cod_contrato") == 31).head().mean_unit_price is None


def test_answers_are_read_once(spark):
    """Pieces of the plan that turn a text into prices: one per answer, not one for each time its prices are named."""
    items = spark.createDataFrame([(c, n, n, 7, 5.0, "u", "x") for c in range(4) for n in (1, 2, 3)], ITEMS)
    answers = spark.createDataFrame([(0, "1;2;3;4;5;6;7"), (1, "4"), (2, "1.5,2"), (5, "9")], ANSWERS)
    for df in (pl.priced_items(items, answers, "gpt_unit_prices"), pl.answer_prices(answers, pl.item_counts(items), "gpt_unit_prices")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") <= 2  # an explode may ask before whether there is anything
    got = {(r.n_cod_contrato, r.n_item): r.mean_unit_price for r in pl.priced_items(items, answers, "gpt_unit_prices").collect()}
    assert got == {(0, 1): 1.5, (0, 2): 3.5, (0, 3): 5.5, (1, 1): 4.0, (2, 1): 1.5, (2, 2): 2.0}
