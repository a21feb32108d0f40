"""Times the headline queries and prints one line of JSON.

``BENCH_SF_DIR`` names the tables (default sf0.1) and ``BENCH_CPUS`` the local threads.
Each query's whole result is computed; the regression base is built once, timed as its own
entry, and read back by the models, as a user would do it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fairtender.checks import QUERIES
from fairtender.checks import standin as st
from fairtender.operators import regress as rg
from fairtender.plans import estimates as es
from fairtender.session import session

HEADLINE = [
    "yearly_contract_shares",
    "spread_prices",
    "join_inner_group",
    "win_row_number",
    "win_panel_entity",
    "old_supplier",
    "reshape_wide_items",
    "sample_n_by_main",
    "encode",
    "portal_links",
    "text_clean",
    "text_normalise",
    "title_case",
    "chunk_text",
    "chat_validate",
    "chat_token_counts",
    "agg_distribution",
    "did_cells",
    "ols",
    "ols_absorb_fe",
]


def did_boot_300_all_items(spark, sf):
    key = ["n_cod_contrato", "n_item", "codigoitem", "ruc_proveedor"]
    return rg.fit(st.contract_items(spark, sf), "monto_contratado_item", rg.did_terms(), key=key, reps=300)


MODELS = {
    "did_boot_300_all_items": did_boot_300_all_items,
    "report_models_300": lambda spark, sf: es.report_models(st.saved_base(spark, sf)),
    "subset_models_300": lambda spark, sf: es.subset_models(st.saved_base(spark, sf), "objetocontractual"),
    "price_models_300": lambda spark, sf: es.price_models(st.saved_prices(spark, sf)),
    "ols_absorb_two": lambda spark, sf: QUERIES["ols_absorb_two"](spark, sf),
    "falsification_sweep": lambda spark, sf: es.falsification_models(st.saved_base(spark, sf), range(470, 481)),
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, make):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)

    for table in ("lineitem", "orders", "documents"):
        spark.read.parquet(f"{sf}/{table}.parquet").count()
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf))
    timed("regression_base", lambda: st.saved_base(spark, sf))
    for name in ("yearly_mean_price", "yearly_report_rate"):
        timed(name, lambda: QUERIES[name](spark, sf))
    for name, make in MODELS.items():
        timed(name, lambda: make(spark, sf))
    print(json.dumps({"metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
