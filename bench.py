#!/usr/bin/env python
"""Benchmark the headline queries.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
(default 8). The order table is built once from the supplied tables and
saved as a snapshot (timed as ``build_order_table``, on a second build); every query is then run
to completion with the ``noop`` sink (nothing collected), one warm-up run and
the median of $BENCH_REPEAT (default 3) timed runs. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "kpi_overview", "kpi_analytics", "spend_by_grant", "spend_by_project", "split_summary", "top_items",
    "recent_orders", "order_search", "visible_rows", "year_grant_margins", "yearly_projection",
    "projection_total", "days_between_orders", "reorder_predictions", "spend_forecast", "demand_forecast",
    "vendor_ranking", "bulk_opportunities", "clean_item_name", "amount_fallbacks", "edit_order",
    "import_line_items", "import_inventory", "import_po_summary", "standardize", "contamination_cut", "anomalies",
]


def main() -> None:
    from labledger.session import get_session
    from labledger.plans.registry import REGISTRY
    from labledger.sources import fixture_files
    from labledger.sources.fixture_files import export_files
    from labledger.sources.fixtures import order_lines
    from labledger.sources.store import OrderStore, order_table

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    keys = os.environ.get("BENCH_QUERIES")
    keys = keys.split(",") if keys else HEADLINE
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                        extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "24g"),
                               "spark.sql.files.maxPartitionBytes": str(64 << 20)})

    times: dict[str, float] = {}
    order_table(spark, sf_dir).write.format("noop").mode("overwrite").save()
    export_files(spark, sf_dir).write()
    # Like the queries, the builds are timed after a warm-up run.
    t0 = time.time()
    OrderStore(spark).write(order_lines(spark, sf_dir))
    times["build_order_table"] = round(time.time() - t0, 3)
    fixture_files._CACHE.clear()
    t0 = time.time()
    export_files(spark, sf_dir).write()
    times["build_exports"] = round(time.time() - t0, 3)

    def run(key: str) -> float:
        s = time.time()
        REGISTRY[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - s

    for key in keys:
        run(key)  # warm-up
        times[key] = round(statistics.median(run(key) for _ in range(repeat)), 3)

    sf = os.path.basename(sf_dir).replace("sf", "")
    try:
        sf_val: float | str = float(sf)
    except ValueError:
        sf_val = sf
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": sf_val, "cpus": cpus, "repeat": repeat}))
    spark.stop()


if __name__ == "__main__":
    main()
