"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillweave.catalog import load_all  # noqa: E402
from tillweave.session import local_session  # noqa: E402

HEADLINE = [
    "v_sales_by_store_day", "v_product_price_rank", "v_top_products_by_store", "v_order_fulfilment_status", "v_returns_analysis",
    "v_gl_journal_balance", "v_sales_channel_pivot", "mv_sales_daily_store", "mv_sales_monthly_category", "mv_customer_rfm",
    "hier_category_tree", "hier_gl_climb", "join_asof_fx", "job_effective_price", "job_tax_1", "job_movement_apply",
    "job_basket_validate", "job_loyalty_redeem", "job_journal_post", "dq_check_constraints", "dq_orphans", "rec_canonical",
    "rec_compare", "rec_cell_diff", "sink_order_document", "inc_fast_refresh", "inc_audit_customer", "inc_audit",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    queries = load_all().QUERIES
    queries["flt_window"](spark, folder).write.format("noop").mode("overwrite").save()  # warm the JVM
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
