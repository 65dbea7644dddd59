"""Scheduled batches that write their results: run log, reporting refresh, month end."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tillweave.catalog.registry import query
from tillweave.operators.scalars import beside
from tillweave.plans import batch as b
from tillweave.session import shared_dir
from tillweave.sources.binding import AS_OF
from tillweave.sources.extracts import job_run, published, sales_extract, write_extract

c = F.col


def fresh(t, name: str) -> str:
    return os.path.join(shared_dir(t.spark), name, uuid.uuid4().hex)


def logged(t):
    """Three logged jobs over the orders: one counts, one is skipped, one fails."""
    log = fresh(t, "log")
    with job_run(t.spark, "COUNT_ORDERS", log) as run:
        run.rows = t.sales_order.count()
    with job_run(t.spark, "NOTHING_TO_DO", log) as run:
        run.skipped = True
    with job_run(t.spark, "BROKEN", log, swallow=True):
        raise RuntimeError("boom")
    return t.spark.read.parquet(log).select("job_name", "status", F.coalesce("rows_processed", F.lit(-1)).alias("rows_processed"), F.coalesce("message", F.lit("")).alias("message"))


query("sink_job_log", """
SELECT 'COUNT_ORDERS' AS job_name, 'SUCCESS' AS status, COUNT(*) AS rows_processed, '' AS message FROM rt_sales_order
UNION ALL SELECT 'NOTHING_TO_DO', 'SKIPPED', -1, '' UNION ALL SELECT 'BROKEN', 'FAILED', -1, 'boom'""")(logged)


def refreshed(t):
    """Published aggregates with their row counts."""
    out = fresh(t, "reporting")
    done = b.refresh_reporting(t, AS_OF, out)
    frames = [published(t.spark, done[name]).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name in done]
    first = frames[0]
    for f in frames[1:]:
        first = first.unionByName(f)
    return first


query("job_refresh_reporting", """
SELECT 'mv_customer_rfm' AS name, COUNT(*) AS rows FROM rt_customer UNION ALL SELECT 'mv_stock_position', COUNT(DISTINCT variant_id) FROM rt_inventory_stock
UNION ALL SELECT 'mv_supplier_performance', COUNT(*) FROM rt_supplier UNION ALL SELECT 'mv_promotion_uplift', COUNT(DISTINCT promotion_id) FROM rt_sales_order
UNION ALL SELECT 'mv_sales_monthly_category', COUNT(*) FROM (SELECT DISTINCT DATE_TRUNC('month', o.order_ts), p.category_id, o.currency_code, o.channel_code FROM rt_sales_order o
  JOIN rt_sales_order_line l ON l.order_id = o.order_id JOIN rt_product p ON p.product_id = l.variant_id)""")(refreshed)


def month_ends(t):
    """A forced month end that runs through, and one stopped by its first step."""
    done = b.month_end(t, 200107, "2001-07-10", AS_OF, fresh(t, "month"), force=True)
    stopped = b.month_end(t, 199901, "2001-07-10", AS_OF, fresh(t, "month"))
    out = fresh(t, "export")
    write_extract(sales_extract(t, "2001-07-10", "2001-07-10"), out)
    rows = t.spark.read.option("header", True).csv(out).agg(F.count("*").alias("rows_exported"))
    steps = t.spark.createDataFrame([("forced", *s) for s in done] + [("closed", *s) for s in stopped], "run string, step string, status string")
    return beside(steps, rows)


query("job_month_end", """
SELECT v.*, (SELECT COUNT(*) FROM rt_sales_order WHERE CAST(order_ts AS DATE) = DATE '2001-07-10') AS rows_exported FROM (VALUES ('forced', 'CLOSE_PERIOD', 'SUCCESS'), ('forced', 'POST_GL', 'SUCCESS'),
  ('forced', 'EXPORT', 'SUCCESS'), ('closed', 'CLOSE_PERIOD', 'FAILED'), ('closed', 'POST_GL', 'SKIPPED'), ('closed', 'EXPORT', 'SKIPPED')) v(run, step, status)""")(month_ends)
