"""Parameterised reports over orders, purchasing and stock."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillweave.functions.values import as_time, day_of, display, keep_last, nvl, order_nulls, share
from tillweave.sources.tables import RetailTables


def in_days(ts: str, start: str, stop: str):
    """Days start..stop, the last one included."""
    end = as_time(stop) + F.expr("INTERVAL 1 DAY")
    return (F.col(ts) >= as_time(start)) & (F.col(ts) < end)


def busy_stores(t: RetailTables, start, stop, min_orders: int = 1) -> DataFrame:
    """Stores with at least min_orders orders in the days given. order_id is the key of the table,
    so a plain count equals the distinct count and needs one shuffle instead of two."""
    return t.sales_order.filter(in_days("order_ts", start, stop)).groupBy("store_id").agg(
        F.count("order_id").alias("order_count")).filter(F.col("order_count") >= min_orders)


def store_day_summary(t: RetailTables, start, stop) -> DataFrame:
    daily = t.sales_order.filter(in_days("order_ts", start, stop)).groupBy(
        "store_id", day_of("order_ts").alias("sales_date")).agg(
        F.count("order_id").alias("order_count"), F.sum("subtotal_amount").alias("net_amount"))
    ranked = Window.partitionBy("sales_date").orderBy(order_nulls("net_amount", desc=True, nulls="last"))
    return daily.join(t.store.select("store_id", "store_code"), "store_id").select(
        "store_id", "store_code", "sales_date", "order_count", "net_amount", F.rank().over(ranked).alias("day_rank"))


def sales_mix(t: RetailTables, start, stop) -> DataFrame:
    """Store by channel with share of the total, the last order and the runner-up store."""
    mix = t.sales_order.filter(in_days("order_ts", start, stop)).groupBy("store_id", "channel_code").agg(
        F.count("order_id").alias("order_count"), F.sum("subtotal_amount").alias("net_amount"),
        keep_last("order_number", "order_ts").alias("last_order_number"))
    rows = mix.join(t.store.select("store_id", "store_code"), "store_id")
    # windows over stores x channels, a few hundred rows
    everything = Window.partitionBy()
    second = Window.orderBy(order_nulls("net_amount", desc=True), F.desc("store_code")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select(
        "store_id", "store_code", "channel_code", "order_count", "net_amount",
        share("net_amount", F.sum("net_amount").over(everything)).alias("share_of_total"), "last_order_number",
        F.nth_value("store_code", 2).over(second).alias("runner_up_store"))


def top_stores(t: RetailTables, as_of, n: int = 10) -> DataFrame:
    """The best n store days of the last thirty days, formatted for print.

    The source takes the first n rows of an unordered summary; here the rows are ordered by value.
    """
    today = datetime.datetime.fromisoformat(str(as_of)).date()
    rows = store_day_summary(t, str(today - datetime.timedelta(days=30)), str(today))
    top = rows.orderBy(order_nulls("net_amount", desc=True, nulls="last"), "store_code", "sales_date").limit(n)
    return top.select(
        F.rpad(nvl("store_code", "?"), 14, " ").alias("store"), display("sales_date", "date").alias("sales_day"),
        F.lpad(nvl("order_count", 0).cast("string"), 6, " ").alias("orders"), display("net_amount", "number").alias("net"))


def order_line_counts(t: RetailTables, store_id: int, start=None, stop=None) -> DataFrame:
    orders = t.sales_order.filter(F.col("store_id") == store_id)
    if start is not None:
        orders = orders.filter(F.col("order_ts") >= as_time(start))
    if stop is not None:
        orders = orders.filter(F.col("order_ts") < as_time(stop) + F.expr("INTERVAL 1 DAY"))
    return t.sales_order_line.join(orders.select("order_id"), "order_id", "left_semi").groupBy("order_id").agg(
        F.count("*").alias("line_count"))


def order_value(t: RetailTables) -> DataFrame:
    sums = t.sales_order_line.groupBy("order_id").agg(F.sum("line_total").alias("v"))
    return t.sales_order.select("order_id").join(sums, "order_id", "left").select("order_id", nvl("v", 0).alias("order_value"))


def po_total(t: RetailTables) -> DataFrame:
    live = t.purchase_order_line.filter(nvl("status", "OPEN") != "CANCELLED")
    sums = live.groupBy("po_id").agg(F.sum("line_total").alias("v"))
    return t.purchase_order.select("po_id").join(sums, "po_id", "left").select("po_id", nvl("v", 0).alias("po_total"))


def available_qty(t: RetailTables, by_location: bool = False) -> DataFrame:
    keys = ["variant_id", "location_id"] if by_location else ["variant_id"]
    return t.inventory_stock.groupBy(*keys).agg(nvl(F.sum("qty_available"), 0).alias("available_qty"))


# ---- the business questions asked of both copies of the data ----------------------------------

def top_products_last_quarter(t: RetailTables, as_of, n: int = 20) -> DataFrame:
    """Best products by revenue per country in the quarter before `as_of`."""
    from tillweave.operators.positions import top_k

    start = F.add_months(F.date_trunc("quarter", as_time(as_of)).cast("date"), -3).cast("timestamp_ntz")
    stop = F.date_trunc("quarter", as_time(as_of)).cast("timestamp_ntz")
    orders = t.sales_order.filter((F.col("order_ts") >= start) & (F.col("order_ts") < stop)).select("order_id", "store_id")
    country = t.store.select("store_id", "region_id").join(t.region.select("region_id", "country_code"), "region_id").drop("region_id")
    sums = t.sales_order_line.join(orders, "order_id").groupBy("store_id", "variant_id").agg(F.sum("line_total").alias("revenue"))
    sums = sums.join(country, "store_id").groupBy("country_code", "variant_id").agg(F.sum("revenue").alias("revenue"))
    return top_k(sums, ["country_code"], [order_nulls("revenue", desc=True), F.col("variant_id")], n)


def lapsed_by_tier(t: RetailTables, as_of, months: int = 12) -> DataFrame:
    """Loyalty customers without an order in the last months, per tier."""
    since = F.add_months(as_time(as_of).cast("date"), -months).cast("timestamp_ntz")
    recent = t.sales_order.filter(F.col("order_ts") >= since).select("customer_id")
    return t.loyalty_account.join(recent, "customer_id", "left_anti").groupBy("tier_code").agg(F.count("*").alias("lapsed"))


def orders_with_payments(t: RetailTables) -> DataFrame:
    """Every order with its captured and open amounts, unpaid ones included."""
    paid = t.order_payment.groupBy("order_id").agg(
        F.sum(F.when(F.col("status") == "CAPTURED", F.col("amount"))).alias("captured"),
        F.sum(F.when(F.col("status") != "CAPTURED", F.col("amount"))).alias("pending"), F.count("*").alias("payments"))
    return t.sales_order.select("order_id", "order_total").join(paid, "order_id", "left").select(
        "order_id", "order_total", nvl("payments", 0).alias("payments"), nvl("captured", 0).alias("captured"),
        nvl("pending", 0).alias("pending"))


def stock_at(t: RetailTables, day: str) -> DataFrame:
    """Net ledger quantity per location and variant up to the end of a day."""
    stop = as_time(day) + F.expr("INTERVAL 1 DAY")
    moves = t.inventory_movement.filter(F.col("movement_ts") < stop)
    qty = F.abs("qty")
    legs = moves.select("variant_id", F.inline(F.array(
        F.struct(F.col("to_location_id").alias("location_id"), qty.alias("q")),
        F.struct(F.col("from_location_id").alias("location_id"), (-qty).alias("q"))))).filter(F.col("location_id").isNotNull())
    return legs.groupBy("location_id", "variant_id").agg(F.sum("q").alias("net_qty"))


def trading_hours(t: RetailTables) -> DataFrame:
    """Orders per store and local hour of day."""
    from tillweave.operators.filters import local_time

    local = local_time(t.sales_order.select("order_id", "store_id", "order_ts"), t.store, t.region, t.country, "order_ts")
    return local.groupBy("store_id", F.hour("local_ts").alias("local_hour")).agg(F.count("*").alias("orders"))
