"""The materialised aggregates.

The three additive ones keep a COUNT beside every SUM, so that a group can be maintained from
signed deltas and disappears when its count reaches zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.functions.values import By, as_time, day_of, days_between, keep_last, month_of, nvl, rate_pct, share
from tillweave.operators.positions import rank_cols, with_part_total
from tillweave.plans.views import SOLD, mean_of
from tillweave.sources.tables import RetailTables


def pair(name: str, c) -> list:
    """SUM and COUNT of one measure."""
    c = F.col(c) if isinstance(c, str) else c
    return [F.sum(c).alias(name), F.count(c).alias(f"{name}_cnt")]


def sales_daily_store(t: RetailTables) -> DataFrame:
    # lines collapse per order before the join; sums of sums and counts of counts stay additive
    lines = t.sales_order_line.groupBy("order_id").agg(
        F.count("*").alias("n"), *pair("q", "qty"), *pair("g", F.col("qty") * F.col("unit_price")),
        *pair("d", "discount_amount"), *pair("x", "tax_amount"))
    heads = t.sales_order.select("order_id", "store_id", day_of("order_ts").alias("sales_date"), "currency_code")
    return heads.join(lines, "order_id").groupBy("store_id", "sales_date", "currency_code").agg(
        F.sum("n").alias("line_count"), F.sum("q").alias("total_qty"), F.sum("q_cnt").alias("total_qty_cnt"),
        F.sum("g").alias("gross_amount"), F.sum("g_cnt").alias("gross_amount_cnt"),
        F.sum("d").alias("discount_amount"), F.sum("d_cnt").alias("discount_amount_cnt"),
        F.sum("x").alias("tax_amount"), F.sum("x_cnt").alias("tax_amount_cnt"))


def sales_monthly_category(t: RetailTables) -> DataFrame:
    net = F.col("qty") * F.col("unit_price") - F.col("discount_amount")
    variants = (
        t.product_variant.select("variant_id", "product_id").join(t.product.select("product_id", "category_id"), "product_id")
        .join(t.product_category.select("category_id", "category_code"), "category_id").drop("product_id"))
    heads = t.sales_order.select("order_id", month_of("order_ts").alias("month_start"), "currency_code", "channel_code")
    return (
        t.sales_order_line.join(heads, "order_id").join(variants, "variant_id")
        .groupBy("month_start", "category_id", "category_code", "currency_code", "channel_code")
        .agg(F.count("*").alias("line_count"), *pair("total_qty", "qty"), *pair("net_amount", net), *pair("tax_amount", "tax_amount"))
    )


def stock_position(t: RetailTables) -> DataFrame:
    """below_reorder_cnt counts every row, because its CASE is never NULL; kept as the source has it."""
    low = F.col("reorder_point").isNotNull() & (F.col("qty_on_hand") < F.col("reorder_point") + F.col("qty_reserved"))
    flag = F.when(low, 1).otherwise(0)
    return t.inventory_stock.groupBy("variant_id").agg(
        F.count("*").alias("location_count"), *pair("qty_on_hand", "qty_on_hand"), *pair("qty_reserved", "qty_reserved"),
        F.sum(flag).alias("below_reorder_count"), F.count(flag).alias("below_reorder_cnt"))


def customer_rfm(t: RetailTables, as_of) -> DataFrame:
    """Recency, frequency and monetary quintiles with the last channel and the country share.

    Orders collapse to one row per customer before the customer join. The quintiles rank all
    customers together, so they go through the distributed ranking; `customer_id` breaks ties.
    """
    orders = t.sales_order.filter(F.col("status").isin(*SOLD)).groupBy("customer_id").agg(
        F.count("*").alias("frequency_orders"), F.max("order_ts").alias("last_order_ts"),
        F.sum("order_total").alias("money"), keep_last("channel_code", "order_ts").alias("last_channel_code"))
    base = t.customer.join(orders, "customer_id", "left").select(
        "customer_id", "customer_ref", "home_country_code", "preferred_store_id",
        nvl("frequency_orders", 0).alias("frequency_orders"), "last_order_ts",
        days_between(as_time(as_of), "last_order_ts", 0).cast("bigint").alias("recency_days"),
        nvl("money", 0).alias("monetary_amount"), "last_channel_code")
    for name, by in (("r_score", By("recency_days", desc=True, nulls="last")), ("f_score", By("frequency_orders", nulls="first")),
                     ("m_score", By("monetary_amount", nulls="first"))):
        base = rank_cols(base, [], [by], {name: ("ntile", 5)}, ["customer_id"])
    base = with_part_total(base, ["home_country_code"], {"_all": F.sum("monetary_amount")})
    return base.withColumn("country_value_share", share("monetary_amount", "_all")).drop("_all")


def supplier_performance(t: RetailTables) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s)
    po = t.purchase_order.groupBy("supplier_id").agg(
        F.count("*").alias("po_count"), F.sum("order_total").alias("ordered_value"),
        F.sum(F.datediff("expected_date", "order_date")).alias("_d"), F.count("expected_date").alias("_n"),
        of("RECEIVED").alias("received_count"), of("CANCELLED").alias("cancelled_count"), of("PART_RECV").alias("partial_count"))
    rows = t.supplier.join(po, "supplier_id", "left")
    count = lambda c: nvl(c, 0).alias(c)
    return rows.select(
        "supplier_id", "supplier_code", "supplier_name", "currency_code", count("po_count"), count("ordered_value"),
        mean_of("_d", "_n", 2).alias("avg_promised_days"), count("received_count"), count("cancelled_count"), count("partial_count"),
        rate_pct("received_count", "po_count").alias("fill_rate_pct"), F.col("rating").alias("supplier_rating"))


def promotion_uplift(t: RetailTables) -> DataFrame:
    """budget_remaining repeats the promotion's value once per order, as the source sums it."""
    orders = t.sales_order.filter(F.col("promotion_id").isNotNull()).groupBy("promotion_id").agg(
        F.count("*").alias("order_count"), F.count("order_id").alias("order_count_chk"),
        *pair("subtotal_amount", "subtotal_amount"), *pair("discount_amount", "discount_amount"))
    left = nvl("budget_amount", 0) - nvl("spent_amount", 0)
    return t.promotion.join(orders, "promotion_id").select(
        "promotion_id", "promo_code", "promo_type", "country_code", F.col("status").alias("promo_status"), "order_count",
        "order_count_chk", "subtotal_amount", "subtotal_amount_cnt", "discount_amount", "discount_amount_cnt",
        (left * F.col("order_count")).alias("budget_remaining"), F.col("order_count").alias("budget_remaining_cnt"))
