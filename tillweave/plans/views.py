"""The analytic views. Each takes the retail tables and, where the source reads the clock, an
explicit `as_of`.

Joins carry no hints: the planner broadcasts a side when its size is known to be small and AQE
revises the choice at run time. Aggregates over order lines are reduced to one row per order (or
per shipped line) before they meet the order, so a hot order never multiplies through a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillweave.functions.values import (
    By, as_time, contact_label, day_of, days_between, decode, greatest_null, keep_last, month_of, nvl, nvl2,
    order_nulls, rate_pct, seconds_between, share, valid_on,
)
from tillweave.operators import hierarchy as tree
from tillweave.operators.positions import rank_cols, top_k, with_part_total
from tillweave.sources.tables import RetailTables

CHANNELS = {"POS": "pos", "WEB": "web", "APP": "app", "CALL": "call_centre", "KIOSK": "kiosk", "PARTNER": "partner"}
LIVE = ("PLACED", "PICKING", "SHIPPED", "DELIVERED")
SOLD = ("PLACED", "SHIPPED", "DELIVERED")


def line_sums(t: RetailTables) -> DataFrame:
    """Order lines reduced to one row per order."""
    return t.sales_order_line.groupBy("order_id").agg(
        F.sum("qty").alias("units"),
        F.sum(F.col("qty") * F.col("unit_price") - F.col("discount_amount")).alias("net"),
        F.sum("tax_amount").alias("tax"),
        F.sum("line_total").alias("gross"),
        F.count("*").alias("lines"),
    )


def sales_by_store_day(t: RetailTables) -> DataFrame:
    """Daily sales per store and currency with ten ordered measures.

    The windows run over daily totals: a store's group is its trading days, a day's group its
    stores, both bounded by the calendar and the estate rather than by the orders.
    """
    orders = t.sales_order.filter(F.col("status").isin(*LIVE)).select(
        "order_id", "store_id", "currency_code", day_of("order_ts").alias("sales_date"))
    daily = orders.join(line_sums(t), "order_id").groupBy("store_id", "sales_date", "currency_code").agg(
        F.count("*").alias("order_count"),
        F.sum("units").alias("units_sold"),
        F.sum("net").alias("net_amount"),
        F.sum("tax").alias("tax_amount"),
    )
    rows = daily.join(t.store.select("store_id", "store_code", "store_name"), "store_id")
    by_store = Window.partitionBy("store_id").orderBy("sales_date", "currency_code")
    by_day = Window.partitionBy("sales_date").orderBy(order_nulls("net_amount", desc=True))
    stable_day = Window.partitionBy("sales_date").orderBy(order_nulls("net_amount", desc=True), "store_id", "currency_code")
    month = Window.partitionBy("store_id", month_of("sales_date")).orderBy("sales_date", "currency_code")
    week = by_store.rowsBetween(-6, 0)
    best = Window.partitionBy("store_id").orderBy(order_nulls("net_amount", desc=True), "sales_date")
    net = F.col("net_amount")
    return rows.select(
        "store_id", "store_code", "store_name", "sales_date", "currency_code", "order_count", "units_sold",
        "net_amount", "tax_amount",
        F.row_number().over(by_store).alias("trading_day_seq"),
        F.rank().over(by_day).alias("day_rank_by_value"),
        F.dense_rank().over(by_day).alias("day_dense_rank"),
        F.ntile(4).over(stable_day).alias("value_quartile"),
        F.lag(net, 1).over(by_store).alias("prev_day_amount"),
        F.lead(net, 1).over(by_store).alias("next_day_amount"),
        (net - F.coalesce(F.lag(net, 1).over(by_store), F.lit(0))).alias("day_on_day_delta"),
        F.sum(net).over(month.rowsBetween(Window.unboundedPreceding, 0)).alias("mtd_amount"),
        (F.sum(net).over(week).cast("double") / F.count(net).over(week)).alias("rolling_7d_avg"),
        share(net, F.sum(net).over(Window.partitionBy("sales_date"))).alias("share_of_day"),
        F.first_value("sales_date").over(
            best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("best_day_date"),
    )


def product_price_rank(t: RetailTables) -> DataFrame:
    """Price rank, percentile, the priciest and the second priciest article of each category.

    Category maxima and the two named articles are aggregates joined back; only the ranks need
    order, and rank_cols spreads a category too large for one task.
    """
    rows = t.product.filter(F.col("status") == "ACTIVE").join(
        t.product_category.select("category_id", "category_name"), "category_id")
    tops = rows.groupBy("category_id", "list_price").agg(F.min("sku").alias("first_sku"))
    tops = tops.groupBy("category_id").agg(
        F.max("list_price").alias("category_max_price"), F.max(F.struct("list_price", "first_sku"))["first_sku"].alias("priciest_sku"))
    # the last but one row in ascending (price, sku) order is the second of the reversed order
    second = top_k(rows.select("category_id", "list_price", "sku"), ["category_id"],
                   [order_nulls("list_price", desc=True), F.col("sku").desc()], 2)
    second = second.filter("rn = 2").select("category_id", F.col("sku").alias("second_priciest_sku"))
    # positions are found once; the ascending ranks are the descending ones seen from the other end
    ranked = rank_cols(rows, ["category_id"], [By("list_price", desc=True)],
                       {"price_rank": "rank", "price_dense_rank": "dense_rank", "_upto": "cume_dist"}, ["product_id"])
    ranked = with_part_total(ranked, ["category_id"], {"_n": F.count("*")})
    n, last = F.col("_n"), F.round(F.col("_upto") * F.col("_n")).cast("bigint")
    ranked = ranked.withColumns({"price_percentile": F.when(n > 1, (n - last) / (n - 1)).otherwise(0.0), "price_cume_dist": (n - F.col("price_rank") + 1) / n})
    return ranked.join(tops, "category_id").join(second, "category_id", "left").select(
        "product_id", "sku", "product_name", "category_id", "category_name", "list_price", "unit_cost", "margin_pct",
        "price_rank", "price_dense_rank", "price_percentile", "price_cume_dist", "category_max_price",
        "priciest_sku", "second_priciest_sku")


def legacy_orders(t: RetailTables, country: str = "GB") -> DataFrame:
    """Customers with their orders; the country filter sits inside the outer join, and the later
    non-null test on the address line drops the customers it left unmatched."""
    address = t.address.filter(F.col("country_code") == country).select(
        F.col("address_id").alias("primary_address_id"), F.col("city").alias("bill_city"),
        F.col("postal_code").alias("bill_postal_code"), F.col("line2").alias("bill_line2"))
    so = t.sales_order.select(
        "customer_id", "order_id", "order_number", "order_ts", F.col("status").alias("order_status"), "subtotal_amount",
        "store_id", "sales_employee_id", "discount_amount")
    return (
        t.customer.filter(F.col("status") != "ERASED")
        .join(address, "primary_address_id", "left")
        .filter(F.col("bill_line2").isNotNull())
        .join(t.country.select(F.col("country_code").alias("home_country_code"), "country_name"), "home_country_code")
        .join(so, "customer_id", "left")
        .join(t.store.select("store_id", "store_code", "store_name"), "store_id", "left")
        .join(t.employee.select(F.col("employee_id").alias("sales_employee_id"),
                                F.col("employee_number").alias("sales_rep_number")), "sales_employee_id", "left")
        .select("customer_id", "customer_ref", "last_name", "order_id", "order_number", "order_ts", "order_status",
                "subtotal_amount", "store_code", "store_name", "sales_rep_number", "bill_city", "bill_postal_code",
                "bill_line2", "country_name", nvl("discount_amount", 0).alias("discount_amount"))
    )


def legacy_customer_orders(t: RetailTables, country: str) -> DataFrame:
    """All customers of a country with whatever orders, stores and sales staff they have."""
    so = t.sales_order.select("customer_id", "order_id", "order_number", "store_id", "sales_employee_id")
    return (
        t.customer.filter(F.col("home_country_code") == country).join(so, "customer_id", "left")
        .join(t.store.select("store_id", "store_code"), "store_id", "left")
        .join(t.employee.select(F.col("employee_id").alias("sales_employee_id"), "employee_number"),
              "sales_employee_id", "left")
        .select("customer_id", "customer_ref", "last_name", "order_id", "order_number", "store_code", "employee_number")
    )


def top_products_by_store(t: RetailTables, k: int = 10) -> DataFrame:
    """The k best selling variants of each store by units."""
    lines = t.sales_order_line.join(
        t.sales_order.filter(F.col("status").isin(*SOLD)).select("order_id", "store_id"), "order_id")
    sums = lines.groupBy("store_id", "variant_id").agg(
        F.sum("qty").alias("units_sold"),
        F.sum(F.col("qty") * F.col("unit_price") - F.col("discount_amount")).alias("net_amount"))
    best = top_k(sums, ["store_id"], [order_nulls("units_sold", desc=True, nulls="last"), F.col("variant_id")], k)
    named = t.product_variant.select("variant_id", "variant_sku", "product_id").join(
        t.product.select("product_id", "product_name"), "product_id")
    return best.join(named, "variant_id").select(
        "store_id", "variant_id", "variant_sku", "product_name", "units_sold", "net_amount", "rn")


def recent_orders_unsorted(t: RetailTables, n: int = 50) -> DataFrame:
    """Any n orders, then sorted: the limit comes before the order, so the choice is arbitrary."""
    some = t.sales_order.select(
        "order_id", "order_number", "order_ts", "store_id", "channel_code", "status", "subtotal_amount").limit(n)
    numbered = some.withColumn("legacy_row_num", F.row_number().over(Window.orderBy(F.lit(1))))  # n rows only
    return numbered.orderBy(order_nulls("order_ts", desc=True))


def customer_360(t: RetailTables) -> DataFrame:
    """One row per customer with address, store, loyalty and state flags."""
    return (
        t.customer
        .join(t.country.select(F.col("country_code").alias("home_country_code"), "country_name", "tz_name"), "home_country_code")
        .join(t.address.select(F.col("address_id").alias("primary_address_id"), F.col("line1").alias("address_line1"),
                               F.col("city").alias("address_city"), F.col("postal_code").alias("address_postal_code")),
              "primary_address_id", "left")
        .join(t.store.select(F.col("store_id").alias("preferred_store_id"), F.col("store_code").alias("preferred_store_code"),
                             F.col("store_name").alias("preferred_store_name")), "preferred_store_id", "left")
        .join(t.loyalty_account.select("customer_id", "loyalty_id", "card_number", "tier_code", "points_balance",
                                       "lifetime_points"), "customer_id", "left")
        .join(t.loyalty_tier.select("tier_code", "tier_name", F.col("discount_pct").alias("tier_discount_pct")),
              "tier_code", "left")
        .select(
            "customer_id", "customer_ref", "first_name", "last_name", "email", "mobile_phone", "birth_date",
            F.col("status").alias("customer_status"), "marketing_optin", "created_ts", "home_country_code", "country_name",
            "tz_name", "primary_address_id", "address_line1", "address_city", "address_postal_code", "preferred_store_id",
            "preferred_store_code", "preferred_store_name", "loyalty_id", "card_number", "tier_code", "tier_name",
            "tier_discount_pct", "points_balance", "lifetime_points",
            decode("mobile_phone", {None: "NO_MOBILE"}, "HAS_MOBILE").alias("mobile_flag"),
            decode("marketing_optin", {"Y": "OPTED_IN", "N": "OPTED_OUT"}, "UNKNOWN").alias("marketing_state"),
            nvl2("gdpr_erasure_ts", "ERASED", "LIVE").alias("gdpr_state"),
            nvl2("loyalty_id", "MEMBER", "GUEST").alias("loyalty_state"),
            nvl("points_balance", 0).alias("points_or_zero"),
        )
    )


def product_sellable(t: RetailTables, as_of) -> DataFrame:
    """Variants with product, category and brand, and whether they can be sold at `as_of`."""
    launched = F.col("launch_date").isNull() | (F.col("launch_date") <= as_time(as_of))
    ok = (F.col("product_status") == "ACTIVE") & (F.col("variant_active") == "Y") & launched
    return (
        t.product_variant.withColumnRenamed("is_active", "variant_active")
        .join(t.product.withColumnRenamed("status", "product_status"), "product_id")
        .join(t.product_category.select("category_id", "category_code", "category_name"), "category_id")
        .join(t.brand.select("brand_id", "brand_code", "brand_name", "is_own_label"), "brand_id", "left")
        .select("variant_id", "variant_sku", "barcode_ean13", "size_code", "colour_code", "pack_qty", "variant_active",
                "product_id", "sku", "product_name", "product_status", "list_price", "unit_cost", "margin_pct",
                "launch_date", "category_id", "category_code", "category_name", "brand_id", "brand_code", "brand_name",
                "is_own_label", F.when(ok, "Y").otherwise("N").alias("is_sellable"))
    )


def open_purchase_orders(t: RetailTables, as_of) -> DataFrame:
    """Open purchase orders with age, delivery state and outstanding quantity."""
    now = as_time(as_of)
    lines = t.purchase_order_line.groupBy("po_id").agg(
        F.count("*").alias("line_count"), F.sum(F.col("qty_ordered") - nvl("qty_received", 0)).alias("qty_outstanding"))
    return (
        t.purchase_order.filter(F.col("status").isin("DRAFT", "SENT", "PART_RECV"))
        .join(t.supplier.select("supplier_id", "supplier_code", "supplier_name"), "supplier_id")
        .join(t.warehouse.select("warehouse_id", "warehouse_code"), "warehouse_id")
        .join(t.employee.select(F.col("employee_id").alias("approved_by_employee_id"),
                                F.col("employee_number").alias("approver_number")), "approved_by_employee_id", "left")
        .join(lines, "po_id", "left")
        .select("po_id", "po_number", "supplier_id", "supplier_code", "supplier_name", "warehouse_id", "warehouse_code",
                "order_date", "expected_date", "status", "currency_code", "order_total", "approved_by_employee_id",
                "approver_number", F.datediff(now, "order_date").alias("age_days"),
                F.when(F.col("expected_date") < now, "OVERDUE")
                .when(F.col("expected_date") < now + F.expr("INTERVAL 7 DAYS"), "DUE_SOON").otherwise("ON_TRACK").alias("delivery_flag"),
                nvl("line_count", 0).alias("line_count"), nvl("qty_outstanding", 0).alias("qty_outstanding"))
    )


def sales_channel_pivot(t: RetailTables) -> DataFrame:
    """Month and store by channel: amount and count for each of the six channels."""
    src = t.sales_order.filter(F.col("status").isin(*SOLD)).select(
        "store_id", month_of("order_ts").alias("month_start"), "channel_code", "subtotal_amount")
    wide = src.groupBy("store_id", "month_start").pivot("channel_code", list(CHANNELS)).agg(
        F.sum("subtotal_amount").alias("amt"), F.count(F.lit(1)).alias("cnt"))
    cols = []
    for code, name in CHANNELS.items():
        cols += [F.col(f"{code}_amt").alias(f"{name}_amt"), nvl(f"{code}_cnt", 0).alias(f"{name}_cnt")]
    return wide.select("store_id", "month_start", *cols)


def stock_position(t: RetailTables) -> DataFrame:
    """Stock with reorder state and availability band."""
    state = nvl2("reorder_point", F.when(F.col("qty_available") < F.col("reorder_point"), "BELOW").otherwise("OK"), "UNMANAGED")
    band = decode(F.signum("qty_available").cast("int"), {-1: "NEGATIVE", 0: "EMPTY", 1: "IN_STOCK"}, "UNKNOWN")
    return (
        t.inventory_stock.join(t.inventory_location, "location_id")
        .join(t.product_variant.select("variant_id", "variant_sku", "product_id"), "variant_id")
        .join(t.product.select("product_id", "product_name"), "product_id")
        .select("location_id", "location_code", "location_type", "warehouse_id", "store_id", "variant_id", "variant_sku",
                "product_id", "product_name", "qty_on_hand", "qty_reserved", "qty_available", "reorder_point", "reorder_qty",
                "last_movement_ts", state.alias("reorder_state"), band.alias("availability_band"))
    )


def inventory_reorder(t: RetailTables, as_of) -> DataFrame:
    """Stock below its reorder point with the primary suppliers valid on the day."""
    source = t.supplier_product.filter(
        (F.col("is_primary_source") == "Y") & (F.col("valid_to").isNull() | (F.col("valid_to") >= day_of(as_time(as_of))))
    ).select("variant_id", "supplier_id", "supplier_sku", F.col("unit_cost").alias("supplier_unit_cost"),
             "lead_time_days", "min_order_qty")
    low = t.inventory_stock.filter(F.col("reorder_point").isNotNull() & (F.col("qty_available") < F.col("reorder_point")))
    return (
        low.join(t.inventory_location.select("location_id", "warehouse_id", "store_id"), "location_id")
        .join(source, "variant_id", "left")
        .select("location_id", "variant_id", "warehouse_id", "store_id", "qty_on_hand", "qty_reserved", "qty_available",
                "reorder_point", nvl("reorder_qty", 0).alias("reorder_qty"),
                greatest_null(nvl("reorder_qty", 0), nvl("reorder_point", 0) - F.col("qty_available")).alias("suggested_qty"),
                "supplier_id", "supplier_sku", "supplier_unit_cost", "lead_time_days", "min_order_qty")
    )


def promotion_effectiveness(t: RetailTables, as_of, fan_out: bool = True) -> DataFrame:
    """Orders, amounts and coupons attributed to each promotion.

    As the source writes it, orders and coupons are both joined before summing, so amounts are
    repeated once per coupon and redemptions once per order. Each side is aggregated alone and
    multiplied by the other side's row count, which gives those sums without building the pairs.
    `fan_out=False` gives the plain sums.
    """
    now = as_time(as_of)
    orders = t.sales_order.filter(F.col("promotion_id").isNotNull()).groupBy("promotion_id").agg(
        F.count("*").alias("attributed_orders"), F.sum("subtotal_amount").alias("sub"), F.sum("discount_amount").alias("disc"))
    coupons = t.coupon.groupBy("promotion_id").agg(
        F.count("*").alias("coupon_count"), F.sum("redemption_count").alias("redeemed"))
    rows = t.promotion.join(orders, "promotion_id", "left").join(coupons, "promotion_id", "left")
    per = lambda c: F.greatest(nvl(c, 0), F.lit(1)) if fan_out else F.lit(1)
    sub, disc = nvl("sub", 0) * per("coupon_count"), nvl("disc", 0) * per("coupon_count")
    live = (F.when((now >= F.col("start_ts")) & (now <= F.col("end_ts")), "LIVE")
            .when(now < F.col("start_ts"), "PENDING").otherwise("ENDED"))
    return rows.select(
        "promotion_id", "promo_code", "promo_name", "promo_type", "country_code", "status", "start_ts", "end_ts",
        "budget_amount", "spent_amount", (nvl("budget_amount", 0) - nvl("spent_amount", 0)).alias("budget_remaining"),
        live.alias("live_state"), nvl("attributed_orders", 0).alias("attributed_orders"),
        sub.alias("attributed_subtotal"), disc.alias("attributed_discount"), rate_pct(disc, sub).alias("discount_rate_pct"),
        nvl("coupon_count", 0).alias("coupon_count"),
        (nvl("redeemed", 0) * per("attributed_orders")).alias("coupon_redemptions"))


def customer_loyalty_summary(t: RetailTables) -> DataFrame:
    """Accounts with accrued and redeemed points, last activity and the next tier review."""
    ledger = t.loyalty_transaction.groupBy("loyalty_id").agg(
        F.sum(F.when(F.col("txn_type") == "ACCRUE", F.col("points_delta"))).alias("acc"),
        F.sum(F.when(F.col("txn_type") == "REDEEM", F.col("points_delta"))).alias("red"),
        F.max("txn_ts").alias("last_activity_ts"))
    return (
        t.loyalty_account.join(t.customer.select("customer_id", "customer_ref", "last_name", "home_country_code"), "customer_id")
        .join(t.loyalty_tier.select("tier_code", "tier_name", "min_points", "points_multiplier", "review_interval"), "tier_code")
        .join(ledger, "loyalty_id", "left")
        .select("loyalty_id", "customer_id", "customer_ref", "last_name", "home_country_code", "card_number", "tier_code",
                "tier_name", "min_points", "points_multiplier", "points_balance", "lifetime_points", "enrolled_date",
                "tier_reviewed_date", (F.col("tier_reviewed_date") + F.col("review_interval")).alias("next_review_date"),
                F.col("status").alias("account_status"), nvl("acc", 0).alias("points_accrued"),
                nvl(F.abs("red"), 0).alias("points_redeemed"), "last_activity_ts")
    )


def supplier_scorecard(t: RetailTables) -> DataFrame:
    """Suppliers with purchase order counts, value and the average promised days."""
    agg = t.purchase_order.groupBy("supplier_id").agg(
        F.count("*").alias("po_count"), F.sum("order_total").alias("ordered_value"),
        F.count_if(F.col("status") == "RECEIVED").alias("received_count"),
        F.count_if(F.col("status") == "CANCELLED").alias("cancelled_count"),
        F.sum(F.datediff("expected_date", "order_date")).alias("_days"), F.count("expected_date").alias("_n"))
    return t.supplier.join(agg, "supplier_id", "left").select(
        "supplier_id", "supplier_code", "supplier_name", "currency_code", "payment_terms_days", "rating", "is_approved",
        "lead_time", contact_label("primary_contact").alias("contact_label"),
        F.col("primary_contact.email").alias("contact_email"), nvl("po_count", 0).alias("po_count"),
        nvl("ordered_value", 0).alias("ordered_value"), nvl("received_count", 0).alias("received_count"),
        nvl("cancelled_count", 0).alias("cancelled_count"), mean_of("_days", "_n", 2).alias("avg_promised_days"),
        decode("is_approved", {"Y": "APPROVED", "N": "PENDING"}, "UNKNOWN").alias("approval_state"))


def mean_of(total: str, n: str, scale: int):
    """Rounded exact mean of whole numbers."""
    whole = "decimal(20,0)"
    return F.round(F.col(total).cast(whole) / F.nullif(F.col(n).cast(whole), F.lit(0).cast(whole)), scale)


def returns_analysis(t: RetailTables) -> DataFrame:
    """Return lines with days to return, rank by volume within the reason, and variant totals."""
    rows = (
        t.return_line.join(t.return_request.drop("order_id"), "return_id")
        .join(t.return_reason, "reason_code")
        .join(t.sales_order.select("order_id", "order_ts"), "order_id")
    )
    rows = with_part_total(rows, ["variant_id"], {"variant_total_returned": F.sum("qty_returned")})
    rows = rank_cols(rows, ["reason_code"], [By("qty_returned", desc=True, nulls="last")],
                     {"reason_volume_rank": "rank"}, ["return_id", "line_no"])
    return rows.select(
        "return_id", "rma_number", "order_id", "customer_id", "store_id", F.col("status").alias("return_status"),
        "requested_ts", "refund_amount", "line_no", "variant_id", "qty_returned", "disposition_code", "reason_code",
        "reason_desc", "reason_group", "is_restockable", "order_ts",
        days_between("requested_ts", "order_ts", 1).alias("days_to_return"), "reason_volume_rank", "variant_total_returned")


def shipment_sla(t: RetailTables) -> DataFrame:
    """Shipments with transit interval parts and whether they met the two-day promise."""
    transit = F.col("delivered_ts") - F.col("shipped_ts")
    late_after = F.col("shipped_ts") + F.expr("INTERVAL 2 DAYS")
    state = (F.when(F.col("delivered_ts").isNull(), "IN_TRANSIT").when(F.col("delivered_ts") <= late_after, "ON_TIME").otherwise("LATE"))
    return t.shipment.join(t.carrier, "carrier_code").select(
        "shipment_id", "order_id", "carrier_code", "carrier_name", "service_level", "tracking_ref",
        F.col("status").alias("shipment_status"), "shipped_ts", "delivered_ts", transit.alias("transit_time"),
        F.extract(F.lit("DAY"), transit).alias("transit_days"), F.extract(F.lit("HOUR"), transit).alias("transit_hours"),
        "cutoff_offset", state.alias("sla_state"), days_between("delivered_ts", "shipped_ts", 2).alias("actual_days"))


def active_price_list_item(t: RetailTables, as_of) -> DataFrame:
    """Price items in force at `as_of`; the end is exclusive."""
    return t.price_list_item.filter(valid_on("effective_from", "effective_to", as_of))


def journal_lines_by_journal(t: RetailTables) -> DataFrame:
    return t.gl_journal_line.groupBy("journal_id").agg(
        F.count("*").alias("line_count"), F.sum("debit_amount").alias("total_debit"),
        F.sum("credit_amount").alias("total_credit"), F.sum("base_amount").alias("total_base_amount"))


def gl_journal_balance(t: RetailTables) -> DataFrame:
    """Journals with their totals and whether both sides agree."""
    rows = t.gl_journal.join(
        t.gl_period.select("period_id", "fiscal_year", "period_no", F.col("status").alias("period_status")), "period_id"
    ).join(journal_lines_by_journal(t), "journal_id", "left")
    dr, cr = nvl("total_debit", 0), nvl("total_credit", 0)
    return rows.select(
        "journal_id", "journal_ref", "source_module", "journal_date", F.col("status").alias("journal_status"), "posted_ts",
        "fiscal_year", "period_no", "period_status", nvl("line_count", 0).alias("line_count"), dr.alias("total_debit"),
        cr.alias("total_credit"), (dr - cr).alias("out_of_balance"), nvl("total_base_amount", 0).alias("total_base_amount"),
        F.when(dr == cr, "BALANCED").otherwise("UNBALANCED").alias("balance_state"))


def store_estate(t: RetailTables) -> DataFrame:
    """Store master with trading window, next refit and size band."""
    bands = {"HYPER": "LARGE", "SUPER": "LARGE", "EXPRESS": "SMALL", "OUTLET": "SMALL", "ONLINE": "VIRTUAL"}
    return (
        t.store.join(t.region.select("region_id", "region_code", "region_name", "country_code"), "region_id")
        .join(t.country.select("country_code", "country_name", "tz_name"), "country_code")
        .join(t.address.select("address_id", "city", "postal_code"), "address_id")
        .join(t.employee.select(F.col("employee_id").alias("manager_employee_id"), F.col("full_name").alias("manager_name")),
              "manager_employee_id", "left")
        .select("store_id", "store_code", "store_name", "store_format", "region_id", "region_code", "region_name",
                "country_code", "country_name", "tz_name", "address_id", "city", "postal_code", "opened_date", "closed_date",
                "selling_area_sqm", "opening_offset", "closing_offset",
                (F.col("closing_offset") - F.col("opening_offset")).alias("trading_window"), "refit_cycle",
                (F.col("opened_date") + F.col("refit_cycle")).alias("next_refit_due"), "manager_employee_id", "manager_name",
                decode("closed_date", {None: "TRADING"}, "CLOSED").alias("trading_state"),
                decode("store_format", bands, "OTHER").alias("format_band"),
                F.round(F.col("selling_area_sqm") / 100, 1).alias("area_units"), nvl("selling_area_sqm", 0).alias("area_or_zero"))
    )


def fx_latest_rates(t: RetailTables) -> DataFrame:
    """The newest rate of every ordered pair of active currencies, NULL where none is quoted.

    The pairs come from one row holding the active currency codes (the result has a row for each
    pair of them); the rates themselves are reduced by a partial aggregate.
    """
    active = t.currency.filter(F.col("is_active") == "Y")
    codes = active.agg(F.collect_set(F.struct("currency_code", "minor_units")).alias("all"))
    pairs = codes.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).filter(
        F.col("a.currency_code") != F.col("b.currency_code"))
    latest = t.exchange_rate.groupBy("from_currency", "to_currency").agg(
        keep_last("rate", "rate_date").alias("latest_rate"), F.max("rate_date").alias("latest_rate_date"))
    return pairs.select(
        F.col("a.currency_code").alias("from_currency"), F.col("b.currency_code").alias("to_currency"),
        F.col("a.minor_units").alias("from_minor_units"), F.col("b.minor_units").alias("to_minor_units"),
    ).join(latest, ["from_currency", "to_currency"], "left")


def order_fulfilment_status(t: RetailTables) -> DataFrame:
    """Ordered against shipped quantities, and the amount captured, per order.

    Lines, shipped lines and captures hardly share a key within one input split, so summing them
    before the shuffle would only hold them all: their narrow rows go to the order's slice first, and
    are summed there per line, then per order. Every line row of a key meets the same shipped sum.
    There are as many slices as the session has shuffle partitions, so a task's sums follow that number.
    """
    def rows(df: DataFrame, line: str | None = None, **held: str) -> DataFrame:
        kinds = {"qty": "decimal(12,3)", "n": "bigint", "sent": "decimal(12,3)", "cap": "decimal(14,2)"}
        return df.select("order_id", (F.col(line) if line else F.lit(None).cast("bigint")).alias("line_no"), *[
            (F.expr(held[k]) if k in held else F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items()])

    every = rows(t.sales_order_line, "line_no", qty="qty", n="1").unionByName(
        rows(t.shipment_line.filter(F.col("order_line_no").isNotNull()), "order_line_no", sent="qty_shipped")).unionByName(
        rows(t.order_payment.filter(F.col("status") == "CAPTURED"), cap="amount"))
    slices = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), 1)
    per_line = every.repartition(slices, "order_id").groupBy("order_id", "line_no").agg(*[F.sum(c).alias(c) for c in ("qty", "n", "sent", "cap")])
    per_order = per_line.groupBy("order_id").agg(
        F.sum("n").alias("line_count"), F.sum("qty").alias("qty_ordered"), F.sum(F.col("sent") * F.col("n")).alias("qty_shipped"), F.sum("cap").alias("cap"))
    sent, ordered = nvl("qty_shipped", 0), nvl("qty_ordered", 0)
    return (
        t.sales_order.join(per_order, "order_id", "left")
        .select("order_id", "order_number", "order_ts", "store_id", "channel_code", F.col("status").alias("order_status"),
                "currency_code", "order_total", nvl("line_count", 0).alias("line_count"), ordered.alias("qty_ordered"),
                sent.alias("qty_shipped"), (ordered - sent).alias("qty_outstanding"),
                F.when(sent == 0, "UNSHIPPED").when(sent < ordered, "PARTIAL").otherwise("COMPLETE").alias("fulfilment_state"),
                nvl("cap", 0).alias("amount_captured"))
    )


SEVERITY_ORDER = {"FATAL": 1, "ERROR": 2, "WARN": 3, "INFO": 4}


def data_quality_open(t: RetailTables, as_of) -> DataFrame:
    """Unresolved issues with severity order, hits per rule and age.

    Hits and the rule's sequence number come from one row per rule, not from windows over issues.
    """
    live = t.data_quality_issue.filter(F.col("resolved_ts").isNull())
    rules = live.groupBy("rule_code").agg(F.count("*").alias("rule_hit_count"))
    rules = rules.withColumn("rule_seq", F.dense_rank().over(Window.orderBy("rule_code")))  # one row per rule
    return live.join(rules, "rule_code").select(
        "issue_id", "rule_code", "entity_name", "entity_key", "severity", "detail", "detected_ts",
        decode("severity", SEVERITY_ORDER, 9).alias("severity_order"), "rule_hit_count", "rule_seq",
        days_between(as_time(as_of), "detected_ts", 2).alias("age_days"))


def audit_recent(t: RetailTables, as_of, days: int = 30) -> DataFrame:
    """The audit trail of the last days with heads, lengths and recency per table."""
    recent = t.audit_log.filter(F.col("changed_ts") > as_time(as_of) - F.make_dt_interval(F.lit(days)))
    ranked = rank_cols(recent, ["table_name"], [By("changed_ts", desc=True)], {"recency_seq": "row_number"}, ["audit_id"])
    return ranked.select(
        "audit_id", "table_name", "pk_value", "action_type",
        decode("action_type", {"I": "INSERT", "U": "UPDATE", "D": "DELETE"}, "OTHER").alias("action_label"), "changed_by",
        "changed_ts", F.substring("old_row", 1, 400).alias("old_row_head"), F.substring("new_row", 1, 400).alias("new_row_head"),
        nvl2("old_row", F.length("old_row"), 0).alias("old_row_bytes"), nvl2("new_row", F.length("new_row"), 0).alias("new_row_bytes"),
        "recency_seq")


# ---- hierarchy views ----------------------------------------------------------------------------

def category_tree(t: RetailTables) -> DataFrame:
    walked = tree.hierarchy(
        t.product_category, "category_id", "parent_category_id",
        paths={"category_path": ("category_name", " > "), "code_path": ("category_code", "/")},
        roots={"root_category_code": "category_code", "root_category_name": "category_name"},
        sort=["sort_order", "category_code"])
    return walked.select(
        "category_id", "category_code", "category_name", "parent_category_id", F.col("level").alias("tree_depth"),
        "category_path", "code_path", "root_category_code", "root_category_name", F.col("is_leaf").alias("is_leaf_node"),
        F.concat(F.repeat(F.lit(" "), (F.col("level") - 1) * 2), "category_name").alias("indented_name"), "sort_order", "sort_path")


def employee_line(t: RetailTables) -> DataFrame:
    cols = t.employee.select("employee_id", "employee_number", "full_name", "last_name", "job_title", "manager_id", "store_id", "is_active")
    return tree.hierarchy(
        cols, "employee_id", "manager_id",
        paths={"chain_path": ("employee_number", "/"), "chain_names": ("last_name", " <- ")},
        roots={"top_manager_id": "employee_id", "top_manager_name": "full_name"},
        prior={"direct_manager_number": "employee_number"},
    ).withColumnsRenamed({"level": "reporting_depth", "is_leaf": "is_individual_contributor"}).drop("last_name", "is_cycle")


def region_tree(t: RetailTables) -> DataFrame:
    """The filter is applied to the finished tree: a retired region is a hole, its subtree stays."""
    walked = tree.hierarchy(t.region, "region_id", "parent_region_id", paths={"region_path": ("region_code", ".")},
                            roots={"root_region_code": "region_code"})
    return walked.filter(F.col("region_level") != "RETIRED").withColumnRenamed("level", "depth").drop("is_leaf", "is_cycle")


def gl_climb(t: RetailTables) -> DataFrame:
    """From each postable account up to its ancestors, with the reached account's own totals.

    An ancestor appears once per leaf below it, so the view must not be summed.
    """
    climbed = tree.hierarchy(
        t.gl_account, "account_code", "parent_account_code", start=F.col("is_postable") == "Y", direction="up",
        paths={"rollup_path": ("account_code", "|")}, roots={"leaf_account_code": "account_code"})
    sums = t.gl_journal_line.groupBy("account_code").agg(F.sum("debit_amount").alias("dr"), F.sum("credit_amount").alias("cr"))
    return climbed.join(sums, "account_code", "left").select(
        "account_code", "account_name", "account_type", "normal_balance", "parent_account_code",
        F.col("level").alias("climb_level"), "leaf_account_code", "rollup_path", nvl("dr", 0).alias("debit_total"),
        nvl("cr", 0).alias("credit_total"))


def subtree(t: RetailTables, root) -> DataFrame:
    """Categories below a root with their product counts."""
    walked = tree.hierarchy(t.product_category, "category_id", "parent_category_id", start=F.col("category_id") == F.lit(root),
                            paths={"path": ("category_code", "/")}, roots={"root_code": "category_code"})
    count = t.product.groupBy("category_id").agg(F.count("*").alias("product_count"))
    return walked.join(count, "category_id", "left").select(
        "category_id", "category_code", "category_name", F.col("level").alias("depth"), "path", "root_code", "is_leaf",
        nvl("product_count", 0).alias("product_count"))


def region_subtree(t: RetailTables, region_code: str) -> DataFrame:
    walked = tree.hierarchy(t.region, "region_id", "parent_region_id", start=F.col("region_code") == region_code,
                            paths={"region_path": ("region_code", "/")}, roots={"root_region": "region_code"})
    stores = t.store.groupBy("region_id").agg(F.count("*").alias("store_count"))
    return walked.join(stores, "region_id", "left").select(
        "root_region", "region_id", "region_code", "region_name", "region_level", F.col("level").alias("tree_depth"),
        "is_leaf", "region_path", nvl("store_count", 0).alias("store_count"))


def rollup_movement(t: RetailTables) -> DataFrame:
    """Net movement of each account with its depth and top account.

    Lines are summed per account first, so the tree walk carries one row per account.
    """
    walked = tree.hierarchy(t.gl_account, "account_code", "parent_account_code", roots={"top_account": "account_code"})
    sums = t.gl_journal_line.groupBy("account_code").agg(
        F.sum(nvl("debit_amount", 0) - nvl("credit_amount", 0)).alias("movement"))
    return walked.join(sums, "account_code", "left").groupBy(
        "account_code", "account_name", "account_type", F.col("level").alias("coa_depth"), "top_account"
    ).agg(F.sum(nvl("movement", 0)).alias("movement"))


def manager_chain(t: RetailTables, max_depth: int = 20) -> DataFrame:
    """' <- ' chain of employee numbers from each employee upwards.

    The walk stops after max_depth + 1 managers above the employee; a chain that is cut, or whose
    manager row is missing, is NULL from there on, and so is its text.
    """
    base = t.employee.select("employee_id", "employee_number", "manager_id")
    most = max_depth + 1
    length = F.col("n") + F.col("_up_n")
    folded = tree.climb(
        base, "employee_id", "manager_id",
        {"n": F.lit(1), "chain": F.col("employee_number"), "whole": F.col("manager_id").isNull()},
        {"n": F.least(length, F.lit(most + 1)), "chain": F.when(length <= most, F.concat("chain", F.lit(" <- "), "_up_chain")), "whole": F.col("_up_whole")},
        rounds=most.bit_length())
    text = F.when(F.col("_up").isNull() & F.col("whole") & (F.col("n") <= most), F.col("chain"))
    return folded.select("employee_id", text.alias("manager_chain"))


def rebuild_levels(categories: DataFrame, max_depth: int = 12) -> DataFrame:
    """merch_level from the walk (cut at max_depth, NULL when never reached) and is_leaf."""
    walked = tree.hierarchy(categories.select("category_id", "parent_category_id"), "category_id", "parent_category_id",
                            max_depth=max_depth).select("category_id", F.col("level").alias("merch_level"))
    parents = categories.select(F.col("parent_category_id").alias("category_id"), F.lit("N").alias("is_leaf")).filter(
        F.col("category_id").isNotNull()).distinct()
    return categories.join(walked, "category_id", "left").join(parents, "category_id", "left").withColumn(
        "is_leaf", nvl("is_leaf", "Y"))


def ancestor_path(t: RetailTables, cap: int = 200) -> DataFrame:
    """Bottom-up category path of every variant, capped in length.

    Paths are built once per category that owns products and joined to the variants.
    """
    used = t.product.select("category_id").distinct().withColumn("_used", F.lit(True))
    base = t.product_category.select("category_id", "category_code", "parent_category_id").join(used, "category_id", "left")
    climbed = tree.hierarchy(base, "category_id", "parent_category_id", start=F.col("_used").isNotNull(), direction="up",
                             paths={"path": ("category_code", ">")}, roots={"_of": "category_id"})
    longest = climbed.groupBy("_of").agg(F.max("path").alias("path"))
    return (
        t.product_variant.select("variant_id", "product_id").join(t.product.select("product_id", "category_id"), "product_id")
        .join(longest, F.col("category_id") == F.col("_of"))
        .select("variant_id", F.substring("path", 1, cap).alias("category_path"))
    )
