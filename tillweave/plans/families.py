"""Parameterised view families: one function per family, one branch per shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillweave.functions.values import as_time, add_months_keep_end, day_of, decode, nvl, nvl2, order_nulls, share
from tillweave.operators.aggregates import first_last, median_over

from tillweave.operators.joins import country_variants, outer_shape1, outer_shape2, outer_shape3
from tillweave.plans import pricing
from tillweave.plans.views import LIVE, line_sums, region_subtree, rollup_movement
from tillweave.sources.tables import RetailTables

# Outside systems with transport, inbound and outbound entity.
SYSTEMS = (
    ("POS", "DELIMITED", "sales_order", "product"),
    ("WMS", "FIXED_WIDTH", "inventory_movement", "purchase_order"),
    ("TMS", "XML", "shipment", "shipment"),
    ("ERP_LEGACY", "COBOL_COPYBOOK", "gl_journal", "gl_journal"),
    ("CRM", "JSON", "customer", "customer"),
    ("PIM", "XML", "product", "product_variant"),
    ("FIN_SAP", "IDOC", "gl_journal_line", "gl_journal_line"),
    ("PAYGW", "ISO8583", "order_payment", "order_payment"),
    ("LOYALTY_HUB", "JSON", "loyalty_transaction", "loyalty_account"),
    ("MKTG_CLOUD", "CSV", "customer", "promotion"),
    ("SUPPLIER_EDI", "EDIFACT", "goods_receipt", "purchase_order_line"),
    ("TAX_ENGINE", "SOAP", "tax_rate", "sales_order_line"),
    ("BI_WAREHOUSE", "PARQUET", "sales_order_line", "sales_order"),
    ("ECOM", "REST", "sales_order", "price_list_item"),
    ("MOBILE_APP", "REST", "customer_address", "coupon"),
    ("RMA_PORTAL", "REST", "return_request", "return_line"),
    ("FRAUD_RISK", "SOAP", "order_payment", "sales_order"),
    ("WFM_ROSTER", "CSV", "employee", "store"),
)


def sales_region(t: RetailTables, region: str, shape: int) -> DataFrame:
    """0 daily sales per store with a rolling week and rank · 1 orders in local time · 2 subtree."""
    if shape == 2:
        return region_subtree(t, region)
    stores = t.store.select("store_id", "store_code", "region_id").join(
        t.region.filter(F.col("region_code") == region).select("region_id", "region_code", "country_code"), "region_id")
    if shape == 0:
        orders = t.sales_order.filter(F.col("status").isin(*LIVE)).select("order_id", "store_id", day_of("order_ts").alias("sales_day"))
        daily = orders.join(stores, "store_id").join(line_sums(t), "order_id").groupBy("region_code", "store_id", "store_code", "sales_day").agg(
            F.count("*").alias("order_count"), F.sum("units").alias("units"), F.sum("gross").alias("gross_amount"))
        week = Window.partitionBy("store_id").orderBy("sales_day").rowsBetween(-6, 0)
        ranked = Window.partitionBy("sales_day").orderBy(order_nulls("gross_amount", desc=True))
        return daily.withColumns({"rolling_7d_amount": F.sum("gross_amount").over(week), "store_rank": F.rank().over(ranked)})
    orders = t.sales_order.join(stores, "store_id").join(t.country.select("country_code", "tz_name"), "country_code")
    local = F.convert_timezone(F.lit("UTC"), F.col("tz_name"), F.col("order_ts"))
    return orders.select(
        "region_code", "country_code", "tz_name", "order_id", F.col("order_ts").alias("order_ts_session"), local.alias("order_ts_local"),
        day_of("order_ts").alias("order_date"), F.hour("order_ts").alias("order_hour"), "channel_code", "status",
        (nvl("subtotal_amount", 0) - nvl("discount_amount", 0)).alias("net_amount"))


def category_perf(t: RetailTables, category: str, shape: int, limit: int = 500) -> DataFrame:
    """0 averages per brand · 1 rank of an arbitrary sample of lines · 2 first, last and median price."""
    cat = t.product_category.filter(F.col("category_code") == category).select("category_id", "category_code", "category_name")
    products = t.product.join(cat, "category_id")
    variants = t.product_variant.select("variant_id", "variant_sku", "product_id").join(
        products.select("product_id", "category_id", "category_code"), "product_id")
    if shape == 0:
        # products have their variants counted first, then averages weighted by the joined row count
        per = t.product_variant.groupBy("product_id").agg(F.count("*").alias("nv"))
        rows = products.join(per, "product_id", "left").withColumns({"nv": nvl("nv", 0), "w": F.greatest(nvl("nv", 0), F.lit(1))})
        mean = lambda c: (F.sum(F.col(c) * F.col("w")).cast("double") / F.sum(F.when(F.col(c).isNotNull(), F.col("w"))))
        return rows.groupBy("category_code", "category_name", "brand_id").agg(
            F.count("*").alias("product_count"), F.sum("nv").alias("variant_count"), mean("list_price").alias("avg_list_price"),
            mean("unit_cost").alias("avg_unit_cost"), mean("margin_pct").alias("avg_margin_pct"),
            F.sum(F.when(F.col("status") == "DISCONTINUED", F.col("w")).otherwise(0)).alias("discontinued"))
    if shape == 1:
        some = t.sales_order_line.join(variants, "variant_id").limit(limit)  # any rows, as the source takes them
        sums = some.groupBy("category_code", "variant_id", "variant_sku").agg(F.sum("qty").alias("qty_sold"))
        return sums.withColumn("true_rank", F.row_number().over(Window.orderBy(F.desc("qty_sold"))))
    items = t.price_list_item.select("variant_id", "price_list_id", "effective_from", "unit_price").join(variants, "variant_id")
    first, last = first_last(["variant_id"], [F.col("effective_from"), F.col("price_list_id")], "unit_price")
    rows = median_over(items, ["category_id"], "unit_price", "median_price")
    return rows.select("category_code", "variant_id", "price_list_id", "effective_from", "unit_price", first.alias("first_price"),
                       last.alias("last_price"), "median_price")


def country_tax(t: RetailTables, country: str, as_of, statutory: DataFrame, tax_shape: int, price_shape: int) -> DataFrame:
    """Active variants of one country with standard and reduced tax and two rule prices."""
    rows = country_variants(t, country).withColumns({
        "std_code": F.lit("STD"), "red_code": F.lit("RED"), "on_date": as_time(as_of), "one": F.lit(1), "pos": F.lit("POS"),
        "dozen": F.lit(12), "web": F.lit("WEB")})
    rows = pricing.tax(rows, t.tax_rate, statutory, "list_price", "std_code", "on_date", tax_shape, "tax_standard")
    rows = pricing.tax(rows, t.tax_rate, statutory, "list_price", "red_code", "on_date", tax_shape, "tax_reduced")
    rows = pricing.price_rule(rows, t, country, price_shape, as_of, "pos_price", "one", "pos")
    rows = pricing.price_rule(rows, t, country, price_shape, as_of, "web_bulk_price", "dozen", "web")
    return rows.select(
        "country_code", "country_name", "currency_code", "vat_scheme", "variant_id", "variant_sku", "list_price", "tax_standard",
        "tax_reduced", "pos_price", "web_bulk_price", nvl2("launch_date", "LAUNCHED", "PIPELINE").alias("launch_state"),
        decode("product_status", {None: "UNKNOWN", "ACTIVE": "SELLABLE"}, "BLOCKED").alias("sell_state"))


def legacy_join(t: RetailTables, shape: int, as_of=None) -> DataFrame:
    return (outer_shape1, outer_shape2)[shape](t) if shape < 2 else outer_shape3(t, as_of)


def kpi(t: RetailTables, shape: int) -> DataFrame:
    """0 channel shares · 1 contactability · 2 account movement · 3 store intervals and lead time."""
    if shape == 0:
        ch = t.sales_order.groupBy("channel_code").agg(F.count("*").alias("order_count"), F.sum(nvl("subtotal_amount", 0)).alias("net_amount"))
        return ch.withColumns({  # one row per channel
            "revenue_share": share("net_amount", F.sum("net_amount").over(Window.partitionBy())),
            "cume_dist": F.cume_dist().over(Window.orderBy("net_amount")),
            "revenue_quartile": F.ntile(4).over(Window.orderBy(F.desc("net_amount")))})
    if shape == 1:
        return (
            t.customer.join(t.loyalty_account.select("customer_id", "points_balance", "tier_code"), "customer_id", "left")
            .join(t.loyalty_tier.select("tier_code", "tier_name"), "tier_code", "left")
            .select("customer_id", "customer_ref", nvl("first_name", "<unknown>").alias("first_name"), "last_name",
                    nvl2("email", "CONTACTABLE", "NO_EMAIL").alias("contactability"),
                    decode("marketing_optin", {"Y": "IN", "N": "OUT"}, "UNSET").alias("optin_state"),
                    nvl("points_balance", 0).alias("points_balance"), "tier_name")
        )
    if shape == 2:
        return rollup_movement(t)
    # longest lead time per variant first, then per store: two partial aggregates, no fan-out
    lead = t.supplier_product.groupBy("variant_id").agg(F.max("lead_time_days").alias("lt"))
    stocked = t.inventory_stock.select("location_id", "variant_id").join(
        t.inventory_location.filter(F.col("store_id").isNotNull()).select("location_id", "store_id"), "location_id")
    per_store = stocked.join(lead, "variant_id").groupBy("store_id").agg(F.max("lt").alias("lead_time_days"))
    return t.store.filter(F.col("closed_date").isNull()).join(per_store, "store_id", "left").select(
        "store_id", "store_code", "opening_offset", "closing_offset", (F.col("closing_offset") - F.col("opening_offset")).alias("trading_window"),
        "refit_cycle", add_months_keep_end("opened_date", F.col("refit_months")).alias("next_refit_due"), "lead_time_days",
        F.make_dt_interval(nvl("lead_time_days", 0).cast("int")).alias("lead_time"))


def interface_extract(t: RetailTables, system: str, strict: bool, as_of) -> DataFrame:
    """Outbound order feed of one system; strict feeds need address line 2 and postal code, the
    others carry the last month only."""
    transport = next(tr for code, tr, _, _ in SYSTEMS if code == system)
    address = t.address.select(F.col("address_id").alias("ship_address_id"), "line1", "line2", "city", "postal_code", "country_code")
    orders = t.sales_order.filter(F.col("status").isin("PLACED", "SHIPPED", "DELIVERED"))
    if not strict:
        orders = orders.filter(F.col("order_ts") >= add_months_keep_end(as_time(as_of), -1).cast("timestamp_ntz"))
    out = orders.join(address, "ship_address_id", "left").select(
        F.lit(system).alias("system_code"), F.lit(transport).alias("transport"), "order_id", "order_number", "order_ts", "channel_code",
        "status", "line1", "line2", "city", "postal_code", "country_code", nvl("subtotal_amount", 0).alias("subtotal_amount"),
        nvl("tax_amount", 0).alias("tax_amount"))
    return out.filter(F.col("line2").isNotNull() & F.col("postal_code").isNotNull()) if strict else out


def interface_extracts(t: RetailTables, as_of, systems: tuple = SYSTEMS[:15]) -> DataFrame:
    """Order feeds of all systems, every second one strict, from one scan and one join of the orders:
    an order is repeated for the systems whose rule it meets."""
    address = t.address.select(F.col("address_id").alias("ship_address_id"), "line1", "line2", "city", "postal_code", "country_code")
    orders = t.sales_order.filter(F.col("status").isin("PLACED", "SHIPPED", "DELIVERED")).join(address, "ship_address_id", "left")
    whole = F.col("line2").isNotNull() & F.col("postal_code").isNotNull()
    recent = F.col("order_ts") >= add_months_keep_end(as_time(as_of), -1).cast("timestamp_ntz")
    feeds = F.array(*[F.struct(F.lit(code).alias("system_code"), F.lit(transport).alias("transport"), F.lit(k % 2 == 1).alias("strict"))
                      for k, (code, transport, _, _) in enumerate(systems)])
    met = F.filter(feeds, lambda f: F.when(f["strict"], whole).otherwise(recent))
    return orders.select("*", F.inline(met)).select(
        "system_code", "transport", "order_id", "order_number", "order_ts", "channel_code", "status", "line1", "line2", "city", "postal_code",
        "country_code", nvl("subtotal_amount", 0).alias("subtotal_amount"), nvl("tax_amount", 0).alias("tax_amount"))


def archive_window(t: RetailTables, year: int) -> DataFrame:
    """Order lines of one calendar year; the year test reaches the scan through order_ts."""
    ts = F.col("order_ts")
    orders = t.sales_order.filter((ts >= as_time(f"{year}-01-01")) & (ts < as_time(f"{year + 1}-01-01"))).select(
        "order_id", "order_ts", "store_id", "currency_code", "status")
    lines = t.sales_order_line.drop("status", "fulfil_location_id")
    return orders.join(lines, "order_id").select(
        F.lit(year).alias("archive_year"), "order_id", "line_no", "order_ts", "store_id", "variant_id", "currency_code", "qty", "unit_price",
        nvl("discount_amount", 0).alias("discount_amount"), nvl("tax_amount", 0).alias("tax_amount"), "line_total", "status")
