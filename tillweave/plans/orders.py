"""Order jobs: baskets, placing, cancelling, picking, allocating, shipping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillweave.functions.values import as_time, order_nulls
from tillweave.operators.positions import assign_ids, running_min
from tillweave.plans.pricing import dec, price_requests, store_country
from tillweave.plans.reports import available_qty
from tillweave.plans.views import CHANNELS
from tillweave.session import stash
from tillweave.sources.tables import RetailTables


def basket_validate(heads: DataFrame, lines: DataFrame, t: RetailTables, as_of) -> tuple[DataFrame, DataFrame]:
    """Check baskets: heads (basket_id, store_id, channel_code), lines (basket_id, line_no,
    variant_id, qty, unit_price). Returns the lines of sound baskets with their price, and one
    reject per other basket with its first failure: empty, channel, then line by line short stock,
    no price, changed price.
    """
    asked = lines.join(heads, "basket_id").withColumn("on_date", as_time(as_of))
    whole = price_requests(asked, t)
    stock = available_qty(t)
    whole = whole.join(stock, "variant_id", "left").withColumn("available_qty", F.coalesce("available_qty", F.lit(0)))
    vid = F.col("variant_id").cast("string")
    step = (
        F.when(F.col("available_qty") < F.col("qty"), F.struct(F.lit(1).alias("step"), F.concat(F.lit("Insufficient stock for variant "), vid).alias("why")))
        .when(F.col("price").isNull(), F.struct(F.lit(2).alias("step"), F.concat(F.lit("No price for variant "), vid).alias("why")))
        .when(F.abs(F.col("unit_price") - F.col("price")) > dec("0.01"), F.struct(F.lit(3).alias("step"), F.concat(F.lit("Price changed for variant "), vid).alias("why")))
    )
    wrong_channel = F.coalesce(~F.col("channel_code").isin(*CHANNELS), F.lit(False))
    judged = whole.withColumn("_bad", step)
    # a basket has few lines, so whether all of them are sound is a window, not a second price plan
    sound = ~F.bool_or(F.col("_bad").isNotNull() | wrong_channel).over(Window.partitionBy("basket_id"))
    kept = judged.withColumn("_sound", sound).filter("_sound").select(*asked.columns, F.coalesce("unit_price", "price").cast("decimal(12,4)").alias("sell_price"))
    first = judged.groupBy("basket_id").agg(
        F.min(F.when(F.col("_bad").isNotNull(), F.struct("line_no", F.col("_bad.step").alias("step"), F.col("_bad.why").alias("why")))).alias("_f"),
        F.count("*").alias("_n"))
    reason = F.when(F.col("_n").isNull(), "Basket is empty").when(
        wrong_channel, F.concat(F.lit("Invalid channel: "), F.col("channel_code"))).otherwise(F.col("_f.why"))
    rejects = heads.join(first, "basket_id", "left").withColumn("reject_reason", reason)
    return kept, rejects.filter(F.col("reject_reason").isNotNull()).select("basket_id", "reject_reason")


def orders_place(ok: DataFrame, t: RetailTables, start_id: int, as_of) -> tuple[DataFrame, DataFrame]:
    """Orders and lines for sound baskets (lines as basket_validate returns them, with customer_id).

    Tax is 20% per line, rounded per line; totals are the sums of the lines. The sound lines are
    written once, since heads and lines both follow from them and their prices are costly.
    """
    net = F.col("qty") * F.col("sell_price")
    ok = stash(ok.select("basket_id", "line_no", "variant_id", "qty", "sell_price", "customer_id", "store_id", "channel_code"))
    lines = ok.withColumns({"_net": net.cast("decimal(24,7)"), "_tax": F.round(net * dec("0.2"), 2).cast("decimal(16,2)")})
    heads = lines.groupBy("basket_id", "customer_id", "store_id", "channel_code").agg(
        F.sum("_net").alias("subtotal_amount"), F.sum("_tax").alias("tax_amount"))
    currency = store_country(t).join(t.country.select("country_code", "currency_code"), "country_code").select("store_id", "currency_code")
    heads = assign_ids(heads.join(currency, "store_id"), [F.col("basket_id")], start_id, "order_id", "SO", 12, "order_number")
    zero = F.lit(0).cast("decimal(14,2)")
    orders = heads.select(
        "basket_id", "order_id", "order_number", "customer_id", "store_id", "channel_code", as_time(as_of).alias("order_ts"),
        F.lit("PLACED").alias("status"), "currency_code", F.col("subtotal_amount").cast("decimal(14,2)").alias("subtotal_amount"),
        zero.alias("discount_amount"), F.col("tax_amount").cast("decimal(14,2)").alias("tax_amount"), zero.alias("shipping_amount"))
    out = lines.join(heads.select("basket_id", "order_id"), "basket_id").select(
        "order_id", "line_no", "variant_id", "qty", F.col("sell_price").alias("unit_price"), F.lit(0).cast("decimal(12,4)").alias("discount_amount"),
        F.col("_tax").cast("decimal(12,4)").alias("tax_amount"), F.lit("PLACED").alias("status"))
    return orders, out


def orders_cancel(t: RetailTables, requests: DataFrame) -> tuple[RetailTables, DataFrame]:
    """Cancel the listed orders with their lines, unless shipped, delivered, returned or unknown."""
    asked = requests.select("order_id").distinct()
    known = asked.join(t.sales_order.select("order_id", "status"), "order_id", "left")
    reason = F.when(F.col("status").isNull(), F.concat(F.lit("Unknown order "), F.col("order_id").cast("string"))).when(
        F.col("status").isin("SHIPPED", "DELIVERED", "RETURNED"), F.concat(F.lit("Cannot cancel an order in status "), F.col("status")))
    judged = known.withColumn("reject_reason", reason)
    good = judged.filter(F.col("reject_reason").isNull()).select("order_id", F.lit(True).alias("_cancel"))

    def cancelled(df: DataFrame) -> DataFrame:
        return df.join(good, "order_id", "left").withColumn(
            "status", F.when(F.col("_cancel"), "CANCELLED").otherwise(F.col("status"))).select(*df.columns)

    return t.replace(sales_order=cancelled(t.sales_order), sales_order_line=cancelled(t.sales_order_line)), judged.filter(
        F.col("reject_reason").isNotNull()).select("order_id", "reject_reason")


def pick_list(t: RetailTables, store_id: int, n: int | None = 100) -> DataFrame:
    """Pickable lines of a store. With a limit, any n lines are taken and then sorted."""
    lines = (
        t.sales_order.filter((F.col("store_id") == store_id) & (F.col("status") == "PICKING")).select("order_id", "order_number", "order_ts")
        .join(t.sales_order_line.select("order_id", "line_no", "variant_id", "qty", "fulfil_location_id"), "order_id")
        .join(t.product_variant.select("variant_id", "variant_sku", "product_id"), "variant_id")
        .join(t.product.select("product_id", "product_name"), "product_id")
        .join(t.inventory_location.select(F.col("location_id").alias("fulfil_location_id"), "location_code"), "fulfil_location_id", "left")
        .select("order_id", "order_number", "order_ts", "line_no", "variant_id", "variant_sku", "product_name", "qty", "fulfil_location_id", "location_code")
    )
    return lines if n is None else lines.limit(n).orderBy(order_nulls("order_ts"), order_nulls("line_no"))


def pick_wave(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claim the oldest PLACED order of every store, one wave per batch."""
    claimed = orders.filter(F.col("status") == "PLACED").groupBy("store_id").agg(
        F.min(F.struct("order_ts", "order_id"))["order_id"].alias("order_id"))
    mark = claimed.select("order_id", F.lit(True).alias("_claimed"))
    new = orders.join(mark, "order_id", "left").withColumn(
        "status", F.when(F.col("_claimed"), "PICKING").otherwise(F.col("status"))).select(*orders.columns)
    return new, claimed


def allocate(lines: DataFrame, t: RetailTables) -> DataFrame:
    """Give each unallocated line the smallest location that holds enough of its variant.

    Stock is not reduced between lines, so the answer depends on (variant, qty) alone and is
    worked out once per distinct pair: stock and quantities of a variant are sorted together from
    much to little, and the least location so far is the one wanted. No pairs are built.
    """
    asked = lines.filter(F.col("fulfil_location_id").isNull() & F.col("qty").isNotNull()).select("variant_id", "qty").distinct()
    usable = t.inventory_stock.filter(F.col("qty_available").isNotNull()).join(
        t.inventory_location.filter(F.col("location_type").isin("PICKFACE", "SHELF", "BULK")).select("location_id"), "location_id", "left_semi")
    both = usable.select("variant_id", F.col("qty_available").alias("_amount"), F.lit(False).alias("_asked"), F.col("location_id").alias("_loc")).unionByName(
        asked.select("variant_id", F.col("qty").alias("_amount"), F.lit(True).alias("_asked"), F.lit(None).cast(usable.schema["location_id"].dataType).alias("_loc")))
    least = running_min(both, ["variant_id"], [F.desc("_amount"), F.asc("_asked")], ["_loc"])
    found = least.filter(F.col("_asked")).select("variant_id", F.col("_amount").cast(lines.schema["qty"].dataType).alias("qty"), "_loc")
    done = lines.join(found, ["variant_id", "qty"], "left").withColumn("fulfil_location_id", F.coalesce("fulfil_location_id", "_loc"))
    return done.withColumn("status", F.when(F.col("fulfil_location_id").isNotNull(), "ALLOCATED").otherwise(F.col("status"))).select(*lines.columns)


def ship(orders: DataFrame, lines: DataFrame, carrier: str, start_id: int, as_of, service: str = "STANDARD") -> tuple[DataFrame, DataFrame, DataFrame]:
    """One shipment per order: shipments, shipment lines and the orders as SHIPPED."""
    heads = assign_ids(orders.select("order_id"), [F.col("order_id")], start_id, "shipment_id", "TRK", 12, "tracking_ref")
    shipments = heads.select(
        "shipment_id", "order_id", F.lit(carrier).alias("carrier_code"), F.lit(service).alias("service_level"), "tracking_ref",
        as_time(as_of).alias("shipped_ts"), F.lit("SHIPPED").alias("status"))
    out = lines.join(heads.select("order_id", "shipment_id"), "order_id").select(
        "shipment_id", "order_id", F.col("line_no").alias("order_line_no"), "variant_id", F.col("qty").alias("qty_shipped"))
    return shipments, out, orders.withColumn("status", F.lit("SHIPPED"))
