"""Prices, price rules and taxes for whole request tables.

Small rule data (rates of a country) travels as one array per country, so the request table is
read once and never shuffled for it. Price lists can be large; they meet requests that were first
reduced to distinct (variant, country, channel, day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.functions.values import as_time, day_of, decode, greatest_null, keep_last, nvl, order_nulls, share, valid_on
from tillweave.operators.joins import fx_asof
from tillweave.operators.merge import upsert
from tillweave.operators.positions import top_k
from tillweave.operators.scalars import beside
from tillweave.sources.tables import RetailTables

# Rule themes in their numbered order.
RULE_THEMES = (
    "VOLUME_BREAK",
    "LOYALTY_TIER",
    "CLEARANCE",
    "BUNDLE",
    "CHANNEL_PARITY",
    "MARGIN_FLOOR",
    "COMPETITOR",
    "SEASONAL",
    "SUPPLIER_FUND",
    "BASKET_THRESHOLD",
)


def dec(text: str) -> Column:
    """An exact decimal literal."""
    whole, _, part = text.partition(".")
    return F.lit(text).cast(f"decimal({max(len(whole.lstrip('-')), 1) + len(part)},{len(part)})")


def store_country(t: RetailTables) -> DataFrame:
    return t.store.select("store_id", "region_id").join(
        t.region.select("region_id", "country_code"), "region_id").select("store_id", "country_code")


# ---- currency -----------------------------------------------------------------------------------

def fx_convert(df: DataFrame, rates: DataFrame, amount: str, from_: str, to: str, date: str) -> tuple[DataFrame, DataFrame]:
    """Add `converted`, rounded to six places; equal currencies keep the amount as it is.

    A NULL amount converts to NULL; an amount without any rate is rejected.
    """
    priced = fx_asof(df, rates, from_, to, date)
    money = F.col(amount).cast("decimal(16,4)")
    value = (
        F.when(F.col(from_) == F.col(to), money)
        .when(F.col("inverse").isNotNull(), F.round(money / F.col("inverse"), 6))
        .otherwise(F.round(money * F.col("rate").cast("decimal(18,8)"), 6))
    ).cast("decimal(24,6)")
    done = priced.withColumn("converted", value)
    missing = F.col(amount).isNotNull() & F.col("converted").isNull()
    ok = done.filter(~missing).drop("rate", "inverse")
    reason = F.concat(F.lit("No FX rate for "), F.col(from_), F.lit("->"), F.col(to), F.lit(" on or before "),
                      F.date_format(date, "yyyy-MM-dd"))
    return ok, done.filter(missing).select(*df.columns, reason.alias("reject_reason"))


# ---- effective and winning price -------------------------------------------------------------------

def _list_items(t: RetailTables) -> DataFrame:
    return t.price_list.join(t.price_list_item, "price_list_id")


def _base_price(t: RetailTables) -> DataFrame:
    return t.product_variant.select("variant_id", "product_id").join(
        t.product.select("product_id", F.col("list_price").alias("_base")), "product_id").select("variant_id", "_base")


def _pick() -> Column:
    """Least (priority with NULLs last, newest effective_from, list id) decides."""
    return F.struct(
        F.col("priority").isNull().alias("a"), F.col("priority").alias("b"),
        (-F.unix_micros(F.col("effective_from").cast("timestamp"))).alias("c"), F.col("price_list_id").alias("e"),
        F.col("unit_price").alias("unit_price"), F.col("currency_code").alias("currency_code"),
        F.col("price_reason_code").alias("price_reason_code"))


def price_requests(requests: DataFrame, t: RetailTables) -> DataFrame:
    """(variant_id, store_id, channel_code, on_date) requests with `country_code` and `price`:
    the listed price inside both validity ranges, else the product's list price, else NULL."""
    asked = requests.join(store_country(t), "store_id", "left")
    keys = ["variant_id", "country_code", "channel_code", "on_date"]
    distinct = asked.select(*keys).distinct()
    items = _list_items(t).filter(F.col("unit_price").isNotNull())
    inside = valid_on("valid_from", "valid_to", F.col("on_date"), "closed") & valid_on("effective_from", "effective_to", F.col("on_date"))
    best = distinct.join(items, ["variant_id", "country_code", "channel_code"]).filter(inside).groupBy(*keys).agg(
        F.min(_pick())["unit_price"].alias("_listed"))
    return asked.join(best, keys, "left").join(_base_price(t), "variant_id", "left").select(
        *requests.columns, "country_code", F.coalesce("_listed", "_base").alias("price"))


def effective_price(requests: DataFrame, t: RetailTables) -> tuple[DataFrame, DataFrame]:
    """Priced requests, and rejects for the ones without any price."""
    found = price_requests(requests, t)
    ok = found.filter(F.col("price").isNotNull()).select(*requests.columns, "price")
    bad = found.filter(F.col("price").isNull()).select(*requests.columns, F.concat(
        F.lit("No price for variant "), F.col("variant_id").cast("string"), F.lit(" in "), nvl("country_code", "?")).alias("reject_reason"))
    return ok, bad


def winning_price(requests: DataFrame, t: RetailTables, as_of) -> DataFrame:
    """Winning price with its source LIST, PROMO or NONE; end dates are ignored by design."""
    asked = requests.join(store_country(t), "store_id", "left")
    keys = ["variant_id", "country_code", "channel_code"]
    items = _list_items(t).filter(F.col("effective_from") <= as_time(as_of))
    best = items.join(asked.select(*keys).distinct(), keys).groupBy(*keys).agg(F.min(_pick()).alias("_w"))
    source = F.when(F.col("_w").isNull(), "NONE").when(F.col("_w.price_reason_code").isNull(), "LIST").otherwise("PROMO")
    return asked.join(best, keys, "left").select(
        *requests.columns, F.col("_w.unit_price").alias("price"), F.col("_w.currency_code").alias("currency_code"),
        source.alias("source_code"))


def price_batch(items: DataFrame, points: DataFrame, list_id: int, start: str) -> DataFrame:
    """Merge (variant_id, price) points into a list at a truncated date; NULL prices are ignored."""
    src = points.filter(F.col("price").isNotNull()).select(
        F.lit(list_id).cast("bigint").alias("price_list_id"), "variant_id", day_of(as_time(start)).alias("effective_from"),
        F.col("price").cast("decimal(12,4)").alias("new_price"))
    new = {"unit_price": F.col("s.new_price"), "price_reason_code": F.lit("BATCH_REPRICE")}
    return upsert(items, src, ["price_list_id", "variant_id", "effective_from"], new, new)


# ---- tax ----------------------------------------------------------------------------------------------

def tax(df: DataFrame, rates: DataFrame, statutory: DataFrame, net: str, code: str, date: str, shape: int,
        name: str = "tax") -> DataFrame:
    """Tax of each row by one of six national rules; `df` carries country_code, `statutory` has
    (country_code, std, red).

    0 code table · 1 newest valid rate of the code · 2 NULL-aware band · 3 best of all valid rates
    (lowest for RED) · 4 rates of the code not yet ended, newest first · 5 highest valid rate of the
    code. Every rule falls back to the statutory standard rate.
    """
    packed = rates.groupBy("country_code").agg(F.collect_list(F.struct(
        "tax_code", "valid_from", "valid_to", F.col("rate_pct").cast("decimal(7,3)").alias("rate"))).alias("_rates"))
    rows = df.join(statutory.select("country_code", F.col("std").cast("decimal(7,3)").alias("_std"),
                                    F.col("red").cast("decimal(7,3)").alias("_red")), "country_code", "left").join(
        packed, "country_code", "left")
    when, zero = F.col(date), F.lit(0).cast("decimal(7,3)")
    std, red = F.col("_std"), F.col("_red")
    asked = F.upper(nvl(code, "STD"))
    all_rates = F.coalesce("_rates", F.array())
    live = F.filter(all_rates, lambda r: valid_on(r["valid_from"], r["valid_to"], when))
    of_code = lambda arr: F.filter(arr, lambda r: r["tax_code"] == asked)
    newest = lambda arr: F.array_max(F.transform(arr, lambda r: F.struct(r["valid_from"], r["rate"].alias("rate"))))["rate"]
    values = lambda arr: F.transform(arr, lambda r: r["rate"])
    if shape == 0:
        rate = decode(asked, {"STD": std, "RED": red, "ZER": zero, "EXE": zero}, std)
    elif shape == 1:
        rate = F.coalesce(newest(of_code(live)), std)
    elif shape == 2:
        rate = decode(code, {None: std, "RED": red, "ZER": zero}, std)
    elif shape == 3:
        rate = F.coalesce(F.when(asked == "RED", F.array_min(values(live))).otherwise(F.array_max(values(live))), std)
    elif shape == 4:
        open_ = F.filter(of_code(all_rates), lambda r: r["valid_to"].isNull() | (r["valid_to"] > when))
        rate = F.coalesce(newest(open_), std)
    elif shape == 5:
        rate = F.coalesce(F.array_max(values(of_code(live))), std)
    else:
        raise ValueError(f"no tax rule {shape}")
    amount = nvl(F.col(net).cast("decimal(18,4)"), 0) * rate * dec("0.01")
    return rows.withColumn(name, F.round(amount, 2).cast("decimal(18,2)")).drop("_std", "_red", "_rates")


# ---- country price rules ----------------------------------------------------------------------------------

def price_rule(df: DataFrame, t: RetailTables, country: str, shape: int, as_of, name: str = "rule_price",
               qty: str = "qty", channel: str = "channel_code") -> DataFrame:
    """Price of (variant_id, list_price, qty, channel) rows under one of six national rules."""
    base, q, ch = nvl(F.col("list_price"), 0).cast("decimal(14,4)"), F.col(qty), F.col(channel)
    one = dec("1.00")
    lists = t.price_list.filter(F.col("country_code") == country).select("price_list_id", "channel_code")
    if shape == 0:
        step = F.when(q >= 24, dec("0.88")).when(q >= 6, dec("0.94")).otherwise(one)
        price = base * step * F.when(ch.isin("WEB", "APP"), dec("0.97")).otherwise(one)
    elif shape == 1:
        # the source takes an arbitrary item; here the first by (list, effective_from)
        first = t.price_list_item.join(lists, "price_list_id").groupBy("variant_id", "channel_code").agg(
            F.min(F.struct("price_list_id", "effective_from", "unit_price"))["unit_price"].alias("_first"))
        df = df.join(first.withColumnRenamed("channel_code", "_ch"), (df["variant_id"] == first["variant_id"]) & (ch == F.col("_ch")), "left").drop(
            first["variant_id"]).drop("_ch")
        price = F.coalesce("_first", "list_price")
    elif shape == 2:
        since = F.add_months(as_time(as_of).cast("date"), -3).cast("timestamp_ntz")
        orders = t.sales_order.filter(F.col("order_ts") >= since).select("order_id", "store_id").join(
            store_country(t).filter(F.col("country_code") == country), "store_id")
        sold = t.sales_order_line.join(orders.select("order_id"), "order_id", "left_semi").groupBy("variant_id").agg(F.sum("qty").alias("_q"))
        big = beside(sold, sold.agg(F.sum("_q").alias("_all"))).filter(share("_q", "_all") > 0.05).select("variant_id", F.lit(True).alias("_big"))
        df = df.join(big, "variant_id", "left")
        price = base * F.when(F.col("_big"), dec("0.95")).otherwise(one)
    elif shape == 3:
        low = t.price_list_item.join(lists, "price_list_id").groupBy("variant_id").agg(F.min("unit_price").alias("_low"))
        df = df.join(low, "variant_id", "left")
        price = F.coalesce("_low", "list_price") * F.when(q >= 12, dec("0.90")).otherwise(one)
    elif shape == 4:
        steps = len(("VOLUME", "CHANNEL", "LOYALTY", "CLEARANCE"))
        price = base * F.when(q >= 12, dec("0.92")).otherwise(one) * F.when(ch == "WEB", dec("0.98")).otherwise(one)
        price = price - dec(f"{steps / 1000:.3f}")
    elif shape == 5:
        early = t.store.join(t.region.filter(F.col("country_code") == country).select("region_id"), "region_id", "left_semi").agg(
            (F.min("opening_offset") < F.expr("INTERVAL '9' HOUR")).alias("_early"))
        df = beside(df, early)
        price = base * F.when(F.col("_early"), dec("0.99")).otherwise(one)
    else:
        raise ValueError(f"no price rule {shape}")
    rounded = F.round(price, 2).cast("decimal(14,2)")
    return df.withColumn(name, greatest_null(F.lit(0).cast("decimal(14,2)"), rounded)).drop("_first", "_big", "_low", "_early")


# ---- rule themes --------------------------------------------------------------------------------------------

def sellable_variants(t: RetailTables, as_of) -> DataFrame:
    """Variants a rule may touch: active, product ACTIVE, category known, launched by `as_of`."""
    now = as_time(as_of)
    return (
        t.product_variant.filter(F.col("is_active") == "Y").select("variant_id", "product_id")
        .join(t.product.filter((F.col("status") == "ACTIVE") & (nvl("launch_date", now) <= now)).select("product_id", "category_id"), "product_id")
        .join(t.product_category.select("category_id"), "category_id", "left_semi").select("variant_id")
    )


def _price_facts(t: RetailTables, kind: int) -> DataFrame:
    """(variant_id, latest, prior) by the fact a theme looks at."""
    items = t.price_list_item.select("variant_id", "price_list_id", "effective_from", "unit_price", "was_price", "price_reason_code")
    newest_first = [order_nulls("effective_from", desc=True), F.col("price_list_id").desc()]
    if kind == 0:
        last = top_k(items, ["variant_id"], newest_first, 2)
        return last.groupBy("variant_id").agg(
            keep_last("unit_price", "effective_from").alias("latest"), F.max(F.when(F.col("rn") == 2, F.col("unit_price"))).alias("prior"))
    if kind == 3:
        last = top_k(items, ["variant_id"], newest_first, 25)
        return last.groupBy("variant_id").agg(F.min_by("unit_price", "rn").alias("latest"), F.max_by("unit_price", "rn").alias("prior"))
    g = items.groupBy("variant_id").agg(F.min("unit_price").alias("lo"), F.max("unit_price").alias("hi"),
                                        F.max("was_price").alias("was"), F.max("price_reason_code").alias("why"))
    if kind in (1, 2):
        return g.select("variant_id", F.col("lo").alias("latest"), F.col("hi").alias("prior"))
    return g.select("variant_id", nvl("lo", 0).alias("latest"), decode("why", {None: F.col("was"), "CLEARANCE": F.col("hi")}, F.col("was")).alias("prior"))


def rule_evaluate(requests: DataFrame, t: RetailTables, number: int, as_of) -> DataFrame:
    """Outcome of rule `number` (1-based) for (variant_id, qty, base_price) requests: whether it
    applies, the adjusted price and the theme code."""
    theme = RULE_THEMES[(number - 1) % len(RULE_THEMES)]
    kind = number % 5
    threshold, factor = 4 + number % 9, dec(f"0.{85 + number % 12:02d}")
    rows = requests.join(sellable_variants(t, as_of).withColumn("_ok", F.lit(True)), "variant_id", "left").join(
        _price_facts(t, kind).withColumn("_seen", F.lit(True)), "variant_id", "left")
    start = F.coalesce("base_price", "latest", "prior", F.lit(0)).cast("decimal(14,4)")
    cut = F.when(nvl("qty", 1) >= threshold, factor).otherwise(dec("1.00"))
    price = F.round(F.greatest(F.lit(0).cast("decimal(20,8)"), (start * cut).cast("decimal(20,8)")), 4).cast("decimal(14,4)")
    applies = F.when(F.col("_ok"), "Y").otherwise("N")
    if kind == 0:  # this theme reads one row, and reports N with the base price when there is none
        applies = F.when(F.col("_seen").isNull(), "N").otherwise(applies)
        price = F.when(F.col("_seen").isNull(), F.col("base_price").cast("decimal(14,4)")).otherwise(price)
    return rows.select(*requests.columns, applies.alias("applies"), price.alias("adjusted_price"), F.lit(theme).alias("reason_code"))


def rule_apply(t: RetailTables, list_id: int, number: int, as_of, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """Evaluate a whole price list and, unless it is a dry run, write price and reason back."""
    items = t.price_list_item
    ours = items.filter(F.col("price_list_id") == list_id).withColumns({"qty": F.lit(1), "base_price": F.col("unit_price")})
    judged = rule_evaluate(ours, t, number, as_of)
    hit = (F.col("applies") == "Y") & F.lit(not dry_run)
    changed = judged.withColumns({
        "unit_price": F.when(hit, F.col("adjusted_price")).otherwise(F.col("unit_price")).cast("decimal(12,4)"),
        "price_reason_code": F.when(hit, F.substring("reason_code", 1, 20)).otherwise(F.col("price_reason_code")),
    }).select(*items.columns)
    summary = ours.agg(F.count("*").alias("n")).select(
        F.lit(RULE_THEMES[(number - 1) % len(RULE_THEMES)]).alias("rule_code"), F.lit("price_list_item").alias("entity_name"),
        F.lit(str(list_id)).alias("entity_key"), F.lit("INFO").alias("severity"),
        F.concat(F.lit("evaluated "), F.col("n").cast("string"), F.lit(f" dry_run={'Y' if dry_run else 'N'}")).alias("detail"))
    return items.filter(F.col("price_list_id") != list_id).unionByName(changed), summary
