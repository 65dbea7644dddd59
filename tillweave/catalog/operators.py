"""Filters, joins, aggregates, windows, sorts and table functions over the whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillweave.catalog.registry import d, day, half_up, i, query
from tillweave.catalog.views import NET, NOW
from tillweave.functions import values as x
from tillweave.operators import aggregates as a
from tillweave.operators import filters as f
from tillweave.operators import joins as j
from tillweave.operators.positions import rank_cols, top_k, with_part_total
from tillweave.sources.binding import AS_OF

By = x.By

# ---- sources ---------------------------------------------------------------------------------------

query("src_table", f"""
SELECT order_id, order_number, customer_id, store_id, channel_code, order_ts, status, currency_code,
  {d('subtotal_amount')} AS subtotal_amount, {d('subtotal_amount - discount_amount + tax_amount + shipping_amount')} AS order_total
FROM rt_sales_order""")(lambda t: t.sales_order.select(
    "order_id", "order_number", "customer_id", "store_id", "channel_code", "order_ts", "status", "currency_code",
    "subtotal_amount", "order_total"))

# ---- projections and filters -------------------------------------------------------------------------

query("prj_virtual", f"""
SELECT l.order_id, l.line_no, l.variant_id, {d(NET + ' + l.tax_amount')} AS line_total,
  {half_up('(p.list_price - p.unit_cost) * 100 * 10000', 'p.list_price * 10000', 2)} AS margin_pct,
  CONCAT(UPPER(TRIM(a.line1)), '|', UPPER(TRIM(a.city)), '|', a.country_code) AS normalised_key
FROM rt_sales_order_line l JOIN rt_product p ON p.product_id = l.variant_id
JOIN rt_sales_order o ON o.order_id = l.order_id JOIN rt_address a ON a.address_id = o.ship_address_id""")(
    lambda t: t.sales_order_line.join(t.product.select(F.col("product_id").alias("variant_id"), "margin_pct"), "variant_id")
    .join(t.sales_order.select("order_id", F.col("ship_address_id").alias("address_id")), "order_id")
    .join(t.address.select("address_id", "normalised_key"), "address_id")
    .select("order_id", "line_no", "variant_id", "line_total", "margin_pct", "normalised_key"))

query("prj_virtual_ledger", f"""
SELECT journal_id, line_no, {d('(debit_amount - credit_amount) * CAST(fx_rate AS DECIMAL(4,0))')} AS base_amount FROM rt_gl_journal_line
""")(lambda t: t.gl_journal_line.select("journal_id", "line_no", "base_amount"))

query("prj_null_logic", f"""
SELECT customer_id, COALESCE(first_name, '<none>') AS nvl_name, CASE WHEN email IS NOT NULL THEN 'C' ELSE 'N' END AS nvl2_email,
  CASE WHEN marketing_optin IS NULL THEN 'UNSET' WHEN marketing_optin = 'Y' THEN 'IN' ELSE 'OUT' END AS decoded,
  CASE WHEN mobile_phone IS NULL OR email IS NULL THEN NULL ELSE GREATEST(mobile_phone, email) END AS greatest_or_null,
  NULLIF(status, 'ACTIVE') AS other_status, {i('SIGN(preferred_store_id - 12)')} AS band FROM rt_customer""")(
    lambda t: t.customer.select(
        "customer_id", x.nvl("first_name", "<none>").alias("nvl_name"), x.nvl2("email", "C", "N").alias("nvl2_email"),
        x.decode("marketing_optin", {None: "UNSET", "Y": "IN"}, "OUT").alias("decoded"),
        x.greatest_null("mobile_phone", "email").alias("greatest_or_null"),
        F.nullif(F.col("status"), F.lit("ACTIVE")).alias("other_status"),
        F.signum(F.col("preferred_store_id") - 12).cast("bigint").alias("band")))

query("flt_valid_on", f"""
SELECT o.order_id, COUNT(r.tax_rate_id) AS rates_open,
  COUNT(r.tax_rate_id) FILTER (r.valid_to IS NULL OR r.valid_to > o.order_ts) AS rates_strict
FROM rt_sales_order o JOIN rt_store s ON s.store_id = o.store_id JOIN rt_region g ON g.region_id = s.region_id
LEFT JOIN rt_tax_rate r ON r.country_code = g.country_code AND r.valid_from <= o.order_ts AND (r.valid_to IS NULL OR r.valid_to >= o.order_ts)
GROUP BY o.order_id""")(
    lambda t: t.sales_order.select("order_id", "store_id", "order_ts")
    .join(t.store.select("store_id", "region_id").join(t.region.select("region_id", "country_code"), "region_id"), "store_id")
    .withColumnRenamed("country_code", "cc").alias("o")
    .join(t.tax_rate.alias("r"), (F.col("r.country_code") == F.col("o.cc")) & x.valid_on("r.valid_from", "r.valid_to", F.col("o.order_ts"), "closed"), "left")
    .groupBy("order_id").agg(F.count("tax_rate_id").alias("rates_open"),
                             F.count_if(F.col("tax_rate_id").isNotNull() & x.valid_on("valid_from", "valid_to", F.col("order_ts"))).alias("rates_strict")))

query("flt_window", """
SELECT order_id, order_ts FROM rt_sales_order
WHERE order_ts >= CAST('1997-01-01' AS TIMESTAMP) AND order_ts < CAST('1998-01-01' AS TIMESTAMP)""")(
    lambda t: t.sales_order.filter(x.in_window("order_ts", "1997-01-01", "1998-01-01")).select("order_id", "order_ts"))

query("flt_optional_param", "SELECT 'all' AS scope, COUNT(*) AS n FROM rt_sales_order UNION ALL SELECT 'web', COUNT(*) FROM rt_sales_order WHERE channel_code = 'WEB'")(
    lambda t: a.union_checks([f.where_if(t.sales_order, c).agg(F.count("*").alias("n")).select(F.lit(s).alias("scope"), "n")
                              for s, c in (("all", None), ("web", F.col("channel_code") == "WEB"))]))

query("flt_dynamic", """
SELECT price_list_id, COUNT(*) AS n FROM rt_price_list_item WHERE unit_price > 950 AND price_reason_code IS NULL GROUP BY 1""")(
    lambda t: f.filter_text(f.filter_text(t.price_list_item, "unit_price > 950 and price_reason_code is null"))
    .groupBy("price_list_id").agg(F.count("*").alias("n")))

query("flt_row_policy_store", "SELECT order_id, store_id FROM rt_sales_order WHERE store_id = 7")(
    lambda t: f.apply_store_policy(f.apply_store_policy(t.sales_order, f.Reader("HQ_MERCH")), f.Reader("STORE", store_id=7)).select("order_id", "store_id"))

query("flt_row_policy_country", "SELECT customer_id, status FROM rt_customer WHERE home_country_code = 'N05' AND status <> 'ERASED'")(
    lambda t: f.apply_country_policy(t.customer, f.Reader("STORE", country_code="N05")).select("customer_id", "status"))

query("prj_column_mask", "SELECT customer_id, last_name, CAST(NULL AS STRING) AS email, CAST(NULL AS STRING) AS mobile_phone FROM rt_customer")(
    lambda t: f.mask_columns(t.customer, f.Reader("STORE")).select("customer_id", "last_name", "email", "mobile_phone"))

query("prj_mask_email", """
SELECT customer_id, CASE WHEN email IS NULL THEN NULL WHEN INSTR(email, '@') <= 1 THEN '***'
  ELSE CONCAT(SUBSTR(email, 1, 1), REPEAT('*', GREATEST(INSTR(email, '@') - 2, 1)), SUBSTR(email, INSTR(email, '@'))) END AS email FROM rt_customer""")(
    lambda t: f.mask_pii(t.customer, ["email"]).select("customer_id", "email"))

query("prj_gdpr_erase", f"""
SELECT customer_id, CASE WHEN customer_id % 7 = 0 THEN 'ERASED' ELSE status END AS status, CASE WHEN customer_id % 7 <> 0 THEN email END AS email,
  CASE WHEN customer_id % 7 <> 0 THEN mobile_phone END AS mobile_phone,
  CASE WHEN customer_id % 7 = 0 THEN {NOW} ELSE gdpr_erasure_ts END AS gdpr_erasure_ts FROM rt_customer""")(
    lambda t: __import__("tillweave.operators.merge", fromlist=["erase"]).erase(
        t.customer, t.sales_order.join(t.customer.filter("customer_id % 7 = 0"), "customer_id", "left_semi").select("customer_id")
        .union(t.customer.filter("customer_id % 7 = 0").select("customer_id")), AS_OF)
    .select("customer_id", "status", "email", "mobile_phone", "gdpr_erasure_ts"))

query("prj_store_local_time", """
SELECT o.order_id, (o.order_ts AT TIME ZONE 'UTC') AT TIME ZONE y.tz_name AS local_ts
FROM rt_sales_order o JOIN rt_store s ON s.store_id = o.store_id JOIN rt_region r ON r.region_id = s.region_id
JOIN rt_country y ON y.country_code = r.country_code""")(
    lambda t: f.local_time(t.sales_order.select("order_id", "store_id", "order_ts"), t.store, t.region, t.country, "order_ts").select("order_id", "local_ts"))

query("prj_store_label", """
SELECT o.order_id, CASE WHEN s.store_id IS NULL THEN CONCAT('STORE?', CAST(o.sid AS STRING)) ELSE CONCAT(s.store_code, ' - ', s.store_name) END AS store_label
FROM (SELECT order_id, order_id % 30 AS sid FROM rt_sales_order) o LEFT JOIN rt_store s ON s.store_id = o.sid""")(
    lambda t: f.store_label(t.sales_order.select("order_id", (F.col("order_id") % 30).alias("store_id")), t.store).select("order_id", "store_label"))

query("flt_orders_by_status", """
SELECT order_id, order_ts FROM rt_sales_order WHERE store_id = 3 AND status = 'PLACED'
  AND order_ts >= CAST('1996-01-01' AS TIMESTAMP) AND order_ts < CAST('2000-01-01' AS TIMESTAMP)""")(
    lambda t: f.orders_by_status(t.sales_order, 3, "PLACED", "1996-01-01", "2000-01-01").select("order_id", "order_ts"))

query("flt_order_feed", f"""
SELECT order_id, order_number, channel_code, status, order_ts, {d('subtotal_amount')} AS subtotal_amount FROM rt_sales_order
WHERE order_ts >= CAST('1999-03-01' AS TIMESTAMP) AND order_ts < CAST('1999-04-01' AS TIMESTAMP)""")(
    lambda t: f.order_feed(t.sales_order, "1999-03-01", "1999-04-01"))

# ---- joins ---------------------------------------------------------------------------------------------

query("join_inner_star", f"""
SELECT s.store_code, b.brand_code, {d('SUM(l.qty)')} AS qty FROM rt_sales_order_line l JOIN rt_sales_order o ON o.order_id = l.order_id
JOIN rt_store s ON s.store_id = o.store_id JOIN rt_product p ON p.product_id = l.variant_id JOIN rt_brand b ON b.brand_id = p.brand_id
GROUP BY 1, 2""")(lambda t: j.star(t.sales_order_line.select("order_id", F.col("variant_id").alias("product_id"), "qty"), [
    (t.sales_order.select("order_id", "store_id"), "order_id"), (t.store.select("store_id", "store_code"), "store_id"),
    (t.product.select("product_id", "brand_id"), "product_id"), (t.brand.select("brand_id", "brand_code"), "brand_id")])
    .groupBy("store_code", "brand_code").agg(F.sum("qty").alias("qty")))

query("join_left_chain", """
SELECT c.customer_id, a.city, s.store_code, la.card_number, lt.tier_name FROM rt_customer c
LEFT JOIN rt_address a ON a.address_id = c.primary_address_id LEFT JOIN rt_store s ON s.store_id = c.preferred_store_id
LEFT JOIN rt_loyalty_account la ON la.customer_id = c.customer_id LEFT JOIN rt_loyalty_tier lt ON lt.tier_code = la.tier_code""")(
    lambda t: j.left_chain(t.customer.select("customer_id", "primary_address_id", "preferred_store_id"), [
        (t.address.select(F.col("address_id").alias("primary_address_id"), "city"), "primary_address_id"),
        (t.store.select(F.col("store_id").alias("preferred_store_id"), "store_code"), "preferred_store_id"),
        (t.loyalty_account.select("customer_id", "card_number", "tier_code"), "customer_id"),
        (t.loyalty_tier.select("tier_code", "tier_name"), "tier_code")]).select("customer_id", "city", "store_code", "card_number", "tier_name"))

query("join_outer_shape1", """
SELECT o.order_id, o.order_number, o.status AS order_status, c.customer_ref, c.last_name, sh.tracking_ref, sh.status AS shipment_status
FROM rt_sales_order o LEFT JOIN rt_customer c ON c.customer_id = o.customer_id
LEFT JOIN rt_shipment sh ON sh.order_id = o.order_id AND sh.status = 'DELIVERED'""")(j.outer_shape1)

query("join_outer_shape2", f"""
SELECT po.po_id, po.po_number, po.order_date, s.supplier_code, s.supplier_name, l.line_no, {d('l.qty_ordered')} AS qty_ordered,
  {d('COALESCE(l.qty_received, 0)')} AS qty_received
FROM rt_purchase_order po JOIN rt_supplier s ON s.supplier_id = po.supplier_id LEFT JOIN rt_purchase_order_line l ON l.po_id = po.po_id
WHERE COALESCE(l.status, 'OPEN') <> 'CANCELLED' AND po.status IN ('SENT', 'PART_RECV')""")(j.outer_shape2)

query("join_outer_shape3", f"""
SELECT r.return_id, r.rma_number, r.status AS return_status, l.line_no, {d('l.qty_returned')} AS qty_returned, n.reason_desc, n.is_restockable,
  e.employee_number AS approver
FROM rt_return_request r LEFT JOIN rt_return_line l ON l.return_id = r.return_id LEFT JOIN rt_return_reason n ON n.reason_code = l.reason_code
LEFT JOIN rt_employee e ON e.employee_id = r.approved_by_employee_id WHERE r.requested_ts >= {NOW} - INTERVAL 24 MONTH""")(
    lambda t: j.outer_shape3(t, AS_OF))

query("join_anti", """
SELECT l.order_id, l.line_no FROM rt_sales_order_line l
WHERE NOT EXISTS (SELECT 1 FROM rt_shipment s WHERE s.order_id = l.order_id)""")(
    lambda t: j.orphans(t.sales_order_line, t.shipment, ["order_id"]).select("order_id", "line_no"))

query("join_semi", """
SELECT category_id, category_code FROM rt_product_category c WHERE EXISTS (SELECT 1 FROM rt_product p WHERE p.category_id = c.category_id)""")(
    lambda t: j.exists_in(t.product_category, t.product.select("category_id"), "category_id").select("category_id", "category_code"))

query("join_cross", f"""
SELECT y.country_code, y.vat_scheme, pv.variant_id, {d('p.list_price')} AS list_price FROM rt_country y, rt_product_variant pv
JOIN rt_product p ON p.product_id = pv.product_id WHERE y.country_code = 'N06' AND pv.is_active = 'Y'""")(
    lambda t: j.country_variants(t, "N06").select("country_code", "vat_scheme", "variant_id", "list_price"))

query("join_theta", """
SELECT DISTINCT a.from_currency, a.to_currency FROM (SELECT from_currency, to_currency FROM rt_exchange_rate
  UNION SELECT to_currency, from_currency FROM rt_exchange_rate) a WHERE a.from_currency <> a.to_currency""")(
    lambda t: j.currency_pairs_quoted(t.exchange_rate))

query("join_scalar_subquery", f"""
SELECT la.loyalty_id, (SELECT COUNT(*) FROM rt_loyalty_transaction q WHERE q.loyalty_id = la.loyalty_id) AS n,
  CAST((SELECT SUM(points_delta) FROM rt_loyalty_transaction q WHERE q.loyalty_id = la.loyalty_id) AS BIGINT) AS points,
  (SELECT MAX(txn_ts) FROM rt_loyalty_transaction q WHERE q.loyalty_id = la.loyalty_id) AS last_ts FROM rt_loyalty_account la""")(
    lambda t: j.with_lookup_agg(t.loyalty_account.select("loyalty_id"), t.loyalty_transaction, "loyalty_id", [
        F.count("*").alias("n"), F.sum("points_delta").alias("points"), F.max("txn_ts").alias("last_ts")]).withColumn("n", x.nvl("n", 0)))

query("join_aggregate_inline", f"""
SELECT s.supplier_id, s.supplier_name, {i('COALESCE(a.n, 0)')} AS parts, {d('a.best')} AS best_cost FROM rt_supplier s
LEFT JOIN (SELECT supplier_id, COUNT(*) AS n, MIN(unit_cost) AS best FROM rt_supplier_product GROUP BY 1) a ON a.supplier_id = s.supplier_id""")(
    lambda t: j.with_lookup_agg(t.supplier.select("supplier_id", "supplier_name"), t.supplier_product, "supplier_id",
                                [F.count("*").alias("parts"), F.min("unit_cost").alias("best_cost")]).withColumn("parts", x.nvl("parts", 0)))

query("join_asof_fx", """
WITH ask AS (SELECT order_id, order_ts, currency_code AS f, CASE WHEN order_id % 3 = 0 THEN 'USD' ELSE 'GBP' END AS g FROM rt_sales_order),
dir AS (SELECT a.order_id, r.rate FROM ask a ASOF JOIN rt_exchange_rate r ON r.from_currency = a.f AND r.to_currency = a.g AND a.order_ts >= r.rate_date),
inv AS (SELECT a.order_id, r.rate FROM ask a ASOF JOIN rt_exchange_rate r ON r.from_currency = a.g AND r.to_currency = a.f AND a.order_ts >= r.rate_date)
SELECT a.order_id, a.f AS from_currency, a.g AS to_currency,
  ROUND(CASE WHEN a.f = a.g THEN 1 WHEN d.rate IS NOT NULL THEN CAST(d.rate AS DOUBLE) ELSE 1 / CAST(v.rate AS DOUBLE) END, 6) AS rate
FROM ask a LEFT JOIN dir d ON d.order_id = a.order_id LEFT JOIN inv v ON v.order_id = a.order_id""")(
    lambda t: j.fx_asof(t.sales_order.select("order_id", "order_ts", F.col("currency_code").alias("from_currency"),
                                             F.when(F.col("order_id") % 3 == 0, "USD").otherwise("GBP").alias("to_currency")),
                        t.exchange_rate, "from_currency", "to_currency", "order_ts")
    .select("order_id", "from_currency", "to_currency", F.round("rate", 6).cast("double").alias("rate")))

query("join_null_safe", """
SELECT x.k, CAST(x.n AS BIGINT) AS customers, CAST(y.n AS BIGINT) AS orders
FROM (SELECT preferred_store_id AS k, COUNT(*) AS n FROM rt_customer GROUP BY 1) x
JOIN (SELECT CASE WHEN customer_id IS NOT NULL THEN store_id END AS k, COUNT(*) AS n FROM rt_sales_order GROUP BY 1) y
  ON x.k IS NOT DISTINCT FROM y.k""")(
    lambda t: j.null_safe_join(
        t.customer.groupBy(F.col("preferred_store_id").alias("k")).agg(F.count("*").alias("customers")),
        t.sales_order.groupBy(F.when(F.col("customer_id").isNotNull(), F.col("store_id")).alias("k")).agg(F.count("*").alias("orders")), ["k"]))

# ---- aggregates ------------------------------------------------------------------------------------------

query("agg_group", f"""
SELECT store_id, status, COUNT(*) AS n, {d('SUM(subtotal_amount)')} AS total, {d('MIN(subtotal_amount)')} AS low, {d('MAX(subtotal_amount)')} AS high,
  CAST(SUM(subtotal_amount) AS DOUBLE) / COUNT(*) AS mean FROM rt_sales_order GROUP BY 1, 2""")(
    lambda t: a.group_agg(t.sales_order, ["store_id", "status"], [
        F.count("*").alias("n"), F.sum("subtotal_amount").alias("total"), F.min("subtotal_amount").alias("low"),
        F.max("subtotal_amount").alias("high"), (F.sum("subtotal_amount").cast("double") / F.count("subtotal_amount")).alias("mean")]))

query("agg_count_distinct", """
SELECT o.store_id, COUNT(DISTINCT l.order_id) AS orders, COUNT(DISTINCT l.variant_id) AS variants
FROM rt_sales_order_line l JOIN rt_sales_order o ON o.order_id = l.order_id GROUP BY 1""")(
    lambda t: a.count_distinct_by(t.sales_order_line.join(t.sales_order.select("order_id", "store_id"), "order_id"), ["store_id"],
                                  {"orders": "order_id", "variants": "variant_id"}))

query("agg_conditional", """
SELECT supplier_id, COUNT(*) FILTER (status = 'RECEIVED') AS received, COUNT(*) FILTER (status = 'CANCELLED') AS cancelled,
  COUNT(*) FILTER (expected_date IS NULL) AS undated FROM rt_purchase_order GROUP BY 1""")(
    lambda t: a.count_where(t.purchase_order, ["supplier_id"], {
        "received": F.col("status") == "RECEIVED", "cancelled": F.col("status") == "CANCELLED", "undated": F.col("expected_date").isNull()}))

query("agg_having", """
SELECT customer_id, COUNT(*) AS n FROM rt_sales_order WHERE customer_id IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= 12""")(
    lambda t: a.having(t.sales_order.filter(F.col("customer_id").isNotNull()), ["customer_id"], [F.count("*").alias("n")], F.col("n") >= 12))

query("agg_keep_last", """
SELECT customer_id, MAX(channel_code) AS last_channel FROM (SELECT *, RANK() OVER (PARTITION BY customer_id ORDER BY order_ts DESC) AS k FROM rt_sales_order)
WHERE k = 1 GROUP BY 1""")(lambda t: t.sales_order.groupBy("customer_id").agg(x.keep_last("channel_code", "order_ts").alias("last_channel")))

query("agg_first_tied", """
SELECT product_id, category_id, FIRST_VALUE(sku) OVER (PARTITION BY category_id ORDER BY list_price DESC, sku) AS priciest FROM rt_product""")(
    lambda t: a.keep_first_over(t.product.select("product_id", "category_id", "list_price", "sku"), ["category_id"], "list_price", "sku", "priciest")
    .select("product_id", "category_id", "priciest"))

query("agg_percentile", """
SELECT pli.price_list_id, pli.variant_id, pli.effective_from, m.median_price FROM rt_price_list_item pli JOIN (
  SELECT price_list_id, PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY CAST(unit_price AS DOUBLE)) AS median_price FROM rt_price_list_item GROUP BY 1) m
  ON m.price_list_id = pli.price_list_id""")(
    lambda t: a.median_over(t.price_list_item, ["price_list_id"], "unit_price", "median_price")
    .select("price_list_id", "variant_id", "effective_from", "median_price"))

query("agg_pivot", f"""
SELECT store_id, {', '.join(f"{d(f'SUM(subtotal_amount) FILTER (status = {chr(39)}{s}{chr(39)})')} AS {s.lower()}" for s in ('PLACED', 'SHIPPED', 'DELIVERED'))}
FROM rt_sales_order GROUP BY 1""")(
    lambda t: a.pivot_fixed(t.sales_order, ["store_id"], "status", ["PLACED", "SHIPPED", "DELIVERED"], [F.sum("subtotal_amount")])
    .withColumnsRenamed({s: s.lower() for s in ("PLACED", "SHIPPED", "DELIVERED")}))

query("agg_listagg", """
SELECT store_id, STRING_AGG(DISTINCT channel_code, ',' ORDER BY channel_code) AS channels FROM rt_sales_order GROUP BY 1""")(
    lambda t: a.listagg_by(t.sales_order, ["store_id"], "channel_code", ",", "channels"))

query("agg_nested_window", f"""
SELECT channel_code, yr, {d('total')} AS total, {d('LAG(total) OVER (PARTITION BY channel_code ORDER BY yr)')} AS prev_total,
  RANK() OVER (PARTITION BY yr ORDER BY total DESC) AS yr_rank, {d('SUM(total) OVER (PARTITION BY channel_code ORDER BY yr ROWS UNBOUNDED PRECEDING)')} AS to_date
FROM (SELECT channel_code, CAST(EXTRACT(YEAR FROM order_ts) AS BIGINT) AS yr, SUM(subtotal_amount) AS total FROM rt_sales_order GROUP BY 1, 2)""")(
    lambda t: a.agg_then_window(t.sales_order.withColumn("yr", F.year("order_ts").cast("bigint")), ["channel_code", "yr"],
                                [F.sum("subtotal_amount").alias("total")], {
        "prev_total": a.lag_lead(["channel_code"], [F.col("yr")], "total", 1),
        "yr_rank": F.rank().over(Window.partitionBy("yr").orderBy(F.desc("total"))),
        "to_date": a.running_sum(["channel_code"], [F.col("yr")], "total")}))

query("agg_array", """
SELECT variant_id, STRING_AGG(CAST(CAST(unit_price AS DECIMAL(12,4)) AS STRING), ';' ORDER BY effective_from, price_list_id) AS prices
FROM rt_price_list_item GROUP BY 1""")(
    lambda t: a.ordered_list(t.price_list_item.withColumn("txt", F.col("unit_price").cast("string")), ["variant_id"],
                             ["effective_from", "price_list_id"], "txt", "prices").withColumn("prices", F.array_join("prices", ";")))

query("agg_ratio_round", f"""
SELECT store_id, {half_up('SUM(discount_amount) * 100 * 100', 'SUM(subtotal_amount) * 100', 2)} AS discount_pct FROM rt_sales_order GROUP BY 1""")(
    lambda t: t.sales_order.groupBy("store_id").agg(F.sum("discount_amount").alias("dd"), F.sum("subtotal_amount").alias("s"))
    .select("store_id", x.rate_pct("dd", "s").alias("discount_pct")))

# ---- windows ---------------------------------------------------------------------------------------------

query("win_row_number", """
SELECT order_id, store_id, ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY order_ts, order_id) AS rn FROM rt_sales_order""")(
    lambda t: rank_cols(t.sales_order.select("order_id", "store_id", "order_ts"), ["store_id"], [By("order_ts")], {"rn": "row_number"}, ["order_id"])
    .select("order_id", "store_id", "rn"))

query("win_rank", """
SELECT order_id, line_no, variant_id, RANK() OVER w AS rk, DENSE_RANK() OVER w AS dr FROM rt_sales_order_line
WINDOW w AS (PARTITION BY variant_id ORDER BY qty DESC)""")(
    lambda t: rank_cols(t.sales_order_line.select("order_id", "line_no", "variant_id", "qty"), ["variant_id"], [By("qty", desc=True)],
                        {"rk": "rank", "dr": "dense_rank"}, ["order_id", "line_no"]).select("order_id", "line_no", "variant_id", "rk", "dr"))

query("win_rank_spread", """
SELECT order_id, line_no, variant_id, RANK() OVER w AS rk, DENSE_RANK() OVER w AS dr, PERCENT_RANK() OVER w AS pr, CUME_DIST() OVER w AS cd FROM rt_sales_order_line
WINDOW w AS (PARTITION BY status ORDER BY qty DESC)""")(
    lambda t: rank_cols(t.sales_order_line.select("order_id", "line_no", "variant_id", "qty", "status"), ["status"], [By("qty", desc=True)],
                        {"rk": "rank", "dr": "dense_rank", "pr": "percent_rank", "cd": "cume_dist"}, ["order_id", "line_no", "variant_id"])
    .select("order_id", "line_no", "variant_id", "rk", "dr", "pr", "cd"))

query("win_percent_rank", """
SELECT product_id, PERCENT_RANK() OVER w AS pr, CUME_DIST() OVER w AS cd FROM rt_product WINDOW w AS (PARTITION BY status ORDER BY list_price)""")(
    lambda t: rank_cols(t.product.select("product_id", "status", "list_price"), ["status"], [By("list_price")],
                        {"pr": "percent_rank", "cd": "cume_dist"}, ["product_id"]).select("product_id", "pr", "cd"))

query("win_ntile", """
SELECT customer_id, NTILE(5) OVER (ORDER BY n DESC NULLS LAST, customer_id) AS bucket FROM (
  SELECT c.customer_id, COUNT(o.order_id) AS n FROM rt_customer c LEFT JOIN rt_sales_order o ON o.customer_id = c.customer_id GROUP BY 1)""")(
    lambda t: rank_cols(t.customer.select("customer_id").join(t.sales_order.groupBy("customer_id").agg(F.count("*").alias("n")), "customer_id", "left")
                        .withColumn("n", x.nvl("n", 0)), [], [By("n", desc=True, nulls="last")], {"bucket": ("ntile", 5)}, ["customer_id"])
    .select("customer_id", "bucket"))


def _daily(t):
    return t.sales_order.groupBy("store_id", x.day_of("order_ts").alias("dy")).agg(F.sum("subtotal_amount").alias("v"), F.count("*").alias("n"))


_DAILY = f"(SELECT store_id, {day('order_ts')} AS dy, SUM(subtotal_amount) AS v, COUNT(*) AS n FROM rt_sales_order GROUP BY 1, 2)"

query("win_lag_lead", f"""
SELECT store_id, dy, {d('LAG(v) OVER w')} AS prev_v, {d('LEAD(v) OVER w')} AS next_v, {d('LAG(v, 1, 0) OVER w')} AS prev_or_zero
FROM {_DAILY} WINDOW w AS (PARTITION BY store_id ORDER BY dy)""")(
    lambda t: _daily(t).select("store_id", "dy", a.lag_lead(["store_id"], [F.col("dy")], "v", 1).alias("prev_v"),
                               a.lag_lead(["store_id"], [F.col("dy")], "v", -1).alias("next_v"),
                               F.coalesce(a.lag_lead(["store_id"], [F.col("dy")], "v", 1), F.lit(0)).alias("prev_or_zero")))

query("win_running", f"""
SELECT store_id, dy, {d("SUM(v) OVER (PARTITION BY store_id, DATE_TRUNC('month', dy) ORDER BY dy ROWS UNBOUNDED PRECEDING)")} AS mtd FROM {_DAILY}""")(
    lambda t: _daily(t).withColumn("m", x.month_of("dy")).select("store_id", "dy", a.running_sum(["store_id", "m"], [F.col("dy")], "v").alias("mtd")))

query("win_rolling", f"""
SELECT store_id, dy, {d('SUM(v) OVER w')} AS sum7, CAST(SUM(v) OVER w AS DOUBLE) / COUNT(v) OVER w AS avg7
FROM {_DAILY} WINDOW w AS (PARTITION BY store_id ORDER BY dy ROWS 6 PRECEDING)""")(
    lambda t: _daily(t).select("store_id", "dy", a.rolling(["store_id"], [F.col("dy")], "v", 7).alias("sum7"),
                               a.rolling(["store_id"], [F.col("dy")], "v", 7, "avg").alias("avg7")))

query("win_first_last", f"""
SELECT store_id, dy, {d('FIRST_VALUE(v) OVER w')} AS first_v, {d('LAST_VALUE(v) OVER w')} AS last_v FROM {_DAILY}
WINDOW w AS (PARTITION BY store_id ORDER BY dy ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")(
    lambda t: _daily(t).select("store_id", "dy", *[c.alias(n) for n, c in zip(("first_v", "last_v"), a.first_last(["store_id"], [F.col("dy")], "v"))]))

query("win_nth_from_last", f"""
SELECT store_id, dy, NTH_VALUE(dy, 2) OVER (PARTITION BY store_id ORDER BY v DESC, dy DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_best
FROM {_DAILY}""")(lambda t: _daily(t).select("store_id", "dy", a.nth_from_last(["store_id"], [("v", False), ("dy", False)], "dy", 2).alias("second_best")))

query("win_ratio", """
SELECT order_id, CAST(subtotal_amount AS DOUBLE) / NULLIF(CAST(SUM(subtotal_amount) OVER (PARTITION BY store_id) AS DOUBLE), 0) AS store_share FROM rt_sales_order""")(
    lambda t: with_part_total(t.sales_order.select("order_id", "store_id", "subtotal_amount"), ["store_id"], {"s": F.sum("subtotal_amount")})
    .select("order_id", x.share("subtotal_amount", "s").alias("store_share")))

query("win_partition_agg", f"""
SELECT order_id, line_no, variant_id, {d('MAX(unit_price) OVER w')} AS top_price, {d('SUM(qty) OVER w')} AS variant_qty, COUNT(*) OVER w AS variant_lines
FROM rt_sales_order_line WINDOW w AS (PARTITION BY variant_id)""")(
    lambda t: with_part_total(t.sales_order_line.select("order_id", "line_no", "variant_id", "unit_price", "qty"), ["variant_id"], {
        "top_price": F.max("unit_price"), "variant_qty": F.sum("qty"), "variant_lines": F.count("*")}).drop("unit_price", "qty"))

# ---- sorts, limits, sets ------------------------------------------------------------------------------------

query("top_k_per_group", f"""
SELECT supplier_id, po_id, {d('order_total')} AS order_total, rn FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY supplier_id ORDER BY order_total DESC, po_id) AS rn FROM rt_purchase_order) WHERE rn <= 5""")(
    lambda t: top_k(t.purchase_order.select("supplier_id", "po_id", "order_total"), ["supplier_id"], [x.order_nulls("order_total", desc=True), F.col("po_id")], 5))

query("top_n", f"SELECT order_id, {d('subtotal_amount')} AS subtotal_amount FROM rt_sales_order ORDER BY rt_sales_order.subtotal_amount DESC, order_id LIMIT 100")(
    lambda t: a.top_n(t.sales_order.select("order_id", "subtotal_amount"), [F.desc("subtotal_amount"), F.col("order_id")], 100))

query("limit_then_sort")(lambda t: a.limit_then_sort(t.sales_order.select("order_id", "order_ts"), 100, [F.desc("order_ts")]))

query("sort_null_order", """
SELECT customer_id, ROW_NUMBER() OVER (ORDER BY primary_address_id ASC NULLS LAST, customer_id) AS asc_pos,
  ROW_NUMBER() OVER (ORDER BY primary_address_id DESC NULLS FIRST, customer_id) AS desc_pos FROM rt_customer""")(
    lambda t: rank_cols(rank_cols(t.customer.select("customer_id", "primary_address_id"), [], [By("primary_address_id")], {"asc_pos": "row_number"}, ["customer_id"]),
                        [], [By("primary_address_id", desc=True)], {"desc_pos": "row_number"}, ["customer_id"]).drop("primary_address_id"))

query("checksum_pair", """
SELECT COUNT(*) AS n_limit_first, COUNT(*) AS n_sort_first, CAST(SUM(order_id) AS BIGINT) AS sort_first
FROM (SELECT order_id FROM rt_sales_order ORDER BY order_ts DESC, order_id LIMIT 100)""")(
    lambda t: a.checksum_pair(t.sales_order, "order_id", [F.desc("order_ts"), F.col("order_id")], 100).select("n_limit_first", "n_sort_first", "sort_first"))

query("set_union_all", """
SELECT 'orders' AS check_name, COUNT(*) = COUNT(DISTINCT order_id) AND COUNT(*) > 0 AS passed FROM rt_sales_order
UNION ALL SELECT 'customers', COUNT(*) FILTER (customer_ref IS NULL) = 0 FROM rt_customer
UNION ALL SELECT 'stock', COUNT(*) FILTER (qty_reserved < 0) = 0 FROM rt_inventory_stock""")(
    lambda t: a.union_checks([
        t.sales_order.agg(F.lit("orders").alias("check_name"), ((F.count("*") == F.count_distinct("order_id")) & (F.count("*") > 0)).alias("passed")),
        t.customer.agg(F.lit("customers").alias("check_name"), (F.count_if(F.col("customer_ref").isNull()) == 0).alias("passed")),
        t.inventory_stock.agg(F.lit("stock").alias("check_name"), (F.count_if(F.col("qty_reserved") < 0) == 0).alias("passed"))]))

query("set_multi_insert", f"""
SELECT order_id, 1 AS line_no, '1100' AS account_code, {d('subtotal_amount - discount_amount')} AS debit, 0.0::DOUBLE AS credit FROM rt_sales_order
UNION ALL SELECT order_id, 2, '4000', 0.0, {d('subtotal_amount - discount_amount')} FROM rt_sales_order
UNION ALL SELECT order_id, 3, '2200', 0.0, {d('tax_amount')} FROM rt_sales_order""".replace("1 AS line_no", "CAST(1 AS BIGINT) AS line_no"))(
    lambda t: a.explode_legs(
        t.sales_order.withColumn("net", (F.col("subtotal_amount") - F.col("discount_amount")).cast("decimal(16,2)")).withColumn("tax", F.col("tax_amount").cast("decimal(16,2)")),
        [F.struct(F.lit(n).alias("line_no"), F.lit(acc).alias("account_code"), dr.cast("decimal(16,2)").alias("debit"), cr.cast("decimal(16,2)").alias("credit"))
         for n, acc, dr, cr in ((1, "1100", F.col("net"), F.lit(0)), (2, "4000", F.lit(0), F.col("net")), (3, "2200", F.lit(0), F.col("tax")))], ["order_id"]))

# ---- table functions ----------------------------------------------------------------------------------------

query("udtf_split", """
SELECT doc_id, CAST(i AS BIGINT) AS part_no, parts[i] AS part FROM (
  SELECT doc_id, parts, UNNEST(RANGE(1, LEN(parts) + 1)) AS i FROM (SELECT doc_id, STRING_SPLIT(text, ',') AS parts FROM documents))""")(
    lambda t: a.split_rows(t.base("documents").select("doc_id", "text"), "text").drop("text"))

query("udtf_lateral", """
SELECT p.p_partkey AS variant_id, w.word, CAST(LENGTH(w.word) AS BIGINT) AS len FROM part p, LATERAL (SELECT UNNEST(STRING_SPLIT(p.p_name, ' ')) AS word) w""")(
    lambda t: t.spark.sql("""SELECT p.p_partkey AS variant_id, w.word, length(w.word) AS len FROM {part} p,
                             LATERAL (SELECT explode(split(p.p_name, ' ')) AS word) w""", part=t.base("part")))

query("udtf_pipelined", """
SELECT o.store_id, COUNT(*) AS n, CAST(MAX(x.lines) AS BIGINT) AS max_lines FROM rt_sales_order o
JOIN (SELECT order_id, COUNT(*) AS lines FROM rt_sales_order_line GROUP BY 1) x ON x.order_id = o.order_id GROUP BY 1""")(
    lambda t: t.sales_order.select("order_id", "store_id").join(t.sales_order_line.groupBy("order_id").agg(F.count("*").alias("lines")), "order_id")
    .groupBy("store_id").agg(F.count("*").alias("n"), F.max("lines").alias("max_lines")))

query("udf_deterministic", """
SELECT order_id, CAST(CASE WHEN EXTRACT(MONTH FROM order_ts) = 1 THEN 12 ELSE EXTRACT(MONTH FROM order_ts) - 1 END AS BIGINT) AS fiscal_period,
  (SELECT COUNT(*) FROM RANGE(CAST(DATE_DIFF('day', DATE '1990-01-01', CAST(order_ts AS DATE)) AS BIGINT), CAST(DATE_DIFF('day', DATE '1990-01-01', CAST(order_ts AS DATE)) + 1 + order_id % 12 AS BIGINT)) r(d)
    WHERE (d % 7) < 5) AS working_days,
  REGEXP_REPLACE(UPPER(order_number), '[^A-Z0-9]', '', 'g') AS sku_key FROM rt_sales_order""")(
    lambda t: t.sales_order.select(
        "order_id", x.fiscal_period("order_ts").alias("fiscal_period"),
        x.working_days("order_ts", F.col("order_ts") + F.make_dt_interval((F.col("order_id") % 12).cast("int"))).alias("working_days"),
        x.normalise_sku("order_number").alias("sku_key")))

query("udf_cached_lookup", f"""
SELECT l.order_id, l.line_no, l.variant_id, {d('p.list_price')} AS base_price FROM rt_sales_order_line l
LEFT JOIN rt_product_variant v ON v.variant_id = l.variant_id LEFT JOIN rt_product p ON p.product_id = v.product_id""")(
    lambda t: t.sales_order_line.select("order_id", "line_no", "variant_id").join(
        t.product_variant.select("variant_id", "product_id").join(t.product.select("product_id", F.col("list_price").alias("base_price")), "product_id"),
        "variant_id", "left").drop("product_id"))

# ---- text and struct helpers exercised over whole tables ---------------------------------------------------------

query("scalar_text_keys", """
SELECT doc_id, REPLACE(UPPER(TRIM(REGEXP_REPLACE(text, '\\s+', ' ', 'g'))), '\u1e9e', '\u00df') AS norm, CAST(LENGTH(text) AS BIGINT) AS chars, CAST(STRLEN(text) AS BIGINT) AS bytes FROM documents""")(
    lambda t: t.base("documents").select("doc_id", x.normalise_text("text").alias("norm"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes")))

query("scalar_labels", """
SELECT supplier_id, CONCAT('SUPPLIER:', supplier_code, ':', supplier_name, CASE is_approved WHEN 'Y' THEN ' [approved]' WHEN 'N' THEN ' [unapproved]' ELSE ' [unknown]' END) AS party,
  CASE WHEN REGEXP_MATCHES(contact_email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$') THEN 'Y' ELSE 'N' END AS email_ok FROM rt_supplier""")(
    lambda t: t.supplier.select("supplier_id", x.supplier_label("supplier_code", "supplier_name", "is_approved").alias("party"), x.valid_email("contact_email").alias("email_ok")))
