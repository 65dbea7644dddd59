"""Prices, taxes, rule themes and view families."""

from __future__ import annotations

import functools
import os
import uuid

from pyspark.sql import functions as F

from tillweave.catalog.registry import d, day, half_up, i, query
from tillweave.catalog.views import NET, NOW
from tillweave.plans import families as fam
from tillweave.plans import pricing as p
from tillweave.session import shared_dir
from tillweave.sources import feeds
from tillweave.sources.binding import AS_OF

ORDERS_IN = "o.status IN ('PLACED', 'PICKING', 'SHIPPED', 'DELIVERED')"


def statutory(t):
    """Statutory rates per country, derived from the nation table."""
    return t.base("nation").select(
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("country_code"),
        (15 + F.col("n_nationkey") % 10).cast("decimal(7,3)").alias("std"), (5 + F.col("n_nationkey") % 4).cast("decimal(7,3)").alias("red"))


STAT = "(SELECT CONCAT('N', LPAD(CAST(n_nationkey AS STRING), 2, '0')) AS country_code, 15 + n_nationkey % 10 AS std, 5 + n_nationkey % 4 AS red FROM nation)"


def requests(t):
    """One price request per order line."""
    return t.sales_order_line.select("order_id", "line_no", (F.col("variant_id") + F.when(F.col("line_no") == 7, 10_000_000).otherwise(0)).alias("variant_id"), "qty").join(
        t.sales_order.select("order_id", "store_id", "channel_code", F.col("order_ts").alias("on_date")), "order_id")


REQ = """(SELECT l.order_id, l.line_no, l.variant_id + CASE WHEN l.line_no = 7 THEN 10000000 ELSE 0 END AS variant_id, l.qty, o.store_id, o.channel_code,
  o.order_ts AS on_date, g.country_code FROM rt_sales_order_line l JOIN rt_sales_order o ON o.order_id = l.order_id
  JOIN rt_store s ON s.store_id = o.store_id JOIN rt_region g ON g.region_id = s.region_id)"""

_PICKED = f"""
WITH req AS (SELECT DISTINCT variant_id, country_code, channel_code, on_date FROM {REQ}),
cand AS (SELECT r.*, i.unit_price, ROW_NUMBER() OVER (PARTITION BY r.variant_id, r.country_code, r.channel_code, r.on_date
    ORDER BY pl.priority ASC NULLS LAST, i.effective_from DESC, pl.price_list_id) AS k
  FROM req r JOIN rt_price_list pl ON pl.country_code = r.country_code AND pl.channel_code = r.channel_code
  JOIN rt_price_list_item i ON i.price_list_id = pl.price_list_id AND i.variant_id = r.variant_id
  WHERE pl.valid_from <= r.on_date AND COALESCE(pl.valid_to, r.on_date) >= r.on_date AND i.effective_from <= r.on_date
    AND (i.effective_to IS NULL OR i.effective_to > r.on_date)),
priced AS (SELECT r.order_id, r.line_no, r.variant_id, r.country_code, COALESCE(c.unit_price, pr.list_price) AS price FROM {REQ} r
  LEFT JOIN cand c ON c.k = 1 AND c.variant_id = r.variant_id AND c.country_code = r.country_code AND c.channel_code = r.channel_code AND c.on_date = r.on_date
  LEFT JOIN rt_product pr ON pr.product_id = r.variant_id)"""

for _name in ("join_asof_price", "job_effective_price"):
    query(_name, f"{_PICKED} SELECT order_id, line_no, variant_id, {d('price')} AS price FROM priced WHERE price IS NOT NULL")(
        lambda t: p.effective_price(requests(t), t)[0].select("order_id", "line_no", "variant_id", "price"))
query("job_effective_price_rejects", f"""{_PICKED} SELECT order_id, line_no, CONCAT('No price for variant ', CAST(variant_id AS STRING), ' in ', country_code) AS reject_reason
FROM priced WHERE price IS NULL""")(lambda t: p.effective_price(requests(t), t)[1].select("order_id", "line_no", "reject_reason"))

query("job_winning_price", f"""
WITH req AS (SELECT DISTINCT variant_id, country_code, channel_code FROM {REQ}),
cand AS (SELECT r.*, i.unit_price, pl.currency_code, CASE WHEN i.price_reason_code IS NULL THEN 'LIST' ELSE 'PROMO' END AS src,
    ROW_NUMBER() OVER (PARTITION BY r.variant_id, r.country_code, r.channel_code ORDER BY pl.priority ASC NULLS LAST, i.effective_from DESC, pl.price_list_id) AS k
  FROM req r JOIN rt_price_list pl ON pl.country_code = r.country_code AND pl.channel_code = r.channel_code
  JOIN rt_price_list_item i ON i.price_list_id = pl.price_list_id AND i.variant_id = r.variant_id WHERE i.effective_from <= {NOW})
SELECT r.order_id, r.line_no, r.variant_id, {d('c.unit_price')} AS price, c.currency_code, COALESCE(c.src, 'NONE') AS source_code FROM {REQ} r
LEFT JOIN cand c ON c.k = 1 AND c.variant_id = r.variant_id AND c.country_code = r.country_code AND c.channel_code = r.channel_code""")(
    lambda t: p.winning_price(requests(t), t, AS_OF).select("order_id", "line_no", "variant_id", "price", "currency_code", "source_code"))


def fx_in(t):
    return t.sales_order.select("order_id", "order_ts", "subtotal_amount", F.col("currency_code").alias("from_currency"),
                                F.when(F.col("order_id") % 3 == 0, "USD").otherwise("GBP").alias("to_currency"))


_FX = """
WITH ask AS (SELECT order_id, order_ts, subtotal_amount, currency_code AS f, CASE WHEN order_id % 3 = 0 THEN 'USD' ELSE 'GBP' END AS g FROM rt_sales_order),
dir AS (SELECT a.order_id, r.rate FROM ask a ASOF JOIN rt_exchange_rate r ON r.from_currency = a.f AND r.to_currency = a.g AND a.order_ts >= r.rate_date),
inv AS (SELECT a.order_id, r.rate FROM ask a ASOF JOIN rt_exchange_rate r ON r.from_currency = a.g AND r.to_currency = a.f AND a.order_ts >= r.rate_date),
val AS (SELECT a.*, CASE WHEN a.f = a.g THEN CAST(a.subtotal_amount AS DOUBLE) WHEN d.rate IS NOT NULL THEN CAST(a.subtotal_amount * CAST(d.rate AS DECIMAL(6,2)) AS DOUBLE)
   ELSE CAST(__INV__ AS DOUBLE) END AS c FROM ask a LEFT JOIN dir d ON d.order_id = a.order_id LEFT JOIN inv v ON v.order_id = a.order_id)""".replace(
    "__INV__", half_up("a.subtotal_amount * 100", "v.rate * 100", 6))
query("job_fx_convert", _FX + " SELECT order_id, f AS from_currency, g AS to_currency, c AS converted FROM val WHERE c IS NOT NULL")(
    lambda t: p.fx_convert(fx_in(t), t.exchange_rate, "subtotal_amount", "from_currency", "to_currency", "order_ts")[0]
    .select("order_id", "from_currency", "to_currency", F.col("converted").cast("double").alias("converted")))
query("job_fx_convert_rejects", _FX + """ SELECT order_id, CONCAT('No FX rate for ', f, '->', g, ' on or before ', STRFTIME(order_ts, '%Y-%m-%d')) AS reject_reason
FROM val WHERE c IS NULL""")(
    lambda t: p.fx_convert(fx_in(t), t.exchange_rate, "subtotal_amount", "from_currency", "to_currency", "order_ts")[1].select("order_id", "reject_reason"))

query("job_price_batch", f"""
SELECT price_list_id, variant_id, effective_from, {d('unit_price')} AS unit_price, price_reason_code FROM rt_price_list_item x
WHERE NOT (price_list_id = 33 AND effective_from = CAST('1996-07-01' AS TIMESTAMP) AND EXISTS (SELECT 1 FROM rt_product p WHERE p.product_id = x.variant_id AND p.product_id % 11 <> 0))
UNION ALL SELECT 33, product_id, CAST('1996-07-01' AS TIMESTAMP), {d('list_price - 1')}, 'BATCH_REPRICE' FROM rt_product WHERE product_id % 11 <> 0""")(
    lambda t: p.price_batch(t.price_list_item, t.product.select(F.col("product_id").alias("variant_id"),
                            F.when(F.col("product_id") % 11 != 0, F.col("list_price") - 1).alias("price")), 33, "1996-07-01 13:00:00")
    .select("price_list_id", "variant_id", "effective_from", "unit_price", "price_reason_code"))

# ---- taxes -------------------------------------------------------------------------------------------

_TAXIN = f"""(SELECT o.order_id, g.country_code, CASE WHEN o.order_id % 13 = 0 THEN NULL ELSE o.subtotal_amount END AS net,
  CASE o.order_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'RED' WHEN 2 THEN 'ZER' WHEN 3 THEN 'red' WHEN 4 THEN 'EXE' ELSE 'STD' END AS code, o.order_ts AS dt, st.std, st.red
  FROM rt_sales_order o JOIN rt_store s ON s.store_id = o.store_id JOIN rt_region g ON g.region_id = s.region_id LEFT JOIN {STAT} st ON st.country_code = g.country_code)"""
_LIVE = "r.country_code = q.country_code AND r.valid_from <= q.dt AND (r.valid_to IS NULL OR r.valid_to > q.dt)"
_UP = "UPPER(COALESCE(q.code, 'STD'))"
_RATE = {
    0: f"CASE {_UP} WHEN 'RED' THEN q.red WHEN 'ZER' THEN 0 WHEN 'EXE' THEN 0 ELSE q.std END",
    1: f"COALESCE((SELECT r.rate_pct FROM rt_tax_rate r WHERE {_LIVE} AND r.tax_code = {_UP} ORDER BY r.valid_from DESC LIMIT 1), q.std)",
    2: "CASE q.code WHEN 'RED' THEN q.red WHEN 'ZER' THEN 0 ELSE q.std END",
    3: f"COALESCE(CASE WHEN {_UP} = 'RED' THEN (SELECT MIN(r.rate_pct) FROM rt_tax_rate r WHERE {_LIVE}) ELSE (SELECT MAX(r.rate_pct) FROM rt_tax_rate r WHERE {_LIVE}) END, q.std)",
    4: f"COALESCE((SELECT r.rate_pct FROM rt_tax_rate r WHERE r.country_code = q.country_code AND r.tax_code = {_UP} AND COALESCE(r.valid_to, CAST('9999-12-31' AS TIMESTAMP)) > q.dt ORDER BY r.valid_from DESC LIMIT 1), q.std)",
    5: f"COALESCE((SELECT MAX(r.rate_pct) FROM rt_tax_rate r WHERE {_LIVE} AND r.tax_code = {_UP}), q.std)",
}


def tax_in(t):
    code = F.when(F.col("order_id") % 6 == 0, F.lit(None)).when(F.col("order_id") % 6 == 1, "RED").when(F.col("order_id") % 6 == 2, "ZER").when(
        F.col("order_id") % 6 == 3, "red").when(F.col("order_id") % 6 == 4, "EXE").otherwise("STD")
    return t.sales_order.join(p.store_country(t), "store_id").select(
        "order_id", "country_code", F.when(F.col("order_id") % 13 != 0, F.col("subtotal_amount")).alias("net"), code.alias("code"), F.col("order_ts").alias("dt"))


for _shape, _sql in _RATE.items():
    query(f"job_tax_{_shape}", f"""
SELECT order_id, {d('ROUND(COALESCE(net, 0) * CAST(rate AS DECIMAL(7,2)) * CAST(0.01 AS DECIMAL(4,2)), 2)')} AS tax FROM (SELECT q.order_id, q.net, {_sql} AS rate FROM {_TAXIN} q)""")(
        lambda t, s=_shape: p.tax(tax_in(t), t.tax_rate, statutory(t), "net", "code", "dt", s).select("order_id", "tax"))

# ---- price rules -----------------------------------------------------------------------------------------

_PL = "(SELECT i.variant_id, i.price_list_id, i.effective_from, i.unit_price, pl.channel_code FROM rt_price_list_item i JOIN rt_price_list pl ON pl.price_list_id = i.price_list_id WHERE pl.country_code = 'N10')"
_CUT = "CAST({0} AS DECIMAL(4,2))"
_RULES = {
    0: f"p.list_price * CASE WHEN q.qty >= 24 THEN {_CUT.format('0.88')} WHEN q.qty >= 6 THEN {_CUT.format('0.94')} ELSE {_CUT.format('1')} END * CASE WHEN q.channel_code IN ('WEB', 'APP') THEN {_CUT.format('0.97')} ELSE {_CUT.format('1')} END",
    1: f"COALESCE((SELECT x.unit_price FROM {_PL} x WHERE x.variant_id = q.variant_id AND x.channel_code = q.channel_code ORDER BY x.price_list_id, x.effective_from LIMIT 1), p.list_price)",
    3: f"COALESCE((SELECT MIN(x.unit_price) FROM {_PL} x WHERE x.variant_id = q.variant_id), p.list_price) * CASE WHEN q.qty >= 12 THEN {_CUT.format('0.9')} ELSE {_CUT.format('1')} END",
    4: f"p.list_price * CASE WHEN q.qty >= 12 THEN {_CUT.format('0.92')} ELSE {_CUT.format('1')} END * CASE WHEN q.channel_code = 'WEB' THEN {_CUT.format('0.98')} ELSE {_CUT.format('1')} END - CAST(0.004 AS DECIMAL(5,3))",
    5: f"p.list_price * CASE WHEN (SELECT MIN(s.opening_minutes) FROM rt_store s JOIN rt_region g ON g.region_id = s.region_id WHERE g.country_code = 'N10') < 540 THEN {_CUT.format('0.99')} ELSE {_CUT.format('1')} END",
    2: f"""p.list_price * CASE WHEN q.variant_id IN (SELECT v FROM (SELECT l.variant_id AS v, CAST(SUM(l.qty) AS DOUBLE) / CAST(SUM(SUM(l.qty)) OVER () AS DOUBLE) AS sh
        FROM rt_sales_order_line l JOIN rt_sales_order o ON o.order_id = l.order_id JOIN rt_store s ON s.store_id = o.store_id JOIN rt_region g ON g.region_id = s.region_id
        WHERE g.country_code = 'N10' AND o.order_ts >= CAST('2001-04-20' AS TIMESTAMP) GROUP BY 1) WHERE sh > 0.05) THEN {_CUT.format('0.95')} ELSE {_CUT.format('1')} END""",
}
for _shape, _sql in _RULES.items():
    query(f"job_price_rules_{_shape}", f"""
SELECT q.order_id, q.line_no, q.variant_id, {d(f'GREATEST(0, ROUND({_sql}, 2))')} AS rule_price FROM {REQ} q JOIN rt_product p ON p.product_id = q.variant_id""")(
        lambda t, s=_shape: p.price_rule(requests(t).join(t.product.select(F.col("product_id").alias("variant_id"), "list_price"), "variant_id"),
                                         t, "N10", s, "2001-07-20 00:00:00").select("order_id", "line_no", "variant_id", "rule_price"))

# ---- rule themes ----------------------------------------------------------------------------------------------

_FACTS = {
    0: """SELECT variant_id, MAX(CASE WHEN effective_from = top THEN unit_price END) AS latest, MAX(CASE WHEN k = 2 THEN unit_price END) AS prior FROM (
           SELECT *, MAX(effective_from) OVER (PARTITION BY variant_id) AS top, ROW_NUMBER() OVER (PARTITION BY variant_id ORDER BY effective_from DESC, price_list_id DESC) AS k FROM rt_price_list_item) WHERE k <= 2 GROUP BY 1""",
    1: "SELECT variant_id, MIN(unit_price) AS latest, MAX(unit_price) AS prior FROM rt_price_list_item GROUP BY 1",
    2: "SELECT variant_id, MIN(unit_price) AS latest, MAX(unit_price) AS prior FROM rt_price_list_item GROUP BY 1",
    3: """SELECT variant_id, MAX(CASE WHEN k = 1 THEN unit_price END) AS latest, MAX(CASE WHEN k = mk THEN unit_price END) AS prior FROM (SELECT *, MAX(k) OVER (PARTITION BY variant_id) AS mk FROM (
           SELECT *, ROW_NUMBER() OVER (PARTITION BY variant_id ORDER BY effective_from DESC, price_list_id DESC) AS k FROM rt_price_list_item) WHERE k <= 25) GROUP BY 1""",
    4: """SELECT variant_id, COALESCE(MIN(unit_price), 0) AS latest, CASE WHEN MAX(price_reason_code) = 'CLEARANCE' THEN MAX(unit_price) ELSE MAX(was_price) END AS prior FROM rt_price_list_item GROUP BY 1""",
}


def rule_in(t):
    return t.sales_order_line.select("order_id", "line_no", "variant_id", "qty",
                                     F.when(F.col("order_id") % 2 == 0, F.col("unit_price")).alias("base_price"))


for _n in range(1, 11):
    _theme = p.RULE_THEMES[_n - 1]
    _seen = "f.variant_id IS NOT NULL" if _n % 5 == 0 else "TRUE"
    query(f"job_rule_evaluate_{_theme.lower()}", f"""
SELECT l.order_id, l.line_no, l.variant_id, CASE WHEN {_seen} AND pv.is_active = 'Y' AND p.status = 'ACTIVE' AND COALESCE(p.launch_date, {NOW}) <= {NOW} THEN 'Y' ELSE 'N' END AS applies,
  CASE WHEN {_seen} THEN {d(f'''ROUND(GREATEST(0, CAST(COALESCE(CASE WHEN l.order_id % 2 = 0 THEN l.unit_price END, f.latest, f.prior, 0) AS DECIMAL(14,4))
    * CASE WHEN l.qty >= {4 + _n % 9} THEN CAST(0.{85 + _n % 12} AS DECIMAL(4,2)) ELSE CAST(1 AS DECIMAL(4,2)) END), 4)''')}
  ELSE {d('CASE WHEN l.order_id % 2 = 0 THEN l.unit_price END')} END AS adjusted_price, '{_theme}' AS reason_code
FROM rt_sales_order_line l LEFT JOIN rt_product_variant pv ON pv.variant_id = l.variant_id LEFT JOIN rt_product p ON p.product_id = pv.product_id
LEFT JOIN ({_FACTS[_n % 5]}) f ON f.variant_id = l.variant_id""")(
        lambda t, n=_n: p.rule_evaluate(rule_in(t), t, n, AS_OF).select("order_id", "line_no", "variant_id", "applies", "adjusted_price", "reason_code"))

query("job_rule_apply", f"""
SELECT i.price_list_id, i.variant_id, i.effective_from, {d('i.unit_price')} AS unit_price,
  CASE WHEN i.price_list_id = 50 AND pv.is_active = 'Y' AND p.status = 'ACTIVE' AND COALESCE(p.launch_date, {NOW}) <= {NOW} THEN 'CLEARANCE' ELSE i.price_reason_code END AS price_reason_code
FROM rt_price_list_item i LEFT JOIN rt_product_variant pv ON pv.variant_id = i.variant_id LEFT JOIN rt_product p ON p.product_id = pv.product_id""")(
    lambda t: p.rule_apply(t, 50, 3, AS_OF, dry_run=False)[0].select("price_list_id", "variant_id", "effective_from", "unit_price", "price_reason_code"))
query("job_rule_apply_summary", """
SELECT 'CLEARANCE' AS rule_code, 'price_list_item' AS entity_name, '50' AS entity_key, 'INFO' AS severity,
  CONCAT('evaluated ', CAST(COUNT(*) AS STRING), ' dry_run=Y') AS detail FROM rt_price_list_item WHERE price_list_id = 50""")(
    lambda t: p.rule_apply(t, 50, 3, AS_OF)[1])

# ---- families ---------------------------------------------------------------------------------------------------

query("gen_sales_region_daily", f"""
WITH dly AS (SELECT g.region_code, s.store_id, s.store_code, {day('o.order_ts')} AS sales_day, COUNT(DISTINCT o.order_id) AS order_count, SUM(l.qty) AS units, SUM({NET} + l.tax_amount) AS gross
  FROM rt_sales_order o JOIN rt_sales_order_line l ON l.order_id = o.order_id JOIN rt_store s ON s.store_id = o.store_id JOIN rt_region g ON g.region_id = s.region_id
  WHERE g.region_code = 'CTRY03' AND {ORDERS_IN} GROUP BY 1, 2, 3, 4)
SELECT region_code, store_id, store_code, sales_day, order_count, {d('units')} AS units, {d('gross')} AS gross_amount,
  {d('SUM(gross) OVER (PARTITION BY store_id ORDER BY sales_day ROWS 6 PRECEDING)')} AS rolling_7d_amount,
  RANK() OVER (PARTITION BY sales_day ORDER BY gross DESC) AS store_rank FROM dly""")(lambda t: fam.sales_region(t, "CTRY03", 0))

query("gen_sales_region_local", f"""
SELECT g.region_code, y.country_code, y.tz_name, o.order_id, o.order_ts AS order_ts_session, (o.order_ts AT TIME ZONE 'UTC') AT TIME ZONE y.tz_name AS order_ts_local,
  {day('o.order_ts')} AS order_date, {i('EXTRACT(HOUR FROM o.order_ts)')} AS order_hour, o.channel_code, o.status, {d('o.subtotal_amount - o.discount_amount')} AS net_amount
FROM rt_sales_order o JOIN rt_store s ON s.store_id = o.store_id JOIN rt_region g ON g.region_id = s.region_id JOIN rt_country y ON y.country_code = g.country_code
WHERE g.region_code = 'CTRY02'""")(lambda t: fam.sales_region(t, "CTRY02", 1))

query("gen_sales_region_tree", """
WITH tree AS (
  SELECT *, 1 AS lv, CONCAT('/', region_code) AS p FROM rt_region WHERE region_code = 'AREA2'
  UNION ALL
  SELECT r.*, t.lv + 1, CONCAT(t.p, '/', r.region_code) FROM tree t JOIN rt_region r ON r.parent_region_id = t.region_id)
SELECT 'AREA2' AS root_region, region_id, region_code, region_name, region_level, CAST(lv AS BIGINT) AS tree_depth,
  CAST(CASE WHEN region_id IN (SELECT parent_region_id FROM rt_region WHERE parent_region_id IS NOT NULL) THEN 0 ELSE 1 END AS BIGINT) AS is_leaf,
  p AS region_path, (SELECT COUNT(*) FROM rt_store s WHERE s.region_id = tree.region_id) AS store_count FROM tree""")(lambda t: fam.sales_region(t, "AREA2", 2))

query("gen_category_perf_brand", f"""
SELECT c.category_code, c.category_name, p.brand_id, COUNT(DISTINCT p.product_id) AS product_count, COUNT(DISTINCT v.variant_id) AS variant_count,
  CAST(SUM(p.list_price) AS DOUBLE) / COUNT(p.list_price) AS avg_list_price, CAST(SUM(p.unit_cost) AS DOUBLE) / COUNT(p.unit_cost) AS avg_unit_cost,
  SUM({half_up('(p.list_price - p.unit_cost) * 100 * 10000', 'p.list_price * 10000', 2)}) / COUNT(*) AS avg_margin_pct,
  COUNT(*) FILTER (p.status = 'DISCONTINUED') AS discontinued
FROM rt_product_category c JOIN rt_product p ON p.category_id = c.category_id LEFT JOIN rt_product_variant v ON v.product_id = p.product_id
WHERE c.category_code = 'PROMO_12_3' GROUP BY 1, 2, 3""")(
    lambda t: fam.category_perf(t, "PROMO_12_3", 0))

query("gen_category_perf_sample")(lambda t: fam.category_perf(t, "PROMO_12_3", 1))

query("gen_category_perf_prices", f"""
SELECT 'PROMO_12_3' AS category_code, i.variant_id, i.price_list_id, i.effective_from, {d('i.unit_price')} AS unit_price,
  {d('FIRST_VALUE(i.unit_price) OVER w')} AS first_price, {d('LAST_VALUE(i.unit_price) OVER w')} AS last_price, m.med AS median_price
FROM rt_price_list_item i JOIN rt_product p ON p.product_id = i.variant_id JOIN rt_product_category c ON c.category_id = p.category_id
JOIN (SELECT p.category_id, PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY CAST(i.unit_price AS DOUBLE)) AS med FROM rt_price_list_item i JOIN rt_product p ON p.product_id = i.variant_id GROUP BY 1) m ON m.category_id = c.category_id
WHERE c.category_code = 'PROMO_12_3' WINDOW w AS (PARTITION BY i.variant_id ORDER BY i.effective_from, i.price_list_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")(
    lambda t: fam.category_perf(t, "PROMO_12_3", 2))

_R10 = "CASE {0} WHEN 'STD' THEN 15 WHEN 'RED' THEN 7 ELSE 15 END"
query("gen_country_tax", f"""
SELECT 'N10' AS country_code, y.country_name, y.currency_code, y.vat_scheme, pv.variant_id, pv.variant_sku, {d('p.list_price')} AS list_price,
  {d('ROUND(p.list_price * 15 * CAST(0.01 AS DECIMAL(4,2)), 2)')} AS tax_standard, {d('ROUND(p.list_price * 7 * CAST(0.01 AS DECIMAL(4,2)), 2)')} AS tax_reduced,
  {d('ROUND(p.list_price, 2)')} AS pos_price, {d('ROUND(p.list_price * CAST(0.94 AS DECIMAL(4,2)) * CAST(0.97 AS DECIMAL(4,2)), 2)')} AS web_bulk_price,
  CASE WHEN p.launch_date IS NULL THEN 'PIPELINE' ELSE 'LAUNCHED' END AS launch_state,
  CASE WHEN p.status IS NULL THEN 'UNKNOWN' WHEN p.status = 'ACTIVE' THEN 'SELLABLE' ELSE 'BLOCKED' END AS sell_state
FROM rt_product_variant pv JOIN rt_product p ON p.product_id = pv.product_id JOIN rt_country y ON y.country_code = 'N10' WHERE pv.is_active = 'Y'""")(
    lambda t: fam.country_tax(t, "N10", AS_OF, statutory(t), 0, 0))

query("gen_legacy_join", """
SELECT o.order_id, o.order_number, o.status AS order_status, c.customer_ref, c.last_name, sh.tracking_ref, sh.status AS shipment_status
FROM rt_sales_order o LEFT JOIN rt_customer c ON c.customer_id = o.customer_id LEFT JOIN rt_shipment sh ON sh.order_id = o.order_id AND sh.status = 'DELIVERED'""")(
    lambda t: fam.legacy_join(t, 0))

query("gen_kpi_channel", f"""
SELECT channel_code, n AS order_count, {d('v')} AS net_amount, CAST(v AS DOUBLE) / CAST(SUM(v) OVER () AS DOUBLE) AS revenue_share,
  CUME_DIST() OVER (ORDER BY v) AS cume_dist, NTILE(4) OVER (ORDER BY v DESC) AS revenue_quartile
FROM (SELECT channel_code, COUNT(*) AS n, SUM(subtotal_amount) AS v FROM rt_sales_order GROUP BY 1)""")(lambda t: fam.kpi(t, 0))

query("gen_kpi_contact", """
SELECT c.customer_id, c.customer_ref, COALESCE(c.first_name, '<unknown>') AS first_name, c.last_name, CASE WHEN c.email IS NULL THEN 'NO_EMAIL' ELSE 'CONTACTABLE' END AS contactability,
  CASE c.marketing_optin WHEN 'Y' THEN 'IN' WHEN 'N' THEN 'OUT' ELSE 'UNSET' END AS optin_state, COALESCE(la.points_balance, 0) AS points_balance, lt.tier_name
FROM rt_customer c LEFT JOIN rt_loyalty_account la ON la.customer_id = c.customer_id LEFT JOIN rt_loyalty_tier lt ON lt.tier_code = la.tier_code""")(lambda t: fam.kpi(t, 1))

query("gen_kpi_ledger", f"""
WITH tree AS (
  SELECT *, 1 AS lv, account_code AS top FROM rt_gl_account WHERE parent_account_code IS NULL
  UNION ALL
  SELECT a.*, t.lv + 1, t.top FROM tree t JOIN rt_gl_account a ON a.parent_account_code = t.account_code)
SELECT t.account_code, t.account_name, t.account_type, {i('t.lv')} AS coa_depth, t.top AS top_account, {d('SUM(COALESCE(l.debit_amount, 0) - COALESCE(l.credit_amount, 0))')} AS movement
FROM tree t LEFT JOIN rt_gl_journal_line l ON l.account_code = t.account_code GROUP BY 1, 2, 3, 4, 5""")(lambda t: fam.kpi(t, 2))

query("gen_kpi_store", f"""
SELECT s.store_id, s.store_code, CAST(s.opening_minutes * 60 AS DOUBLE) AS opening_offset, CAST(s.closing_minutes * 60 AS DOUBLE) AS closing_offset,
  CAST((s.closing_minutes - s.opening_minutes) * 60 AS DOUBLE) AS trading_window, {i('s.refit_months')} AS refit_cycle,
  CAST(CASE WHEN CAST(s.opened_date AS DATE) = LAST_DAY(s.opened_date) THEN LAST_DAY(s.opened_date + INTERVAL 1 MONTH * s.refit_months)
       ELSE CAST(s.opened_date + INTERVAL 1 MONTH * s.refit_months AS DATE) END AS TIMESTAMP) AS next_refit_due,
  a.m AS lead_time_days, CAST(COALESCE(a.m, 0) * 86400 AS DOUBLE) AS lead_time
FROM rt_store s LEFT JOIN (SELECT il.store_id, MAX(sp.lead_time_days) AS m FROM rt_inventory_location il JOIN rt_inventory_stock k ON k.location_id = il.location_id
  JOIN rt_supplier_product sp ON sp.variant_id = k.variant_id WHERE il.store_id IS NOT NULL GROUP BY 1) a ON a.store_id = s.store_id WHERE s.closed_date IS NULL""")(lambda t: fam.kpi(t, 3))

for _name, _system, _transport, _strict in (("src_interface_extract", "WMS", "FIXED_WIDTH", True), ("gen_interface_extract", "ECOM", "REST", False)):
    _cond = "a.line2 IS NOT NULL AND a.line2 <> '' AND a.postal_code IS NOT NULL" if _strict else f"o.order_ts >= {NOW} - INTERVAL 1 MONTH"
    query(_name, f"""
SELECT '{_system}' AS system_code, '{_transport}' AS transport, o.order_id, o.order_number, o.order_ts, o.channel_code, o.status, a.line1, NULLIF(a.line2, '') AS line2, a.city,
  a.postal_code, a.country_code, {d('o.subtotal_amount')} AS subtotal_amount, {d('o.tax_amount')} AS tax_amount
FROM rt_sales_order o LEFT JOIN rt_address a ON a.address_id = o.ship_address_id WHERE o.status IN ('PLACED', 'SHIPPED', 'DELIVERED') AND {_cond}""")(
        lambda t, s=_system, k=_strict: fam.interface_extract(t, s, k, AS_OF))

_FEEDS = ", ".join(f"('{code}', '{transport}', {k % 2 == 1})" for k, (code, transport, _, _) in enumerate(fam.SYSTEMS[:15]))
query("gen_interface_extracts", f"""
SELECT f.system_code, f.transport, o.order_id, o.order_number, o.order_ts, o.channel_code, o.status, a.line1, NULLIF(a.line2, '') AS line2, a.city,
  a.postal_code, a.country_code, {d('o.subtotal_amount')} AS subtotal_amount, {d('o.tax_amount')} AS tax_amount
FROM rt_sales_order o LEFT JOIN rt_address a ON a.address_id = o.ship_address_id JOIN (VALUES {_FEEDS}) f(system_code, transport, strict)
  ON CASE WHEN f.strict THEN a.line2 IS NOT NULL AND a.line2 <> '' AND a.postal_code IS NOT NULL ELSE o.order_ts >= {NOW} - INTERVAL 1 MONTH END
WHERE o.status IN ('PLACED', 'SHIPPED', 'DELIVERED')""")(lambda t: fam.interface_extracts(t, AS_OF))

# entity, its two keys, a text and a number, by which the rows of a feed are shown
_SHOWN = {
    "product": ("product_id", None, "sku", "list_price"), "purchase_order": ("po_id", "supplier_id", "po_number", "order_total"),
    "shipment": ("shipment_id", "order_id", "tracking_ref", None), "gl_journal": ("journal_id", "period_id", "journal_ref", None),
    "customer": ("customer_id", None, "email", None), "product_variant": ("variant_id", "product_id", "variant_sku", "pack_qty"),
    "gl_journal_line": ("journal_id", "line_no", "account_code", "debit_amount"), "order_payment": ("payment_id", "order_id", "payment_method", "amount"),
    "loyalty_account": ("loyalty_id", "customer_id", "card_number", "points_balance"), "promotion": ("promotion_id", None, "promo_code", "budget_amount"),
    "purchase_order_line": ("po_id", "line_no", "status", "unit_cost"), "sales_order_line": ("order_id", "line_no", "status", "unit_price"),
    "sales_order": ("order_id", "customer_id", "order_number", "subtotal_amount"), "price_list_item": ("price_list_id", "variant_id", "price_reason_code", "unit_price"),
    "coupon": ("coupon_id", "promotion_id", "coupon_code", "redemption_count"), "return_line": ("return_id", "line_no", "reason_code", "qty_returned"),
    "store": ("store_id", "region_id", "store_code", "selling_area_sqm"),
}


def feeds_read_back(t):
    """All outbound feeds written in their formats, and their rows as a reader finds them."""
    folder = os.path.join(shared_dir(t.spark), "feeds", uuid.uuid4().hex)
    sent, parts = feeds.write_feeds(t, folder), []
    for code, path in sent.items():
        transport, entity = feeds.outbound_entities()[code]
        shown = zip(("key_1", "key_2", "label", "amount"), _SHOWN[entity], ("bigint", "bigint", "string", "double"), strict=True)
        parts.append(feeds.read_feed(t.spark, path, transport, getattr(t, entity)).select(
            F.lit(code).alias("system_code"), F.lit(transport).alias("transport"), *[(F.lit(None) if c is None else F.col(c)).cast(kind).alias(n) for n, c, kind in shown]))
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


query("sink_interface_feeds", "\nUNION ALL ".join(
    f"SELECT '{code}' AS system_code, '{transport}' AS transport, CAST({_SHOWN[entity][0]} AS BIGINT) AS key_1, CAST({_SHOWN[entity][1] or 'NULL'} AS BIGINT) AS key_2, "
    f"NULLIF(CAST({_SHOWN[entity][2]} AS STRING), '') AS label, CAST({_SHOWN[entity][3] or 'NULL'} AS DOUBLE) AS amount FROM rt_{entity}"
    for code, (transport, entity) in feeds.outbound_entities().items()))(feeds_read_back)

query("gen_archive_window", f"""
SELECT CAST(1999 AS BIGINT) AS archive_year, o.order_id, l.line_no, o.order_ts, o.store_id, l.variant_id, o.currency_code, {d('l.qty')} AS qty, {d('l.unit_price')} AS unit_price,
  {d('l.discount_amount')} AS discount_amount, {d('l.tax_amount')} AS tax_amount, {d(NET + ' + l.tax_amount')} AS line_total, o.status
FROM rt_sales_order o JOIN rt_sales_order_line l ON l.order_id = o.order_id WHERE o.order_ts >= CAST('1999-01-01' AS TIMESTAMP) AND o.order_ts < CAST('2000-01-01' AS TIMESTAMP)""")(
    lambda t: fam.archive_window(t, 1999))
