"""Materialised aggregates and reports."""

from __future__ import annotations

from tillweave.catalog.registry import d, day, half_up, i, month, query
from tillweave.catalog.views import NET, NOW, hours
from tillweave.plans import mviews as m
from tillweave.plans import reports as r
from tillweave.sources.binding import AS_OF

TOTAL = "o.subtotal_amount - o.discount_amount + o.tax_amount + o.shipping_amount"

query("mv_sales_daily_store", f"""
SELECT o.store_id, {day('o.order_ts')} AS sales_date, o.currency_code, COUNT(*) AS line_count, {d('SUM(l.qty)')} AS total_qty,
  COUNT(l.qty) AS total_qty_cnt, {d('SUM(l.qty * l.unit_price)')} AS gross_amount, COUNT(l.qty * l.unit_price) AS gross_amount_cnt,
  {d('SUM(l.discount_amount)')} AS discount_amount, COUNT(l.discount_amount) AS discount_amount_cnt,
  {d('SUM(l.tax_amount)')} AS tax_amount, COUNT(l.tax_amount) AS tax_amount_cnt
FROM rt_sales_order o JOIN rt_sales_order_line l ON l.order_id = o.order_id GROUP BY 1, 2, 3""")(m.sales_daily_store)

query("mv_sales_monthly_category", f"""
SELECT {month('o.order_ts')} AS month_start, c.category_id, c.category_code, o.currency_code, o.channel_code, COUNT(*) AS line_count,
  {d('SUM(l.qty)')} AS total_qty, COUNT(l.qty) AS total_qty_cnt, {d(f'SUM({NET})')} AS net_amount, COUNT({NET}) AS net_amount_cnt,
  {d('SUM(l.tax_amount)')} AS tax_amount, COUNT(l.tax_amount) AS tax_amount_cnt
FROM rt_sales_order o JOIN rt_sales_order_line l ON l.order_id = o.order_id JOIN rt_product_variant pv ON pv.variant_id = l.variant_id
JOIN rt_product p ON p.product_id = pv.product_id JOIN rt_product_category c ON c.category_id = p.category_id GROUP BY 1, 2, 3, 4, 5""")(m.sales_monthly_category)

_LOW = "CASE WHEN reorder_point IS NOT NULL AND qty_on_hand < reorder_point + qty_reserved THEN 1 ELSE 0 END"
query("mv_stock_position", f"""
SELECT variant_id, COUNT(*) AS location_count, {d('SUM(qty_on_hand)')} AS qty_on_hand, COUNT(qty_on_hand) AS qty_on_hand_cnt,
  {d('SUM(qty_reserved)')} AS qty_reserved, COUNT(qty_reserved) AS qty_reserved_cnt, {i(f'SUM({_LOW})')} AS below_reorder_count,
  COUNT({_LOW}) AS below_reorder_cnt FROM rt_inventory_stock GROUP BY 1""")(m.stock_position)

query("mv_customer_rfm", f"""
WITH base AS (
  SELECT c.customer_id, c.customer_ref, c.home_country_code, c.preferred_store_id, COUNT(o.order_id) AS freq, MAX(o.order_ts) AS last_ts,
    COALESCE(SUM({TOTAL}), 0) AS money, MAX(CASE WHEN o.order_ts = z.mx THEN o.channel_code END) AS ch
  FROM rt_customer c LEFT JOIN rt_sales_order o ON o.customer_id = c.customer_id AND o.status IN ('PLACED', 'SHIPPED', 'DELIVERED')
  LEFT JOIN (SELECT customer_id, MAX(order_ts) AS mx FROM rt_sales_order WHERE status IN ('PLACED', 'SHIPPED', 'DELIVERED') GROUP BY 1) z ON z.customer_id = c.customer_id
  GROUP BY 1, 2, 3, 4), r AS (SELECT *, CAST({half_up(hours(NOW, 'last_ts'), '86400', 0)} AS BIGINT) AS rec FROM base)
SELECT customer_id, customer_ref, home_country_code, preferred_store_id, freq AS frequency_orders, last_ts AS last_order_ts, rec AS recency_days,
  {d('money')} AS monetary_amount, ch AS last_channel_code,
  NTILE(5) OVER (ORDER BY rec DESC NULLS LAST, customer_id) AS r_score, NTILE(5) OVER (ORDER BY freq NULLS FIRST, customer_id) AS f_score,
  NTILE(5) OVER (ORDER BY money NULLS FIRST, customer_id) AS m_score,
  CAST(money AS DOUBLE) / NULLIF(CAST(SUM(money) OVER (PARTITION BY home_country_code) AS DOUBLE), 0) AS country_value_share FROM r""")(
    lambda t: m.customer_rfm(t, AS_OF))

query("mv_supplier_performance", f"""
SELECT s.supplier_id, s.supplier_code, s.supplier_name, s.currency_code, COUNT(po.po_id) AS po_count, {d('COALESCE(SUM(po.order_total), 0)')} AS ordered_value,
  {half_up("SUM(DATE_DIFF('day', po.order_date, po.expected_date))", 'COUNT(po.expected_date)', 2)} AS avg_promised_days,
  COUNT(*) FILTER (po.status = 'RECEIVED') AS received_count, COUNT(*) FILTER (po.status = 'CANCELLED') AS cancelled_count,
  COUNT(*) FILTER (po.status = 'PART_RECV') AS partial_count,
  {half_up("100 * COUNT(*) FILTER (po.status = 'RECEIVED')", 'COUNT(po.po_id)', 2)} AS fill_rate_pct, {d('s.rating')} AS supplier_rating
FROM rt_supplier s LEFT JOIN rt_purchase_order po ON po.supplier_id = s.supplier_id
GROUP BY s.supplier_id, s.supplier_code, s.supplier_name, s.currency_code, s.rating""")(m.supplier_performance)

query("mv_promotion_uplift", f"""
SELECT pr.promotion_id, pr.promo_code, pr.promo_type, pr.country_code, pr.status AS promo_status, COUNT(*) AS order_count, COUNT(o.order_id) AS order_count_chk,
  {d('SUM(o.subtotal_amount)')} AS subtotal_amount, COUNT(o.subtotal_amount) AS subtotal_amount_cnt, {d('SUM(o.discount_amount)')} AS discount_amount,
  COUNT(o.discount_amount) AS discount_amount_cnt, {d('SUM(COALESCE(pr.budget_amount, 0) - COALESCE(pr.spent_amount, 0))')} AS budget_remaining,
  COUNT(*) AS budget_remaining_cnt
FROM rt_promotion pr JOIN rt_sales_order o ON o.promotion_id = pr.promotion_id GROUP BY 1, 2, 3, 4, 5""")(m.promotion_uplift)

_Y97 = "order_ts >= CAST('1997-01-01' AS TIMESTAMP) AND order_ts < CAST('1998-01-01' AS TIMESTAMP)"
query("rpt_busy_stores", f"""
SELECT store_id, COUNT(DISTINCT order_id) AS order_count FROM rt_sales_order WHERE {_Y97} GROUP BY 1 HAVING COUNT(DISTINCT order_id) >= 90""")(
    lambda t: r.busy_stores(t, "1997-01-01", "1997-12-31", 90))

query("rpt_store_day_summary", f"""
SELECT o.store_id, s.store_code, {day('o.order_ts')} AS sales_date, COUNT(DISTINCT o.order_id) AS order_count, {d('SUM(o.subtotal_amount)')} AS net_amount,
  RANK() OVER (PARTITION BY {day('o.order_ts')} ORDER BY SUM(o.subtotal_amount) DESC NULLS LAST) AS day_rank
FROM rt_sales_order o JOIN rt_store s ON s.store_id = o.store_id WHERE {_Y97} GROUP BY 1, 2, 3""")(
    lambda t: r.store_day_summary(t, "1997-01-01", "1997-12-31"))

query("rpt_sales_mix", f"""
WITH mix AS (SELECT o.store_id, s.store_code, o.channel_code, COUNT(*) AS n, SUM(o.subtotal_amount) AS net,
    FIRST(o.order_number ORDER BY o.order_ts DESC, o.order_number DESC) AS last_no
  FROM rt_sales_order o JOIN rt_store s ON s.store_id = o.store_id WHERE {_Y97} GROUP BY 1, 2, 3)
SELECT store_id, store_code, channel_code, n AS order_count, {d('net')} AS net_amount,
  CAST(net AS DOUBLE) / CAST(SUM(net) OVER () AS DOUBLE) AS share_of_total, last_no AS last_order_number,
  NTH_VALUE(store_code, 2) OVER (ORDER BY net DESC, store_code DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS runner_up_store FROM mix""")(
    lambda t: r.sales_mix(t, "1997-01-01", "1997-12-31"))

query("rpt_top_stores", f"""
SELECT RPAD(store_code, 14, ' ') AS store, UPPER(STRFTIME(dy, '%d-%b-%Y')) AS sales_day, LPAD(CAST(n AS STRING), 6, ' ') AS orders, FORMAT('{{:,.2f}}', CAST(v AS DOUBLE)) AS net
FROM (SELECT s.store_code, {day('o.order_ts')} AS dy, COUNT(*) AS n, SUM(o.subtotal_amount) AS v FROM rt_sales_order o JOIN rt_store s ON s.store_id = o.store_id
  WHERE o.order_ts >= CAST('2001-07-03' AS TIMESTAMP) AND o.order_ts < CAST('2001-08-03' AS TIMESTAMP) GROUP BY 1, 2 ORDER BY v DESC, 1, 2 LIMIT 10)""")(
    lambda t: r.top_stores(t, AS_OF))

query("rpt_order_line_counts", """
SELECT o.order_id, COUNT(*) AS line_count FROM rt_sales_order o JOIN rt_sales_order_line l ON l.order_id = o.order_id
WHERE o.store_id = 5 AND o.order_ts >= CAST('1996-01-01' AS TIMESTAMP) GROUP BY 1""")(lambda t: r.order_line_counts(t, 5, "1996-01-01"))

query("rpt_order_value", f"""
SELECT o.order_id, {d(f'COALESCE(SUM({NET} + l.tax_amount), 0)')} AS order_value FROM rt_sales_order o
LEFT JOIN rt_sales_order_line l ON l.order_id = o.order_id GROUP BY 1""")(r.order_value)

query("rpt_po_total", f"""
SELECT po.po_id, {d('COALESCE(SUM(l.qty_ordered * l.unit_cost), 0)')} AS po_total FROM rt_purchase_order po
LEFT JOIN rt_purchase_order_line l ON l.po_id = po.po_id AND COALESCE(l.status, 'OPEN') <> 'CANCELLED' GROUP BY 1""")(r.po_total)

query("rpt_available_qty", f"SELECT variant_id, {d('SUM(qty_on_hand - qty_reserved)')} AS available_qty FROM rt_inventory_stock GROUP BY 1")(r.available_qty)
query("rpt_available_qty_by_location", f"""
SELECT variant_id, location_id, {d('SUM(qty_on_hand - qty_reserved)')} AS available_qty FROM rt_inventory_stock GROUP BY 1, 2""")(
    lambda t: r.available_qty(t, by_location=True))

# ---- the business questions ------------------------------------------------------------------------

query("question_top_products", f"""
SELECT country_code, variant_id, {d('revenue')} AS revenue, rn FROM (
  SELECT g.country_code, l.variant_id, SUM({NET} + l.tax_amount) AS revenue,
    ROW_NUMBER() OVER (PARTITION BY g.country_code ORDER BY SUM({NET} + l.tax_amount) DESC, l.variant_id) AS rn
  FROM rt_sales_order o JOIN rt_sales_order_line l ON l.order_id = o.order_id JOIN rt_store s ON s.store_id = o.store_id
  JOIN rt_region g ON g.region_id = s.region_id
  WHERE o.order_ts >= CAST('2001-04-01' AS TIMESTAMP) AND o.order_ts < CAST('2001-07-01' AS TIMESTAMP) GROUP BY 1, 2) WHERE rn <= 20""")(
    lambda t: r.top_products_last_quarter(t, AS_OF))

query("question_lapsed_by_tier", """
SELECT la.tier_code, COUNT(*) AS lapsed FROM rt_loyalty_account la WHERE NOT EXISTS (
  SELECT 1 FROM rt_sales_order o WHERE o.customer_id = la.customer_id AND o.order_ts >= CAST('2000-08-02' AS TIMESTAMP)) GROUP BY 1""")(
    lambda t: r.lapsed_by_tier(t, AS_OF))

query("question_orders_with_payments", f"""
SELECT o.order_id, {d(TOTAL)} AS order_total, COALESCE(p.n, 0) AS payments, {d('COALESCE(p.c, 0)')} AS captured, {d('COALESCE(p.q, 0)')} AS pending
FROM rt_sales_order o LEFT JOIN (SELECT order_id, COUNT(*) AS n, SUM(amount) FILTER (status = 'CAPTURED') AS c, SUM(amount) FILTER (status <> 'CAPTURED') AS q
  FROM rt_order_payment GROUP BY 1) p ON p.order_id = o.order_id""")(r.orders_with_payments)

query("question_stock_at", f"""
SELECT location_id, variant_id, {d('SUM(q)')} AS net_qty FROM (
  SELECT to_location_id AS location_id, variant_id, ABS(qty) AS q, movement_ts FROM rt_inventory_movement
  UNION ALL SELECT from_location_id, variant_id, -ABS(qty), movement_ts FROM rt_inventory_movement)
WHERE location_id IS NOT NULL AND movement_ts < CAST('2000-01-02' AS TIMESTAMP) GROUP BY 1, 2""")(lambda t: r.stock_at(t, "2000-01-01"))

query("question_trading_hours", """
SELECT o.store_id, CAST(EXTRACT(HOUR FROM (o.order_ts AT TIME ZONE 'UTC') AT TIME ZONE y.tz_name) AS BIGINT) AS local_hour, COUNT(*) AS orders
FROM rt_sales_order o JOIN rt_store s ON s.store_id = o.store_id JOIN rt_region g ON g.region_id = s.region_id JOIN rt_country y ON y.country_code = g.country_code
GROUP BY 1, 2""")(r.trading_hours)
