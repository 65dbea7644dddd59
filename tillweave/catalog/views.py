"""Analytic views and hierarchy views, each with its checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillweave.catalog.registry import d, day, half_up, i, month, pct, query
from tillweave.operators import hierarchy as tree
from tillweave.plans import views as v
from tillweave.sources.binding import AS_OF

NOW = f"CAST('{AS_OF}' AS TIMESTAMP)"
EVENTS_NOW = "2024-01-31 00:00:00"
ENOW = f"CAST('{EVENTS_NOW}' AS TIMESTAMP)"
NET = "l.qty * l.unit_price - l.discount_amount"


def hours(a: str, b: str) -> str:
    """Whole seconds between two timestamps."""
    return f"(CAST(FLOOR(EPOCH({a})) AS BIGINT) - CAST(FLOOR(EPOCH({b})) AS BIGINT))"


query("v_sales_by_store_day", f"""
WITH daily AS (
  SELECT o.store_id, {day('o.order_ts')} AS sales_date, o.currency_code, COUNT(DISTINCT o.order_id) AS order_count,
         SUM(l.qty) AS units_sold, SUM({NET}) AS net_amount, SUM(l.tax_amount) AS tax_amount
  FROM rt_sales_order o JOIN rt_sales_order_line l ON l.order_id = o.order_id
  WHERE o.status IN ('PLACED', 'PICKING', 'SHIPPED', 'DELIVERED') GROUP BY ALL)
SELECT d.store_id, s.store_code, s.store_name, d.sales_date, d.currency_code, {i('d.order_count')} AS order_count,
  {d('d.units_sold')} AS units_sold, {d('d.net_amount')} AS net_amount, {d('d.tax_amount')} AS tax_amount,
  ROW_NUMBER() OVER st AS trading_day_seq,
  RANK() OVER (PARTITION BY d.sales_date ORDER BY d.net_amount DESC) AS day_rank_by_value,
  DENSE_RANK() OVER (PARTITION BY d.sales_date ORDER BY d.net_amount DESC) AS day_dense_rank,
  NTILE(4) OVER (PARTITION BY d.sales_date ORDER BY d.net_amount DESC, d.store_id) AS value_quartile,
  {d('LAG(d.net_amount) OVER st')} AS prev_day_amount, {d('LEAD(d.net_amount) OVER st')} AS next_day_amount,
  {d('d.net_amount - LAG(d.net_amount, 1, 0) OVER st')} AS day_on_day_delta,
  {d("SUM(d.net_amount) OVER (PARTITION BY d.store_id, DATE_TRUNC('month', d.sales_date) ORDER BY d.sales_date ROWS UNBOUNDED PRECEDING)")} AS mtd_amount,
  CAST(SUM(d.net_amount) OVER (PARTITION BY d.store_id ORDER BY d.sales_date ROWS 6 PRECEDING) AS DOUBLE)
    / COUNT(*) OVER (PARTITION BY d.store_id ORDER BY d.sales_date ROWS 6 PRECEDING) AS rolling_7d_avg,
  CAST(d.net_amount AS DOUBLE) / NULLIF(CAST(SUM(d.net_amount) OVER (PARTITION BY d.sales_date) AS DOUBLE), 0) AS share_of_day,
  FIRST_VALUE(d.sales_date) OVER (PARTITION BY d.store_id ORDER BY d.net_amount DESC, d.sales_date
     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best_day_date
FROM daily d JOIN rt_store s ON s.store_id = d.store_id
WINDOW st AS (PARTITION BY d.store_id ORDER BY d.sales_date)""")(v.sales_by_store_day)

query("v_product_price_rank", f"""
SELECT p.product_id, p.sku, p.product_name, p.category_id, c.category_name, {d('p.list_price')} AS list_price,
  {d('p.unit_cost')} AS unit_cost,
  {half_up('(p.list_price - p.unit_cost) * 100 * 10000', 'p.list_price * 10000', 2)} AS margin_pct,
  RANK() OVER dn AS price_rank, DENSE_RANK() OVER dn AS price_dense_rank,
  PERCENT_RANK() OVER up AS price_percentile, CUME_DIST() OVER up AS price_cume_dist,
  {d('MAX(p.list_price) OVER (PARTITION BY p.category_id)')} AS category_max_price,
  FIRST_VALUE(p.sku) OVER (PARTITION BY p.category_id ORDER BY p.list_price DESC, p.sku) AS priciest_sku,
  NTH_VALUE(p.sku, 2) OVER (PARTITION BY p.category_id ORDER BY p.list_price DESC, p.sku DESC
     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_priciest_sku
FROM rt_product p JOIN rt_product_category c ON c.category_id = p.category_id WHERE p.status = 'ACTIVE'
WINDOW dn AS (PARTITION BY p.category_id ORDER BY p.list_price DESC),
       up AS (PARTITION BY p.category_id ORDER BY p.list_price)""")(v.product_price_rank)

query("v_legacy_orders", f"""
SELECT c.customer_id, c.customer_ref, c.last_name, o.order_id, o.order_number, o.order_ts, o.status AS order_status,
  {d('o.subtotal_amount')} AS subtotal_amount, s.store_code, s.store_name, e.employee_number AS sales_rep_number,
  a.city AS bill_city, a.postal_code AS bill_postal_code, a.line2 AS bill_line2, y.country_name,
  {d('COALESCE(o.discount_amount, 0)')} AS discount_amount
FROM rt_customer c JOIN rt_country y ON y.country_code = c.home_country_code
LEFT JOIN rt_sales_order o ON o.customer_id = c.customer_id LEFT JOIN rt_store s ON s.store_id = o.store_id
LEFT JOIN rt_employee e ON e.employee_id = o.sales_employee_id
LEFT JOIN rt_address a ON a.address_id = c.primary_address_id AND a.country_code = 'N03'
WHERE NULLIF(a.line2, '') IS NOT NULL AND c.status <> 'ERASED'""")(lambda t: v.legacy_orders(t, "N03"))

query("v_legacy_customer_orders", """
SELECT c.customer_id, c.customer_ref, c.last_name, o.order_id, o.order_number, s.store_code, e.employee_number
FROM rt_customer c LEFT JOIN rt_sales_order o ON o.customer_id = c.customer_id
LEFT JOIN rt_store s ON s.store_id = o.store_id LEFT JOIN rt_employee e ON e.employee_id = o.sales_employee_id
WHERE c.home_country_code = 'N04'""")(lambda t: v.legacy_customer_orders(t, "N04"))

query("v_top_products_by_store", f"""
SELECT store_id, variant_id, variant_sku, product_name, {d('units_sold')} AS units_sold, {d('net_amount')} AS net_amount, rn
FROM (SELECT o.store_id, l.variant_id, pv.variant_sku, p.product_name, SUM(l.qty) AS units_sold, SUM({NET}) AS net_amount,
        ROW_NUMBER() OVER (PARTITION BY o.store_id ORDER BY SUM(l.qty) DESC NULLS LAST, l.variant_id) AS rn
      FROM rt_sales_order o JOIN rt_sales_order_line l ON l.order_id = o.order_id
      JOIN rt_product_variant pv ON pv.variant_id = l.variant_id JOIN rt_product p ON p.product_id = pv.product_id
      WHERE o.status IN ('PLACED', 'SHIPPED', 'DELIVERED')
      GROUP BY o.store_id, l.variant_id, pv.variant_sku, p.product_name) WHERE rn <= 10""")(v.top_products_by_store)

query("v_recent_orders_unsorted")(v.recent_orders_unsorted)

query("v_customer_360", f"""
SELECT c.customer_id, c.customer_ref, c.first_name, c.last_name, c.email, c.mobile_phone, c.birth_date,
  c.status AS customer_status, c.marketing_optin, c.created_ts, c.home_country_code, y.country_name, y.tz_name,
  c.primary_address_id, a.line1 AS address_line1, a.city AS address_city, a.postal_code AS address_postal_code,
  c.preferred_store_id, s.store_code AS preferred_store_code, s.store_name AS preferred_store_name, la.loyalty_id,
  la.card_number, la.tier_code, lt.tier_name, {d('lt.discount_pct')} AS tier_discount_pct, la.points_balance, la.lifetime_points,
  CASE WHEN c.mobile_phone IS NULL THEN 'NO_MOBILE' ELSE 'HAS_MOBILE' END AS mobile_flag,
  CASE c.marketing_optin WHEN 'Y' THEN 'OPTED_IN' WHEN 'N' THEN 'OPTED_OUT' ELSE 'UNKNOWN' END AS marketing_state,
  CASE WHEN c.gdpr_erasure_ts IS NULL THEN 'LIVE' ELSE 'ERASED' END AS gdpr_state,
  CASE WHEN la.loyalty_id IS NULL THEN 'GUEST' ELSE 'MEMBER' END AS loyalty_state,
  COALESCE(la.points_balance, 0) AS points_or_zero
FROM rt_customer c JOIN rt_country y ON y.country_code = c.home_country_code
LEFT JOIN rt_address a ON a.address_id = c.primary_address_id LEFT JOIN rt_store s ON s.store_id = c.preferred_store_id
LEFT JOIN rt_loyalty_account la ON la.customer_id = c.customer_id
LEFT JOIN rt_loyalty_tier lt ON lt.tier_code = la.tier_code""")(v.customer_360)

query("v_product_sellable", f"""
SELECT pv.variant_id, pv.variant_sku, pv.barcode_ean13, pv.size_code, pv.colour_code, pv.pack_qty, pv.is_active AS variant_active,
  p.product_id, p.sku, p.product_name, p.status AS product_status, {d('p.list_price')} AS list_price,
  {d('p.unit_cost')} AS unit_cost,
  {half_up('(p.list_price - p.unit_cost) * 100 * 10000', 'p.list_price * 10000', 2)} AS margin_pct,
  p.launch_date, p.category_id, c.category_code, c.category_name, p.brand_id, b.brand_code, b.brand_name, b.is_own_label,
  CASE WHEN p.status = 'ACTIVE' AND pv.is_active = 'Y' AND (p.launch_date IS NULL OR p.launch_date <= {NOW}) THEN 'Y' ELSE 'N' END AS is_sellable
FROM rt_product_variant pv JOIN rt_product p ON p.product_id = pv.product_id
JOIN rt_product_category c ON c.category_id = p.category_id LEFT JOIN rt_brand b ON b.brand_id = p.brand_id
""")(lambda t: v.product_sellable(t, AS_OF))

query("v_open_purchase_orders", f"""
SELECT po.po_id, po.po_number, po.supplier_id, s.supplier_code, s.supplier_name, po.warehouse_id, w.warehouse_code,
  po.order_date, po.expected_date, po.status, po.currency_code, {d('po.order_total')} AS order_total,
  po.approved_by_employee_id, e.employee_number AS approver_number,
  {i(f"DATE_DIFF('day', po.order_date, {NOW})")} AS age_days,
  CASE WHEN po.expected_date < {NOW} THEN 'OVERDUE' WHEN po.expected_date < {NOW} + INTERVAL 7 DAY THEN 'DUE_SOON' ELSE 'ON_TRACK' END AS delivery_flag,
  {i('(SELECT COUNT(*) FROM rt_purchase_order_line x WHERE x.po_id = po.po_id)')} AS line_count,
  {d('(SELECT COALESCE(SUM(x.qty_ordered - COALESCE(x.qty_received, 0)), 0) FROM rt_purchase_order_line x WHERE x.po_id = po.po_id)')} AS qty_outstanding
FROM rt_purchase_order po JOIN rt_supplier s ON s.supplier_id = po.supplier_id JOIN rt_warehouse w ON w.warehouse_id = po.warehouse_id
LEFT JOIN rt_employee e ON e.employee_id = po.approved_by_employee_id
WHERE po.status IN ('DRAFT', 'SENT', 'PART_RECV')""")(lambda t: v.open_purchase_orders(t, AS_OF))

_PIV = ", ".join(
    f"{d(f'SUM(subtotal_amount) FILTER (channel_code = {chr(39)}{c}{chr(39)})')} AS {n}_amt, "
    f"COUNT(*) FILTER (channel_code = '{c}') AS {n}_cnt" for c, n in v.CHANNELS.items())
query("v_sales_channel_pivot", f"""
SELECT store_id, {month('order_ts')} AS month_start, {_PIV} FROM rt_sales_order
WHERE status IN ('PLACED', 'SHIPPED', 'DELIVERED') GROUP BY store_id, {month('order_ts')}""")(v.sales_channel_pivot)

query("v_stock_position", f"""
SELECT k.location_id, il.location_code, il.location_type, il.warehouse_id, il.store_id, k.variant_id, pv.variant_sku,
  p.product_id, p.product_name, {d('k.qty_on_hand')} AS qty_on_hand, {d('k.qty_reserved')} AS qty_reserved,
  {d('k.qty_on_hand - k.qty_reserved')} AS qty_available, {d('k.reorder_point')} AS reorder_point, {d('k.reorder_qty')} AS reorder_qty,
  k.last_movement_ts,
  CASE WHEN k.reorder_point IS NULL THEN 'UNMANAGED' WHEN k.qty_on_hand - k.qty_reserved < k.reorder_point THEN 'BELOW' ELSE 'OK' END AS reorder_state,
  CASE SIGN(k.qty_on_hand - k.qty_reserved) WHEN -1 THEN 'NEGATIVE' WHEN 0 THEN 'EMPTY' WHEN 1 THEN 'IN_STOCK' ELSE 'UNKNOWN' END AS availability_band
FROM rt_inventory_stock k JOIN rt_inventory_location il ON il.location_id = k.location_id
JOIN rt_product_variant pv ON pv.variant_id = k.variant_id JOIN rt_product p ON p.product_id = pv.product_id""")(v.stock_position)

query("v_inventory_reorder", f"""
SELECT k.location_id, k.variant_id, il.warehouse_id, il.store_id, {d('k.qty_on_hand')} AS qty_on_hand,
  {d('k.qty_reserved')} AS qty_reserved, {d('k.qty_on_hand - k.qty_reserved')} AS qty_available,
  {d('k.reorder_point')} AS reorder_point, {d('COALESCE(k.reorder_qty, 0)')} AS reorder_qty,
  {d('GREATEST(COALESCE(k.reorder_qty, 0), k.reorder_point - (k.qty_on_hand - k.qty_reserved))')} AS suggested_qty,
  sp.supplier_id, sp.supplier_sku, {d('sp.unit_cost')} AS supplier_unit_cost, sp.lead_time_days, sp.min_order_qty
FROM rt_inventory_stock k JOIN rt_inventory_location il ON il.location_id = k.location_id
LEFT JOIN rt_supplier_product sp ON sp.variant_id = k.variant_id AND sp.is_primary_source = 'Y'
  AND (sp.valid_to IS NULL OR sp.valid_to >= {day(NOW)})
WHERE k.reorder_point IS NOT NULL AND k.qty_on_hand - k.qty_reserved < k.reorder_point""")(lambda t: v.inventory_reorder(t, AS_OF))

_PROMO = """
SELECT pr.promotion_id, pr.promo_code, pr.promo_name, pr.promo_type, pr.country_code, pr.status, pr.start_ts, pr.end_ts,
  {d1} AS budget_amount, {d2} AS spent_amount, {d3} AS budget_remaining,
  CASE WHEN {now} BETWEEN pr.start_ts AND pr.end_ts THEN 'LIVE' WHEN {now} < pr.start_ts THEN 'PENDING' ELSE 'ENDED' END AS live_state,
  COUNT(DISTINCT o.order_id) AS attributed_orders, {d4} AS attributed_subtotal, {d5} AS attributed_discount,
  {p} AS discount_rate_pct, COUNT(DISTINCT c.coupon_id) AS coupon_count, {i1} AS coupon_redemptions
FROM rt_promotion pr LEFT JOIN rt_sales_order o ON o.promotion_id = pr.promotion_id
LEFT JOIN rt_coupon c ON c.promotion_id = pr.promotion_id
GROUP BY pr.promotion_id, pr.promo_code, pr.promo_name, pr.promo_type, pr.country_code, pr.status, pr.start_ts, pr.end_ts,
  pr.budget_amount, pr.spent_amount"""
_PARTS = dict(now=NOW, d1=d("pr.budget_amount"), d2=d("pr.spent_amount"),
              d3=d("COALESCE(pr.budget_amount, 0) - COALESCE(pr.spent_amount, 0)"))
query("v_promotion_effectiveness", _PROMO.format(
    **_PARTS, d4=d("COALESCE(SUM(o.subtotal_amount), 0)"), d5=d("COALESCE(SUM(o.discount_amount), 0)"),
    p=pct("COALESCE(SUM(o.discount_amount), 0)", "COALESCE(SUM(o.subtotal_amount), 0)"),
    i1=i("COALESCE(SUM(c.redemption_count), 0)")))(lambda t: v.promotion_effectiveness(t, AS_OF))

query("v_promotion_effectiveness_plain", f"""
SELECT pr.promotion_id, pr.promo_code, COALESCE(o.n, 0) AS attributed_orders, {d('COALESCE(o.s, 0)')} AS attributed_subtotal,
  {d('COALESCE(o.x, 0)')} AS attributed_discount, {pct('COALESCE(o.x, 0)', 'COALESCE(o.s, 0)')} AS discount_rate_pct,
  COALESCE(c.n, 0) AS coupon_count, {i('COALESCE(c.r, 0)')} AS coupon_redemptions
FROM rt_promotion pr
LEFT JOIN (SELECT promotion_id, COUNT(*) AS n, SUM(subtotal_amount) AS s, SUM(discount_amount) AS x FROM rt_sales_order GROUP BY 1) o ON o.promotion_id = pr.promotion_id
LEFT JOIN (SELECT promotion_id, COUNT(*) AS n, SUM(redemption_count) AS r FROM rt_coupon GROUP BY 1) c ON c.promotion_id = pr.promotion_id
""")(lambda t: v.promotion_effectiveness(t, AS_OF, fan_out=False).select(
    "promotion_id", "promo_code", "attributed_orders", "attributed_subtotal", "attributed_discount", "discount_rate_pct",
    "coupon_count", "coupon_redemptions"))

query("v_customer_loyalty_summary", f"""
SELECT la.loyalty_id, la.customer_id, c.customer_ref, c.last_name, c.home_country_code, la.card_number, la.tier_code, lt.tier_name,
  lt.min_points, {d('lt.points_multiplier')} AS points_multiplier, la.points_balance, la.lifetime_points, la.enrolled_date,
  la.tier_reviewed_date, la.tier_reviewed_date + INTERVAL 1 MONTH * lt.review_months AS next_review_date, la.status AS account_status,
  {i("COALESCE((SELECT SUM(x.points_delta) FROM rt_loyalty_transaction x WHERE x.loyalty_id = la.loyalty_id AND x.txn_type = 'ACCRUE'), 0)")} AS points_accrued,
  {i("COALESCE((SELECT ABS(SUM(x.points_delta)) FROM rt_loyalty_transaction x WHERE x.loyalty_id = la.loyalty_id AND x.txn_type = 'REDEEM'), 0)")} AS points_redeemed,
  (SELECT MAX(x.txn_ts) FROM rt_loyalty_transaction x WHERE x.loyalty_id = la.loyalty_id) AS last_activity_ts
FROM rt_loyalty_account la JOIN rt_customer c ON c.customer_id = la.customer_id JOIN rt_loyalty_tier lt ON lt.tier_code = la.tier_code
""")(v.customer_loyalty_summary)

_CONTACT = """CONCAT(COALESCE(s.contact_name, '(unnamed contact)'),
  CASE WHEN s.contact_role IS NOT NULL THEN CONCAT(' (', s.contact_role, ')') ELSE '' END,
  CASE WHEN s.contact_email IS NOT NULL THEN CONCAT(' <', LOWER(s.contact_email), '>') ELSE '' END)"""
query("v_supplier_scorecard", f"""
SELECT s.supplier_id, s.supplier_code, s.supplier_name, s.currency_code, {i('s.payment_terms_days')} AS payment_terms_days,
  {d('s.rating')} AS rating, s.is_approved, CAST(s.lead_time_days * 86400 AS DOUBLE) AS lead_time, {_CONTACT} AS contact_label,
  s.contact_email, COALESCE(a.n, 0) AS po_count, {d('COALESCE(a.val, 0)')} AS ordered_value,
  COALESCE(a.rec, 0) AS received_count, COALESCE(a.can, 0) AS cancelled_count, {half_up('a.dd', 'a.dn', 2)} AS avg_promised_days,
  CASE s.is_approved WHEN 'Y' THEN 'APPROVED' WHEN 'N' THEN 'PENDING' ELSE 'UNKNOWN' END AS approval_state
FROM rt_supplier s LEFT JOIN (
  SELECT supplier_id, COUNT(DISTINCT po_id) AS n, SUM(order_total) AS val, COUNT(*) FILTER (status = 'RECEIVED') AS rec,
    COUNT(*) FILTER (status = 'CANCELLED') AS can, SUM(DATE_DIFF('day', order_date, expected_date)) AS dd, COUNT(expected_date) AS dn
  FROM rt_purchase_order GROUP BY supplier_id) a ON a.supplier_id = s.supplier_id""")(v.supplier_scorecard)

query("v_returns_analysis", f"""
SELECT rr.return_id, rr.rma_number, rr.order_id, rr.customer_id, rr.store_id, rr.status AS return_status, rr.requested_ts,
  {d('rr.refund_amount')} AS refund_amount, rl.line_no, rl.variant_id, {d('rl.qty_returned')} AS qty_returned, rl.disposition_code,
  rl.reason_code, rn.reason_desc, rn.reason_group, rn.is_restockable, o.order_ts,
  {half_up(hours('rr.requested_ts', 'o.order_ts'), '86400', 1)} AS days_to_return,
  RANK() OVER (PARTITION BY rl.reason_code ORDER BY rl.qty_returned DESC NULLS LAST) AS reason_volume_rank,
  {d('SUM(rl.qty_returned) OVER (PARTITION BY rl.variant_id)')} AS variant_total_returned
FROM rt_return_request rr JOIN rt_return_line rl ON rl.return_id = rr.return_id
JOIN rt_return_reason rn ON rn.reason_code = rl.reason_code JOIN rt_sales_order o ON o.order_id = rr.order_id""")(v.returns_analysis)

query("v_shipment_sla", f"""
SELECT sh.shipment_id, sh.order_id, sh.carrier_code, ca.carrier_name, sh.service_level, sh.tracking_ref, sh.status AS shipment_status,
  sh.shipped_ts, sh.delivered_ts, CAST({hours('sh.delivered_ts', 'sh.shipped_ts')} AS DOUBLE) AS transit_time,
  {i(hours('sh.delivered_ts', 'sh.shipped_ts') + ' // 86400')} AS transit_days,
  {i(hours('sh.delivered_ts', 'sh.shipped_ts') + ' % 86400 // 3600')} AS transit_hours, CAST(ca.cutoff_minutes * 60 AS DOUBLE) AS cutoff_offset,
  CASE WHEN sh.delivered_ts IS NULL THEN 'IN_TRANSIT' WHEN sh.delivered_ts <= sh.shipped_ts + INTERVAL 2 DAY THEN 'ON_TIME' ELSE 'LATE' END AS sla_state,
  {half_up(hours('sh.delivered_ts', 'sh.shipped_ts'), '86400', 2)} AS actual_days
FROM rt_shipment sh JOIN rt_carrier ca ON ca.carrier_code = sh.carrier_code""")(v.shipment_sla)

query("v_active_price_list_item", f"""
SELECT price_list_id, variant_id, effective_from, {d('unit_price')} AS unit_price, {d('was_price')} AS was_price, tax_rate_id,
  effective_to, price_reason_code FROM rt_price_list_item
WHERE effective_from <= {NOW} AND (effective_to IS NULL OR effective_to > {NOW})""")(lambda t: v.active_price_list_item(t, AS_OF))

query("v_gl_journal_balance", f"""
SELECT j.journal_id, j.journal_ref, j.source_module, j.journal_date, j.status AS journal_status, j.posted_ts, p.fiscal_year, p.period_no,
  p.status AS period_status, COUNT(l.line_no) AS line_count, {d('COALESCE(SUM(l.debit_amount), 0)')} AS total_debit,
  {d('COALESCE(SUM(l.credit_amount), 0)')} AS total_credit,
  {d('COALESCE(SUM(l.debit_amount), 0) - COALESCE(SUM(l.credit_amount), 0)')} AS out_of_balance,
  {d('COALESCE(SUM((l.debit_amount - l.credit_amount) * CAST(l.fx_rate AS DECIMAL(4,0))), 0)')} AS total_base_amount,
  CASE WHEN COALESCE(SUM(l.debit_amount), 0) = COALESCE(SUM(l.credit_amount), 0) THEN 'BALANCED' ELSE 'UNBALANCED' END AS balance_state
FROM rt_gl_journal j JOIN rt_gl_period p ON p.period_id = j.period_id LEFT JOIN rt_gl_journal_line l ON l.journal_id = j.journal_id
GROUP BY j.journal_id, j.journal_ref, j.source_module, j.journal_date, j.status, j.posted_ts, p.fiscal_year, p.period_no, p.status
""")(v.gl_journal_balance)

query("v_store_estate", f"""
SELECT s.store_id, s.store_code, s.store_name, s.store_format, s.region_id, r.region_code, r.region_name, r.country_code,
  y.country_name, y.tz_name, s.address_id, a.city, a.postal_code, s.opened_date, s.closed_date, {d('s.selling_area_sqm')} AS selling_area_sqm,
  CAST(s.opening_minutes * 60 AS DOUBLE) AS opening_offset, CAST(s.closing_minutes * 60 AS DOUBLE) AS closing_offset,
  CAST((s.closing_minutes - s.opening_minutes) * 60 AS DOUBLE) AS trading_window, {i('s.refit_months')} AS refit_cycle,
  s.opened_date + INTERVAL 1 MONTH * s.refit_months AS next_refit_due, s.manager_employee_id,
  CASE WHEN e.employee_id IS NOT NULL THEN CONCAT(e.first_name, ' ', e.last_name) END AS manager_name,
  CASE WHEN s.closed_date IS NULL THEN 'TRADING' ELSE 'CLOSED' END AS trading_state,
  CASE WHEN s.store_format IN ('HYPER', 'SUPER') THEN 'LARGE' WHEN s.store_format IN ('EXPRESS', 'OUTLET') THEN 'SMALL'
    WHEN s.store_format = 'ONLINE' THEN 'VIRTUAL' ELSE 'OTHER' END AS format_band,
  {half_up('s.selling_area_sqm * 100', '10000', 1)} AS area_units, {d('COALESCE(s.selling_area_sqm, 0)')} AS area_or_zero
FROM rt_store s JOIN rt_region r ON r.region_id = s.region_id JOIN rt_country y ON y.country_code = r.country_code
JOIN rt_address a ON a.address_id = s.address_id LEFT JOIN rt_employee e ON e.employee_id = s.manager_employee_id""")(v.store_estate)

query("v_fx_latest_rates", f"""
SELECT a.currency_code AS from_currency, b.currency_code AS to_currency,
  {d('(SELECT MAX(rate) FROM rt_exchange_rate e WHERE e.from_currency = a.currency_code AND e.to_currency = b.currency_code AND e.rate_date = (SELECT MAX(rate_date) FROM rt_exchange_rate f WHERE f.from_currency = a.currency_code AND f.to_currency = b.currency_code))')} AS latest_rate,
  (SELECT MAX(rate_date) FROM rt_exchange_rate e WHERE e.from_currency = a.currency_code AND e.to_currency = b.currency_code) AS latest_rate_date,
  {i('a.minor_units')} AS from_minor_units, {i('b.minor_units')} AS to_minor_units
FROM rt_currency a, rt_currency b WHERE a.currency_code <> b.currency_code AND a.is_active = 'Y' AND b.is_active = 'Y'""")(v.fx_latest_rates)

query("v_order_fulfilment_status", f"""
SELECT o.order_id, o.order_number, o.order_ts, o.store_id, o.channel_code, o.status AS order_status, o.currency_code,
  {d('o.subtotal_amount - o.discount_amount + o.tax_amount + o.shipping_amount')} AS order_total, COUNT(l.line_no) AS line_count,
  {d('COALESCE(SUM(l.qty), 0)')} AS qty_ordered, {d('COALESCE(SUM(x.qs), 0)')} AS qty_shipped,
  {d('COALESCE(SUM(l.qty), 0) - COALESCE(SUM(x.qs), 0)')} AS qty_outstanding,
  CASE WHEN COALESCE(SUM(x.qs), 0) = 0 THEN 'UNSHIPPED' WHEN COALESCE(SUM(x.qs), 0) < COALESCE(SUM(l.qty), 0) THEN 'PARTIAL' ELSE 'COMPLETE' END AS fulfilment_state,
  {d("(SELECT COALESCE(SUM(p.amount), 0) FROM rt_order_payment p WHERE p.order_id = o.order_id AND p.status = 'CAPTURED')")} AS amount_captured
FROM rt_sales_order o LEFT JOIN rt_sales_order_line l ON l.order_id = o.order_id
LEFT JOIN (SELECT order_id, order_line_no, SUM(qty_shipped) AS qs FROM rt_shipment_line GROUP BY 1, 2) x
  ON x.order_id = l.order_id AND x.order_line_no = l.line_no
GROUP BY o.order_id, o.order_number, o.order_ts, o.store_id, o.channel_code, o.status, o.currency_code,
  o.subtotal_amount, o.discount_amount, o.tax_amount, o.shipping_amount""")(v.order_fulfilment_status)

query("v_data_quality_open", f"""
SELECT issue_id, rule_code, entity_name, entity_key, severity, detail, detected_ts,
  {i("CASE severity WHEN 'FATAL' THEN 1 WHEN 'ERROR' THEN 2 WHEN 'WARN' THEN 3 WHEN 'INFO' THEN 4 ELSE 9 END")} AS severity_order,
  COUNT(*) OVER (PARTITION BY rule_code) AS rule_hit_count, DENSE_RANK() OVER (ORDER BY rule_code) AS rule_seq,
  {half_up(hours(ENOW, 'detected_ts'), '86400', 2)} AS age_days
FROM rt_data_quality_issue WHERE resolved_ts IS NULL""")(lambda t: v.data_quality_open(t, EVENTS_NOW))

query("v_audit_recent", f"""
SELECT audit_id, table_name, pk_value, action_type,
  CASE action_type WHEN 'I' THEN 'INSERT' WHEN 'U' THEN 'UPDATE' WHEN 'D' THEN 'DELETE' ELSE 'OTHER' END AS action_label, changed_by,
  changed_ts, SUBSTR(old_row, 1, 400) AS old_row_head, SUBSTR(new_row, 1, 400) AS new_row_head,
  {i('COALESCE(LENGTH(old_row), 0)')} AS old_row_bytes, {i('COALESCE(LENGTH(new_row), 0)')} AS new_row_bytes,
  ROW_NUMBER() OVER (PARTITION BY table_name ORDER BY changed_ts DESC, audit_id) AS recency_seq
FROM rt_audit_log WHERE changed_ts > {ENOW} - INTERVAL 10 DAY""")(lambda t: v.audit_recent(t, EVENTS_NOW, 10))

# ---- hierarchies ---------------------------------------------------------------------------------

query("hier_category_tree", f"""
WITH tree AS (
  SELECT *, 1 AS lv, CONCAT(' > ', category_name) AS p1, CONCAT('/', category_code) AS p2, category_code AS rc, category_name AS rn
  FROM rt_product_category WHERE parent_category_id IS NULL
  UNION ALL
  SELECT c.*, t.lv + 1, CONCAT(t.p1, ' > ', c.category_name), CONCAT(t.p2, '/', c.category_code), t.rc, t.rn
  FROM tree t JOIN rt_product_category c ON c.parent_category_id = t.category_id)
SELECT category_id, category_code, category_name, parent_category_id, {i('lv')} AS tree_depth, p1 AS category_path, p2 AS code_path,
  rc AS root_category_code, rn AS root_category_name,
  {i('CASE WHEN category_id IN (SELECT parent_category_id FROM rt_product_category WHERE parent_category_id IS NOT NULL) THEN 0 ELSE 1 END')} AS is_leaf_node,
  CONCAT(REPEAT(' ', CAST((lv - 1) * 2 AS BIGINT)), category_name) AS indented_name, sort_order FROM tree""")(
    lambda t: v.category_tree(t).drop("sort_path"))

query("sort_siblings", """
WITH tree AS (
  SELECT category_id, [LPAD(CAST(sort_order AS STRING), 9, '0') || category_code] AS sp
  FROM rt_product_category WHERE parent_category_id IS NULL
  UNION ALL
  SELECT c.category_id, LIST_APPEND(t.sp, LPAD(CAST(c.sort_order AS STRING), 9, '0') || c.category_code)
  FROM tree t JOIN rt_product_category c ON c.parent_category_id = t.category_id)
SELECT category_id, ROW_NUMBER() OVER (ORDER BY sp) AS seq FROM tree""")(
    lambda t: __import__("tillweave.operators.positions", fromlist=["number_rows"]).number_rows(
        v.category_tree(t).select("category_id", "sort_path"), [F.col("sort_path").asc_nulls_last()], "seq").drop("sort_path"))

query("hier_employee_line", """
WITH tree AS (
  SELECT *, 1 AS lv, employee_id AS top, CONCAT(first_name, ' ', last_name) AS topn, CONCAT('/', employee_number) AS p1,
    CONCAT(' <- ', last_name) AS p2, CAST(NULL AS STRING) AS prior FROM rt_employee WHERE manager_id IS NULL
  UNION ALL
  SELECT e.*, t.lv + 1, t.top, t.topn, CONCAT(t.p1, '/', e.employee_number), CONCAT(t.p2, ' <- ', e.last_name), t.employee_number
  FROM tree t JOIN rt_employee e ON e.manager_id = t.employee_id)
SELECT employee_id, employee_number, CONCAT(first_name, ' ', last_name) AS full_name, job_title, manager_id, store_id,
  CASE WHEN termination_date IS NULL THEN 'Y' ELSE 'N' END AS is_active, CAST(lv AS BIGINT) AS reporting_depth, top AS top_manager_id,
  topn AS top_manager_name, p1 AS chain_path, p2 AS chain_names,
  CAST(CASE WHEN employee_id IN (SELECT manager_id FROM rt_employee WHERE manager_id IS NOT NULL) THEN 0 ELSE 1 END AS BIGINT) AS is_individual_contributor,
  prior AS direct_manager_number FROM tree""")(v.employee_line)

query("hier_region", """
WITH tree AS (
  SELECT *, 1 AS lv, region_code AS rc, CONCAT('.', region_code) AS p FROM rt_region WHERE parent_region_id IS NULL
  UNION ALL
  SELECT r.*, t.lv + 1, t.rc, CONCAT(t.p, '.', r.region_code) FROM tree t JOIN rt_region r ON r.parent_region_id = t.region_id)
SELECT region_id, region_code, region_name, region_level, country_code, parent_region_id, CAST(lv AS BIGINT) AS depth,
  rc AS root_region_code, p AS region_path FROM tree WHERE region_level <> 'RETIRED'""")(v.region_tree)

query("hier_gl_climb", f"""
WITH climb AS (
  SELECT *, 1 AS lv, account_code AS leaf, CONCAT('|', account_code) AS p FROM rt_gl_account WHERE is_postable = 'Y'
  UNION ALL
  SELECT a.*, c.lv + 1, c.leaf, CONCAT(c.p, '|', a.account_code) FROM climb c JOIN rt_gl_account a ON a.account_code = c.parent_account_code)
SELECT c.account_code, c.account_name, c.account_type, c.normal_balance, c.parent_account_code, {i('c.lv')} AS climb_level,
  c.leaf AS leaf_account_code, c.p AS rollup_path, {d('COALESCE(s.dr, 0)')} AS debit_total, {d('COALESCE(s.cr, 0)')} AS credit_total
FROM climb c LEFT JOIN (SELECT account_code, SUM(debit_amount) AS dr, SUM(credit_amount) AS cr FROM rt_gl_journal_line GROUP BY 1) s
  ON s.account_code = c.account_code""")(v.gl_climb)

query("hier_subtree", """
WITH tree AS (
  SELECT *, 1 AS lv, CONCAT('/', category_code) AS p FROM rt_product_category WHERE category_id = 13
  UNION ALL
  SELECT c.*, t.lv + 1, CONCAT(t.p, '/', c.category_code) FROM tree t JOIN rt_product_category c ON c.parent_category_id = t.category_id)
SELECT category_id, category_code, category_name, CAST(lv AS BIGINT) AS depth, p AS path, 'MEDIUM' AS root_code,
  CAST(CASE WHEN category_id IN (SELECT parent_category_id FROM rt_product_category WHERE parent_category_id IS NOT NULL) THEN 0 ELSE 1 END AS BIGINT) AS is_leaf,
  (SELECT COUNT(*) FROM rt_product p WHERE p.category_id = tree.category_id) AS product_count FROM tree""")(lambda t: v.subtree(t, 13))

query("hier_rollup_movement", f"""
WITH tree AS (
  SELECT *, 1 AS lv, account_code AS top FROM rt_gl_account WHERE parent_account_code IS NULL
  UNION ALL
  SELECT a.*, t.lv + 1, t.top FROM tree t JOIN rt_gl_account a ON a.parent_account_code = t.account_code)
SELECT t.account_code, t.account_name, t.account_type, {i('t.lv')} AS coa_depth, t.top AS top_account,
  {d('SUM(COALESCE(l.debit_amount, 0) - COALESCE(l.credit_amount, 0))')} AS movement
FROM tree t LEFT JOIN rt_gl_journal_line l ON l.account_code = t.account_code GROUP BY 1, 2, 3, 4, 5""")(v.rollup_movement)

query("hier_path_all", """
WITH tree AS (
  SELECT category_id, category_name AS p FROM rt_product_category WHERE parent_category_id IS NULL
  UNION ALL
  SELECT c.category_id, CONCAT(t.p, ' | ', c.category_name) FROM tree t JOIN rt_product_category c ON c.parent_category_id = t.category_id)
SELECT category_id, CASE WHEN COUNT(*) > 1 THEN '(ambiguous)' ELSE MIN(p) END AS path FROM tree GROUP BY 1""")(
    lambda t: tree.path_all(t.product_category, "category_id", "parent_category_id", "category_name", " | "))

query("hier_depth_all", """
WITH climb AS (
  SELECT location_id AS o, location_id, parent_location_id, 1 AS lv FROM rt_inventory_location
  UNION ALL
  SELECT c.o, l.location_id, l.parent_location_id, c.lv + 1 FROM climb c JOIN rt_inventory_location l ON l.location_id = c.parent_location_id)
SELECT s.location_id, s.variant_id, CAST(COALESCE(x.depth, 0) AS BIGINT) AS depth
FROM rt_inventory_stock s LEFT JOIN (SELECT o, MAX(lv) AS depth FROM climb GROUP BY 1) x ON x.o = s.location_id""")(
    lambda t: t.inventory_stock.select("location_id", "variant_id").join(
        tree.depth_all(t.inventory_location, "location_id", "parent_location_id"), "location_id", "left")
    .withColumn("depth", F.coalesce("depth", F.lit(0))))

query("hier_category_depth", """
WITH climb AS (
  SELECT category_id AS o, category_id, parent_category_id, 1 AS lv FROM rt_product_category
  UNION ALL
  SELECT c.o, l.category_id, l.parent_category_id, c.lv + 1 FROM climb c JOIN rt_product_category l ON l.category_id = c.parent_category_id)
SELECT o AS category_id, CAST(MAX(lv) AS BIGINT) AS depth FROM climb GROUP BY 1""")(
    lambda t: tree.depth_all(t.product_category, "category_id", "parent_category_id"))

query("hier_manager_chain", """
WITH climb AS (
  SELECT employee_id AS o, manager_id, employee_number AS p, 1 AS lv FROM rt_employee
  UNION ALL
  SELECT c.o, e.manager_id, CONCAT(c.p, ' <- ', e.employee_number), c.lv + 1
  FROM climb c JOIN rt_employee e ON e.employee_id = c.manager_id WHERE c.lv <= 20)
SELECT o AS employee_id, MAX(CASE WHEN manager_id IS NULL THEN p END) AS manager_chain FROM climb GROUP BY 1""")(v.manager_chain)

query("hier_leaves", """
WITH tree AS (
  SELECT category_id FROM rt_product_category WHERE category_id = 14
  UNION ALL
  SELECT c.category_id FROM tree t JOIN rt_product_category c ON c.parent_category_id = t.category_id)
SELECT category_id FROM tree WHERE category_id NOT IN (SELECT parent_category_id FROM rt_product_category WHERE parent_category_id IS NOT NULL)""")(
    lambda t: tree.leaves(t.product_category, "category_id", "parent_category_id", 14))

query("hier_rebuild_levels", """
WITH tree AS (
  SELECT category_id, 1 AS lv FROM rt_product_category WHERE parent_category_id IS NULL
  UNION ALL
  SELECT c.category_id, t.lv + 1 FROM tree t JOIN rt_product_category c ON c.parent_category_id = t.category_id WHERE t.lv < 3)
SELECT c.category_id, c.category_code, CAST(t.lv AS BIGINT) AS merch_level,
  CASE WHEN c.category_id IN (SELECT parent_category_id FROM rt_product_category WHERE parent_category_id IS NOT NULL) THEN 'N' ELSE 'Y' END AS is_leaf
FROM rt_product_category c LEFT JOIN tree t ON t.category_id = c.category_id""")(
    lambda t: v.rebuild_levels(t.product_category, 3).select("category_id", "category_code", "merch_level", "is_leaf"))

query("hier_ancestor_path_rule", """
WITH climb AS (
  SELECT category_id AS o, parent_category_id, CONCAT('>', category_code) AS p FROM rt_product_category
  UNION ALL
  SELECT c.o, a.parent_category_id, CONCAT(c.p, '>', a.category_code) FROM climb c JOIN rt_product_category a ON a.category_id = c.parent_category_id)
SELECT pv.variant_id, SUBSTR(MAX(c.p), 1, 30) AS category_path
FROM rt_product_variant pv JOIN rt_product p ON p.product_id = pv.product_id JOIN climb c ON c.o = p.category_id GROUP BY 1""")(
    lambda t: v.ancestor_path(t, 30))

# managers rewired so that some employees form rings and others lose their manager
_RING = """WITH emp AS (
  SELECT employee_id, CASE WHEN employee_id % 100 = 3 THEN employee_id * 8 + 1 ELSE manager_id END AS manager_id FROM rt_employee),
tree AS (
  SELECT employee_id FROM emp WHERE manager_id IS NULL
  UNION ALL
  SELECT e.employee_id FROM tree t JOIN emp e ON e.manager_id = t.employee_id)"""


def _ring(t):
    return t.employee.select("employee_id", F.when(F.col("employee_id") % 100 == 3, F.col("employee_id") * 8 + 1)
                             .otherwise(F.col("manager_id")).alias("manager_id"))


query("hier_cycle_check", _RING + """
SELECT COUNT(*) AS nodes, COUNT(*) FILTER (manager_id IS NULL) AS roots, COUNT(*) FILTER (manager_id = employee_id) AS self_parents,
  COUNT(*) FILTER (manager_id IS NOT NULL AND manager_id NOT IN (SELECT employee_id FROM emp)) AS dangling,
  (SELECT COUNT(DISTINCT employee_id) FROM tree) AS reached,
  COUNT(*) - (SELECT COUNT(DISTINCT employee_id) FROM tree) AS unreached FROM emp""")(
    lambda t: tree.cycle_report(_ring(t), "employee_id", "manager_id"))

query("hier_cycle_members", _RING + """, climb AS (
  SELECT employee_id AS o, manager_id, 1 AS lv FROM emp
  UNION ALL
  SELECT c.o, e.manager_id, c.lv + 1 FROM climb c JOIN emp e ON e.employee_id = c.manager_id WHERE c.lv < 12 AND c.manager_id <> c.o)
SELECT DISTINCT o AS employee_id FROM climb WHERE manager_id = o""")(lambda t: tree.on_ring(_ring(t), "employee_id", "manager_id"))

# the same operators under the names of the join inventory
from tillweave.catalog.registry import ORACLES, QUERIES  # noqa: E402

for _alias, _name in (("join_recursive", "hier_employee_line"), ("join_legacy_outer", "v_legacy_orders")):
    QUERIES[_alias], ORACLES[_alias] = QUERIES[_name], ORACLES[_name]
