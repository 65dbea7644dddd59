"""Data quality jobs with their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillweave.catalog.registry import query
from tillweave.catalog.views import NOW
from tillweave.functions import rules as r
from tillweave.functions.rules import CHECKS, REFERENCES
from tillweave.plans import quality as q
from tillweave.sources.binding import AS_OF

c = F.col
_KEYS = {
    "sales_order": ("order_id",), "sales_order_line": ("order_id", "line_no"), "customer": ("customer_id",), "supplier": ("supplier_id",),
    "inventory_movement": ("movement_id",), "inventory_stock": ("location_id", "variant_id"), "product_variant": ("variant_id",),
    "goods_receipt": ("receipt_id",), "data_quality_issue": ("issue_id",), "audit_log": ("audit_id",), "coupon": ("coupon_id",),
    "gl_journal_line": ("journal_id", "line_no"), "region": ("region_id",), "store": ("store_id",), "price_list_item": ("price_list_id", "variant_id"),
    "purchase_order_line": ("po_id", "line_no"), "loyalty_account": ("loyalty_id",), "currency": ("currency_code",),
    "exchange_rate": ("from_currency", "to_currency", "rate"), "tax_rate": ("tax_rate_id",), "employee": ("employee_id",), "product": ("product_id",),
    "purchase_order": ("po_id",), "inventory_location": ("location_id",), "loyalty_transaction": ("loyalty_txn_id",), "promotion": ("promotion_id",),
    "order_payment": ("payment_id",), "shipment_line": ("shipment_id", "line_no"), "return_request": ("return_id",), "return_line": ("return_id", "line_no"),
    "gl_account": ("account_code",), "gl_period": ("period_id",), "gl_journal": ("journal_id",),
}


def _rule_sql(table: str) -> str:
    key = " || '/' || ".join(f"CAST({k} AS STRING)" for k in _KEYS[table])
    return " UNION ALL ".join(
        f"SELECT '{name}' AS rule_code, '{table}' AS entity_name, {key} AS entity_key FROM rt_{table} WHERE NOT ({expr.replace('RLIKE', 'SIMILAR TO').replace('^[0-9]{13}$', '[0-9]{13}')})"
        for name, expr in CHECKS[table].items() if (table, name) not in q.UNBOUND_RULES)


query("dq_check_constraints", " UNION ALL ".join(_rule_sql(t) for t in _KEYS))(
    lambda t: q.check_constraints(t, {n: F.concat_ws("/", *k) for n, k in _KEYS.items()}).select("rule_code", "entity_name", "entity_key"))

_EAN = "+".join(f"CAST(SUBSTR(barcode_ean13, {k}, 1) AS BIGINT) * {3 if k % 2 == 0 else 1}" for k in range(1, 13))
query("dq_validators", f"""
SELECT 'EAN13' AS rule_code, CAST(variant_id AS STRING) AS entity_key FROM rt_product_variant WHERE (10 - ({_EAN}) % 10) % 10 <> CAST(SUBSTR(barcode_ean13, 13, 1) AS BIGINT)
UNION ALL SELECT 'SIZE_CODE', CAST(variant_id AS STRING) FROM rt_product_variant WHERE LENGTH(size_code) < 3
UNION ALL SELECT 'COLOUR', CAST(variant_id AS STRING) FROM rt_product_variant WHERE TRIM(colour_code) = '' OR STRLEN(colour_code) > 8
UNION ALL SELECT 'PACK', CAST(variant_id AS STRING) FROM rt_product_variant WHERE pack_qty > 5
UNION ALL SELECT 'FLAG', CAST(variant_id AS STRING) FROM rt_product_variant WHERE is_active <> 'Y'""")(
    lambda t: q.run_validators(t.product_variant, "product_variant", c("variant_id"), {
        "EAN13": r.valid_ean13("barcode_ean13"), "SIZE_CODE": r.valid_code("size_code", 3), "COLOUR": r.valid_text("colour_code", 8),
        "PACK": r.valid_qty("pack_qty", 5), "FLAG": r.valid_member("is_active", ("Y",))}).select("rule_code", "entity_key"))

query("dq_validators_orders", """
SELECT 'AMOUNT' AS rule_code, CAST(order_id AS STRING) AS entity_key FROM rt_sales_order WHERE subtotal_amount > 100000
UNION ALL SELECT 'CHANNEL', CAST(order_id AS STRING) FROM rt_sales_order WHERE channel_code NOT IN ('POS', 'WEB')
UNION ALL SELECT 'WINDOW', CAST(order_id AS STRING) FROM rt_sales_order WHERE order_ts < CAST('1996-01-01' AS TIMESTAMP) OR order_ts >= CAST('1999-01-01' AS TIMESTAMP)
UNION ALL SELECT 'RATIO', CAST(order_id AS STRING) FROM rt_sales_order WHERE discount_amount <> 0 AND subtotal_amount > discount_amount * 9
UNION ALL SELECT 'PCT', CAST(order_id AS STRING) FROM rt_sales_order WHERE shipping_amount NOT BETWEEN 0 AND 100
UNION ALL SELECT 'ISO2', CAST(order_id AS STRING) FROM rt_sales_order WHERE currency_code NOT IN ('GBP', 'USD')""")(
    lambda t: q.run_validators(t.sales_order, "sales_order", c("order_id"), {
        "AMOUNT": r.valid_amount("subtotal_amount", 100_000), "CHANNEL": r.valid_member("channel_code", ("POS", "WEB")), "WINDOW": r.valid_window("order_ts", 1997),
        "RATIO": r.valid_ratio("subtotal_amount", "discount_amount", 9), "PCT": r.valid_pct("shipping_amount"), "ISO2": r.valid_country("currency_code", ("GBP", "USD"))})
    .select("rule_code", "entity_key"))

query("dq_validators_lookup", f"""
WITH o AS (SELECT o.order_id, o.order_ts, o.currency_code, g.country_code FROM rt_sales_order o JOIN rt_store s ON s.store_id = o.store_id JOIN rt_region g ON g.region_id = s.region_id)
SELECT 'CURRENCY_ACTIVE' AS rule_code, CAST(order_id AS STRING) AS entity_key FROM o WHERE NOT EXISTS (SELECT 1 FROM rt_currency y WHERE y.currency_code = o.currency_code AND y.is_active = 'Y')
UNION ALL SELECT 'TAX_RATE_KNOWN', CAST(order_id AS STRING) FROM o WHERE NOT EXISTS (SELECT 1 FROM rt_tax_rate x WHERE x.country_code = o.country_code AND x.valid_from <= o.order_ts AND (x.valid_to IS NULL OR x.valid_to > o.order_ts))""")(
    lambda t: q.run_lookup_rules(
        t.sales_order.select("order_id", "order_ts", c("currency_code").alias("ccy"), "store_id").join(t.store.select("store_id", "region_id"), "store_id")
        .join(t.region.select("region_id", c("country_code").alias("ctry")), "region_id"), t, "sales_order", c("order_id"), AS_OF, "ccy", "ctry", "order_ts").select("rule_code", "entity_key"))
query("dq_validity", f"SELECT 'VALID_UNTIL' AS rule_code, supplier_sku AS entity_key FROM rt_supplier_product WHERE valid_to < CAST(CAST({NOW} AS DATE) AS TIMESTAMP)")(
    lambda t: q.run_lookup_rules(t.supplier_product, t, "supplier_product", c("supplier_sku"), AS_OF, valid_to="valid_to").select("rule_code", "entity_key"))

_PAIRS = tuple(p for p in REFERENCES if p[0] not in ("promotion_product",))
query("dq_orphans", " UNION ALL ".join(
    f"SELECT '{ch}' AS child, '{pa}' AS parent, '{fk}' AS foreign_key, COUNT(*) AS orphans FROM rt_{ch} c WHERE c.{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rt_{pa} p WHERE p.{pk} = c.{fk})"
    for ch, pa, fk, pk in _PAIRS))(lambda t: q.dq_orphans(t, _PAIRS))

query("dq_soft_refs", """
SELECT 'shipment_line_order_line' AS check_name, COUNT(*) AS orphans FROM rt_shipment_line s WHERE NOT EXISTS (SELECT 1 FROM rt_sales_order_line l WHERE l.order_id = s.order_id AND l.line_no = s.order_line_no)
UNION ALL SELECT 'return_line_order_line', COUNT(*) FROM rt_return_line s WHERE NOT EXISTS (SELECT 1 FROM rt_sales_order_line l WHERE l.order_id = s.order_id AND l.line_no = s.line_no)
UNION ALL SELECT 'loyalty_transaction_order', COUNT(*) FROM rt_loyalty_transaction s WHERE NOT EXISTS (SELECT 1 FROM rt_sales_order l WHERE l.order_id = s.order_id)
UNION ALL SELECT 'loyalty_transaction_account', COUNT(*) FROM rt_loyalty_transaction s WHERE NOT EXISTS (SELECT 1 FROM rt_loyalty_account l WHERE l.loyalty_id = s.loyalty_id)""")(q.dq_soft_refs)

_MIN = {"sales_order": (0, 2400.0), "customer": (10, 120.5), "product": (0, 1100.0), "inventory_movement": (5, 4000.0)}
query("dq_row_minimums", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, COUNT(*) AS rows, CAST({f} + CEIL({s} * 2.5) AS BIGINT) AS minimum, CASE WHEN COUNT(*) >= {f} + CEIL({s} * 2.5) THEN 'Y' ELSE 'N' END AS passed FROM rt_{n}"
    for n, (f, s) in _MIN.items()))(lambda t: q.dq_row_minimums(t, _MIN, 2.5))

query("dq_stock", """
SELECT COUNT(*) AS stock_rows, COUNT(*) FILTER (qty_on_hand < 0) AS negative_rows, CAST(FLOOR(COUNT(*) / 40) AS BIGINT) AS expected_negative, COUNT(*) FILTER (qty_on_hand < -30) AS below_floor,
  COUNT(*) FILTER (qty_reserved < 0) AS negative_reserved,
  (SELECT COUNT(*) FROM rt_inventory_location WHERE (warehouse_id IS NULL) = (store_id IS NULL)) AS bad_owner FROM rt_inventory_stock""")(q.dq_stock)

_EMP = "(SELECT employee_id, CASE WHEN employee_id % 100 = 3 THEN employee_id * 8 + 1 WHEN employee_id % 100 = 77 THEN employee_id ELSE manager_id END AS manager_id FROM rt_employee)"
query("dq_hierarchy", f"""
WITH e AS {_EMP}, tree AS (
  SELECT employee_id FROM e WHERE manager_id IS NULL
  UNION ALL
  SELECT x.employee_id FROM tree t JOIN e x ON x.manager_id = t.employee_id WHERE x.employee_id <> x.manager_id)
SELECT 'TREE_UNREACHABLE' AS rule_code, CAST(employee_id AS STRING) AS entity_key FROM e WHERE employee_id NOT IN (SELECT employee_id FROM tree)
UNION ALL SELECT 'TREE_SELF_PARENT', CAST(employee_id AS STRING) FROM e WHERE employee_id = manager_id
UNION ALL SELECT 'TREE_ROOTS', 'ALL' FROM e HAVING COUNT(*) FILTER (manager_id IS NULL) <> 1""")(
    lambda t: q.dq_hierarchy(t.employee.select("employee_id", F.when(c("employee_id") % 100 == 3, c("employee_id") * 8 + 1).when(
        c("employee_id") % 100 == 77, c("employee_id")).otherwise(c("manager_id")).alias("manager_id")), "EMPLOYEE", "employee_id", "manager_id").select("rule_code", "entity_key"))

query("dq_finance", """
SELECT 'JOURNAL_UNBALANCED' AS rule_code, CAST(journal_id AS STRING) AS entity_key, CONCAT(CAST(CAST(SUM(debit_amount) AS DECIMAL(20,2)) AS STRING), ' <> ', CAST(CAST(SUM(credit_amount) AS DECIMAL(20,2)) AS STRING)) AS detail
FROM rt_gl_journal_line GROUP BY journal_id HAVING SUM(debit_amount) <> SUM(credit_amount)
UNION ALL SELECT 'LINE_BOTH_SIDES', CONCAT(CAST(journal_id AS STRING), '/', CAST(line_no AS STRING)), 'debit and credit on one line' FROM rt_gl_journal_line WHERE debit_amount > 0 AND credit_amount > 0
UNION ALL SELECT 'NEGATIVE_BALANCE', CAST(loyalty_id AS STRING), CAST(points_balance AS STRING) FROM rt_loyalty_account WHERE points_balance < 0""")(
    lambda t: q.dq_finance(t).select("rule_code", "entity_key", "detail"))

query("dq_journal_line", """
SELECT 'LINE_BOTH_SIDES' AS rule_code, CONCAT(CAST(journal_id AS STRING), '/', CAST(line_no AS STRING)) AS entity_key FROM rt_gl_journal_line WHERE debit_amount > 0 AND credit_amount > 0
UNION ALL SELECT 'LINE_NEEDS_RATE', CONCAT(CAST(journal_id AS STRING), '/', CAST(line_no AS STRING)) FROM rt_gl_journal_line WHERE fx_rate IS NULL AND currency_code <> 'GBP'
UNION ALL SELECT 'TOO_MANY_OPEN_PERIODS', 'ALL' FROM rt_gl_period HAVING COUNT(*) FILTER (status = 'OPEN') > 2""")(lambda t: q.dq_journal_line(t).select("rule_code", "entity_key"))

query("dq_canaries", """
SELECT (SELECT COUNT(*) FROM rt_address) AS addresses, (SELECT COUNT(NULLIF(line2, '')) FROM rt_address) AS line2_present,
  (SELECT COUNT(DISTINCT COALESCE(NULLIF(line2, ''), '<null>')) FROM rt_address) AS line2_distinct, (SELECT COUNT(*) FROM rt_customer WHERE mobile_phone IS NULL) AS mobile_null,
  (SELECT COUNT(*) FROM rt_sales_order o LEFT JOIN rt_customer cu ON cu.customer_id = o.customer_id LEFT JOIN rt_shipment s ON s.order_id = o.order_id AND s.status = 'DELIVERED') AS outer_join_rows""")(q.dq_canaries)

query("dq_negative_margin", """
SELECT sku AS entity_key, CONCAT('list_price ', CAST(CAST(list_price AS DECIMAL(12,2)) AS STRING), ' below unit_cost ', CAST(CAST(unit_cost AS DECIMAL(12,3)) AS STRING)) AS detail FROM rt_product WHERE list_price < unit_cost""")(
    lambda t: q.dq_negative_margin(t.product).select("entity_key", "detail"))
query("dq_unpriced", "SELECT CAST(variant_id AS STRING) AS entity_key FROM rt_product_variant v WHERE is_active = 'Y' AND NOT EXISTS (SELECT 1 FROM rt_price_list_item i WHERE i.variant_id = v.variant_id)")(
    lambda t: q.dq_unpriced(t).select("entity_key"))
query("dq_ledger_drift", """
SELECT CAST(a.loyalty_id AS STRING) AS entity_key, CONCAT('ledger sum ', CAST(CAST(l.s AS BIGINT) AS STRING), ' <> account balance ', CAST(a.points_balance AS STRING)) AS detail
FROM rt_loyalty_account a JOIN (SELECT loyalty_id, SUM(points_delta) AS s FROM rt_loyalty_transaction GROUP BY 1) l ON l.loyalty_id = a.loyalty_id WHERE l.s <> a.points_balance""")(
    lambda t: q.dq_ledger_drift(t.loyalty_account, t.loyalty_transaction).select("entity_key", "detail"))
query("dq_transitions", "SELECT 'REACTIVATED_SKU' AS rule_code, CAST(product_id AS STRING) AS entity_key FROM rt_product WHERE status = 'DISCONTINUED' AND product_id % 3 = 0")(
    lambda t: q.dq_transitions(t.product.select("product_id", "status"), t.product.select("product_id", F.when(c("product_id") % 3 == 0, "ACTIVE").otherwise(c("status")).alias("status")),
                               "product", "product_id").select("rule_code", "entity_key"))
query("dq_severity_floor", "SELECT issue_id, severity FROM rt_data_quality_issue WHERE severity IN ('FATAL', 'ERROR', 'WARN')")(
    lambda t: q.severity_floor(t.data_quality_issue, "WARN").select("issue_id", "severity"))
