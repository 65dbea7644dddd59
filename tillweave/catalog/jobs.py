"""Merges, batch jobs and outbound files over whole tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tillweave.catalog.pricing import _PICKED, REQ
from tillweave.catalog.registry import d, day, i, query
from tillweave.catalog.views import NET, NOW
from tillweave.functions.values import as_time, nvl
from tillweave.operators import merge as m
from tillweave.operators.aggregates import explode_legs
from tillweave.operators.positions import assign_ids
from tillweave.operators.scalars import beside
from tillweave.plans import batch as b
from tillweave.plans import catalogue as cat
from tillweave.plans import finance as fin
from tillweave.plans import inventory as inv
from tillweave.plans import loyalty as loy
from tillweave.plans import orders as ords
from tillweave.plans import procurement as proc
from tillweave.session import shared_dir
from tillweave.sources import extracts as ex
from tillweave.sources.binding import AS_OF

c = F.col

# ---- merges --------------------------------------------------------------------------------------------

query("merge_upsert", f"""
SELECT customer_id, CASE WHEN customer_id % 3 = 0 THEN 'CLOSED' ELSE status END AS status, CASE WHEN customer_id % 3 = 0 THEN 'M' ELSE marketing_optin END AS marketing_optin FROM rt_customer
UNION ALL SELECT customer_id + 10000000, 'CLOSED', 'N' FROM rt_customer WHERE customer_id % 3 = 1""")(
    lambda t: m.upsert(
        t.customer.select("customer_id", "status", "marketing_optin"),
        t.customer.filter("customer_id % 3 <> 2").select((c("customer_id") + F.when(c("customer_id") % 3 == 1, 10_000_000).otherwise(0)).alias("customer_id"), F.lit("CLOSED").alias("st")),
        ["customer_id"], {"status": c("s.st"), "marketing_optin": F.lit("M")}, {"status": c("s.st"), "marketing_optin": F.lit("N")}))

def _walked(legs: str) -> str:
    """Balances row by row: `legs` has location_id, variant_id, delta, guarded and the order columns o1, o2, o3, o4."""
    return f"""WITH RECURSIVE leg AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id, variant_id ORDER BY o1, o2, o3, o4) AS rn FROM ({legs}) z),
places AS (SELECT location_id, variant_id FROM leg UNION SELECT location_id, variant_id FROM rt_inventory_stock),
run AS (SELECT p.location_id, p.variant_id, CAST(0 AS BIGINT) AS rn, CAST(s.qty_on_hand AS DECIMAL(28,3)) AS q, FALSE AS hit FROM places p
  LEFT JOIN rt_inventory_stock s ON s.location_id = p.location_id AND s.variant_id = p.variant_id
  UNION ALL SELECT r.location_id, r.variant_id, l.rn, CAST(CASE WHEN r.q IS NULL THEN l.delta WHEN l.guarded AND r.q + l.delta < 0 THEN r.q ELSE r.q + l.delta END AS DECIMAL(28,3)),
    r.hit OR r.q IS NULL OR NOT l.guarded OR r.q + l.delta >= 0
  FROM run r JOIN leg l ON l.location_id = r.location_id AND l.variant_id = r.variant_id AND l.rn = r.rn + 1),
ends AS (SELECT location_id, variant_id, ARG_MAX(q, rn) AS q, BOOL_OR(hit) AS hit FROM run GROUP BY 1, 2)"""


query("merge_increment", f"""
{_walked("SELECT to_location_id AS location_id, variant_id, qty AS delta, TRUE AS guarded, movement_id AS o1, qty AS o2, 0 AS o3, 0 AS o4 FROM rt_inventory_movement WHERE to_location_id IS NOT NULL")}
SELECT location_id, variant_id, {d('q')} AS qty_on_hand FROM ends""")(
    lambda t: m.add_qty(t.inventory_stock, t.inventory_movement.filter(c("to_location_id").isNotNull()).select(
        c("to_location_id").alias("location_id"), "variant_id", "movement_id", "qty"), ["location_id", "variant_id"], order=["movement_id", "qty"]).select("location_id", "variant_id", "qty_on_hand"))

query("merge_replace", f"""
WITH snap AS (SELECT from_location_id AS location_id, variant_id, SUM(ABS(qty)) AS q FROM rt_inventory_movement WHERE from_location_id IS NOT NULL GROUP BY 1, 2)
SELECT COALESCE(s.location_id, x.location_id) AS location_id, COALESCE(s.variant_id, x.variant_id) AS variant_id,
  {d('COALESCE(x.q, s.qty_on_hand)')} AS qty_on_hand, {d('COALESCE(s.qty_reserved, 0)')} AS qty_reserved
FROM rt_inventory_stock s FULL JOIN snap x ON x.location_id = s.location_id AND x.variant_id = s.variant_id""")(
    lambda t: m.replace_qty(t.inventory_stock, t.inventory_movement.filter(c("from_location_id").isNotNull()).groupBy(
        c("from_location_id").alias("location_id"), "variant_id").agg(F.sum(F.abs("qty")).alias("qty")), ["location_id", "variant_id"])
    .select("location_id", "variant_id", "qty_on_hand", "qty_reserved"))

query("merge_update_only", f"""
SELECT p.payment_id, CASE WHEN o.status IN ('SHIPPED', 'DELIVERED') THEN 'CAPTURED' ELSE p.status END AS status,
  CASE WHEN o.status IN ('SHIPPED', 'DELIVERED') AND p.status <> 'CAPTURED' THEN 'CHANGED' ELSE p.payment_method END AS payment_method
FROM rt_order_payment p JOIN rt_sales_order o ON o.order_id = p.order_id""")(
    lambda t: m.update_where_changed(
        t.order_payment, t.sales_order.filter(c("status").isin("SHIPPED", "DELIVERED")).select("order_id", F.lit("CAPTURED").alias("status")),
        ["order_id"], ["status"], {"payment_method": F.lit("CHANGED")}).select("payment_id", "status", "payment_method"))

_MERGE_SRC = "(SELECT rule_code, entity_name, entity_key, 'synced' AS detail FROM (SELECT DISTINCT rule_code, entity_name, entity_key FROM rt_data_quality_issue WHERE issue_id % 2 = 0 UNION SELECT 'NEW_RULE', 'PRODUCT', CAST(product_id AS STRING) FROM rt_product))"
for _name in ("merge_with_delete", "job_interface_sync"):
    query(_name, f"""
SELECT t.rule_code, t.entity_name, t.entity_key, t.severity, CASE WHEN s.detail IS NOT NULL AND t.resolved_ts IS NULL THEN s.detail ELSE t.detail END AS detail
FROM rt_data_quality_issue t LEFT JOIN {_MERGE_SRC} s ON s.rule_code = t.rule_code AND s.entity_name = t.entity_name AND s.entity_key = t.entity_key
WHERE NOT (s.detail IS NOT NULL AND t.resolved_ts IS NULL AND t.severity = 'RESOLVED')
UNION ALL SELECT s.rule_code, s.entity_name, s.entity_key, 'INFO', s.detail FROM {_MERGE_SRC} s
WHERE NOT EXISTS (SELECT 1 FROM rt_data_quality_issue t WHERE s.rule_code = t.rule_code AND s.entity_name = t.entity_name AND s.entity_key = t.entity_key)""")(
        lambda t: b.interface_sync(
            t.data_quality_issue, t.data_quality_issue.filter("issue_id % 2 = 0").select("rule_code", "entity_name", "entity_key").unionByName(
                t.product.select(F.lit("NEW_RULE").alias("rule_code"), F.lit("PRODUCT").alias("entity_name"), c("product_id").cast("string").alias("entity_key"))
            ).withColumns({"severity": F.lit("INFO"), "detail": F.lit("synced")}), "2024-02-01").select("rule_code", "entity_name", "entity_key", "severity", "detail"))

query("update_from_lookup", """
SELECT l.order_id, l.line_no, l.variant_id, COALESCE(l.fulfil_location_id, x.loc) AS fulfil_location_id
FROM rt_sales_order_line l LEFT JOIN (SELECT variant_id, MIN(location_id) AS loc FROM rt_inventory_stock WHERE qty_on_hand > 0 GROUP BY 1) x ON x.variant_id = l.variant_id""")(
    lambda t: m.fill_from_lookup(t.sales_order_line, t.inventory_stock.filter("qty_on_hand > 0"), ["variant_id"], "fulfil_location_id", F.min("location_id"))
    .select("order_id", "line_no", "variant_id", "fulfil_location_id"))

query("delete_older_than", "SELECT audit_id FROM rt_audit_log WHERE changed_ts >= CAST('2024-01-16' AS TIMESTAMP)")(
    lambda t: m.purge(t.audit_log, "changed_ts", 15, "2024-01-31")[0].select("audit_id"))
query("delete_older_than_count", "SELECT COUNT(*) AS rows_deleted FROM rt_audit_log WHERE changed_ts < CAST('2024-01-16' AS TIMESTAMP)")(
    lambda t: m.purge(t.audit_log, "changed_ts", 15, "2024-01-31")[1])

query("archive_purge", "SELECT issue_id FROM rt_data_quality_issue WHERE resolved_ts IS NULL")(
    lambda t: m.archive_purge(t.data_quality_issue, 2024, dry_run=False)[0].select("issue_id"))
query("archive_purge_summary", """
SELECT 'ARCHIVE_PURGE' AS rule_code, '2024' AS entity_key, CONCAT('candidates=', CAST(COUNT(*) AS STRING), ' dry_run=Y') AS detail FROM rt_data_quality_issue WHERE resolved_ts IS NOT NULL""")(
    lambda t: m.archive_purge(t.data_quality_issue, 2024)[1].select("rule_code", "entity_key", "detail"))

def _good():
    return {"QTY_NEGATIVE": c("qty_received") >= 0, "REJECT_UNKNOWN": c("qty_rejected").isNotNull()}


query("insert_quarantine", """
SELECT receipt_id FROM rt_goods_receipt WHERE qty_received >= 0 AND qty_rejected IS NOT NULL""")(
    lambda t: m.quarantine(t.goods_receipt, _good(), "GOODS_RECEIPT", c("receipt_id"))[0].select("receipt_id"))
query("insert_quarantine_rejects", """
SELECT 'QTY_NEGATIVE' AS rule_code, CAST(receipt_id AS STRING) AS entity_key FROM rt_goods_receipt WHERE qty_received < 0
UNION ALL SELECT 'REJECT_UNKNOWN', CAST(receipt_id AS STRING) FROM rt_goods_receipt WHERE qty_rejected IS NULL""")(
    lambda t: m.quarantine(t.goods_receipt, _good(), "GOODS_RECEIPT", c("receipt_id"))[1].select("rule_code", "entity_key"))

query("dedupe_key", """
SELECT variant_id AS product_id, MIN(order_id * 100 + line_no) AS first_seen FROM (SELECT DISTINCT variant_id, order_id, line_no FROM rt_sales_order_line)
WHERE variant_id % 4 <> 0 GROUP BY 1""")(
    lambda t: m.reject_duplicates(
        t.sales_order_line.select(c("variant_id").alias("product_id"), (c("order_id") * 100 + c("line_no")).alias("seen")).distinct(),
        t.product.filter("product_id % 4 = 0").select("product_id"), "product_id", ["seen"])[0].withColumnRenamed("seen", "first_seen"))

query("assign_ids", """
SELECT customer_id, ROW_NUMBER() OVER (ORDER BY customer_id) + 500 AS id, CONCAT('RMA', LPAD(CAST((ROW_NUMBER() OVER (ORDER BY customer_id) + 499) % 999 + 1 AS STRING), 6, '0')) AS ref FROM rt_customer""")(
    lambda t: assign_ids(t.customer.select("customer_id"), [c("customer_id")], 500, prefix="RMA", width=6, cycle=999))


def _c360_changes(t):
    """Every third customer changed, every tenth erased, and one new customer per four existing."""
    cu = t.customer.select("customer_id", "first_name", "last_name", "home_country_code")
    blank = {"customer_ref": None, "email": None, "mobile_phone": None, "marketing_optin": None, "customer_status": None, "points_balance": None,
             "tier_code": None, "card_number": None, "birth_date": None, "preferred_store_id": None, "primary_address_id": None}
    types = {"points_balance": "bigint", "birth_date": "timestamp_ntz", "preferred_store_id": "bigint", "primary_address_id": "bigint"}
    base = cu.withColumns({k: F.lit(v).cast(types.get(k, "string")) for k, v in blank.items()})
    upd = base.filter("customer_id % 3 = 1 and customer_id % 10 <> 0").withColumns({"email": F.concat(F.lit(" NEW"), c("customer_id").cast("string"), F.lit("@X.org ")),
                                                           "customer_status": F.lit("DORMANT"), "points_balance": c("customer_id") * 2})
    gone = base.filter("customer_id % 10 = 0")
    new = base.filter("customer_id % 4 = 0").withColumns({"customer_id": c("customer_id") + 10_000_000, "card_number": F.when(c("customer_id") % 8 == 0, "CARD")})
    return upd.withColumn("op", F.lit("U")).unionByName(gone.withColumn("op", F.lit("D"))).unionByName(new.withColumn("op", F.lit("I")))


query("view_write_through", """
SELECT customer_id, CASE WHEN customer_id % 10 = 0 THEN 'ERASED' WHEN customer_id % 3 = 1 THEN 'DORMANT' ELSE status END AS status,
  CASE WHEN customer_id % 10 = 0 THEN NULL WHEN customer_id % 3 = 1 THEN CONCAT('new', CAST(customer_id AS STRING), '@x.org') ELSE email END AS email, customer_ref FROM rt_customer
UNION ALL SELECT customer_id + 10000000, 'ACTIVE', NULL, 'CU-PENDING' FROM rt_customer WHERE customer_id % 4 = 0""")(
    lambda t: b.apply_view_changes("customer_360", _c360_changes(t), t, AS_OF)["customer"].select("customer_id", "status", "email", "customer_ref"))
query("view_write_through_accounts", """
SELECT loyalty_id, customer_id, CASE WHEN customer_id % 3 = 1 AND customer_id % 10 <> 0 THEN customer_id * 2 ELSE points_balance END AS points_balance, tier_code FROM rt_loyalty_account
UNION ALL SELECT customer_id + 10000000, customer_id + 10000000, 0, 'BRONZE' FROM rt_customer WHERE customer_id % 8 = 0""")(
    lambda t: b.apply_view_changes("customer_360", _c360_changes(t), t, AS_OF)["loyalty_account"].select("loyalty_id", "customer_id", "points_balance", "tier_code"))


def _product_changes(t):
    rows = t.product_variant.join(t.product.drop("margin_pct"), "product_id").withColumnsRenamed({"is_active": "variant_active", "status": "product_status"})
    upd = rows.filter("variant_id % 5 = 1").withColumns({"list_price": c("list_price") + 1, "variant_active": F.lit("N"), "pack_qty": F.lit(9).cast("bigint")})
    gone = rows.filter("variant_id % 5 = 2")
    new = rows.filter("variant_id % 5 = 3").withColumns({"variant_id": c("variant_id") + 10_000_000, "product_id": c("product_id") + 10_000_000,
                                                         "variant_active": F.lit(None).cast("string"), "product_status": F.lit(None).cast("string")})
    return upd.withColumn("op", F.lit("U")).unionByName(gone.withColumn("op", F.lit("D"))).unionByName(new.withColumn("op", F.lit("I")))


query("view_write_through_product", f"""
SELECT product_id, {d('CASE WHEN product_id % 5 = 1 THEN list_price + 1 ELSE list_price END')} AS list_price, status FROM rt_product
UNION ALL SELECT product_id + 10000000, {d('list_price')}, 'DRAFT' FROM rt_product WHERE product_id % 5 = 3""")(
    lambda t: b.apply_view_changes("product_sellable", _product_changes(t), t, AS_OF)["product"].select("product_id", "list_price", "status"))
query("view_write_through_variant", """
SELECT variant_id, CASE WHEN variant_id % 5 IN (1, 2) THEN 'N' ELSE is_active END AS is_active, CASE WHEN variant_id % 5 = 1 THEN 9 ELSE pack_qty END AS pack_qty FROM rt_product_variant
UNION ALL SELECT variant_id + 10000000, 'Y', pack_qty FROM rt_product_variant WHERE variant_id % 5 = 3""")(
    lambda t: b.apply_view_changes("product_sellable", _product_changes(t), t, AS_OF)["product_variant"].select("variant_id", "is_active", "pack_qty"))


def _po_changes(t):
    po = t.purchase_order
    upd = po.filter("po_id % 7 = 1").withColumns({"status": F.lit("SENT"), "op": F.lit("U")})
    shift = po.filter("po_id % 7 = 2").withColumns({"expected_date": as_time("2002-01-01"), "op": F.lit("U")})
    gone = po.filter("po_id % 7 = 3").withColumn("op", F.lit("D"))
    new = po.filter("po_id % 7 = 4").withColumns({"po_id": c("po_id") + 10_000_000, "po_number": F.lit(None).cast("string"), "status": F.lit(None).cast("string"), "op": F.lit("I")})
    return upd.unionByName(shift).unionByName(gone).unionByName(new)


query("view_write_through_po", """
SELECT po_id, po_number, CASE WHEN po_id % 7 = 1 AND status <> 'SENT' AND approved_by_employee_id IS NOT NULL THEN 'SENT'
    WHEN po_id % 7 = 3 AND status IN ('DRAFT', 'SENT') THEN 'CANCELLED' ELSE status END AS status,
  CASE WHEN po_id % 7 = 2 THEN CAST('2002-01-01' AS TIMESTAMP) ELSE expected_date END AS expected_date FROM rt_purchase_order
UNION ALL SELECT po_id + 10000000, CONCAT('PO', LPAD(CAST(po_id + 10000000 AS STRING), 12, '0')), 'DRAFT', COALESCE(expected_date, CAST('2001-08-16' AS TIMESTAMP)) FROM rt_purchase_order WHERE po_id % 7 = 4""")(
    lambda t: b.apply_view_changes("open_purchase_orders", _po_changes(t), t, AS_OF)["purchase_order"].select("po_id", "po_number", "status", "expected_date"))

# ---- inventory --------------------------------------------------------------------------------------------

_MV_OK = """(SELECT m.* FROM rt_inventory_movement m WHERE m.qty <> 0 AND (m.from_location_id IS NULL OR EXISTS (
  SELECT 1 FROM rt_inventory_stock s WHERE s.location_id = m.from_location_id AND s.variant_id = m.variant_id)))"""
_MV_LEGS = f"""SELECT to_location_id AS location_id, variant_id, ABS(qty) AS delta, TRUE AS guarded, movement_id AS o1, qty AS o2, to_location_id AS o3, FALSE AS o4 FROM {_MV_OK} WHERE to_location_id IS NOT NULL
  UNION ALL SELECT from_location_id, variant_id, -ABS(qty), FALSE, movement_id, qty, to_location_id, TRUE FROM {_MV_OK} WHERE from_location_id IS NOT NULL"""
query("job_movement_apply", f"""
{_walked(_MV_LEGS)}
SELECT e.location_id, e.variant_id, {d('e.q')} AS qty_on_hand, CASE WHEN e.hit THEN {NOW} ELSE s.last_movement_ts END AS last_movement_ts
FROM ends e LEFT JOIN rt_inventory_stock s ON s.location_id = e.location_id AND s.variant_id = e.variant_id""")(
    lambda t: inv.movement_apply(t.inventory_stock, t.inventory_movement, AS_OF)[0].select("location_id", "variant_id", "qty_on_hand", "last_movement_ts"))
query("job_movement_apply_rejects", """
SELECT movement_id, variant_id, CASE WHEN qty = 0 THEN 'Movement quantity must be non-zero' ELSE CONCAT('No stock record at location ', CAST(from_location_id AS STRING)) END AS reject_reason
FROM rt_inventory_movement m WHERE qty = 0 OR (from_location_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rt_inventory_stock s WHERE s.location_id = m.from_location_id AND s.variant_id = m.variant_id))""")(
    lambda t: inv.rejected_movements(t.inventory_stock, t.inventory_movement).select("movement_id", "variant_id", "reject_reason"))

_INTO = "(SELECT to_location_id AS location_id, variant_id, SUM(qty) AS q FROM rt_inventory_movement WHERE to_location_id IS NOT NULL GROUP BY 1, 2)"
query("job_movement_bulk", f"""
SELECT s.location_id, s.variant_id, {d('s.qty_on_hand + COALESCE(x.q, 0)')} AS qty_on_hand FROM rt_inventory_stock s
LEFT JOIN {_INTO} x ON x.location_id = s.location_id AND x.variant_id = s.variant_id""")(
    lambda t: inv.movement_bulk(t.inventory_stock, t.inventory_movement, AS_OF).select("location_id", "variant_id", "qty_on_hand"))
query("job_stock_resnapshot", f"""
SELECT COALESCE(s.location_id, x.location_id) AS location_id, COALESCE(s.variant_id, x.variant_id) AS variant_id, {d('COALESCE(x.q, s.qty_on_hand)')} AS qty_on_hand,
  {d('COALESCE(s.qty_reserved, 0)')} AS qty_reserved FROM rt_inventory_stock s FULL JOIN {_INTO} x ON x.location_id = s.location_id AND x.variant_id = s.variant_id""")(
    lambda t: inv.stock_resnapshot(t.inventory_stock, t.inventory_movement, t.inventory_location, AS_OF).select("location_id", "variant_id", "qty_on_hand", "qty_reserved"))
query("job_reorder_candidates", """
SELECT DISTINCT s.variant_id FROM rt_inventory_stock s JOIN rt_inventory_location l ON l.location_id = s.location_id
WHERE s.reorder_point IS NOT NULL AND s.qty_on_hand - s.qty_reserved < s.reorder_point AND l.warehouse_id = 2""")(lambda t: inv.reorder_candidates(t, 2))

query("job_replenishment", f"""
WITH low AS (SELECT l.warehouse_id, s.location_id, s.variant_id, s.qty_on_hand AS q, s.reorder_point AS r,
    GREATEST(COALESCE(s.reorder_qty, 0), s.reorder_point - (s.qty_on_hand - s.qty_reserved)) AS need,
    (SELECT sp.supplier_id FROM rt_supplier_product sp WHERE sp.variant_id = s.variant_id AND sp.is_primary_source = 'Y' AND (sp.valid_to IS NULL OR sp.valid_to >= {day(NOW)}) ORDER BY sp.unit_cost, sp.supplier_id LIMIT 1) AS sup
  FROM rt_inventory_stock s JOIN rt_inventory_location l ON l.location_id = s.location_id
  WHERE l.warehouse_id IS NOT NULL AND s.reorder_point IS NOT NULL AND s.qty_on_hand - s.qty_reserved < s.reorder_point),
per AS (SELECT warehouse_id, variant_id, SUM(q) AS q, SUM(r) AS r, SUM(need) AS need, MIN(sup) AS sup FROM low GROUP BY 1, 2),
dem AS (SELECT l.warehouse_id, m.variant_id, SUM(ABS(m.qty)) AS sold FROM rt_inventory_movement m JOIN rt_inventory_location l ON l.location_id = m.from_location_id
  WHERE m.movement_type = 'SALE' AND m.movement_ts >= {NOW} - INTERVAL 400 DAY AND m.movement_ts < {NOW} AND l.warehouse_id IS NOT NULL GROUP BY 1, 2)
SELECT p.warehouse_id, p.variant_id, {d('p.q')} AS qty_on_hand, {d('p.r')} AS reorder_point, {d('GREATEST(p.need, COALESCE(d.sold, 0))')} AS suggested_qty, p.sup AS supplier_id, {NOW} AS run_ts
FROM per p LEFT JOIN dem d ON d.warehouse_id = p.warehouse_id AND d.variant_id = p.variant_id""")(lambda t: inv.replenishment(t, AS_OF, 400))

# ---- procurement ---------------------------------------------------------------------------------------------

query("job_receipts", f"""
WITH g AS (SELECT po_id, po_line_no, SUM(qty_received) AS q FROM rt_goods_receipt GROUP BY 1, 2)
SELECT l.po_id, l.line_no, l.variant_id, {d('CASE WHEN g.q IS NULL THEN l.qty_received ELSE COALESCE(l.qty_received, 0) + g.q END')} AS qty_received,
  CASE WHEN g.q IS NULL THEN l.status WHEN COALESCE(l.qty_received, 0) + g.q >= l.qty_ordered THEN 'RECEIVED' ELSE 'PART_RECV' END AS status
FROM rt_purchase_order_line l LEFT JOIN g ON g.po_id = l.po_id AND g.po_line_no = l.line_no""")(
    lambda t: proc.receipts(t, t.goods_receipt)[0].purchase_order_line.select("po_id", "line_no", "variant_id", "qty_received", "status"))
query("job_receipts_rejects", """
SELECT 'RECEIPT_BULK_REJECT' AS rule_code, CONCAT(CAST(po_id AS STRING), '/', CAST(po_line_no AS STRING)) AS entity_key FROM rt_goods_receipt WHERE qty_received < 0""")(
    lambda t: proc.receipts(t, t.goods_receipt)[1].select("rule_code", "entity_key"))
query("job_po_close", """
SELECT po_id, CASE WHEN EXISTS (SELECT 1 FROM rt_purchase_order_line l WHERE l.po_id = p.po_id AND COALESCE(l.qty_received, 0) < l.qty_ordered * CAST(0.95 AS DECIMAL(4,2))) THEN status ELSE 'RECEIVED' END AS status
FROM rt_purchase_order p""")(lambda t: proc.po_close(t, "five").select("po_id", "status"))


def _po_requests(t):
    return t.supplier_product.select(
        (c("variant_id") * 1000 + c("supplier_id")).alias("request_id"), (c("supplier_id") + F.when(c("variant_id") % 30 == 0, 1_000_000).otherwise(0)).alias("supplier_id"),
        (c("variant_id") % 5).alias("warehouse_id"), as_time("2001-08-01").alias("order_date"))


_POREQ = """(SELECT variant_id * 1000 + supplier_id AS request_id, supplier_id + CASE WHEN variant_id % 30 = 0 THEN 1000000 ELSE 0 END AS supplier_id, variant_id % 5 AS warehouse_id
  FROM rt_supplier_product)"""
query("job_po_create", f"""
SELECT r.request_id, 900000000 + ROW_NUMBER() OVER (ORDER BY r.request_id) AS po_id, CONCAT('PO', LPAD(CAST(900000000 + ROW_NUMBER() OVER (ORDER BY r.request_id) AS STRING), 12, '0')) AS po_number,
  r.supplier_id, r.warehouse_id, CAST('2001-08-15' AS TIMESTAMP) AS expected_date, s.currency_code
FROM {_POREQ} r JOIN rt_supplier s ON s.supplier_id = r.supplier_id WHERE s.is_approved = 'Y' OR s.is_approved IS NULL""")(
    lambda t: proc.po_create(_po_requests(t), t, 900_000_000)[0].select("request_id", "po_id", "po_number", "supplier_id", "warehouse_id", "expected_date", "currency_code"))
query("job_po_create_rejects", f"""
SELECT r.request_id, CASE WHEN s.supplier_id IS NULL THEN CONCAT('Unknown supplier ', CAST(r.supplier_id AS STRING)) ELSE CONCAT('Supplier ', CAST(r.supplier_id AS STRING), ' is not approved for purchasing') END AS reject_reason
FROM {_POREQ} r LEFT JOIN rt_supplier s ON s.supplier_id = r.supplier_id WHERE s.supplier_id IS NULL OR s.is_approved <> 'Y'""")(
    lambda t: proc.po_create(_po_requests(t), t, 900_000_000)[1].select("request_id", "reject_reason"))


def _line_requests(t):
    return t.purchase_order_line.select(
        "po_id", c("line_no").alias("seq"), (c("variant_id") + 1).alias("variant_id"), c("qty_ordered").alias("qty"), F.when(c("line_no") % 8 == 0, c("unit_cost")).alias("unit_cost"))


_LREQ = "(SELECT po_id, line_no AS seq, variant_id + 1 AS variant_id, qty_ordered AS qty, CASE WHEN line_no % 8 = 0 THEN unit_cost END AS unit_cost FROM rt_purchase_order_line)"
_LNEW = f"""(SELECT r.po_id, COALESCE(x.m, 0) + ROW_NUMBER() OVER (PARTITION BY r.po_id ORDER BY r.seq, r.variant_id) AS line_no, r.variant_id, r.qty,
  COALESCE(r.unit_cost, (SELECT MIN(sp.unit_cost) FROM rt_supplier_product sp WHERE sp.supplier_id = p.supplier_id AND sp.variant_id = r.variant_id AND sp.is_primary_source = 'Y'), 0) AS cost
  FROM {_LREQ} r JOIN rt_purchase_order p ON p.po_id = r.po_id LEFT JOIN (SELECT po_id, MAX(line_no) AS m FROM rt_purchase_order_line GROUP BY 1) x ON x.po_id = r.po_id)"""
query("job_po_lines", f"SELECT po_id, line_no, variant_id, {d('qty')} AS qty_ordered, {d('cost')} AS unit_cost FROM {_LNEW}")(
    lambda t: proc.po_lines(_line_requests(t), t)[0].select("po_id", "line_no", "variant_id", "qty_ordered", "unit_cost"))
query("job_po_lines_totals", f"""
SELECT p.po_id, {d('COALESCE(n.v, p.order_total)')} AS order_total FROM rt_purchase_order p LEFT JOIN (
  SELECT po_id, CAST(SUM(v) AS DECIMAL(14,2)) AS v FROM (SELECT po_id, qty_ordered * unit_cost AS v FROM rt_purchase_order_line WHERE COALESCE(status, 'OPEN') <> 'CANCELLED'
    UNION ALL SELECT po_id, qty * cost FROM {_LNEW}) WHERE po_id IN (SELECT po_id FROM {_LREQ}) GROUP BY 1) n ON n.po_id = p.po_id""")(
    lambda t: proc.po_totals(_line_requests(t), t).select("po_id", "order_total"))


def _moves_po(t):
    act = F.when(c("po_id") % 3 == 0, "APPROVE").when(c("po_id") % 3 == 1, "SEND").otherwise("CANCEL")
    return t.purchase_order.select((c("po_id") + F.when(c("po_id") % 50 == 0, 100_000_000).otherwise(0)).alias("po_id"), act.alias("action"), F.lit(99).cast("bigint").alias("employee_id"))


query("job_po_transition", """
SELECT po_id, CASE WHEN po_id % 50 = 0 THEN status WHEN po_id % 3 = 1 AND status <> 'SENT' AND approved_by_employee_id IS NOT NULL THEN 'SENT'
    WHEN po_id % 3 = 2 AND status IN ('DRAFT', 'SENT') THEN 'CANCELLED' ELSE status END AS status,
  CASE WHEN po_id % 50 <> 0 AND po_id % 3 = 0 AND status = 'DRAFT' THEN 99 ELSE approved_by_employee_id END AS approved_by_employee_id FROM rt_purchase_order""")(
    lambda t: proc.po_transition(t, _moves_po(t))[0].purchase_order.select("po_id", "status", "approved_by_employee_id"))
query("job_po_transition_lines", """
SELECT l.po_id, l.line_no, l.variant_id, CASE WHEN p.po_id % 50 <> 0 AND p.po_id % 3 = 2 AND p.status IN ('DRAFT', 'SENT') THEN 'CANCELLED' ELSE l.status END AS status
FROM rt_purchase_order_line l JOIN rt_purchase_order p ON p.po_id = l.po_id""")(
    lambda t: proc.po_transition(t, _moves_po(t))[0].purchase_order_line.select("po_id", "line_no", "variant_id", "status"))
query("job_po_transition_rejects", """
SELECT CASE WHEN po_id % 50 = 0 THEN po_id + 100000000 ELSE po_id END AS po_id, CASE WHEN po_id % 50 = 0 THEN CONCAT('Unknown purchase order ', CAST(po_id + 100000000 AS STRING))
  WHEN po_id % 3 = 0 THEN CONCAT('Purchase order ', CAST(po_id AS STRING), ' has already left DRAFT (status ', status, ')')
  WHEN po_id % 3 = 1 AND status = 'SENT' THEN CONCAT('Purchase order ', CAST(po_id AS STRING), ' already sent')
  WHEN po_id % 3 = 1 THEN CONCAT('Purchase order ', CAST(po_id AS STRING), ' is not approved')
  ELSE CONCAT('Purchase order ', CAST(po_id AS STRING), ' cannot be cancelled in its current status') END AS reject_reason
FROM rt_purchase_order WHERE po_id % 50 = 0 OR (po_id % 3 = 0 AND status <> 'DRAFT') OR (po_id % 3 = 1 AND (status = 'SENT' OR approved_by_employee_id IS NULL))
  OR (po_id % 3 = 2 AND status NOT IN ('DRAFT', 'SENT'))""")(
    lambda t: proc.po_transition(t, _moves_po(t))[1].select("po_id", "reject_reason"))

# ---- orders -----------------------------------------------------------------------------------------------------


def _baskets(t):
    """Every order as a basket: some of unknown channel, some without lines, some with a stale price."""
    heads = t.sales_order.select(c("order_id").alias("basket_id"), "customer_id", "store_id", F.when(c("order_id") % 40 == 0, "FAX").otherwise(c("channel_code")).alias("channel_code"))
    # dealt by basket once: the sums of a line and the join with its head need no other shuffle
    lines = t.sales_order_line.filter("order_id % 37 <> 0").repartition("order_id").groupBy(c("order_id").alias("basket_id"), (c("line_no") * 1_000_000 + c("variant_id")).alias("line_no"), "variant_id").agg(
        F.sum("qty").alias("qty"), F.max(F.when(c("order_id") % 6 == 0, F.lit(1).cast("decimal(12,4)"))).alias("unit_price"))
    return heads, lines


_BSK = f"""
WITH RECURSIVE head AS (SELECT order_id AS basket_id, customer_id, store_id, CASE WHEN order_id % 40 = 0 THEN 'FAX' ELSE channel_code END AS channel_code FROM rt_sales_order),
line AS (SELECT order_id AS basket_id, line_no * 1000000 + variant_id AS line_no, variant_id, SUM(qty) AS qty, CASE WHEN MAX(order_id) % 6 = 0 THEN CAST(1 AS DECIMAL(12,4)) END AS unit_price
  FROM rt_sales_order_line WHERE order_id % 37 <> 0 GROUP BY 1, 2, 3),
ask AS (SELECT l.*, h.store_id, h.channel_code, h.customer_id, g.country_code FROM line l JOIN head h ON h.basket_id = l.basket_id
  JOIN rt_store s ON s.store_id = h.store_id JOIN rt_region g ON g.region_id = s.region_id),
cand AS (SELECT r.variant_id, r.country_code, r.channel_code, i.unit_price, ROW_NUMBER() OVER (PARTITION BY r.variant_id, r.country_code, r.channel_code
    ORDER BY pl.priority ASC NULLS LAST, i.effective_from DESC, pl.price_list_id) AS k
  FROM (SELECT DISTINCT variant_id, country_code, channel_code FROM ask) r JOIN rt_price_list pl ON pl.country_code = r.country_code AND pl.channel_code = r.channel_code
  JOIN rt_price_list_item i ON i.price_list_id = pl.price_list_id AND i.variant_id = r.variant_id
  WHERE pl.valid_from <= {NOW} AND COALESCE(pl.valid_to, {NOW}) >= {NOW} AND i.effective_from <= {NOW} AND (i.effective_to IS NULL OR i.effective_to > {NOW})),
judged AS (SELECT a.*, COALESCE(cd.unit_price, p.list_price) AS price,
    CASE WHEN COALESCE(st.q, 0) < a.qty THEN CONCAT('Insufficient stock for variant ', CAST(a.variant_id AS STRING))
      WHEN ABS(a.unit_price - COALESCE(cd.unit_price, p.list_price)) > 0.01 THEN CONCAT('Price changed for variant ', CAST(a.variant_id AS STRING)) END AS why
  FROM ask a LEFT JOIN cand cd ON cd.k = 1 AND cd.variant_id = a.variant_id AND cd.country_code = a.country_code AND cd.channel_code = a.channel_code
  LEFT JOIN rt_product p ON p.product_id = a.variant_id LEFT JOIN (SELECT variant_id, SUM(qty_on_hand - qty_reserved) AS q FROM rt_inventory_stock GROUP BY 1) st ON st.variant_id = a.variant_id),
verdict AS (SELECT h.basket_id, CASE WHEN f.n IS NULL THEN 'Basket is empty' WHEN h.channel_code = 'FAX' THEN 'Invalid channel: FAX' ELSE f.why END AS why
  FROM head h LEFT JOIN (SELECT basket_id, COUNT(*) AS n, ARG_MIN(why, line_no) FILTER (why IS NOT NULL) AS why FROM judged GROUP BY 1) f ON f.basket_id = h.basket_id),
good AS (SELECT j.*, COALESCE(j.unit_price, j.price) AS sell FROM judged j JOIN verdict v ON v.basket_id = j.basket_id WHERE v.why IS NULL)"""
query("job_basket_validate", f"{_BSK} SELECT basket_id, line_no, variant_id, {d('sell')} AS sell_price FROM good")(
    lambda t: ords.basket_validate(*_baskets(t), t, AS_OF)[0].select("basket_id", "line_no", "variant_id", "sell_price"))
query("job_basket_validate_rejects", f"{_BSK} SELECT basket_id, why AS reject_reason FROM verdict WHERE why IS NOT NULL")(
    lambda t: ords.basket_validate(*_baskets(t), t, AS_OF)[1])
query("job_orders_place", f"""{_BSK}
SELECT basket_id, 700000000 + ROW_NUMBER() OVER (ORDER BY basket_id) AS order_id, customer_id, store_id, channel_code, {d('CAST(sub AS DECIMAL(14,2))')} AS subtotal_amount, {d('tax')} AS tax_amount
FROM (SELECT basket_id, customer_id, store_id, channel_code, SUM(qty * sell) AS sub, SUM(ROUND(qty * sell * CAST(0.2 AS DECIMAL(2,1)), 2)) AS tax FROM good GROUP BY 1, 2, 3, 4)""")(
    lambda t: ords.orders_place(ords.basket_validate(*_baskets(t), t, AS_OF)[0], t, 700_000_000, AS_OF)[0]
    .select("basket_id", "order_id", "customer_id", "store_id", "channel_code", "subtotal_amount", "tax_amount"))
query("job_orders_place_lines", f"""{_BSK}, ids AS (SELECT basket_id, 700000000 + ROW_NUMBER() OVER (ORDER BY basket_id) AS order_id FROM (SELECT DISTINCT basket_id FROM good))
SELECT i.order_id, g.line_no, g.variant_id, {d('g.qty')} AS qty, {d('g.sell')} AS unit_price, {d('ROUND(g.qty * g.sell * CAST(0.2 AS DECIMAL(2,1)), 2)')} AS tax_amount
FROM good g JOIN ids i ON i.basket_id = g.basket_id""")(
    lambda t: ords.orders_place(ords.basket_validate(*_baskets(t), t, AS_OF)[0], t, 700_000_000, AS_OF)[1].select("order_id", "line_no", "variant_id", "qty", "unit_price", "tax_amount"))


def _cancels(t):
    return t.sales_order.select((c("order_id") + F.when(c("order_id") % 100 == 0, 50_000_000).otherwise(0)).alias("order_id")).filter("order_id % 2 = 0")


query("job_orders_cancel", """
SELECT order_id, CASE WHEN order_id % 2 = 0 AND order_id % 100 <> 0 AND status NOT IN ('SHIPPED', 'DELIVERED', 'RETURNED') THEN 'CANCELLED' ELSE status END AS status FROM rt_sales_order""")(
    lambda t: ords.orders_cancel(t, _cancels(t))[0].sales_order.select("order_id", "status"))
query("job_orders_cancel_lines", """
SELECT l.order_id, l.line_no, l.variant_id, CASE WHEN o.order_id % 2 = 0 AND o.order_id % 100 <> 0 AND o.status NOT IN ('SHIPPED', 'DELIVERED', 'RETURNED') THEN 'CANCELLED' ELSE l.status END AS status
FROM rt_sales_order_line l JOIN rt_sales_order o ON o.order_id = l.order_id""")(
    lambda t: ords.orders_cancel(t, _cancels(t))[0].sales_order_line.select("order_id", "line_no", "variant_id", "status"))
query("job_orders_cancel_rejects", """
SELECT CASE WHEN order_id % 100 = 0 THEN order_id + 50000000 ELSE order_id END AS order_id, CASE WHEN order_id % 100 = 0 THEN CONCAT('Unknown order ', CAST(order_id + 50000000 AS STRING))
  ELSE CONCAT('Cannot cancel an order in status ', status) END AS reject_reason FROM rt_sales_order WHERE order_id % 2 = 0 AND (order_id % 100 = 0 OR status IN ('SHIPPED', 'DELIVERED', 'RETURNED'))""")(
    lambda t: ords.orders_cancel(t, _cancels(t))[1])

query("job_pick_list", f"""
SELECT o.order_id, o.order_number, o.order_ts, l.line_no, l.variant_id, pv.variant_sku, p.product_name, {d('l.qty')} AS qty, l.fulfil_location_id, il.location_code
FROM rt_sales_order o JOIN rt_sales_order_line l ON l.order_id = o.order_id JOIN rt_product_variant pv ON pv.variant_id = l.variant_id JOIN rt_product p ON p.product_id = pv.product_id
LEFT JOIN rt_inventory_location il ON il.location_id = l.fulfil_location_id WHERE o.store_id = 9 AND o.status = 'PICKING'""")(lambda t: ords.pick_list(t, 9, None))
query("job_pick_wave", """
SELECT store_id, ARG_MIN(order_id, (order_ts, order_id)) AS order_id FROM rt_sales_order WHERE status = 'PLACED' GROUP BY 1""")(lambda t: ords.pick_wave(t.sales_order)[1])
query("job_pick_wave_orders", """
SELECT o.order_id, CASE WHEN w.order_id IS NOT NULL THEN 'PICKING' ELSE o.status END AS status FROM rt_sales_order o LEFT JOIN (
  SELECT ARG_MIN(order_id, (order_ts, order_id)) AS order_id FROM rt_sales_order WHERE status = 'PLACED' GROUP BY store_id) w ON w.order_id = o.order_id""")(
    lambda t: ords.pick_wave(t.sales_order)[0].select("order_id", "status"))
query("job_allocate", """
SELECT l.order_id, l.line_no, l.variant_id, COALESCE(l.fulfil_location_id, x.loc) AS fulfil_location_id, CASE WHEN COALESCE(l.fulfil_location_id, x.loc) IS NULL THEN l.status ELSE 'ALLOCATED' END AS status
FROM rt_sales_order_line l LEFT JOIN (SELECT q.variant_id, q.qty, MIN(s.location_id) AS loc FROM (SELECT DISTINCT variant_id, qty FROM rt_sales_order_line) q
  JOIN rt_inventory_stock s ON s.variant_id = q.variant_id AND s.qty_on_hand - s.qty_reserved >= q.qty JOIN rt_inventory_location il ON il.location_id = s.location_id
  WHERE il.location_type IN ('PICKFACE', 'SHELF', 'BULK') GROUP BY 1, 2) x ON x.variant_id = l.variant_id AND x.qty = l.qty""")(
    lambda t: ords.allocate(t.sales_order_line.drop("line_total"), t).select("order_id", "line_no", "variant_id", "fulfil_location_id", "status"))
_SHIPIDS = "(SELECT order_id, 800000000 + ROW_NUMBER() OVER (ORDER BY order_id) AS shipment_id FROM rt_sales_order WHERE status = 'PICKING')"
query("job_ship", f"""
SELECT shipment_id, order_id, 'CAR1' AS carrier_code, CONCAT('TRK', LPAD(CAST(shipment_id AS STRING), 12, '0')) AS tracking_ref, {NOW} AS shipped_ts FROM {_SHIPIDS}""")(
    lambda t: ords.ship(t.sales_order.filter("status = 'PICKING'"), t.sales_order_line, "CAR1", 800_000_000, AS_OF)[0].select("shipment_id", "order_id", "carrier_code", "tracking_ref", "shipped_ts"))
query("job_ship_lines", f"""
SELECT s.shipment_id, l.order_id, l.line_no AS order_line_no, l.variant_id, {d('l.qty')} AS qty_shipped FROM rt_sales_order_line l JOIN {_SHIPIDS} s ON s.order_id = l.order_id""")(
    lambda t: ords.ship(t.sales_order.filter("status = 'PICKING'"), t.sales_order_line, "CAR1", 800_000_000, AS_OF)[1])

# ---- loyalty -----------------------------------------------------------------------------------------------------


def _earned(t):
    return t.sales_order.filter(c("customer_id").isNotNull()).select(c("customer_id").alias("loyalty_id"), "order_id", F.when(c("order_id") % 17 != 0, c("subtotal_amount")).alias("amount"))


_EARN = f"""(SELECT o.customer_id AS loyalty_id, o.order_id, la.status, CAST(FLOOR(COALESCE(CASE WHEN o.order_id % 17 <> 0 THEN o.subtotal_amount END, 0) * COALESCE(lt.points_multiplier, 1)) AS BIGINT) AS pts
  FROM rt_sales_order o LEFT JOIN rt_loyalty_account la ON la.loyalty_id = o.customer_id LEFT JOIN rt_loyalty_tier lt ON lt.tier_code = la.tier_code WHERE o.customer_id IS NOT NULL)"""
query("job_loyalty_accrue", f"SELECT loyalty_id, order_id, pts AS points_delta, CAST('2003-08-02' AS TIMESTAMP) AS expires_on FROM {_EARN} WHERE status = 'ACTIVE'")(
    lambda t: loy.loyalty_accrue(t, _earned(t), AS_OF)[0].select("loyalty_id", "order_id", "points_delta", "expires_on"))
query("job_loyalty_accrue_accounts", f"""
SELECT la.loyalty_id, CAST(la.points_balance + COALESCE(e.p, 0) AS BIGINT) AS points_balance, CAST(CASE WHEN e.p IS NULL THEN la.lifetime_points ELSE COALESCE(la.lifetime_points, 0) + e.p END AS BIGINT) AS lifetime_points
FROM rt_loyalty_account la LEFT JOIN (SELECT loyalty_id, SUM(pts) AS p FROM {_EARN} WHERE status = 'ACTIVE' GROUP BY 1) e ON e.loyalty_id = la.loyalty_id""")(
    lambda t: loy.loyalty_accrue(t, _earned(t), AS_OF)[1].select("loyalty_id", "points_balance", "lifetime_points"))
query("job_loyalty_accrue_rejects", f"""
SELECT loyalty_id, order_id, CASE WHEN status IS NULL THEN CONCAT('Unknown loyalty account ', CAST(loyalty_id AS STRING)) ELSE CONCAT('Loyalty account ', CAST(loyalty_id AS STRING), ' is ', status) END AS reject_reason
FROM {_EARN} WHERE status IS NULL OR status <> 'ACTIVE'""")(lambda t: loy.loyalty_accrue(t, _earned(t), AS_OF)[2].select("loyalty_id", "order_id", "reject_reason"))


def _redeems(t):
    return t.sales_order.filter(c("customer_id").isNotNull()).select(
        c("customer_id").alias("loyalty_id"), c("order_id").alias("request_no"), F.floor(c("subtotal_amount") / 100).cast("bigint").alias("points"))


# requests walked in order per account by recursion, one request per step
_WALK = """
WITH RECURSIVE req AS (SELECT o.customer_id AS lid, o.order_id AS no, CAST(FLOOR(o.subtotal_amount * 100) AS BIGINT) // 10000 AS pts, la.points_balance AS bal,
    ROW_NUMBER() OVER (PARTITION BY o.customer_id ORDER BY o.order_id) AS k
  FROM rt_sales_order o LEFT JOIN rt_loyalty_account la ON la.loyalty_id = o.customer_id WHERE o.customer_id IS NOT NULL),
walk AS (
  SELECT lid, no, pts, k, COALESCE(bal, -1) >= pts AS ok, CASE WHEN COALESCE(bal, -1) >= pts THEN bal - pts ELSE COALESCE(bal, -1) END AS left_ FROM req WHERE k = 1
  UNION ALL
  SELECT r.lid, r.no, r.pts, r.k, w.left_ >= r.pts, CASE WHEN w.left_ >= r.pts THEN w.left_ - r.pts ELSE w.left_ END FROM walk w JOIN req r ON r.lid = w.lid AND r.k = w.k + 1)"""
query("job_loyalty_redeem", f"{_WALK} SELECT lid AS loyalty_id, no AS request_no, CAST(-pts AS BIGINT) AS points_delta FROM walk WHERE ok")(
    lambda t: loy.loyalty_redeem(t, _redeems(t))[0].select("loyalty_id", "request_no", "points_delta"))
query("job_loyalty_redeem_accounts", f"""{_WALK}
SELECT la.loyalty_id, CAST(la.points_balance - COALESCE(u.p, 0) AS BIGINT) AS points_balance FROM rt_loyalty_account la LEFT JOIN (SELECT lid, SUM(pts) AS p FROM walk WHERE ok GROUP BY 1) u ON u.lid = la.loyalty_id""")(
    lambda t: loy.loyalty_redeem(t, _redeems(t))[1].select("loyalty_id", "points_balance"))
query("job_loyalty_redeem_rejects", f"{_WALK} SELECT lid AS loyalty_id, no AS request_no, pts AS points FROM walk WHERE NOT ok")(lambda t: loy.loyalty_redeem(t, _redeems(t))[2])

_DUE = f"(SELECT loyalty_id, SUM(points_delta) AS p FROM rt_loyalty_transaction WHERE txn_type = 'ACCRUE' AND expires_on < {NOW} GROUP BY 1 HAVING SUM(points_delta) > 0)"
query("job_loyalty_expire", f"SELECT loyalty_id, CAST(-p AS BIGINT) AS points_delta, 'AGE_EXPIRY' AS reason_code FROM {_DUE}")(
    lambda t: loy.loyalty_expire(t, AS_OF)[0].select("loyalty_id", "points_delta", "reason_code"))
query("job_loyalty_expire_accounts", f"""
SELECT la.loyalty_id, CAST(CASE WHEN x.p IS NULL THEN la.points_balance ELSE GREATEST(la.points_balance - x.p, 0) END AS BIGINT) AS points_balance FROM rt_loyalty_account la LEFT JOIN {_DUE} x ON x.loyalty_id = la.loyalty_id""")(
    lambda t: loy.loyalty_expire(t, AS_OF)[1].select("loyalty_id", "points_balance"))
query("job_loyalty_review", f"""
SELECT loyalty_id, CASE WHEN status = 'ACTIVE' AND nt <> tier_code THEN nt ELSE tier_code END AS tier_code, CASE WHEN status = 'ACTIVE' AND nt <> tier_code THEN {day(NOW)} ELSE tier_reviewed_date END AS tier_reviewed_date
FROM (SELECT la.*, (SELECT lt.tier_code FROM rt_loyalty_tier lt WHERE lt.min_points <= la.points_balance ORDER BY lt.min_points DESC LIMIT 1) AS nt FROM rt_loyalty_account la)""")(
    lambda t: loy.loyalty_review(t, AS_OF).select("loyalty_id", "tier_code", "tier_reviewed_date"))

# ---- finance ---------------------------------------------------------------------------------------------------------

query("job_sales_journal", f"""
WITH j AS (SELECT *, ROW_NUMBER() OVER (ORDER BY order_id) + 1000 AS jid, subtotal_amount - discount_amount AS net FROM rt_sales_order)
SELECT jid AS journal_id, CAST(1 AS BIGINT) AS line_no, '1100' AS account_code, {d('net')} AS debit_amount, CAST(0 AS DOUBLE) AS credit_amount, currency_code FROM j
UNION ALL SELECT jid, 2, '4000', 0, {d('net')}, currency_code FROM j UNION ALL SELECT jid, 3, '2200', 0, {d('tax_amount')}, currency_code FROM j""")(
    lambda t: fin.sales_journal(t.sales_order, t.gl_period, 1000, AS_OF)[1].select("journal_id", "line_no", "account_code", "debit_amount", "credit_amount", "currency_code"))
query("job_sales_journal_heads", """
SELECT ROW_NUMBER() OVER (ORDER BY order_id) + 1000 AS journal_id, CONCAT('SAL', LPAD(CAST(ROW_NUMBER() OVER (ORDER BY order_id) + 1000 AS STRING), 12, '0')) AS journal_ref,
  (SELECT MAX(period_id) FROM rt_gl_period WHERE status = 'OPEN') AS period_id, CONCAT('Sales order ', CAST(order_id AS STRING)) AS description FROM rt_sales_order""")(
    lambda t: fin.sales_journal(t.sales_order, t.gl_period, 1000, AS_OF)[0].select("journal_id", "journal_ref", "period_id", "description"))


def _postings(t):
    amt = c("subtotal_amount").cast("decimal(16,2)")
    return t.sales_order.select(
        c("order_id").alias("request_id"), F.when(c("order_id") % 50 == 0, F.lit(1)).otherwise(F.year("order_ts") * 100 + F.month("order_ts")).cast("bigint").alias("period_id"),
        F.lit("sales").alias("source_module"), c("order_ts").alias("journal_date"), F.lit("x").alias("description"), F.lit("1100").alias("debit_account"), F.lit("4000").alias("credit_account"),
        F.when(c("order_id") % 9 == 0, -amt).otherwise(amt).alias("debit_amount"), F.when(c("order_id") % 7 == 0, amt + 1).when(c("order_id") % 9 == 0, -amt).otherwise(amt).cast("decimal(16,2)").alias("credit_amount"),
        F.when(c("order_id") % 2 == 0, c("currency_code")).alias("currency_code"))


_POST = """(SELECT q.*, p.status AS ps, CASE WHEN p.status IS NULL THEN CONCAT('Unknown GL period: ', CAST(q.period_id AS STRING)) WHEN p.status = 'CLOSED' THEN CONCAT('GL period ', CAST(q.period_id AS STRING), ' is closed; journal not posted')
    WHEN dr < 0 OR cr < 0 THEN 'Journal amounts must be non-negative' WHEN dr <> cr THEN CONCAT('Unbalanced journal: debit ', CAST(dr AS STRING), ' <> credit ', CAST(cr AS STRING)) END AS why FROM (
  SELECT order_id AS request_id, CASE WHEN order_id % 50 = 0 THEN 1 ELSE CAST(EXTRACT(YEAR FROM order_ts) * 100 + EXTRACT(MONTH FROM order_ts) AS BIGINT) END AS period_id,
    CAST(CASE WHEN order_id % 9 = 0 THEN -subtotal_amount ELSE subtotal_amount END AS DECIMAL(16,2)) AS dr,
    CAST(CASE WHEN order_id % 7 = 0 THEN subtotal_amount + 1 WHEN order_id % 9 = 0 THEN -subtotal_amount ELSE subtotal_amount END AS DECIMAL(16,2)) AS cr,
    CASE WHEN order_id % 2 = 0 THEN currency_code ELSE 'USD' END AS ccy FROM rt_sales_order) q LEFT JOIN rt_gl_period p ON p.period_id = q.period_id)"""
_GOODJ = f"(SELECT *, ROW_NUMBER() OVER (ORDER BY request_id) + 5000 AS jid FROM {_POST} WHERE why IS NULL)"
query("job_journal_post", f"""
SELECT jid AS journal_id, CAST(1 AS BIGINT) AS line_no, '1100' AS account_code, {d('dr')} AS debit_amount, CAST(0 AS DOUBLE) AS credit_amount, ccy AS currency_code FROM {_GOODJ}
UNION ALL SELECT jid, 2, '4000', 0, {d('cr')}, ccy FROM {_GOODJ}""")(
    lambda t: fin.journal_post(_postings(t), t.gl_period, 5000, AS_OF)[1].select("journal_id", "line_no", "account_code", "debit_amount", "credit_amount", "currency_code"))
query("job_journal_post_control", f"""
SELECT CONCAT('SAL-', CAST(jid AS STRING)) AS pk_value, CONCAT('DR=', CAST(dr AS STRING), ' CR=', CAST(cr AS STRING), ' LINES=2') AS new_row FROM {_GOODJ}""")(
    lambda t: fin.journal_post(_postings(t), t.gl_period, 5000, AS_OF)[2].select("pk_value", "new_row"))
query("job_journal_post_rejects", f"SELECT request_id, why AS reject_reason FROM {_POST} WHERE why IS NOT NULL")(lambda t: fin.journal_post(_postings(t), t.gl_period, 5000, AS_OF)[3])

_GLS = """(SELECT p.period_id, p.status, COALESCE(x.u, 0) AS u, COALESCE(x.dft, 0) AS dft FROM rt_gl_period p LEFT JOIN (
  SELECT j.period_id, COUNT(*) FILTER (s.dr <> s.cr) AS u, COUNT(*) FILTER (j.status = 'DRAFT') AS dft FROM rt_gl_journal j
  LEFT JOIN (SELECT journal_id, SUM(debit_amount) AS dr, SUM(credit_amount) AS cr FROM rt_gl_journal_line GROUP BY 1) s ON s.journal_id = j.journal_id GROUP BY 1) x ON x.period_id = p.period_id)"""
query("job_gl_close", f"SELECT period_id, CASE WHEN status <> 'CLOSED' AND u = 0 AND dft = 0 THEN 'CLOSED' ELSE status END AS status FROM {_GLS}")(
    lambda t: fin.gl_close(t, t.gl_period, AS_OF)[0].select("period_id", "status"))
query("job_gl_close_rejects", f"""
SELECT period_id, CASE WHEN status = 'CLOSED' THEN CONCAT('GL period ', CAST(period_id AS STRING), ' is already closed')
  ELSE CONCAT('Cannot close period ', CAST(period_id AS STRING), ': ', CAST(u AS STRING), ' unbalanced journal(s), ', CAST(dft AS STRING), ' draft journal(s)') END AS reject_reason
FROM {_GLS} WHERE status = 'CLOSED' OR u > 0 OR dft > 0""")(lambda t: fin.gl_close(t, t.gl_period, AS_OF)[1])
query("job_gl_close_forced", "SELECT period_id, 'CLOSED' AS status FROM rt_gl_period")(lambda t: fin.gl_close(t, t.gl_period, AS_OF, force=True)[0].select("period_id", "status"))
query("job_journal_batch")(lambda t: fin.journal_batch(t.gl_journal, 50))

# ---- catalogue ---------------------------------------------------------------------------------------------------------


def _skus(t):
    return t.product.select(F.when(c("product_id") % 3 == 0, F.concat(F.lit("?"), c("sku"))).otherwise(c("sku")).alias("sku"))


query("job_retire_skus", """
SELECT p.product_id, CASE WHEN p.product_id % 3 <> 0 THEN 'DISCONTINUED' ELSE p.status END AS status,
  CASE WHEN p.product_id % 3 <> 0 THEN 'N' ELSE v.is_active END AS is_active FROM rt_product p JOIN rt_product_variant v ON v.product_id = p.product_id""")(
    lambda t: (lambda n: n.product.select("product_id", "status").join(n.product_variant.select("product_id", "is_active"), "product_id"))(cat.retire_skus(t, _skus(t))[0]))
query("job_retire_skus_rejects", "SELECT CONCAT('?', sku) AS sku, CONCAT('Unknown SKU: ?', sku) AS reject_reason FROM rt_product WHERE product_id % 3 = 0")(lambda t: cat.retire_skus(t, _skus(t))[1])


def _new_products(t):
    """New SKUs from the catalogue: some known already, some repeated, some without category or brand."""
    p = t.product.join(t.product_category.select("category_id", "category_code"), "category_id").join(t.brand.select("brand_id", "brand_code"), "brand_id", "left")
    sku = F.when(c("product_id") % 5 == 0, c("sku")).otherwise(F.concat(F.lit("NEW-"), F.floor(c("product_id") / 2).cast("string")))
    return p.select(c("product_id").alias("seq"), sku.alias("sku"), "product_name", F.when(c("product_id") % 11 == 0, "NOWHERE").otherwise(c("category_code")).alias("category_code"),
                    "brand_code", F.when(c("product_id") % 3 != 0, c("list_price")).alias("list_price"), F.when(c("product_id") % 3 != 0, c("unit_cost")).alias("unit_cost"))


_NEWP = """(SELECT p.*, CASE WHEN p.product_id % 5 = 0 THEN p.sku ELSE CONCAT('NEW-', CAST(CAST(FLOOR(p.product_id / 2) AS BIGINT) AS STRING)) END AS nsku, b.brand_id AS bid
  FROM rt_product p LEFT JOIN rt_brand b ON b.brand_id = p.brand_id)"""
_FRESH = f"(SELECT *, ROW_NUMBER() OVER (PARTITION BY nsku ORDER BY product_id) AS k FROM {_NEWP} WHERE product_id % 11 <> 0 AND product_id % 5 <> 0)"
query("job_products_add", f"""
SELECT 60000000 + ROW_NUMBER() OVER (ORDER BY product_id) AS product_id, nsku AS sku, category_id, bid AS brand_id, CASE WHEN product_id % 3 <> 0 THEN 'ACTIVE' ELSE 'DRAFT' END AS status,
  {d('CASE WHEN product_id % 3 <> 0 THEN list_price ELSE 0 END')} AS list_price FROM {_FRESH} WHERE k = 1""")(
    lambda t: cat.products_add(t, _new_products(t), 60_000_000, AS_OF)[0].select("product_id", "sku", "category_id", "brand_id", "status", "list_price"))
query("job_products_add_rejects", f"""
SELECT product_id AS seq, CASE WHEN product_id % 11 = 0 THEN 'Unknown category code: NOWHERE' ELSE CONCAT('Duplicate SKU: ', nsku) END AS reject_reason FROM {_NEWP}
WHERE product_id % 11 = 0 OR product_id % 5 = 0 OR product_id IN (SELECT product_id FROM {_FRESH} WHERE k > 1)""")(
    lambda t: cat.products_add(t, _new_products(t), 60_000_000, AS_OF)[1].select("seq", "reject_reason"))


def _contacts(t):
    s = t.supplier
    return s.select((c("supplier_id") + F.when(c("supplier_id") % 13 == 0, 1_000_000).otherwise(0)).alias("supplier_id"), F.when(
        c("supplier_id") % 5 != 0, F.struct(F.lit("New").alias("contact_name"), F.when(c("supplier_id") % 4 == 0, "nope").otherwise("a.b@c.org").alias("email"), F.lit("Buyer").alias("role_title"))).alias("contact"))


_CWHY = """CASE WHEN supplier_id % 5 = 0 THEN 'Contact must not be null' WHEN supplier_id % 4 = 0 THEN CONCAT('Invalid contact email for supplier ', CAST(sid AS STRING))
  WHEN supplier_id % 13 = 0 THEN CONCAT('Unknown supplier ', CAST(sid AS STRING)) END"""
_CSRC = f"(SELECT *, {_CWHY} AS why FROM (SELECT *, supplier_id + CASE WHEN supplier_id % 13 = 0 THEN 1000000 ELSE 0 END AS sid FROM rt_supplier))"
query("job_contact_update", f"SELECT supplier_id, CASE WHEN why IS NULL THEN 'a.b@c.org' ELSE contact_email END AS email FROM {_CSRC}")(
    lambda t: cat.contact_update(t.supplier, _contacts(t))[0].select("supplier_id", c("primary_contact.email").alias("email")))
query("job_contact_update_rejects", f"SELECT sid AS supplier_id, why AS reject_reason FROM {_CSRC} WHERE why IS NOT NULL")(lambda t: cat.contact_update(t.supplier, _contacts(t))[1])

_EXP = f"(SELECT promotion_id, CASE WHEN status IN ('ACTIVE', 'DRAFT') AND end_ts < CAST('1999-01-01' AS TIMESTAMP) THEN 'EXPIRED' ELSE status END AS status FROM rt_promotion)"
query("job_promotions_expire", f"""
SELECT o.order_id, o.promotion_id, p.status FROM rt_sales_order o JOIN {_EXP} p ON p.promotion_id = o.promotion_id""")(
    lambda t: t.sales_order.select("order_id", "promotion_id").join(cat.promotions_expire(t.promotion, "1999-01-01")[0].select("promotion_id", "status"), "promotion_id"))

# ---- batches -----------------------------------------------------------------------------------------------------------------

query("job_region_refresh_counts", """
SELECT 'REGION_REFRESH' AS rule_code, s.store_code AS entity_key, CONCAT('CTRY03 orders=', CAST(COUNT(o.order_id) AS STRING)) AS detail FROM rt_store s JOIN rt_region g ON g.region_id = s.region_id
LEFT JOIN rt_sales_order o ON o.store_id = s.store_id AND o.order_ts >= CAST('1998-01-01' AS TIMESTAMP) WHERE g.region_code = 'CTRY03' GROUP BY s.store_code""")(
    lambda t: b.region_refresh(t, "CTRY03", "1998-01-01", 0).select("rule_code", "entity_key", "detail"))
query("job_region_refresh_stores", """
SELECT s.store_code AS entity_key, CONCAT('CTRY03 store_id=', CAST(s.store_id AS STRING)) AS detail FROM rt_store s JOIN rt_region g ON g.region_id = s.region_id WHERE g.region_code = 'CTRY03'""")(
    lambda t: b.region_refresh(t, "CTRY03", "1998-01-01", 1).select("entity_key", "detail"))
query("job_region_refresh", """
WITH x AS (SELECT CAST(o.order_ts AS DATE) AS dy, SUM(o.subtotal_amount) AS net FROM rt_sales_order o JOIN rt_store s ON s.store_id = o.store_id JOIN rt_region g ON g.region_id = s.region_id
  WHERE g.region_code = 'CTRY03' AND o.order_ts >= CAST('1998-01-01' AS TIMESTAMP) GROUP BY 1)
SELECT STRFTIME(dy, '%Y-%m-%d') AS entity_key, CONCAT('net=', CAST(net AS STRING), ' delta=', CAST(CAST(COALESCE(net - LAG(net) OVER (ORDER BY dy), 0) AS DECIMAL(25,2)) AS STRING)) AS detail FROM x""")(
    lambda t: b.region_refresh(t, "CTRY03", "1998-01-01", 2).select("entity_key", "detail"))
query("job_category_stage", """
SELECT pv.variant_sku AS entity_key, CONCAT(COALESCE(pv.barcode_ean13, CAST(pv.variant_id AS STRING)), '/', COALESCE(NULLIF(TRIM(pv.colour_code), ''), 'UNSPEC'), '/', COALESCE(pv.size_code, 'ONESIZE')) AS detail
FROM rt_product_variant pv JOIN rt_product p ON p.product_id = pv.product_id JOIN rt_product_category c ON c.category_id = p.category_id WHERE c.category_code = 'SMALL_4_1'""")(
    lambda t: b.category_stage(t, "SMALL_4_1", 1).select("entity_key", "detail"))
query("job_category_stage_active", """
SELECT pv.variant_sku AS entity_key, CONCAT(c.category_name, ' nightly stage') AS detail FROM rt_product_variant pv JOIN rt_product p ON p.product_id = pv.product_id
JOIN rt_product_category c ON c.category_id = p.category_id WHERE c.category_code = 'SMALL_4_1' AND pv.is_active = 'Y'""")(lambda t: b.category_stage(t, "SMALL_4_1", 0).select("entity_key", "detail"))

query("job_interface_batch", """
SELECT 'PIM_STAGED' AS rule_code, 'product' AS entity_name, CAST(variant_id AS STRING) AS entity_key, 'INFO' AS severity, CONCAT('REF-1 staged variant ', CAST(variant_id AS STRING)) AS detail FROM rt_product_variant WHERE is_active = 'Y'""")(
    lambda t: b.interface_batch(t, "PIM", "IN", 0, None, "REF-1"))
query("job_interface_batch_sync", """
SELECT rule_code, entity_name, entity_key, detail FROM rt_data_quality_issue
UNION ALL SELECT 'PIM_SYNC', 'product', CAST(variant_id AS STRING), 'REF-4' FROM rt_product_variant WHERE is_active = 'Y'""")(
    lambda t: b.interface_sync(t.data_quality_issue, b.interface_batch(t, "PIM", "IN", 1, None, "REF-4"), AS_OF).select("rule_code", "entity_name", "entity_key", "detail"))
query("job_interface_batch_count", "SELECT 'POS_DYN' AS rule_code, 'sales_order_line' AS entity_key, CONCAT('REF-2 rows=', CAST(COUNT(*) AS STRING)) AS detail FROM rt_sales_order_line")(
    lambda t: b.interface_batch(t, "POS", "OUT", 2, None, "REF-2", "sales_order_line").select("rule_code", "entity_key", "detail"))
query("job_interface_batch_routes", """
WITH tree AS (
  SELECT *, 1 AS lv, CONCAT('/', region_code) AS p, region_code AS rc FROM rt_region WHERE parent_region_id IS NULL
  UNION ALL
  SELECT r.*, t.lv + 1, CONCAT(t.p, '/', r.region_code), t.rc FROM tree t JOIN rt_region r ON r.parent_region_id = t.region_id)
SELECT 'TMS_ROUTE' AS rule_code, region_code AS entity_key, CONCAT('depth=', CAST(lv AS STRING), ' root=', rc, ' leaf=',
  CASE WHEN region_id IN (SELECT parent_region_id FROM rt_region WHERE parent_region_id IS NOT NULL) THEN '0' ELSE '1' END, ' path=', p) AS detail FROM tree""")(
    lambda t: b.interface_batch(t, "TMS", "IN", 3, None, "REF-3").select("rule_code", "entity_key", "detail"))
query("job_interface_reconcile", """
SELECT 'WMS' AS system_code, COUNT(*) AS rows_processed, CONCAT('WMS reconciled ', CAST(COUNT(*) AS STRING), ' orders') AS message FROM rt_sales_order
WHERE order_ts >= CAST('1997-01-01' AS TIMESTAMP) AND order_ts < CAST('1997-07-01' AS TIMESTAMP)""")(lambda t: b.reconcile_count(t, "WMS", "1997-01-01", "1997-07-01"))
query("job_interface_pending", "SELECT COUNT(*) AS pending FROM rt_data_quality_issue WHERE entity_name = 'STORE' AND resolved_ts IS NULL AND rule_code LIKE 'RULE%'")(
    lambda t: b.pending_count(t, "RULE", "STORE"))
query("job_interface_keys", """
SELECT customer_id, CONCAT('CRM:N:', CAST(customer_id AS STRING)) AS num_key, CONCAT('CRM:C:', COALESCE(UPPER(TRIM(email)), '<none>')) AS text_key, CONCAT('CRM:D:', STRFTIME(birth_date, '%Y-%m-%d')) AS date_key FROM rt_customer""")(
    lambda t: b.resolve_key("CRM", "birth_date", "date", b.resolve_key("CRM", "email", "text", b.resolve_key("CRM", "customer_id", "number", t.customer, "num_key"), "text_key"), "date_key")
    .select("customer_id", "num_key", "text_key", "date_key"))

# ---- outbound files -----------------------------------------------------------------------------------------------------------

_EXTRACT = """SELECT o.order_id, o.order_number, STRFTIME(o.order_ts, '%Y-%m-%dT%H:%M:%S') AS order_ts, s.store_code, o.channel_code AS channel, o.currency_code AS currency,
  CAST(CAST(o.subtotal_amount - o.discount_amount AS DECIMAL(14,2)) AS STRING) AS net_amount FROM rt_sales_order o JOIN rt_store s ON s.store_id = o.store_id
WHERE o.order_ts >= CAST('{0}' AS TIMESTAMP) AND o.order_ts < CAST('{1}' AS TIMESTAMP)"""
query("sink_sales_extract", _EXTRACT.format("1998-01-01", "1999-01-01"))(lambda t: ex.sales_extract(t, "1998-01-01", "1998-12-31"))


def _folder(t, name: str) -> str:
    return os.path.join(shared_dir(t.spark), name, uuid.uuid4().hex)


def _exported(t):
    """A day's export as its file has it, beside the record of its run."""
    out = _folder(t, "export")
    path = b.export_daily(t, "1998-03-02", out)
    log = t.spark.read.parquet(f"{out}/job_run_log").select("job_name", c("status").alias("run_status"), c("rows_processed").alias("run_rows"))
    return beside(t.spark.read.option("header", True).schema("order_id long, order_number string, order_ts string, store_code string, channel string, currency string, net_amount string").csv(path), log)


def _export_fails(t):
    """The second export finds the first one's file: its error is recorded and nothing is raised."""
    out = _folder(t, "export")
    for _ in range(2):
        b.export_daily(t, "1998-03-02", out)
    return t.spark.read.parquet(f"{out}/job_run_log").select("job_name", "status", F.coalesce("rows_processed", F.lit(-1)).alias("rows"), c("message").contains("already exists").alias("says_why"))


_DAY = _EXTRACT.format("1998-03-02", "1998-03-03")
query("job_export_daily", f"SELECT x.*, 'EXPORT_DAILY_SALES' AS job_name, 'SUCCESS' AS run_status, COUNT(*) OVER () AS run_rows FROM ({_DAY}) x")(_exported)
query("job_export_daily_failure", f"""SELECT 'EXPORT_DAILY_SALES' AS job_name, 'SUCCESS' AS status, COUNT(*) AS rows, CAST(NULL AS BOOLEAN) AS says_why FROM ({_DAY})
UNION ALL SELECT 'EXPORT_DAILY_SALES', 'FAILED', -1, TRUE""")(_export_fails)

_LINE = """CONCAT(LPAD(CAST(l.line_no AS STRING), 4, ' '), ' ', RPAD(SUBSTR(pv.variant_sku, 1, 20), 22, ' '), RPAD(SUBSTR(p.product_name, 1, 40), 42, ' '),
  LPAD(CAST(CAST(l.qty AS DECIMAL(12,3)) AS STRING), 12, ' '), LPAD(CAST(CAST(l.unit_price AS DECIMAL(12,4)) AS STRING), 14, ' '),
  LPAD(CAST(CAST(ROUND(l.qty * l.unit_price - l.discount_amount + l.tax_amount, 2) AS DECIMAL(16,2)) AS STRING), 14, ' '), CHR(10))"""
query("sink_order_document", f"""
SELECT o.order_id, CONCAT('ORDER ', o.order_number, ' / ', s.store_code, ' / ', o.channel_code, CHR(10), 'Placed: ', STRFTIME(o.order_ts, '%Y-%m-%d %H:%M:%S'), CHR(10), 'Status: ', o.status, CHR(10),
  REPEAT('-', 40), CHR(10), COALESCE(x.body, ''), '-- generated now', CHR(10)) AS doc
FROM rt_sales_order o JOIN rt_store s ON s.store_id = o.store_id LEFT JOIN (
  SELECT l.order_id, STRING_AGG({_LINE}, '' ORDER BY l.line_no, l.variant_id, {_LINE}) AS body FROM rt_sales_order_line l JOIN rt_product_variant pv ON pv.variant_id = l.variant_id
  JOIN rt_product p ON p.product_id = pv.product_id GROUP BY 1) x ON x.order_id = o.order_id""")(lambda t: ex.order_documents(t, "now"))

def _archived(t):
    """Every year with orders, written one folder a year and read back."""
    years = [r[0] for r in t.sales_order.select(F.year("order_ts")).distinct().collect() if r[0] is not None]  # a row a year
    path = _folder(t, "archive")
    ex.write_archive(ex.archive_orders(t, years, 50_000, 40), path)
    return t.spark.read.parquet(path).select("archive_year", "order_id", "line_no", "variant_id", "amount_ok", "qty_ok")


query("sink_archive_year", f"""
SELECT CAST(EXTRACT(YEAR FROM o.order_ts) AS BIGINT) AS archive_year, o.order_id, l.line_no, l.variant_id, CASE WHEN {NET} + l.tax_amount BETWEEN 0 AND 50000 THEN 'Y' ELSE 'N' END AS amount_ok,
  CASE WHEN l.qty <= 40 THEN 'Y' ELSE 'N' END AS qty_ok FROM rt_sales_order o JOIN rt_sales_order_line l ON l.order_id = o.order_id""")(_archived)


def _feed(t):
    return t.sales_order_line.join(t.product_variant.select("variant_id", "variant_sku"), "variant_id").select(
        "order_id", "line_no", "variant_id", F.when(c("line_no") == 7, "  ").otherwise(F.concat(F.lit(" "), F.lower("variant_sku"))).alias("variant_sku"),
        (c("qty") * F.when(c("line_no") == 6, 100_000).otherwise(1)).alias("qty"), F.when(c("line_no") == 5, "gbp").otherwise("GBP").alias("currency_code"))


query("src_staging", f"""
SELECT l.order_id, l.line_no, l.variant_id, CASE WHEN l.line_no = 7 THEN NULL ELSE UPPER(pv.variant_sku) END AS variant_sku, 'PIM' AS source_system,
  CASE WHEN l.line_no = 7 OR (l.line_no = 6 AND l.qty * 100000 > 1000000) OR l.line_no = 5 THEN 'REJECTED' ELSE 'VALID' END AS status
FROM rt_sales_order_line l JOIN rt_product_variant pv ON pv.variant_id = l.variant_id""")(
    lambda t: ex.stage_feed(_feed(t), "PIM", "FOOTWEAR", AS_OF).select("order_id", "line_no", "variant_id", "variant_sku", "source_system", "status"))

query("src_ref_partition", """
SELECT l.order_id, l.line_no, l.variant_id, CAST(FLOOR(DATE_DIFF('day', DATE '2024-01-01', CAST(o.order_ts AS DATE)) / 30.0) AS BIGINT) AS part_bucket
FROM rt_sales_order_line l JOIN rt_sales_order o ON o.order_id = l.order_id""")(
    lambda t: ex.copartition_child(t.sales_order, t.sales_order_line, "order_id", ex.PartitionSpec(ts="order_ts", every=30)).select("order_id", "line_no", "variant_id", "part_bucket"))

MOVES = ex.PartitionSpec(ts="movement_ts", list_col="movement_type", values=("RECEIPT", "SALE", "RETURN", "TRANSFER"))


def _partitioned(t):
    path = _folder(t, "partitioned")
    ex.write_partitioned(t.inventory_movement, MOVES, path)
    return ex.read_partitioned(t.spark, path, MOVES, "1997-03-10", "1998-02-01", ("SALE", "ADJUST")).select("movement_id", "variant_id", "movement_type", "part_list")


query("src_partitioned", """
SELECT movement_id, variant_id, movement_type, CASE WHEN movement_type IN ('RECEIPT', 'SALE', 'RETURN', 'TRANSFER') THEN movement_type ELSE 'DEFAULT' END AS part_list
FROM rt_inventory_movement WHERE movement_ts >= CAST('1997-03-10' AS TIMESTAMP) AND movement_ts < CAST('1998-02-01' AS TIMESTAMP) AND movement_type IN ('SALE', 'ADJUST')""")(_partitioned)
