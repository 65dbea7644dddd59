"""The retail model bound to the star-schema test tables.

Each entry is one SELECT in the dialect Spark and ANSI engines share, so the same text feeds the
Spark jobs and the checking engine. `{orders}` names a given table, `{rt_store}` another entry.
Fixed master data (countries, tiers, price lists) hangs off nation and region; everything that
should grow hangs off orders, lineitem, customer, part, supplier or events.
"""

from __future__ import annotations

import re
from functools import lru_cache

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

AS_OF = "2001-08-02 00:00:00"


def _pad(expr: str, width: int) -> str:
    return f"LPAD(CAST({expr} AS STRING), {width}, '0')"


def _money(expr: str, p: int = 14, s: int = 2) -> str:
    return f"CAST({expr} AS DECIMAL({p},{s}))"


def _pct_of(expr: str, pct: str, p: int = 14, s: int = 2) -> str:
    return f"CAST(ROUND({_money(expr)} * CAST({pct} AS DECIMAL(4,2)), {s}) AS DECIMAL({p},{s}))"


def _ts(literal: str) -> str:
    return f"CAST('{literal}' AS TIMESTAMP)"


def _days(base: str, n: str) -> str:
    return f"({base} + INTERVAL '1' DAY * ({n}))"


def _currency(region_expr: str) -> str:
    return (
        f"CASE {region_expr} WHEN 0 THEN 'GBP' WHEN 1 THEN 'USD' WHEN 2 THEN 'JPY' "
        f"WHEN 3 THEN 'EUR' ELSE 'CHF' END"
    )


def _union(branches) -> str:
    return "\n        UNION ALL\n        ".join(branches)


_ROOTS = (("1", "ASSET", "D"), ("2", "LIABILITY", "C"), ("4", "REVENUE", "C"), ("5", "EXPENSE", "D"))

_TYPE_NO = (
    "CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 "
    "WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END"
)
_BRAND_NO = "CAST(SUBSTR(p_brand, 7) AS BIGINT)"
_LEAF = f"(100000 + {_TYPE_NO} * 10000 + {_BRAND_NO} * 10 + p_size % 5)"
_MONTH_NO = "((EXTRACT(YEAR FROM {0}) - 1990) * 12 + EXTRACT(MONTH FROM {0}))"
_PO_ID = "CAST(l_suppkey * 1000 + " + _MONTH_NO.format("l_shipdate") + " AS BIGINT)"
_STORE = "(o_custkey % 25)"
_UNIT_COST = "CAST(100 + l_partkey % 900 AS DECIMAL(12,4))"
_LINE_QTY = "CAST(l_quantity AS DECIMAL(12,3))"
_ACC = "CONCAT('{0}', " + _pad(_STORE, 3) + ", CAST(o_orderkey % 5 AS STRING))"

BINDING: dict[str, str] = {
    # ---- reference data -------------------------------------------------------------------
    "rt_currency": f"""
        SELECT {_currency('r_regionkey')} AS currency_code, CONCAT(r_name, ' unit') AS currency_name,
               CASE WHEN r_regionkey = 2 THEN 0 ELSE 2 END AS minor_units,
               CASE WHEN r_regionkey = 4 THEN 'N' ELSE 'Y' END AS is_active
        FROM {{region}}""",
    "rt_country": f"""
        SELECT CONCAT('N', {_pad('n_nationkey', 2)}) AS country_code, n_name AS country_name,
               {_currency('n_regionkey')} AS currency_code,
               CASE n_nationkey % 3 WHEN 0 THEN 'VAT' WHEN 1 THEN 'GST' ELSE 'SALES_TAX' END AS vat_scheme,
               CASE n_nationkey % 6 WHEN 0 THEN 'Europe/London' WHEN 1 THEN 'America/New_York'
                    WHEN 2 THEN 'Asia/Tokyo' WHEN 3 THEN 'Europe/Berlin' WHEN 4 THEN 'Australia/Sydney'
                    ELSE 'America/Sao_Paulo' END AS tz_name
        FROM {{nation}}""",
    "rt_exchange_rate": _union(
        f"""SELECT m.month_start AS rate_date, {_currency(str(r))} AS from_currency, 'GBP' AS to_currency,
               CAST(CAST(50 + {r} * 17 + EXTRACT(MONTH FROM m.month_start) AS DECIMAL(10,0))
                    * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(18,8)) AS rate
        FROM (SELECT DISTINCT CAST(DATE_TRUNC('month', o_orderdate) AS TIMESTAMP) AS month_start FROM {{orders}}) m
        WHERE (EXTRACT(MONTH FROM m.month_start) + {r}) % 4 <> 0""" for r in (1, 2, 3)),
    "rt_region": f"""
        SELECT CAST(1 AS BIGINT) AS region_id, 'WORLD' AS region_code, 'World' AS region_name,
               'N00' AS country_code, CAST(NULL AS BIGINT) AS parent_region_id, 'GLOBAL' AS region_level
        FROM {{region}} WHERE r_regionkey = 0
        UNION ALL
        SELECT CAST(10 + r_regionkey AS BIGINT), CONCAT('AREA', CAST(r_regionkey AS STRING)), r_name,
               'N00', CAST(1 AS BIGINT), 'AREA' FROM {{region}}
        UNION ALL
        SELECT CAST(100 + n_nationkey AS BIGINT), CONCAT('CTRY', {_pad('n_nationkey', 2)}), n_name,
               CONCAT('N', {_pad('n_nationkey', 2)}), CAST(10 + n_regionkey AS BIGINT),
               CASE WHEN n_nationkey = 7 THEN 'RETIRED' ELSE 'COUNTRY' END FROM {{nation}}
        UNION ALL
        SELECT CAST(1000 + s_suppkey AS BIGINT), CONCAT('DIST', {_pad('s_suppkey', 7)}), s_name,
               CONCAT('N', {_pad('s_nationkey', 2)}), CAST(100 + s_nationkey AS BIGINT),
               CASE WHEN s_suppkey % 10 = 3 THEN 'RETIRED' ELSE 'DISTRICT' END FROM {{supplier}}""",
    "rt_tax_rate": _union(
        f"""SELECT CAST(n_nationkey * 10 + {r} AS BIGINT) AS tax_rate_id, CONCAT('N', {_pad('n_nationkey', 2)}) AS country_code,
               '{("STD", "RED", "ZER", "STD")[r]}' AS tax_code,
               CAST({("18 + n_nationkey % 5", "5 + n_nationkey % 3", "0", "15")[r]} AS DECIMAL(5,2)) AS rate_pct,
               {_ts('1998-01-01 00:00:00' if r == 0 else '1994-01-01 00:00:00')} AS valid_from,
               CASE WHEN {r} = 3 THEN {_ts('1998-01-01 00:00:00')}
                    WHEN {r} = 1 AND n_nationkey % 4 = 0 THEN {_ts('2000-01-01 00:00:00')} END AS valid_to
        FROM {{nation}} WHERE n_nationkey <> 24""" for r in range(4)),
    # ---- parties and stores ---------------------------------------------------------------
    "rt_address": f"""
        SELECT c_custkey AS address_id, CONCAT(' ', CAST(c_custkey AS STRING), ' Main St ') AS line1,
               CASE c_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN NULL
                    ELSE CONCAT('Unit ', CAST(c_custkey % 40 AS STRING)) END AS line2,
               c_mktsegment AS city,
               CASE WHEN c_custkey % 14 = 5 THEN NULL ELSE {_pad('c_custkey * 7 % 100000', 5)} END AS postal_code,
               CONCAT('N', {_pad('c_nationkey', 2)}) AS country_code
        FROM {{customer}}""",
    "rt_employee": f"""
        SELECT CAST(c_custkey / 5 AS BIGINT) AS employee_id,
               CONCAT('E', {_pad('CAST(c_custkey / 5 AS BIGINT)', 8)}) AS employee_number,
               CONCAT('First', CAST(c_custkey AS STRING)) AS first_name,
               CONCAT('Last', CAST(c_custkey % 50 AS STRING)) AS last_name,
               c_mktsegment AS job_title, CAST(c_nationkey AS BIGINT) AS store_id,
               CASE WHEN c_custkey = 0 THEN NULL
                    ELSE CAST(FLOOR((c_custkey / 5 - 1) / 8.0) AS BIGINT) END AS manager_id,
               {_days(_ts('1990-01-01 00:00:00'), 'c_custkey % 2000')} AS hire_date,
               CASE WHEN c_custkey % 55 = 10 THEN {_ts('2000-06-30 00:00:00')} END AS termination_date
        FROM {{customer}} WHERE c_custkey % 5 = 0""",
    "rt_store": f"""
        SELECT CAST(n_nationkey AS BIGINT) AS store_id, CONCAT('ST', {_pad('n_nationkey', 4)}) AS store_code,
               n_name AS store_name, CAST(100 + n_nationkey AS BIGINT) AS region_id,
               CAST(n_nationkey AS BIGINT) AS address_id,
               CASE n_nationkey % 6 WHEN 0 THEN 'HYPER' WHEN 1 THEN 'SUPER' WHEN 2 THEN 'EXPRESS'
                    WHEN 3 THEN 'OUTLET' WHEN 4 THEN 'ONLINE' ELSE NULL END AS store_format,
               {_days(_ts('1990-01-31 00:00:00'), 'n_nationkey * 31')} AS opened_date,
               CASE WHEN n_nationkey % 12 = 11 THEN {_ts('2000-01-01 00:00:00')} END AS closed_date,
               CASE WHEN n_nationkey % 8 = 5 THEN NULL
                    ELSE CAST(500 + n_nationkey * 37 AS DECIMAL(8,2)) END AS selling_area_sqm,
               420 + (n_nationkey % 4) * 45 AS opening_minutes,
               1200 + (n_nationkey % 3) * 60 AS closing_minutes,
               36 + n_nationkey % 24 AS refit_months,
               CAST(n_nationkey AS BIGINT) AS manager_employee_id
        FROM {{nation}}""",
    # ---- catalogue ------------------------------------------------------------------------
    "rt_product_category": f"""
        SELECT CAST(1 AS BIGINT) AS category_id, 'ALL' AS category_code, 'All goods' AS category_name,
               CAST(NULL AS BIGINT) AS parent_category_id, CAST(0 AS BIGINT) AS sort_order
        FROM {{region}} WHERE r_regionkey = 0
        UNION ALL
        SELECT DISTINCT CAST(10 + {_TYPE_NO} AS BIGINT), p_type, p_type, CAST(1 AS BIGINT),
               CAST({_TYPE_NO} AS BIGINT) FROM {{part}}
        UNION ALL
        SELECT DISTINCT CAST({_TYPE_NO} * 1000 + {_BRAND_NO} AS BIGINT),
               CONCAT(p_type, '_', CAST({_BRAND_NO} AS STRING)), CONCAT(p_brand, ' ', p_type),
               CAST(10 + {_TYPE_NO} AS BIGINT), {_BRAND_NO} FROM {{part}}
        UNION ALL
        SELECT DISTINCT CAST({_LEAF} AS BIGINT),
               CONCAT(p_type, '_', CAST({_BRAND_NO} AS STRING), '_', CAST(p_size % 5 AS STRING)),
               CONCAT(p_brand, ' ', p_type, ' size ', CAST(p_size % 5 AS STRING)),
               CAST({_TYPE_NO} * 1000 + {_BRAND_NO} AS BIGINT), CAST(p_size % 5 AS BIGINT) FROM {{part}}""",
    "rt_brand": f"""
        SELECT DISTINCT {_BRAND_NO} AS brand_id, UPPER(p_brand) AS brand_code, p_brand AS brand_name,
               CASE WHEN {_BRAND_NO} % 5 = 0 THEN 'Y' ELSE 'N' END AS is_own_label
        FROM {{part}}""",
    "rt_product": f"""
        SELECT p_partkey AS product_id, CONCAT(p_brand, '-', CAST(p_partkey AS STRING)) AS sku,
               p_name AS product_name, CAST({_LEAF} AS BIGINT) AS category_id,
               CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE {_BRAND_NO} END AS brand_id,
               CAST({_money('p_retailprice', 10, 2)} * CAST(CASE WHEN p_partkey % 50 = 7 THEN 1.10 ELSE 0.60 END
                    AS DECIMAL(4,2)) AS DECIMAL(12,4)) AS unit_cost,
               {_money('p_retailprice', 12, 4)} AS list_price,
               CASE p_size % 10 WHEN 0 THEN 'DISCONTINUED' WHEN 9 THEN 'DRAFT' ELSE 'ACTIVE' END AS status,
               CASE WHEN p_partkey % 13 = 0 THEN NULL
                    ELSE {_days(_ts('1994-01-01 00:00:00'), 'p_partkey % 3500')} END AS launch_date
        FROM {{part}}""",
    "rt_product_variant": f"""
        SELECT p_partkey AS variant_id, p_partkey AS product_id,
               CONCAT(p_brand, '-', CAST(p_partkey AS STRING), '-V') AS variant_sku,
               CASE WHEN p_partkey % 21 = 0 THEN NULL
                    ELSE CONCAT('200', {_pad('p_partkey', 9)}, CAST(p_partkey % 10 AS STRING)) END AS barcode_ean13,
               CASE WHEN p_size % 4 = 0 THEN NULL ELSE CONCAT('S', CAST(p_size AS STRING)) END AS size_code,
               CASE p_size % 5 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE CONCAT(' ', p_brand) END AS colour_code,
               CAST(1 + p_size % 6 AS BIGINT) AS pack_qty,
               CASE WHEN p_partkey % 20 = 0 THEN 'N' ELSE 'Y' END AS is_active
        FROM {{part}}""",
    # ---- procurement ----------------------------------------------------------------------
    "rt_supplier": f"""
        SELECT s_suppkey AS supplier_id, CONCAT('SUP', {_pad('s_suppkey', 6)}) AS supplier_code,
               s_name AS supplier_name,
               CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CONCAT('Contact ', CAST(s_suppkey AS STRING)) END AS contact_name,
               CASE s_suppkey % 9 WHEN 0 THEN 'bad-address' WHEN 1 THEN NULL
                    ELSE CONCAT('Sales', CAST(s_suppkey AS STRING), '@Example.com') END AS contact_email,
               CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'Buyer' END AS contact_role,
               30 AS payment_terms_days, {_currency('s_nationkey % 5')} AS currency_code,
               CAST(3 + s_suppkey % 20 AS BIGINT) AS lead_time_days,
               CASE WHEN s_suppkey % 10 = 9 THEN NULL
                    ELSE CAST(CAST(s_suppkey % 101 AS DECIMAL(4,0)) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(3,1)) END AS rating,
               CASE s_suppkey % 7 WHEN 0 THEN 'N' WHEN 6 THEN NULL ELSE 'Y' END AS is_approved
        FROM {{supplier}}""",
    "rt_supplier_product": f"""
        SELECT l_suppkey AS supplier_id, l_partkey AS variant_id,
               CONCAT('SP', CAST(l_suppkey AS STRING), '-', CAST(l_partkey AS STRING)) AS supplier_sku,
               {_UNIT_COST} AS unit_cost, CAST(2 + l_suppkey % 30 AS BIGINT) AS lead_time_days,
               CAST(1 + l_partkey % 10 AS BIGINT) AS min_order_qty,
               CASE WHEN (l_suppkey + l_partkey) % 5 = 0 THEN 'Y' ELSE 'N' END AS is_primary_source,
               {_ts('1995-01-01 00:00:00')} AS valid_from,
               CASE WHEN l_suppkey % 3 = 0 THEN {_ts('2000-01-01 00:00:00')} END AS valid_to
        FROM {{lineitem}} GROUP BY l_suppkey, l_partkey""",
    "rt_purchase_order": f"""
        SELECT g.po_id, CONCAT('PO', {_pad('g.po_id', 12)}) AS po_number, g.supplier_id,
               CAST(g.supplier_id % 5 AS BIGINT) AS warehouse_id, g.order_date,
               CASE WHEN g.po_id % 19 = 0 THEN NULL
                    ELSE {_days('g.order_date', '14 + g.supplier_id % 10')} END AS expected_date,
               CASE g.po_id % 6 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'SENT' WHEN 2 THEN 'PART_RECV'
                    WHEN 3 THEN 'RECEIVED' WHEN 4 THEN 'CANCELLED' ELSE 'SENT' END AS status,
               {_currency('g.supplier_id % 5')} AS currency_code, g.order_total,
               CASE WHEN g.po_id % 6 = 0 AND g.po_id % 4 <> 0 THEN NULL
                    ELSE CAST(g.po_id % 31 AS BIGINT) END AS approved_by_employee_id
        FROM (SELECT {_PO_ID} AS po_id, l_suppkey AS supplier_id,
                     CAST(DATE_TRUNC('month', l_shipdate) AS TIMESTAMP) AS order_date,
                     CAST(SUM({_LINE_QTY} * {_UNIT_COST}) AS DECIMAL(14,2)) AS order_total
              FROM {{lineitem}}
              GROUP BY {_PO_ID}, l_suppkey, CAST(DATE_TRUNC('month', l_shipdate) AS TIMESTAMP)) g""",
    "rt_purchase_order_line": f"""
        SELECT {_PO_ID} AS po_id, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS line_no,
               l_partkey AS variant_id, {_LINE_QTY} AS qty_ordered,
               CASE l_returnflag WHEN 'A' THEN {_LINE_QTY}
                    WHEN 'R' THEN CAST({_LINE_QTY} * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(12,3)) END AS qty_received,
               {_UNIT_COST} AS unit_cost,
               CASE WHEN l_orderkey % 29 = 0 THEN 'CANCELLED' WHEN l_orderkey % 7 = 0 THEN NULL
                    WHEN l_linestatus = 'O' THEN 'OPEN' ELSE 'RECEIVED' END AS status
        FROM {{lineitem}}""",
    "rt_goods_receipt": f"""
        SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS receipt_id, {_PO_ID} AS po_id,
               CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS po_line_no,
               CAST(l_suppkey % 5 AS BIGINT) AS warehouse_id, l_shipdate AS received_ts,
               CAST(CASE WHEN l_orderkey % 41 = 0 THEN -1 ELSE l_quantity END AS DECIMAL(12,3)) AS qty_received,
               CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE CAST(0 AS DECIMAL(12,3)) END AS qty_rejected
        FROM {{lineitem}} WHERE l_linestatus = 'O'""",
    # ---- inventory ------------------------------------------------------------------------
    "rt_warehouse": f"""
        SELECT CAST(r_regionkey AS BIGINT) AS warehouse_id, CONCAT('WH', {_pad('r_regionkey', 3)}) AS warehouse_code,
               r_name AS warehouse_name FROM {{region}}""",
    "rt_inventory_location": f"""
        SELECT CAST(r_regionkey AS BIGINT) AS location_id, CONCAT('BLK', CAST(r_regionkey AS STRING)) AS location_code,
               CAST(r_regionkey AS BIGINT) AS warehouse_id, CAST(NULL AS BIGINT) AS store_id,
               CAST(NULL AS BIGINT) AS parent_location_id, 'BULK' AS location_type FROM {{region}}
        UNION ALL
        SELECT CAST(10 + r_regionkey AS BIGINT), CONCAT('PIK', CAST(r_regionkey AS STRING)),
               CAST(r_regionkey AS BIGINT), CAST(NULL AS BIGINT), CAST(r_regionkey AS BIGINT), 'PICKFACE' FROM {{region}}
        UNION ALL
        SELECT CAST(20 + r_regionkey AS BIGINT), CONCAT('QUA', CAST(r_regionkey AS STRING)),
               CAST(r_regionkey AS BIGINT), CAST(NULL AS BIGINT), CAST(10 + r_regionkey AS BIGINT), 'QUARANTINE' FROM {{region}}
        UNION ALL
        SELECT CAST(100 + n_nationkey AS BIGINT), CONCAT('SHF', {_pad('n_nationkey', 2)}),
               CAST(NULL AS BIGINT), CAST(n_nationkey AS BIGINT), CAST(NULL AS BIGINT), 'SHELF' FROM {{nation}}""",
    "rt_inventory_stock": f"""
        SELECT s.location_id, s.variant_id,
               CAST(CASE WHEN s.variant_id % 40 = 0 THEN -1 - s.variant_id % 30
                    WHEN s.variant_id % 17 = 0 THEN 0 ELSE s.p_size * 10 END AS DECIMAL(14,3)) AS qty_on_hand,
               CAST(s.variant_id % 7 AS DECIMAL(14,3)) AS qty_reserved,
               CASE WHEN s.variant_id % 9 = 0 THEN NULL ELSE CAST(50 + s.variant_id % 100 AS DECIMAL(12,3)) END AS reorder_point,
               CASE WHEN s.variant_id % 8 = 0 THEN NULL ELSE CAST(100 AS DECIMAL(12,3)) END AS reorder_qty,
               {_days(_ts('2001-01-01 00:00:00'), 's.variant_id % 200')} AS last_movement_ts
        FROM (SELECT CAST(p_partkey % 5 AS BIGINT) AS location_id, p_partkey AS variant_id, p_size FROM {{part}}
              UNION ALL
              SELECT CAST(100 + p_partkey % 25 AS BIGINT), p_partkey, p_size FROM {{part}}) s""",
    "rt_inventory_movement": f"""
        SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS movement_id, l_shipdate AS movement_ts,
               l_partkey AS variant_id,
               CASE WHEN l_returnflag IN ('N', 'A') THEN CAST(l_partkey % 5 AS BIGINT) END AS from_location_id,
               CASE WHEN l_returnflag IN ('R', 'A')
                    THEN CAST(CASE WHEN l_orderkey % 83 = 0 THEN 20 ELSE 100 END
                              + CASE WHEN l_orderkey % 83 = 0 THEN l_partkey % 5 ELSE l_partkey % 25 END AS BIGINT)
                    END AS to_location_id,
               CASE WHEN l_orderkey % 50 = 1 THEN 'ADJUST' WHEN l_orderkey % 50 = 2 THEN 'COUNT'
                    WHEN l_returnflag = 'N' THEN 'SALE' WHEN l_returnflag = 'R' THEN 'RETURN' ELSE 'TRANSFER' END AS movement_type,
               CAST(CASE WHEN l_orderkey % 97 = 0 THEN 0 WHEN l_returnflag = 'N' THEN -l_quantity
                    ELSE l_quantity END AS DECIMAL(14,3)) AS qty
        FROM {{lineitem}}""",
    # ---- customers and loyalty ------------------------------------------------------------
    "rt_customer": f"""
        SELECT c_custkey AS customer_id, CONCAT('CU', {_pad('c_custkey', 12)}) AS customer_ref,
               CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE CONCAT('First', CAST(c_custkey AS STRING)) END AS first_name,
               c_name AS last_name,
               CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 25 = 1 THEN '@nobody'
                    WHEN c_custkey % 25 = 2 THEN 'x@example.com'
                    ELSE CONCAT('user', CAST(c_custkey AS STRING), '@example.com') END AS email,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CONCAT('+44', {_pad('c_custkey', 9)}) END AS mobile_phone,
               {_days(_ts('1950-01-01 00:00:00'), 'c_custkey % 15000')} AS birth_date,
               CONCAT('N', {_pad('c_nationkey', 2)}) AS home_country_code,
               CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS preferred_store_id,
               CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE c_custkey END AS primary_address_id,
               CASE c_custkey % 5 WHEN 0 THEN 'Y' WHEN 1 THEN NULL ELSE 'N' END AS marketing_optin,
               CASE c_custkey % 20 WHEN 0 THEN 'ERASED' WHEN 1 THEN 'CLOSED' WHEN 2 THEN 'DORMANT' ELSE 'ACTIVE' END AS status,
               {_days(_ts('1994-01-01 00:00:00'), 'c_custkey % 300')} AS created_ts,
               CASE WHEN c_custkey % 20 = 0 THEN {_ts('2001-01-01 00:00:00')} END AS gdpr_erasure_ts
        FROM {{customer}}""",
    "rt_loyalty_tier": f"""
        SELECT CASE r_regionkey WHEN 0 THEN 'BRONZE' WHEN 1 THEN 'SILVER' WHEN 2 THEN 'GOLD'
                    WHEN 3 THEN 'PLATINUM' ELSE 'DIAMOND' END AS tier_code,
               CONCAT('Tier ', CAST(r_regionkey AS STRING)) AS tier_name,
               CAST(CASE WHEN r_regionkey = 0 THEN 500 ELSE r_regionkey * 6000 END AS BIGINT) AS min_points,
               CAST(r_regionkey * 2 AS DECIMAL(5,2)) AS discount_pct,
               CASE WHEN r_regionkey = 4 THEN NULL
                    ELSE CAST(CAST(4 + r_regionkey AS DECIMAL(5,0)) * CAST(0.25 AS DECIMAL(3,2)) AS DECIMAL(5,2)) END AS points_multiplier,
               6 + 6 * (r_regionkey % 3) AS review_months
        FROM {{region}}""",
    "rt_loyalty_account": f"""
        SELECT c_custkey AS loyalty_id, c_custkey AS customer_id, CONCAT('CARD', {_pad('c_custkey', 12)}) AS card_number,
               CASE c_custkey % 5 WHEN 0 THEN 'BRONZE' WHEN 1 THEN 'SILVER' WHEN 2 THEN 'GOLD'
                    WHEN 3 THEN 'PLATINUM' ELSE 'DIAMOND' END AS tier_code,
               CAST(c_custkey * 37 % 30000 AS BIGINT) AS points_balance,
               CASE WHEN c_custkey % 16 = 0 THEN NULL ELSE CAST(c_custkey * 41 % 60000 AS BIGINT) END AS lifetime_points,
               {_days(_ts('1994-01-31 00:00:00'), 'c_custkey % 300')} AS enrolled_date,
               CASE WHEN c_custkey % 7 = 0 THEN NULL
                    ELSE {_days(_ts('2000-01-31 00:00:00'), 'c_custkey % 300')} END AS tier_reviewed_date,
               CASE WHEN c_custkey % 15 = 1 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status
        FROM {{customer}} WHERE c_custkey % 3 <> 0""",
    "rt_loyalty_transaction": f"""
        SELECT o_orderkey AS loyalty_txn_id,
               CASE WHEN o_orderstatus = 'P' THEN 'REDEEM' WHEN o_orderkey % 45 = 7 THEN 'ADJUST' ELSE 'ACCRUE' END AS txn_type,
               o_custkey AS loyalty_id,
               CASE WHEN o_orderstatus = 'P' THEN -CAST(FLOOR(o_totalprice / 200) AS BIGINT)
                    ELSE CAST(FLOOR(o_totalprice / 100) AS BIGINT) END AS points_delta,
               o_orderkey AS order_id, o_orderdate AS txn_ts,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '24' MONTH END AS expires_on
        FROM {{orders}} WHERE o_custkey % 3 <> 0""",
    # ---- pricing --------------------------------------------------------------------------
    "rt_price_list": _union(
        f"""SELECT CAST(n_nationkey * 10 + {r} AS BIGINT) AS price_list_id, CONCAT('PL', {_pad(f'n_nationkey * 10 + {r}', 4)}) AS price_list_code,
               CONCAT('N', {_pad('n_nationkey', 2)}) AS country_code, {_currency('n_regionkey')} AS currency_code,
               '{("POS", "WEB", "APP", "POS")[r]}' AS channel_code, {_ts('1994-01-01 00:00:00')} AS valid_from,
               CASE WHEN {r} = 3 AND n_nationkey % 2 = 0 THEN {_ts('1999-12-31 00:00:00')} END AS valid_to,
               CAST({("100", "100", "NULL", "50")[r]} AS INT) AS priority
        FROM {{nation}}""" for r in range(4)),
    "rt_price_list_item": f"""
        SELECT CAST(n.n_nationkey * 10 + r.r_regionkey AS BIGINT) AS price_list_id, p.p_partkey AS variant_id,
               CASE WHEN r.r_regionkey = 3 THEN {_ts('1996-07-01 00:00:00')}
                    ELSE {_days(_ts('1995-01-01 00:00:00'), 'p.p_partkey % 900')} END AS effective_from,
               CAST({_money('p.p_retailprice', 10, 2)}
                    * CAST(CASE r.r_regionkey WHEN 0 THEN 0.95 WHEN 1 THEN 0.93 WHEN 2 THEN 0.97 ELSE 0.90 END AS DECIMAL(4,2))
                    AS DECIMAL(12,4)) AS unit_price,
               CASE WHEN r.r_regionkey = 3 THEN {_money('p.p_retailprice', 12, 4)} END AS was_price,
               CAST(n.n_nationkey * 10 AS BIGINT) AS tax_rate_id,
               CASE WHEN p.p_partkey % 4 = 0 THEN {_ts('2000-01-01 00:00:00')} END AS effective_to,
               CASE WHEN r.r_regionkey <> 3 THEN NULL WHEN p.p_partkey % 2 = 0 THEN 'MARKDOWN' ELSE 'CLEARANCE' END AS price_reason_code
        FROM {{part}} p
        JOIN (SELECT n_nationkey, n_nationkey % 5 AS k FROM {{nation}}) n ON n.k = p.p_partkey % 5
        JOIN (SELECT r_regionkey, CASE WHEN r_regionkey < 4 THEN 1 END AS k FROM {{region}}) r
          ON r.k = CASE WHEN p.p_partkey % 19 = 0 THEN 0 ELSE 1 END""",
    "rt_promotion": f"""
        SELECT CAST(n_nationkey AS BIGINT) AS promotion_id, CONCAT('PROMO', {_pad('n_nationkey', 3)}) AS promo_code,
               CONCAT('Promotion ', CAST(n_nationkey AS STRING)) AS promo_name,
               CASE n_nationkey % 6 WHEN 0 THEN 'PCT_OFF' WHEN 1 THEN 'AMT_OFF' WHEN 2 THEN 'BOGO'
                    WHEN 3 THEN 'BUNDLE' WHEN 4 THEN 'THRESHOLD' ELSE 'LOYALTY_X' END AS promo_type,
               {_days(_ts('1996-01-01 00:00:00'), 'n_nationkey * 100')} AS start_ts,
               {_days(_ts('1996-06-01 00:00:00'), 'n_nationkey * 100')} AS end_ts,
               CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE CAST(10000 + n_nationkey * 500 AS DECIMAL(14,2)) END AS budget_amount,
               CAST(n_nationkey * 123 AS DECIMAL(14,2)) AS spent_amount,
               CONCAT('N', {_pad('n_nationkey', 2)}) AS country_code,
               CASE n_nationkey % 4 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'EXPIRED' ELSE 'ACTIVE' END AS status
        FROM {{nation}}""",
    "rt_coupon": f"""
        SELECT c_custkey AS coupon_id, CONCAT('CPN', {_pad('c_custkey', 9)}) AS coupon_code,
               CAST(c_custkey % 24 AS BIGINT) AS promotion_id, CAST(2 AS BIGINT) AS max_redemptions,
               CAST(c_custkey % 4 AS BIGINT) AS redemption_count
        FROM {{customer}} WHERE c_custkey % 4 <> 3""",
    # ---- orders and fulfilment ------------------------------------------------------------
    "rt_sales_order": f"""
        SELECT o_orderkey AS order_id, CONCAT('SO', {_pad('o_orderkey', 12)}) AS order_number,
               CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_custkey END AS customer_id,
               CAST({_STORE} AS BIGINT) AS store_id,
               CASE SUBSTR(o_orderpriority, 1, 1) WHEN '1' THEN 'POS' WHEN '2' THEN 'WEB' WHEN '3' THEN 'APP'
                    WHEN '4' THEN 'CALL' ELSE 'KIOSK' END AS channel_code,
               o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 24) AS order_ts,
               CASE WHEN o_orderstatus = 'F' THEN 'DELIVERED'
                    WHEN o_orderstatus = 'O' AND o_orderkey % 9 = 0 THEN 'SHIPPED'
                    WHEN o_orderstatus = 'O' AND o_orderkey % 11 = 0 THEN 'CANCELLED'
                    WHEN o_orderstatus = 'O' THEN 'PLACED'
                    WHEN o_orderkey % 13 = 0 THEN 'CART' ELSE 'PICKING' END AS status,
               {_currency('(o_custkey % 5)')} AS currency_code,
               {_money('o_totalprice')} AS subtotal_amount,
               CASE WHEN o_orderkey % 4 = 0 THEN {_pct_of('o_totalprice', '0.10')}
                    ELSE CAST(0 AS DECIMAL(14,2)) END AS discount_amount,
               {_pct_of('o_totalprice', '0.05')} AS tax_amount,
               CASE WHEN o_orderkey % 3 = 0 THEN CAST(4.99 AS DECIMAL(14,2)) ELSE CAST(0 AS DECIMAL(14,2)) END AS shipping_amount,
               o_custkey AS ship_address_id,
               CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderkey % 24 AS BIGINT) END AS promotion_id,
               CASE WHEN SUBSTR(o_orderpriority, 1, 1) = '1' THEN CAST(o_orderkey % 37 AS BIGINT) END AS sales_employee_id
        FROM {{orders}}""",
    "rt_sales_order_line": f"""
        SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no, l_partkey AS variant_id,
               {_LINE_QTY} AS qty,
               CAST(CAST(FLOOR(l_extendedprice * 100 / l_quantity) AS DECIMAL(14,0)) * CAST(0.01 AS DECIMAL(4,2))
                    AS DECIMAL(12,4)) AS unit_price,
               CAST({_money('l_extendedprice', 12, 2)} * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(12,4)) AS discount_amount,
               CAST({_money('l_extendedprice', 12, 2)} * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(12,4)) AS tax_amount,
               CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_partkey % 5 AS BIGINT) END AS fulfil_location_id,
               CASE WHEN l_linestatus = 'O' THEN 'PLACED' ELSE 'SHIPPED' END AS status
        FROM {{lineitem}}""",
    "rt_order_payment": f"""
        SELECT o_orderkey AS payment_id, o_orderkey AS order_id,
               CASE WHEN o_orderkey % 2 = 0 THEN 'CARD' ELSE 'CASH' END AS payment_method,
               {_money('o_totalprice')} AS amount,
               CASE o_orderstatus WHEN 'F' THEN 'CAPTURED' WHEN 'O' THEN 'AUTHORISED' ELSE 'PENDING' END AS status
        FROM {{orders}} WHERE o_orderkey % 12 <> 5""",
    "rt_carrier": f"""
        SELECT CONCAT('CAR', CAST(r_regionkey AS STRING)) AS carrier_code, CONCAT(r_name, ' freight') AS carrier_name,
               900 + r_regionkey * 30 AS cutoff_minutes FROM {{region}}""",
    "rt_shipment": f"""
        SELECT o_orderkey AS shipment_id, o_orderkey AS order_id, CONCAT('CAR', CAST(o_orderkey % 5 AS STRING)) AS carrier_code,
               CASE WHEN o_orderkey % 3 = 0 THEN 'EXPRESS' ELSE 'STANDARD' END AS service_level,
               CONCAT('TRK', {_pad('o_orderkey', 12)}) AS tracking_ref,
               {_days('o_orderdate', '1')} AS shipped_ts,
               CASE WHEN o_orderstatus = 'F' THEN {_days('o_orderdate', '1 + o_orderkey % 4')}
                    + INTERVAL '1' HOUR * (o_orderkey % 5) END AS delivered_ts,
               CASE WHEN o_orderstatus = 'F' THEN 'DELIVERED' ELSE 'SHIPPED' END AS status
        FROM {{orders}} WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderkey % 9 = 0)""",
    "rt_shipment_line": f"""
        SELECT l_orderkey AS shipment_id, CAST(l_linenumber AS BIGINT) AS line_no, l_orderkey AS order_id,
               CAST(l_linenumber AS BIGINT) AS order_line_no,
               CASE WHEN l_returnflag = 'A' THEN {_LINE_QTY}
                    ELSE CAST({_LINE_QTY} * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(12,3)) END AS qty_shipped
        FROM {{lineitem}} WHERE l_linestatus = 'F'""",
    # ---- returns --------------------------------------------------------------------------
    "rt_return_reason": f"""
        SELECT CONCAT('R', CAST(r_regionkey AS STRING)) AS reason_code, CONCAT('Reason ', r_name) AS reason_desc,
               CASE WHEN r_regionkey < 3 THEN 'QUALITY' ELSE 'OTHER' END AS reason_group,
               CASE WHEN r_regionkey = 2 THEN 'N' ELSE 'Y' END AS is_restockable
        FROM {{region}}""",
    "rt_return_request": f"""
        SELECT o_orderkey AS return_id, CONCAT('RMA', {_pad('o_orderkey', 8)}) AS rma_number, o_orderkey AS order_id,
               o_custkey AS customer_id, CAST({_STORE} AS BIGINT) AS store_id,
               {_days('o_orderdate', 'o_orderkey % 40')} + INTERVAL '1' HOUR * (o_orderkey % 7) AS requested_ts,
               CASE o_orderkey % 3 WHEN 0 THEN 'REQUESTED' WHEN 1 THEN 'APPROVED' ELSE 'REFUNDED' END AS status,
               {_pct_of('o_totalprice', '0.20')} AS refund_amount,
               CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE CAST(o_orderkey % 37 AS BIGINT) END AS approved_by_employee_id
        FROM {{orders}} WHERE o_orderkey % 5 = 0""",
    "rt_return_line": f"""
        SELECT l_orderkey AS return_id, CAST(l_linenumber AS BIGINT) AS line_no, l_orderkey AS order_id,
               l_partkey AS variant_id, {_LINE_QTY} AS qty_returned,
               CONCAT('R', CAST(l_suppkey % 5 AS STRING)) AS reason_code,
               CASE l_linenumber % 3 WHEN 0 THEN 'RESTOCK' WHEN 1 THEN 'SCRAP' ELSE 'REPAIR' END AS disposition_code
        FROM {{lineitem}} WHERE l_returnflag = 'R' AND l_orderkey % 10 = 0""",
    # ---- finance --------------------------------------------------------------------------
    "rt_gl_account": _union([
        *[f"""SELECT '{code}' AS account_code, '{name}' AS account_name, '{name}' AS account_type, CAST(NULL AS STRING) AS parent_account_code,
                'N' AS is_postable, '{side}' AS normal_balance FROM {{region}} WHERE r_regionkey = 0""" for code, name, side in _ROOTS],
        *[f"""SELECT CONCAT('{code}', {_pad('n_nationkey', 3)}), CONCAT('{name} ', n_name), '{name}', '{code}', 'N', '{side}' FROM {{nation}}"""
          for code, name, side in _ROOTS],
        *[f"""SELECT CONCAT('{code}', {_pad('n_nationkey', 3)}, '{leaf}'), CONCAT('{name} ', n_name, ' {leaf}'), '{name}',
                CONCAT('{code}', {_pad('n_nationkey', 3)}), 'Y', '{side}' FROM {{nation}}""" for code, name, side in _ROOTS for leaf in range(5)]]),
    "rt_gl_period": """
        SELECT DISTINCT CAST(EXTRACT(YEAR FROM o_orderdate) * 100 + EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS period_id,
               CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS fiscal_year,
               CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS period_no,
               CASE WHEN EXTRACT(YEAR FROM o_orderdate) < 2001 THEN 'CLOSED'
                    WHEN EXTRACT(MONTH FROM o_orderdate) < 6 THEN 'CLOSING' ELSE 'OPEN' END AS status
        FROM {orders}""",
    "rt_gl_journal": f"""
        SELECT o_orderkey AS journal_id, CONCAT('SAL', {_pad('o_orderkey', 12)}) AS journal_ref,
               CAST(EXTRACT(YEAR FROM o_orderdate) * 100 + EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS period_id,
               'SALES' AS source_module, o_orderdate AS journal_date,
               CASE WHEN o_orderkey % 10 = 0 THEN 'DRAFT' ELSE 'POSTED' END AS status,
               CASE WHEN o_orderkey % 10 <> 0 THEN {_days('o_orderdate', '3')} END AS posted_ts
        FROM {{orders}}""",
    "rt_gl_journal_line": f"""
        SELECT o_orderkey AS journal_id, CAST(1 AS BIGINT) AS line_no, {_ACC.format('1')} AS account_code,
               CAST({_STORE} AS BIGINT) AS store_id, CAST({_money('o_totalprice')} AS DECIMAL(16,2)) AS debit_amount,
               CAST(0 AS DECIMAL(16,2)) AS credit_amount, {_currency('(o_custkey % 5)')} AS currency_code,
               CASE WHEN o_orderkey % 77 = 0 THEN NULL ELSE CAST(1 AS DECIMAL(18,8)) END AS fx_rate
        FROM {{orders}}
        UNION ALL
        SELECT o_orderkey, CAST(2 AS BIGINT), {_ACC.format('4')}, CAST({_STORE} AS BIGINT), CAST(0 AS DECIMAL(16,2)),
               CAST({_money('o_totalprice')} - {_pct_of('o_totalprice', '0.05')}
                    + CASE WHEN o_orderkey % 100 = 0 THEN 1 ELSE 0 END AS DECIMAL(16,2)),
               {_currency('(o_custkey % 5)')}, CAST(1 AS DECIMAL(18,8)) FROM {{orders}}
        UNION ALL
        SELECT o_orderkey, CAST(3 AS BIGINT), {_ACC.format('2')}, CAST({_STORE} AS BIGINT),
               CAST(CASE WHEN o_orderkey % 300 = 0 THEN 1 ELSE 0 END AS DECIMAL(16,2)),
               CAST({_pct_of('o_totalprice', '0.05')} AS DECIMAL(16,2)), {_currency('(o_custkey % 5)')},
               CAST(1 AS DECIMAL(18,8)) FROM {{orders}}""",
    # ---- operations -----------------------------------------------------------------------
    "rt_audit_log": """
        SELECT event_id AS audit_id, UPPER(event_type) AS table_name, CAST(user_id AS STRING) AS pk_value,
               CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' WHEN 'view' THEN 'X' ELSE 'U' END AS action_type,
               CONCAT('user', CAST(user_id % 7 AS STRING)) AS changed_by, ts AS changed_ts,
               CASE WHEN event_type = 'signup' THEN NULL ELSE props END AS old_row,
               CASE WHEN event_type = 'error' THEN NULL ELSE CONCAT(props, props) END AS new_row
        FROM {events}""",
    "rt_data_quality_issue": """
        SELECT event_id AS issue_id, CONCAT('RULE_', CAST(user_id % 12 AS STRING)) AS rule_code,
               CASE user_id % 3 WHEN 0 THEN 'PRODUCT' WHEN 1 THEN 'STORE' ELSE 'SALES_ORDER' END AS entity_name,
               CAST(user_id AS STRING) AS entity_key,
               CASE event_id % 5 WHEN 0 THEN 'FATAL' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'WARN' WHEN 3 THEN 'INFO'
                    ELSE 'RESOLVED' END AS severity,
               props AS detail, ts AS detected_ts,
               CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL '1' DAY END AS resolved_ts
        FROM {events} WHERE event_type IN ('error', 'view')""",
}

_NAMES = re.compile(r"\brt_[a-z_]+")
_SLOTS = re.compile(r"\{([a-z_]+)\}")


@lru_cache(maxsize=None)
def slots(name: str) -> tuple[str, ...]:
    """The tables one entry reads."""
    return tuple(sorted(set(_SLOTS.findall(BINDING[name]))))


def with_ctes(sql: str) -> str:
    """Prefix a checking query with the entries it reads, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in slots(name):
            if dep in BINDING:
                visit(dep)
        order.append(name)

    for found in sorted(set(_NAMES.findall(sql))):
        if found in BINDING:
            visit(found)
    body = sql.strip()
    own = ""
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if match:
        own, body = ", ", body[match.end():]
    ctes = ", ".join(
        f"{n} AS ({BINDING[n].format(**{s: s for s in slots(n)})})" for n in order
    )
    if not ctes:
        return sql.strip()
    return f"WITH RECURSIVE {ctes}{own or ' '}{body}"
