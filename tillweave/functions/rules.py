"""Validators as Y/N columns; NULL is unknown, not invalid, so it passes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillweave.functions.values import as_col, as_time, nvl


def _yn(c: Column, ok: Column) -> Column:
    return F.when(c.isNull() | ok, "Y").otherwise("N")


def valid_amount(c, limit: int = 100_000) -> Column:
    """0..limit with at most four decimals."""
    c = as_col(c)
    return _yn(c, (c >= 0) & (c <= limit) & (c == F.round(c, 4)))


def valid_qty(c, limit: int = 1000) -> Column:
    """Any sign up to the limit with at most three decimals; zero is a stock count."""
    c = as_col(c)
    return _yn(c, (F.abs(c) <= limit) & (c == F.round(c, 3)))


def valid_pct(c) -> Column:
    c = as_col(c)
    return _yn(c, c.between(0, 100))


def valid_code(c, min_len: int = 2) -> Column:
    c = as_col(c)
    clean = F.upper(F.trim(c))
    return _yn(F.nullif(c, F.lit("")), (F.length(clean) >= min_len) & clean.rlike("^[A-Z][A-Z0-9_]*$"))


def valid_ean13(c) -> Column:
    """Thirteen digits whose weighted sum (1, 3, 1, 3, ...) the last digit completes to a ten."""
    c = as_col(c)
    digit = lambda k: F.substring(c, k, 1).cast("int")
    total = sum((digit(k) * (3 if k % 2 == 0 else 1) for k in range(2, 13)), digit(1))
    check = F.pmod(F.lit(10) - total % 10, F.lit(10))
    return F.when(c.isNull(), "Y").when(~c.rlike("^[0-9]{13}$"), "N").when(check == digit(13), "Y").otherwise("N")


def valid_member(c, allowed: tuple[str, ...]) -> Column:
    """Member of a closed list, ignoring case and surrounding blanks."""
    c = as_col(c)
    return _yn(c, F.upper(F.trim(c)).isin(*allowed))


def valid_country(c, allowed: tuple[str, ...]) -> Column:
    """Known country code; blank padding on the right does not count."""
    c = as_col(c)
    return _yn(c, F.upper(F.rtrim(c)).isin(*allowed))


def valid_window(c, year: int) -> Column:
    """Within the year before `year` to the year after it."""
    c = as_col(c)
    return _yn(c, (c >= as_time(f"{year - 1}-01-01")) & (c < as_time(f"{year + 2}-01-01")))


def valid_text(c, max_bytes: int = 100) -> Column:
    """Not blank and not longer than max_bytes bytes."""
    c = as_col(c)
    return _yn(F.nullif(c, F.lit("")), (F.length(F.trim(c)) > 0) & (F.octet_length(c) <= max_bytes))


def valid_ratio(num, den, bound: int = 5) -> Column:
    """num / den within +-bound; an undefined ratio passes. Compared by products, without dividing."""
    num, den = nvl(num, 0), as_col(den)
    inside = F.abs(num) <= F.abs(den) * bound
    return F.when(den.isNull() | (den == 0) | inside, "Y").otherwise("N")


def valid_until(c, as_of) -> Column:
    """Open-ended or not past the day of `as_of`."""
    c = as_col(c)
    return _yn(c, c >= as_time(as_of).cast("date").cast("timestamp_ntz"))


# The CHECK rules of the retail model, per table.
CHECKS: dict[str, dict[str, str]] = {
    "currency": {
        "ck_currency_active": "is_active IN ('Y', 'N')",
        "ck_currency_minor_units": "minor_units BETWEEN 0 AND 4",
    },
    "exchange_rate": {
        "ck_rate_positive": "rate > 0",
        "ck_rate_not_self": "from_currency <> to_currency",
    },
    "region": {"ck_region_level": "region_level IN ('GLOBAL', 'AREA', 'COUNTRY', 'DISTRICT', 'CLUSTER')"},
    "calendar_day": {"ck_calendar_period": "fiscal_period BETWEEN 1 AND 12 AND fiscal_week BETWEEN 1 AND 53 AND day_of_week BETWEEN 1 AND 7"},
    "tax_rate": {"ck_tax_rate_window": "valid_to IS NULL OR valid_to > valid_from"},
    "store": {
        "ck_store_format": "store_format IN ('HYPER', 'SUPER', 'EXPRESS', 'OUTLET', 'ONLINE')",
        "ck_store_dates": "closed_date IS NULL OR closed_date >= opened_date",
    },
    "employee": {"ck_employee_dates": "termination_date IS NULL OR termination_date >= hire_date"},
    "product": {
        "ck_product_status": "status IN ('DRAFT', 'ACTIVE', 'DISCONTINUED', 'DELETED')",
        "ck_product_costs": "unit_cost >= 0 AND list_price >= 0",
    },
    "product_variant": {
        "ck_variant_barcode_numeric": "barcode_ean13 IS NULL OR barcode_ean13 RLIKE '^[0-9]{13}$'",
        "ck_variant_pack_qty": "pack_qty > 0",
    },
    "supplier": {
        "ck_supplier_rating": "rating IS NULL OR rating BETWEEN 0 AND 10",
        "ck_supplier_approved": "is_approved IN ('Y', 'N')",
    },
    "purchase_order": {"ck_po_status": "status IN ('DRAFT', 'SENT', 'PART_RECV', 'RECEIVED', 'CANCELLED')"},
    "purchase_order_line": {"ck_pol_qty": "qty_ordered > 0", "ck_pol_received": "qty_received >= 0"},
    "goods_receipt": {"ck_gr_quantities": "qty_received >= 0 AND qty_rejected >= 0"},
    "inventory_location": {
        "ck_location_type": "location_type IN ('BACKROOM', 'SHELF', 'BULK', 'PICKFACE', 'QUARANTINE', 'TRANSIT')",
        "ck_location_owner": "(warehouse_id IS NOT NULL AND store_id IS NULL) OR (warehouse_id IS NULL AND store_id IS NOT NULL)",
    },
    "inventory_stock": {
        "ck_stock_quantities": "qty_reserved >= 0 AND (reorder_point IS NULL OR reorder_point >= 0) AND (reorder_qty IS NULL OR reorder_qty > 0)",
    },
    "inventory_movement": {
        "ck_movement_type": "movement_type IN ('RECEIPT', 'SALE', 'RETURN', 'TRANSFER', 'ADJUST', 'SHRINK', 'COUNT')",
        "ck_movement_qty": "qty <> 0 OR movement_type = 'COUNT'",
    },
    "customer": {
        "ck_customer_status": "status IN ('ACTIVE', 'DORMANT', 'CLOSED', 'ERASED')",
        "ck_customer_optin": "marketing_optin IN ('Y', 'N')",
    },
    "customer_address": {"ck_custaddr_type": "address_type IN ('HOME', 'WORK', 'BILLING', 'SHIPPING', 'OTHER')"},
    "loyalty_account": {"ck_loyalty_points": "points_balance >= 0"},
    "loyalty_transaction": {"ck_loytxn_type": "txn_type IN ('ACCRUE', 'REDEEM', 'EXPIRE', 'ADJUST', 'TRANSFER')"},
    "price_list_item": {
        "ck_pli_markdown": "unit_price >= 0 AND (effective_to IS NULL OR effective_to > effective_from) AND (price_reason_code IS NULL "
                           "OR price_reason_code <> 'MARKDOWN' OR (was_price IS NOT NULL AND was_price > unit_price)) "
                           "AND (was_price IS NULL OR price_reason_code IS NOT NULL)",
    },
    "promotion": {
        "ck_promo_type": "promo_type IN ('PCT_OFF', 'AMT_OFF', 'BOGO', 'BUNDLE', 'THRESHOLD', 'LOYALTY_X')",
        "ck_promotion_window": "end_ts > start_ts",
        "ck_promotion_budget": "budget_amount IS NULL OR budget_amount >= 0",
    },
    "promotion_product": {"ck_promoprod_discount": "discount_pct IS NOT NULL OR discount_amount IS NOT NULL"},
    "coupon": {"ck_coupon_redemptions": "redemption_count <= max_redemptions"},
    "sales_order": {
        "ck_so_channel": "channel_code IN ('POS', 'WEB', 'APP', 'CALL', 'KIOSK', 'PARTNER')",
        "ck_so_status": "status IN ('CART', 'PLACED', 'PICKING', 'SHIPPED', 'DELIVERED', 'CANCELLED', 'RETURNED')",
    },
    "sales_order_line": {"ck_sol_qty": "qty > 0"},
    "order_payment": {"ck_payment_method": "payment_method IN ('CARD', 'CASH', 'VOUCHER', 'LOYALTY', 'GIFTCARD', 'BNPL', 'ACCOUNT')"},
    "shipment_line": {"ck_shipline_qty": "qty_shipped > 0"},
    "return_request": {"ck_return_status": "status IN ('REQUESTED', 'APPROVED', 'REJECTED', 'RECEIVED', 'REFUNDED', 'CLOSED')"},
    "return_line": {
        "ck_retline_disposition": "disposition_code IN ('RESTOCK', 'SCRAP', 'REPAIR', 'SUPPLIER', 'DONATE')",
        "ck_retline_qty": "qty_returned > 0",
    },
    "gl_account": {
        "ck_gl_account_type": "account_type IN ('ASSET', 'LIABILITY', 'EQUITY', 'REVENUE', 'EXPENSE')",
        "ck_gl_normal_balance": "normal_balance IN ('D', 'C')",
    },
    "gl_period": {
        "ck_gl_period_status": "status IN ('FUTURE', 'OPEN', 'CLOSING', 'CLOSED')",
        "ck_gl_period_dates": "period_end >= period_start",
    },
    "gl_journal": {
        "ck_journal_source": "source_module IN ('SALES', 'RETURNS', 'PURCHASING', 'INVENTORY', 'PAYROLL', 'MANUAL')",
        "ck_journal_status": "status IN ('DRAFT', 'POSTED', 'REVERSED')",
    },
    "gl_journal_line": {
        "ck_gljl_debit_or_credit": "debit_amount = 0 OR credit_amount = 0",
        "ck_gljl_signs": "debit_amount >= 0 AND credit_amount >= 0",
    },
    "audit_log": {"ck_audit_action": "action_type IN ('I', 'U', 'D')"},
    "job_run_log": {"ck_job_run_status": "status IN ('RUNNING', 'SUCCESS', 'FAILED', 'SKIPPED')"},
    "app_parameter": {"ck_app_param_type": "param_type IN ('STRING', 'NUMBER', 'DATE', 'BOOLEAN')"},
    "data_quality_issue": {"ck_dq_severity": "severity IN ('INFO', 'WARN', 'ERROR', 'FATAL')"},
}

# Child, parent, foreign key and key of the checked references.
REFERENCES: tuple[tuple[str, str, str, str], ...] = (
    ("region", "country", "country_code", "country_code"),
    ("store", "region", "region_id", "region_id"),
    ("store", "address", "address_id", "address_id"),
    ("employee", "store", "store_id", "store_id"),
    ("employee", "employee", "manager_id", "employee_id"),
    ("product", "product_category", "category_id", "category_id"),
    ("product_variant", "product", "product_id", "product_id"),
    ("supplier_product", "product_variant", "variant_id", "variant_id"),
    ("customer", "country", "home_country_code", "country_code"),
    ("loyalty_account", "customer", "customer_id", "customer_id"),
    ("loyalty_transaction", "loyalty_account", "loyalty_id", "loyalty_id"),
    ("price_list_item", "price_list", "price_list_id", "price_list_id"),
    ("promotion_product", "promotion", "promotion_id", "promotion_id"),
    ("coupon", "promotion", "promotion_id", "promotion_id"),
    ("sales_order", "store", "store_id", "store_id"),
    ("sales_order_line", "sales_order", "order_id", "order_id"),
    ("order_payment", "sales_order", "order_id", "order_id"),
    ("shipment", "carrier", "carrier_code", "carrier_code"),
    ("inventory_stock", "inventory_location", "location_id", "location_id"),
    ("inventory_movement", "product_variant", "variant_id", "variant_id"),
    ("purchase_order", "supplier", "supplier_id", "supplier_id"),
    ("purchase_order_line", "purchase_order", "po_id", "po_id"),
    ("return_request", "sales_order", "order_id", "order_id"),
    ("return_line", "return_reason", "reason_code", "reason_code"),
    ("gl_journal", "gl_period", "period_id", "period_id"),
    ("gl_journal_line", "gl_account", "account_code", "account_code"),
)
