"""Columns a table computes from its own row, declared once per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.functions.values import empty_to_null


def _order_total() -> Column:
    return (
        F.col("subtotal_amount") - F.col("discount_amount") + F.col("tax_amount") + F.col("shipping_amount")
    ).cast("decimal(16,2)")


def _margin_pct() -> Column:
    gain = (F.col("list_price") - F.col("unit_cost")).cast("decimal(14,4)")
    return F.round(gain / F.nullif(F.col("list_price"), F.lit(0).cast("decimal(12,4)")) * 100, 2)


DERIVED = {
    "address": lambda: {
        "line2": empty_to_null("line2"),
        "normalised_key": F.concat(
            F.upper(F.trim("line1")), F.lit("|"), F.upper(F.trim("city")), F.lit("|"), F.col("country_code")
        ),
    },
    "employee": lambda: {
        "full_name": F.concat_ws(" ", "first_name", "last_name"),
        "is_active": F.when(F.col("termination_date").isNull(), "Y").otherwise("N"),
    },
    "product": lambda: {"margin_pct": _margin_pct().cast("decimal(7,2)")},
    "purchase_order_line": lambda: {"line_total": (F.col("qty_ordered") * F.col("unit_cost")).cast("decimal(24,7)")},
    "inventory_stock": lambda: {"qty_available": (F.col("qty_on_hand") - F.col("qty_reserved")).cast("decimal(15,3)")},
    "sales_order": lambda: {"order_total": _order_total()},
    "sales_order_line": lambda: {
        "line_total": (
            F.col("qty") * F.col("unit_price") - F.col("discount_amount") + F.col("tax_amount")
        ).cast("decimal(24,7)")
    },
    "gl_journal_line": lambda: {
        "base_amount": ((F.col("debit_amount") - F.col("credit_amount")) * F.col("fx_rate")).cast("decimal(34,10)")
    },
}


def add_derived(df: DataFrame, table: str) -> DataFrame:
    """Add the computed columns of `table`; a table without any comes back unchanged."""
    rule = DERIVED.get(table)
    return df.withColumns(rule()) if rule else df
