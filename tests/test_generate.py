"""The synthetic tables: row counts, unique keys, references, balanced journals."""

import pytest
from pyspark.sql import functions as F

from tillweave.generate import constants as k
from tillweave.generate.tables import GROUPS, generate

# per group: table -> (key columns, references (column, parent table, parent key))
SHAPES = {
    "gen_reference": {"currency": (["currency_code"], []), "country": (["country_code"], [("currency_code", "currency", "currency_code")]),
                      "exchange_rate": (["rate_date", "from_currency", "to_currency"], [("from_currency", "currency", "currency_code")]), "calendar_day": (["day_date"], []),
                      "tax_rate": (["tax_rate_id"], [("country_code", "country", "country_code")]), "loyalty_tier": (["tier_code"], []), "carrier": (["carrier_code"], []),
                      "return_reason": (["reason_code"], []), "app_parameter": (["param_name"], []), "gl_account": (["account_code"], [("parent_account_code", "gl_account", "account_code")]),
                      "gl_period": (["period_id"], [])},
    "gen_geography": {"region": (["region_id"], [("parent_region_id", "region", "region_id"), ("country_code", "country", "country_code")]), "address": (["address_id"], [("country_code", "country", "country_code")]),
                      "warehouse": (["warehouse_id"], [("region_id", "region", "region_id")]), "store": (["store_id"], [("region_id", "region", "region_id"), ("manager_employee_id", "employee", "employee_id")])},
    "gen_employees": {"employee": (["employee_id"], [("manager_id", "employee", "employee_id"), ("store_id", "store", "store_id")])},
    "gen_catalog": {"product_category": (["category_id"], [("parent_category_id", "product_category", "category_id")]), "brand": (["brand_id"], []),
                    "product": (["product_id"], [("category_id", "product_category", "category_id"), ("brand_id", "brand", "brand_id")]),
                    "product_variant": (["variant_id"], [("product_id", "product", "product_id")])},
    "gen_suppliers": {"supplier": (["supplier_id"], [("address_id", "address", "address_id")]),
                      "supplier_product": (["supplier_id", "variant_id"], [("variant_id", "product_variant", "variant_id"), ("supplier_id", "supplier", "supplier_id")])},
    "gen_customers": {"customer": (["customer_id"], [("home_country_code", "country", "country_code")]), "customer_address": (["customer_id", "address_type"], [("address_id", "address", "address_id")]),
                      "loyalty_account": (["loyalty_id"], [("customer_id", "customer", "customer_id"), ("tier_code", "loyalty_tier", "tier_code")]),
                      "loyalty_transaction": (["loyalty_txn_id"], [("loyalty_id", "loyalty_account", "loyalty_id")])},
    "gen_pricing": {"price_list": (["price_list_id"], [("country_code", "country", "country_code")]), "price_list_item": (["price_list_id", "variant_id"], [("price_list_id", "price_list", "price_list_id")]),
                    "promotion": (["promotion_id"], []), "promotion_product": (["promotion_id", "variant_id"], [("promotion_id", "promotion", "promotion_id")]),
                    "coupon": (["coupon_id"], [("promotion_id", "promotion", "promotion_id"), ("customer_id", "customer", "customer_id")])},
    "gen_inventory": {"inventory_location": (["location_id"], [("parent_location_id", "inventory_location", "location_id"), ("store_id", "store", "store_id")]),
                      "inventory_stock": (["location_id", "variant_id"], [("location_id", "inventory_location", "location_id")]),
                      "inventory_movement": (["movement_id"], [("variant_id", "product_variant", "variant_id")])},
    "gen_orders": {"sales_order": (["order_id"], [("store_id", "store", "store_id"), ("customer_id", "customer", "customer_id")]), "sales_order_line": (["order_id", "line_no"], [("order_id", "sales_order", "order_id")]),
                   "order_payment": (["payment_id"], [("order_id", "sales_order", "order_id")]), "shipment": (["shipment_id"], [("carrier_code", "carrier", "carrier_code")]),
                   "shipment_line": (["shipment_id", "line_no"], [("shipment_id", "shipment", "shipment_id")])},
    "gen_procurement": {"purchase_order": (["po_id"], [("supplier_id", "supplier", "supplier_id")]), "purchase_order_line": (["po_id", "line_no"], [("po_id", "purchase_order", "po_id")]),
                        "goods_receipt": (["receipt_id"], [("po_id", "purchase_order", "po_id")])},
    "gen_returns": {"return_request": (["return_id"], [("order_id", "sales_order", "order_id")]), "return_line": (["return_id", "line_no"], [("reason_code", "return_reason", "reason_code")])},
    "gen_finance": {"gl_journal": (["journal_id"], [("period_id", "gl_period", "period_id")]), "gl_journal_line": (["journal_id", "line_no"], [("account_code", "gl_account", "account_code")])},
}


@pytest.mark.parametrize("group", GROUPS)
def test_keys_and_references(spark, group):
    home = {name: g for g, tables in SHAPES.items() for name in tables}
    needed = {home[p] for _, refs in SHAPES[group].values() for _, p, _ in refs if p in home} | {group}
    tables = generate(spark, 1, groups=sorted(needed))
    for name, (key, refs) in SHAPES[group].items():
        rows = k.FIXED_ROWS[name] if name in k.FIXED_ROWS else k.SCALED_ROWS[name]
        assert (tables[name].count(), tables[name].select(*key).distinct().count()) == (rows, rows), name
        for fk, parent, pk in refs:
            lost = tables[name].select(F.col(fk).alias("fk")).filter("fk IS NOT NULL").join(tables[parent].select(F.col(pk).alias("fk")), "fk", "left_anti")
            assert lost.count() == 0, (name, fk)


def test_journals_balance(spark):
    lines = generate(spark, 1, groups=["gen_finance"])["gl_journal_line"]
    assert lines.groupBy("journal_id").agg((F.sum("debit_amount") - F.sum("credit_amount")).alias("x")).filter("x <> 0").count() == 0
