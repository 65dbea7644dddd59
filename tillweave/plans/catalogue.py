"""Product, supplier and promotion jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.functions.values import as_time, day_of, valid_email
from tillweave.operators.merge import reject_duplicates
from tillweave.operators.positions import assign_ids
from tillweave.sources.tables import RetailTables


def retire_skus(t: RetailTables, skus: DataFrame) -> tuple[RetailTables, DataFrame]:
    """Discontinue the listed products and deactivate their variants; unknown SKUs are rejected."""
    asked = skus.select("sku").distinct()
    hit = t.product.select("product_id", "sku").join(asked, "sku", "left_semi").select("product_id", F.lit(True).alias("_off"))
    off = F.col("_off")
    product = t.product.join(hit, "product_id", "left").withColumn(
        "status", F.when(off, "DISCONTINUED").otherwise(F.col("status"))).select(*t.product.columns)
    variant = t.product_variant.join(hit, "product_id", "left").withColumn(
        "is_active", F.when(off, "N").otherwise(F.col("is_active"))).select(*t.product_variant.columns)
    unknown = asked.join(t.product.select("sku"), "sku", "left_anti").withColumn("reject_reason", F.concat(F.lit("Unknown SKU: "), F.col("sku")))
    return t.replace(product=product, product_variant=variant), unknown


def products_add(t: RetailTables, new: DataFrame, start_id: int, as_of) -> tuple[DataFrame, DataFrame]:
    """New products (seq, sku, product_name, category_code, brand_code, list_price, unit_cost).

    An unknown category rejects the row, an unknown brand becomes NULL, a SKU already present or
    repeated in the batch is rejected. Without prices the product starts as a free DRAFT.
    """
    rows = new.join(t.product_category.select("category_code", "category_id"), "category_code", "left").join(
        t.brand.select("brand_code", "brand_id"), "brand_code", "left")
    lost = rows.filter(F.col("category_id").isNull()).select(
        "seq", "sku", F.concat(F.lit("Unknown category code: "), F.col("category_code")).alias("reject_reason"))
    fresh, dup = reject_duplicates(rows.filter(F.col("category_id").isNotNull()), t.product.select("sku"), "sku", ["seq"])
    full = F.col("list_price").isNotNull()
    added = assign_ids(fresh, [F.col("seq")], start_id, "product_id").select(
        "product_id", "sku", "product_name", "category_id", "brand_id", F.coalesce("unit_cost", F.lit(0)).cast("decimal(12,4)").alias("unit_cost"),
        F.coalesce("list_price", F.lit(0)).cast("decimal(12,4)").alias("list_price"), F.when(full, "ACTIVE").otherwise("DRAFT").alias("status"),
        F.when(full, day_of(as_time(as_of))).alias("launch_date"))
    rejects = lost.unionByName(dup.select("seq", "sku", F.concat(F.lit("Duplicate SKU: "), F.col("sku")).alias("reject_reason")))
    return added, rejects


def contact_update(suppliers: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace contact structs (supplier_id, contact); NULL contacts, bad addresses and unknown
    suppliers are rejected."""
    sid = F.col("supplier_id").cast("string")
    known = suppliers.select("supplier_id", F.lit(True).alias("_known"))
    reason = F.when(F.col("contact").isNull(), F.lit("Contact must not be null")).when(
        valid_email(F.col("contact.email")) != "Y", F.concat(F.lit("Invalid contact email for supplier "), sid)).when(
        F.col("_known").isNull(), F.concat(F.lit("Unknown supplier "), sid))
    judged = changes.join(known, "supplier_id", "left").withColumn("reject_reason", reason)
    good = judged.filter(F.col("reject_reason").isNull()).select("supplier_id", F.col("contact").alias("_contact"))
    new = suppliers.join(good, "supplier_id", "left").withColumn(
        "primary_contact", F.when(F.col("_contact").isNotNull(), F.col("_contact")).otherwise(F.col("primary_contact"))).select(*suppliers.columns)
    return new, judged.filter(F.col("reject_reason").isNotNull()).select("supplier_id", "reject_reason")


def promotions_expire(promotions: DataFrame, as_of, audit_rows: int = 100) -> tuple[DataFrame, DataFrame]:
    """ACTIVE and DRAFT promotions past their end expire. The audit covers up to `audit_rows`
    expired promotions, whenever they expired; the source takes any, here the lowest ids."""
    past = F.col("status").isin("ACTIVE", "DRAFT") & (F.col("end_ts") < as_time(as_of))
    new = promotions.withColumn("status", F.when(past, "EXPIRED").otherwise(F.col("status")))
    audit = new.filter(F.col("status") == "EXPIRED").orderBy("promotion_id").limit(audit_rows).select(
        F.lit("PROMOTION").alias("table_name"), F.col("promotion_id").cast("string").alias("pk_value"), F.lit("U").alias("action_type"),
        F.lit("status=ACTIVE").alias("old_row"), F.lit("status=EXPIRED").alias("new_row"))
    return new, audit


def spec_attributes(products: DataFrame) -> DataFrame:
    """Name and value of every /spec/attribute of the spec sheets; sheets without any give their
    /spec/summary under a NULL name."""
    x = F.expr
    rows = products.select(
        "product_id", x("xpath(spec_sheet, '/spec/attribute/@name')").alias("names"), x("xpath(spec_sheet, '/spec/attribute/text()')").alias("vals"),
        x("xpath_string(spec_sheet, '/spec/summary')").alias("summary"))
    some = rows.filter(F.size("names") > 0).select("product_id", F.explode(F.arrays_zip("names", "vals")).alias("p")).select(
        "product_id", F.col("p.names").alias("attr_name"), F.col("p.vals").alias("attr_value"))
    rest = rows.filter((F.coalesce(F.size("names"), F.lit(0)) <= 0) & (F.col("summary") != "")).select(
        "product_id", F.lit(None).cast("string").alias("attr_name"), F.substring("summary", 1, 4000).alias("attr_value"))
    return some.unionByName(rest)
