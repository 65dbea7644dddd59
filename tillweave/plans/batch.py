"""Scheduled batches: regional refreshes, staging, interface runs, reporting refresh, month end."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillweave.functions.values import as_time, day_of, decode, empty_to_null, nvl
from tillweave.operators import hierarchy as tree
from tillweave.operators.merge import upsert_delete
from tillweave.plans import mviews
from tillweave.plans.families import SYSTEMS
from tillweave.sources.extracts import job_run, publish, published, sales_extract, write_extract
from tillweave.sources.tables import RetailTables


def _issue(rule, entity, key, detail, severity="INFO") -> list:
    lift = lambda v: v if not isinstance(v, str) else F.lit(v)
    return [lift(rule).alias("rule_code"), lift(entity).alias("entity_name"), lift(key).alias("entity_key"),
            F.lit(severity).alias("severity"), lift(detail).alias("detail")]


def region_refresh(t: RetailTables, region: str, start: str, shape: int) -> DataFrame:
    """Issues about one region: 0 order count per store · 1 one row per store · 2 daily trend."""
    stores = t.store.select("store_id", "store_code", "region_id").join(
        t.region.filter(F.col("region_code") == region).select("region_id"), "region_id", "left_semi")
    orders = t.sales_order.filter(F.col("order_ts") >= as_time(start))
    if shape == 0:
        counts = orders.groupBy("store_id").agg(F.count("*").alias("n"))
        return stores.join(counts, "store_id", "left").select(*_issue(
            "REGION_REFRESH", "store", F.col("store_code"), F.concat(F.lit(f"{region} orders="), nvl("n", 0).cast("string"))))
    if shape == 1:
        return stores.select(*_issue("REGION_REFRESH", "store", F.col("store_code"),
                                     F.concat(F.lit(f"{region} store_id="), F.col("store_id").cast("string"))))
    daily = orders.join(stores.select("store_id"), "store_id", "left_semi").groupBy(day_of("order_ts").alias("d")).agg(
        F.sum(nvl("subtotal_amount", 0)).alias("net"))
    prev = F.lag("net").over(Window.orderBy("d"))  # one row per trading day
    delta = nvl(F.col("net") - prev, 0)
    return daily.select(*_issue("REGION_TREND", "sales_order", F.date_format("d", "yyyy-MM-dd"), F.concat(
        F.lit("net="), F.col("net").cast("string"), F.lit(" delta="), delta.cast("decimal(25,2)").cast("string"))))


def category_stage(t: RetailTables, category: str, shape: int) -> DataFrame:
    """Issues staging a category's variants: 0 active SKUs with a fixed text · 1 scan key, colour and size."""
    cat = t.product_category.filter(F.col("category_code") == category).select("category_id", "category_name")
    rows = t.product_variant.join(t.product.select("product_id", "category_id"), "product_id").join(cat, "category_id")
    if shape == 0:
        return rows.filter(F.col("is_active") == "Y").select(*_issue(
            f"STAGE_{category}", "product_variant", F.col("variant_sku"), F.concat(F.col("category_name"), F.lit(" nightly stage"))))
    colour = nvl(empty_to_null(F.trim("colour_code")), "UNSPEC")
    detail = F.concat(nvl("barcode_ean13", F.col("variant_id").cast("string")), F.lit("/"), colour, F.lit("/"),
                      decode("size_code", {None: "ONESIZE"}, F.col("size_code")))
    return rows.select(*_issue(f"STAGE_{category}", "product_variant", F.col("variant_sku"), detail))


# ---- interface runs --------------------------------------------------------------------------------

def resolve_key(system: str, key: str | None, kind: str, df: DataFrame, name: str = "resolved") -> DataFrame:
    """System-prefixed key text by the kind of the key column: number, text or date."""
    c = F.col(key)
    text = {"number": c.cast("string"), "text": nvl(empty_to_null(F.upper(F.trim(c))), "<none>"),
            "date": F.date_format(c, "yyyy-MM-dd")}[kind]
    mark = {"number": "N", "text": "C", "date": "D"}[kind]
    return df.withColumn(name, F.concat(F.lit(f"{system}:{mark}:"), text))


def pending_count(t: RetailTables, system: str, entity: str) -> DataFrame:
    """Unresolved issues of a system on an entity."""
    issues = t.data_quality_issue.filter(
        (F.col("entity_name") == entity) & F.col("resolved_ts").isNull() & F.col("rule_code").startswith(system))
    return issues.agg(F.count("*").alias("pending"))


SOURCE_TABLES = ("product_variant", "sales_order", "sales_order_line", "customer", "inventory_movement", "gl_journal_line")


def interface_batch(t: RetailTables, system: str, direction: str, shape: int, n: int | None, ref: str,
                    source: str = "product_variant") -> DataFrame:
    """One import run as issue rows: 0 staged variants · 1 sync rows (merge with interface_sync) ·
    2 row count of a named source · 3 region routes.

    `n` limits a run to any n rows; None takes all. The source name must be a listed table.
    """
    code, _, inbound, outbound = next(s for s in SYSTEMS if s[0] == system)
    entity = inbound if direction == "IN" else outbound
    cut = (lambda df: df) if n is None else (lambda df: df.limit(n))
    if shape in (0, 1):
        rows = cut(t.product_variant.filter(F.col("is_active") == "Y").select("variant_id"))
        vid = F.col("variant_id").cast("string")
        if shape == 0:
            return rows.select(*_issue(f"{code}_STAGED", entity, vid, F.concat(F.lit(f"{ref} staged variant "), vid)))
        return rows.select(*_issue(f"{code}_SYNC", entity, vid, ref))
    if shape == 2:
        if source not in SOURCE_TABLES or not re.fullmatch(r"[a-z_]+", source):
            raise ValueError(f"not a source table: {source}")
        count = cut(getattr(t, source)).agg(F.count("*").alias("n"))
        return count.select(*_issue(f"{code}_DYN", entity, source, F.concat(F.lit(f"{ref} rows="), F.col("n").cast("string"))))
    walked = tree.hierarchy(t.region.select("region_id", "region_code", "parent_region_id"), "region_id", "parent_region_id",
                            paths={"path": ("region_code", "/")}, roots={"root": "region_code"})
    return cut(walked).select(*_issue(f"{code}_ROUTE", "region", F.col("region_code"), F.concat(
        F.lit("depth="), F.col("level").cast("string"), F.lit(" root="), F.col("root"), F.lit(" leaf="), F.col("is_leaf").cast("string"),
        F.lit(" path="), F.col("path"))))


def interface_sync(issues: DataFrame, incoming: DataFrame, as_of) -> DataFrame:
    """Merge sync rows into the issues by (rule, entity, key): unresolved matches take the new
    detail and stamp, and go when their severity is RESOLVED; new keys are added."""
    now = as_time(as_of)
    source = incoming.groupBy("rule_code", "entity_name", "entity_key").agg(F.max("severity").alias("severity"), F.max("detail").alias("detail"))
    return upsert_delete(
        issues, source, ["rule_code", "entity_name", "entity_key"],
        {"detail": F.col("s.detail"), "detected_ts": now},
        {"severity": F.col("s.severity"), "detail": F.col("s.detail"), "detected_ts": now},
        update_if=F.col("t.resolved_ts").isNull(), delete_if=F.col("severity") == "RESOLVED")


def reconcile_count(t: RetailTables, system: str, start: str, stop: str) -> DataFrame:
    """Orders in a half-open window, as the run message of a system."""
    ts = F.col("order_ts")
    rows = t.sales_order.filter((ts >= as_time(start)) & (ts < as_time(stop))).agg(F.count("*").alias("rows_processed"))
    return rows.select(F.lit(system).alias("system_code"), "rows_processed", F.concat(
        F.lit(f"{system} reconciled "), F.col("rows_processed").cast("string"), F.lit(" orders")).alias("message"))


# ---- reporting refresh, export, month end ------------------------------------------------------------

def reporting_views(t: RetailTables, as_of) -> dict[str, DataFrame]:
    """The refresh group followed by the two standalone aggregates."""
    return {
        "mv_sales_monthly_category": mviews.sales_monthly_category(t), "mv_stock_position": mviews.stock_position(t),
        "mv_customer_rfm": mviews.customer_rfm(t, as_of), "mv_supplier_performance": mviews.supplier_performance(t),
        "mv_promotion_uplift": mviews.promotion_uplift(t),
    }


def refresh_reporting(t: RetailTables, as_of, out: str) -> dict[str, str]:
    """Rebuild and publish the reporting aggregates with a run record."""
    done = {}
    with job_run(t.spark, "REFRESH_REPORTING", f"{out}/job_run_log") as run:
        for name, df in reporting_views(t, as_of).items():
            done[name] = f"{out}/{name}"
            publish(df, done[name])
        run.rows, run.message = len(done), "method=C"
    return done


def export_daily(t: RetailTables, day: str, out: str) -> str:
    """The sales extract of one day; a failure is recorded, not raised."""
    path = f"{out}/sales_{day.replace('-', '')}_{day.replace('-', '')}"
    with job_run(t.spark, "EXPORT_DAILY_SALES", f"{out}/job_run_log", swallow=True) as run:
        extract = sales_extract(t, day, day)
        write_extract(extract, path)
        run.rows = t.spark.read.option("header", True).csv(path).count()
    return path


def run_steps(spark, steps: list[tuple[str, Callable[[], int | None]]], log: str) -> list[tuple[str, str]]:
    """Steps in order with a run record each; after a failed step the rest are SKIPPED."""
    result, failed = [], False
    for name, step in steps:
        with job_run(spark, name, log, swallow=True) as run:
            status = "FAILED"
            if failed:
                run.skipped, status = True, "SKIPPED"
            else:
                run.rows = step()
                status = "SUCCESS"
        failed = failed or status == "FAILED"
        result.append((name, status))
    return result


def month_end(t: RetailTables, period_id: int, day: str, as_of, out: str, force: bool = False) -> list[tuple[str, str]]:
    """Close the period, post the sales journals, export the day: in that order, stopping at the
    first failure."""
    from tillweave.plans import finance

    def close() -> int:
        asked = t.spark.createDataFrame([(period_id,)], "period_id long")
        periods, rejects = finance.gl_close(t, asked, as_of, force)
        bad = rejects.first()
        if bad is not None:
            raise RuntimeError(bad["reject_reason"])
        publish(periods, f"{out}/gl_period")
        return 1

    def post() -> int:
        start = as_time(day)
        orders = t.sales_order.filter((F.col("order_ts") >= start) & (F.col("order_ts") < start + F.expr("INTERVAL 1 DAY")))
        journals, lines, _ = finance.sales_journal(orders, t.gl_period, 0, as_of)
        publish(journals, f"{out}/gl_journal")
        publish(lines, f"{out}/gl_journal_line")
        return published(t.spark, f"{out}/gl_journal").count()

    def export() -> int:
        path = f"{out}/sales_{day.replace('-', '')}"
        write_extract(sales_extract(t, day, day), path)
        return t.spark.read.option("header", True).csv(path).count()

    return run_steps(t.spark, [("CLOSE_PERIOD", close), ("POST_GL", post), ("EXPORT", export)], f"{out}/job_run_log")


# ---- writing through views ------------------------------------------------------------------------------

def apply_view_changes(view: str, changes: DataFrame, t: RetailTables, as_of) -> dict[str, DataFrame]:
    """Route (op, row...) changes of a view to its base tables; returns the new base tables.

    customer_360: insert, update or erase a customer and its loyalty account · product_sellable:
    insert or update product and variant, delete deactivates the variant · open_purchase_orders:
    insert, send, cancel or update orders.
    """
    return {"customer_360": _through_customer, "product_sellable": _through_product, "open_purchase_orders": _through_po}[view](changes, t, as_of)


def _overlay(table: DataFrame, source: DataFrame, key: str, sets: dict) -> DataFrame:
    """Set columns of rows matched by key; `s.`-prefixed names read the change row."""
    s = source.select(F.col(key), F.lit(True).alias("_hit"), *[c.alias(f"_{n}") for n, c in sets.items()])
    out = table.join(s, key, "left")
    return out.withColumns({
        n: F.when(F.col("_hit"), F.col(f"_{n}").cast(table.schema[n].dataType)).otherwise(F.col(n)) for n in sets}).select(*table.columns)


def _append(table: DataFrame, rows: DataFrame) -> DataFrame:
    cols = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields]
    return table.unionByName(rows.select(*cols))


def _through_customer(ch: DataFrame, t: RetailTables, as_of) -> dict[str, DataFrame]:
    ins, upd, gone = (ch.filter(F.col("op") == o) for o in ("I", "U", "D"))
    clean = F.lower(F.trim("email"))
    customer = _overlay(t.customer, upd, "customer_id", {
        "first_name": F.col("first_name"), "last_name": F.col("last_name"), "email": clean, "mobile_phone": F.col("mobile_phone"),
        "marketing_optin": F.col("marketing_optin"), "status": F.col("customer_status")})
    customer = _overlay(customer, gone, "customer_id", {
        "status": F.lit("ERASED"), "email": F.lit(None), "mobile_phone": F.lit(None), "gdpr_erasure_ts": as_time(as_of)})
    customer = _append(customer, ins.withColumns({
        "customer_ref": nvl("customer_ref", "CU-PENDING"), "email": clean, "marketing_optin": nvl("marketing_optin", "N"),
        "status": nvl("customer_status", "ACTIVE"), "created_ts": as_time(as_of)}))
    account = t.loyalty_account
    paid = upd.filter(F.col("points_balance").isNotNull()).join(account.select("customer_id"), "customer_id", "left_semi")
    account = account.join(paid.select("customer_id", F.col("points_balance").alias("_p"), F.col("tier_code").alias("_t")), "customer_id", "left").withColumns({
        "points_balance": F.coalesce("_p", "points_balance").cast("bigint"), "tier_code": F.coalesce("_t", "tier_code")}).select(*account.columns)
    cards = ins.filter(F.col("card_number").isNotNull()).withColumns({
        "loyalty_id": F.col("customer_id"), "tier_code": nvl("tier_code", "BRONZE"), "points_balance": nvl("points_balance", 0),
        "lifetime_points": F.lit(0), "enrolled_date": day_of(as_time(as_of)), "status": F.lit("ACTIVE")})
    return {"customer": customer, "loyalty_account": _append(account, cards)}


def _through_product(ch: DataFrame, t: RetailTables, as_of) -> dict[str, DataFrame]:
    ins, upd, gone = (ch.filter(F.col("op") == o) for o in ("I", "U", "D"))
    product = _overlay(t.product, upd, "product_id", {
        "product_name": F.col("product_name"), "list_price": F.col("list_price"), "unit_cost": F.col("unit_cost"), "status": F.col("product_status")})
    product = _append(product, ins.withColumns({
        "unit_cost": nvl("unit_cost", 0), "list_price": nvl("list_price", 0), "status": nvl("product_status", "DRAFT")}))
    variant = _overlay(t.product_variant, upd, "variant_id", {
        "is_active": F.col("variant_active"), "barcode_ean13": F.col("barcode_ean13"), "pack_qty": F.col("pack_qty")})
    variant = _overlay(variant, gone, "variant_id", {"is_active": F.lit("N")})
    variant = _append(variant, ins.withColumns({"pack_qty": nvl("pack_qty", 1), "is_active": nvl("variant_active", "Y")}))
    return {"product": product, "product_variant": variant}


def _through_po(ch: DataFrame, t: RetailTables, as_of) -> dict[str, DataFrame]:
    from tillweave.functions.values import pad_ref
    from tillweave.plans.procurement import po_transition

    ins = ch.filter(F.col("op") == "I")
    old = ch.filter(F.col("op") != "I").join(t.purchase_order.select("po_id", F.col("status").alias("_old")), "po_id")
    action = F.when((F.col("op") == "D") | ((F.col("status") == "CANCELLED") & (F.col("_old") != "CANCELLED")), "CANCEL").when(
        (F.col("status") == "SENT") & (F.col("_old") != "SENT"), "SEND")
    old = old.withColumn("action", action)
    moved, _ = po_transition(t, old.filter(F.col("action").isNotNull()).select("po_id", "action", F.lit(None).cast("bigint").alias("employee_id")))
    po = _overlay(moved.purchase_order, old.filter(F.col("action").isNull()), "po_id", {
        "expected_date": F.col("expected_date"), "approved_by_employee_id": F.col("approved_by_employee_id")})
    today = day_of(as_time(as_of))
    po = _append(po, ins.withColumns({
        "po_number": nvl("po_number", pad_ref("PO", "po_id", 12)), "order_date": nvl("order_date", today),
        "expected_date": nvl("expected_date", today + F.expr("INTERVAL 14 DAYS")), "status": nvl("status", "DRAFT"), "order_total": F.lit(0)}))
    return {"purchase_order": po, "purchase_order_line": moved.purchase_order_line}
