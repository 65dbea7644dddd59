"""Change-driven jobs run as streams over change files derived from the tables."""

from __future__ import annotations

import functools
import os
import uuid

from pyspark.sql import functions as F

from tillweave.catalog.registry import d, day, i, month, query
from tillweave.catalog.views import NOW
from tillweave.operators.positions import assign_ids
from tillweave.plans import mviews
from tillweave.session import shared_dir, stash
from tillweave.sources.binding import AS_OF
from tillweave.sources.extracts import publish, published, write_dynamic
from tillweave.streaming import changes as ch
from tillweave.streaming import handlers as h
from tillweave.streaming import refresh as rf

c = F.col
BATCHES = 3


def fresh(t, name: str) -> str:
    return os.path.join(shared_dir(t.spark), name, uuid.uuid4().hex)


def in_batches(spark, path: str, batches: int) -> int:
    """Files per batch so that a folder is read in about so many batches; its files stay as written."""
    return max(1, -(-len(spark.read.parquet(path).inputFiles()) // batches))


def feed(t, changes, table_df, batches: int = BATCHES):
    """Write changes as they are partitioned, numbered in order, and read them as a stream."""
    path = fresh(t, "changes")
    schema = ch.change_schema(table_df)
    changes.withColumn("seq", F.monotonically_increasing_id()).select("op", "seq", "old", "new").write.parquet(path)
    return ch.read_changes(t.spark, path, schema, files_per_batch=in_batches(t.spark, path, batches))


def as_inserts(df):
    return df.select(F.lit("I").alias("op"), F.lit(None).cast(df.select(F.struct(*df.columns).alias("r")).schema["r"].dataType).alias("old"), F.struct(*df.columns).alias("new"))


def drained(t, stream, to_rows, name: str):
    """Rows a per-batch projection appended over the whole stream."""
    out = fresh(t, "out")
    ch.run_stream(stream, h.append_handler(out, to_rows), f"{name}_{uuid.uuid4().hex[:8]}")
    return t.spark.read.parquet(out)


# ---- change log ------------------------------------------------------------------------------------------

COLS = ["order_id", "status", "subtotal_amount", "promotion_id"]


def order_changes(t):
    old = t.sales_order.select(*COLS).filter("order_id % 11 <> 0")
    new = t.sales_order.select(*COLS).filter("order_id % 13 <> 0").withColumn("status", F.when(c("order_id") % 7 == 0, "RETURNED").otherwise(c("status")))
    return old, new, ch.diff_changes(old, new, ["order_id"])


query("inc_change_log", """
SELECT order_id, CASE WHEN order_id % 11 = 0 THEN 'I' WHEN order_id % 13 = 0 THEN 'D' ELSE 'U' END AS op, CASE WHEN order_id % 11 <> 0 THEN status END AS old_status,
  CASE WHEN order_id % 13 = 0 THEN NULL WHEN order_id % 7 = 0 THEN 'RETURNED' ELSE status END AS new_status
FROM rt_sales_order WHERE NOT (order_id % 11 = 0 AND order_id % 13 = 0) AND (order_id % 11 = 0 OR order_id % 13 = 0 OR order_id % 7 = 0)""")(
    lambda t: order_changes(t)[2].select(F.coalesce("old.order_id", "new.order_id").alias("order_id"), "op", c("old.status").alias("old_status"), c("new.status").alias("new_status")))

# ---- incremental aggregates --------------------------------------------------------------------------------

LINE = ["order_id", "line_no", "variant_id", "qty", "unit_price", "discount_amount", "tax_amount"]
DAY_HEAD = ["store_id", "order_ts", "currency_code"]
MONTH_HEAD = ["order_ts", "currency_code", "channel_code", "category_id", "category_code"]


def line_changes(t, head: list[str]):
    """The lines of odd orders are stored; a stream then adds the even ones, deletes every fifth and
    changes others. The images carry what the aggregate groups by, as the capture wrote it."""
    lines = t.sales_order_line.select(*LINE).join(t.sales_order.select("order_id", *[n for n in head if "category" not in n]), "order_id")
    categories = (t.product_variant.select("variant_id", "product_id").join(t.product.select("product_id", "category_id"), "product_id")
                  .join(t.product_category.select("category_id", "category_code"), "category_id").drop("product_id"))
    lines = (lines.join(categories, "variant_id") if "category_id" in head else lines).select(*LINE, *head)
    stored = t.sales_order_line.filter("order_id % 2 = 1")
    insert, gone, moved = c("order_id") % 2 == 0, c("order_id") % 5 == 0, c("order_id") % 5 == 1
    row, nothing = F.struct(*LINE, *head), F.lit(None)
    more = F.struct(*[(c(n) + 1).cast("decimal(12,3)").alias(n) if n == "qty" else c(n) for n in (*LINE, *head)])
    changes = lines.select(
        F.when(insert, "I").when(gone, "D").when(moved, "U").alias("op"), F.when(~insert, row).otherwise(nothing).alias("old"),
        F.when(insert, row).when(moved, more).alias("new")).filter("op IS NOT NULL")
    return t.replace(sales_order_line=stored), changes, lines


def kept(t, start, spec, deltas, name: str):
    """A stored first copy and a stream of deltas, summed in the state of a streaming query."""
    path = fresh(t, f"mv_{name}")
    start.write.parquet(path)
    store = rf.KeptSums(t.spark, spec, start.schema, fresh(t, f"state_{name}"))
    store.run(t.spark.readStream.schema(start.schema).parquet(path), deltas, f"{name}_{uuid.uuid4().hex[:8]}")
    return store.read()


def streamed_daily(t):
    before, changes, lines = line_changes(t, DAY_HEAD)
    return kept(t, mviews.sales_daily_store(before), rf.DAILY, rf.daily_deltas(feed(t, changes, lines)), "daily")


_AFTER = "(SELECT order_id, CASE WHEN order_id % 2 = 1 AND order_id % 5 = 1 THEN qty + 1 ELSE qty END AS qty, unit_price, discount_amount, tax_amount FROM rt_sales_order_line WHERE order_id % 2 = 0 OR order_id % 5 <> 0)"
query("inc_fast_refresh", f"""
SELECT o.store_id, {day('o.order_ts')} AS sales_date, o.currency_code, COUNT(*) AS line_count, {d('SUM(l.qty)')} AS total_qty, COUNT(*) AS total_qty_cnt, {d('SUM(l.qty * l.unit_price)')} AS gross_amount,
  COUNT(*) AS gross_amount_cnt, {d('SUM(l.discount_amount)')} AS discount_amount, COUNT(*) AS discount_amount_cnt, {d('SUM(l.tax_amount)')} AS tax_amount, COUNT(*) AS tax_amount_cnt
FROM rt_sales_order o JOIN {_AFTER} l ON l.order_id = o.order_id GROUP BY 1, 2, 3""")(streamed_daily)


def streamed_monthly(t):
    before, changes, lines = line_changes(t, MONTH_HEAD)
    return kept(t, mviews.sales_monthly_category(before), rf.MONTHLY, rf.monthly_deltas(feed(t, changes, lines)), "monthly")


query("inc_fast_refresh_monthly", f"""
SELECT {month('o.order_ts')} AS month_start, c.category_id, c.category_code, o.currency_code, o.channel_code, COUNT(*) AS line_count, {d('SUM(l.qty)')} AS total_qty, COUNT(*) AS total_qty_cnt,
  {d('SUM(l.qty * l.unit_price - l.discount_amount)')} AS net_amount, COUNT(*) AS net_amount_cnt, {d('SUM(l.tax_amount)')} AS tax_amount, COUNT(*) AS tax_amount_cnt
FROM rt_sales_order o JOIN {_AFTER.replace("SELECT order_id,", "SELECT order_id, variant_id,")} l ON l.order_id = o.order_id JOIN rt_product_variant pv ON pv.variant_id = l.variant_id
JOIN rt_product p ON p.product_id = pv.product_id JOIN rt_product_category c ON c.category_id = p.category_id GROUP BY 1, 2, 3, 4, 5""")(streamed_monthly)


STOCK = ["location_id", "variant_id", "qty_on_hand", "qty_reserved", "reorder_point"]


def measures():
    low = F.when(c("reorder_point").isNotNull() & (c("qty_on_hand") < c("reorder_point") + c("qty_reserved")), 1).otherwise(0).cast("bigint")
    return {"qty_on_hand": c("qty_on_hand"), "qty_reserved": c("qty_reserved"), "below_reorder": low}


def stock_changes(t):
    stock = t.inventory_stock.select(*STOCK)
    less = F.struct("location_id", "variant_id", (c("qty_on_hand") - 100).cast("decimal(14,3)").alias("qty_on_hand"), "qty_reserved", "reorder_point")
    return stock, stock.filter("variant_id % 4 = 0").select(F.lit("U").alias("op"), F.struct(*STOCK).alias("old"), less.alias("new"))


def streamed_stock(t):
    stock, changes = stock_changes(t)
    return kept(t, rf.complete(stock, rf.STOCK, measures()), rf.STOCK, rf.stock_deltas(feed(t, changes, stock)), "stock")


query("inc_fast_refresh_stock", f"""
SELECT variant_id, COUNT(*) AS location_count, {d('SUM(q)')} AS qty_on_hand, COUNT(*) AS qty_on_hand_cnt, {d('SUM(qty_reserved)')} AS qty_reserved, COUNT(*) AS qty_reserved_cnt,
  {i('SUM(CASE WHEN reorder_point IS NOT NULL AND q < reorder_point + qty_reserved THEN 1 ELSE 0 END)')} AS below_reorder, COUNT(*) AS below_reorder_cnt
FROM (SELECT *, CASE WHEN variant_id % 4 = 0 THEN qty_on_hand - 100 ELSE qty_on_hand END AS q FROM rt_inventory_stock) GROUP BY 1""")(streamed_stock)


def refreshed_by_mode(t):
    """The stock aggregate published, then refreshed from a numbered change log in every mode; one
    fast attempt meets a purged log, one fails on the executors while it writes."""
    stock, changes = stock_changes(t)
    log = stash(assign_ids(changes, [c("old.location_id"), c("old.variant_id")], name="seq"))
    first = stash(rf.complete(stock, rf.STOCK, measures()))
    now = stock.withColumn("qty_on_hand", F.when(c("variant_id") % 4 == 0, (c("qty_on_hand") - 100).cast("decimal(14,3)")).otherwise(c("qty_on_hand")))
    delta = rf.deltas(rf.signed(log).select("row.*", "sign"), rf.STOCK, measures())

    def attempt(case: str, mode: str, fast: bool = True, purged: int = 0, broken: bool = False):
        path = fresh(t, "mv_mode")
        publish(first, path)
        merged = rf.fast_refresh(published(t.spark, path), delta, rf.STOCK)
        if broken:  # some of the groups are written before the fault
            merged = merged.withColumn("location_count", F.when(c("variant_id") % 64 == 1, F.raise_error(F.lit("lost"))).otherwise(c("location_count")).cast("bigint"))
        done = rf.refresh(mode, path, lambda: rf.complete(now, rf.STOCK, measures()), (lambda: merged) if fast else None, lambda: rf.covers(log.filter(c("seq") > purged), 0))
        return published(t.spark, path).agg(F.count("*").alias("groups"), F.sum("qty_on_hand").alias("qty_on_hand")).select(F.lit(case).alias("attempt"), F.lit(done).alias("mode"), "groups", "qty_on_hand")

    made = [attempt("complete", "C"), attempt("fast", "F"), attempt("either", "?"), attempt("not additive", "?", fast=False), attempt("log purged", "?", purged=1), attempt("write fails", "?", broken=True)]
    return functools.reduce(lambda a, b: a.unionByName(b), made)


query("inc_refresh_modes", f"""
SELECT v.attempt, v.mode, s.groups, s.qty_on_hand FROM (SELECT COUNT(DISTINCT variant_id) AS groups, {d('SUM(CASE WHEN variant_id % 4 = 0 THEN qty_on_hand - 100 ELSE qty_on_hand END)')} AS qty_on_hand FROM rt_inventory_stock) s,
(VALUES ('complete', 'COMPLETE'), ('fast', 'FAST'), ('either', 'FAST'), ('not additive', 'COMPLETE'), ('log purged', 'COMPLETE'), ('write fails', 'COMPLETE')) v(attempt, mode)""")(refreshed_by_mode)

# ---- audit ----------------------------------------------------------------------------------------------------

CUST = ["customer_id", "customer_ref", "last_name", "status"]


def customer_changes(t):
    old = t.customer.select(*CUST).filter("customer_id % 5 <> 0")
    new = t.customer.select(*CUST).filter("customer_id % 7 <> 0").withColumn("status", F.when(c("customer_id") % 3 == 0, "CLOSED").otherwise(c("status")))
    return old, ch.diff_changes(old, new, ["customer_id"])


def audited(t):
    table, changes = customer_changes(t)
    return drained(t, feed(t, changes, table), lambda b: h.audit_stream(b, "customer", ["customer_id"]), "audit").drop("batch", "batch_id")


_IMG = "CONCAT(customer_ref, '|', last_name, '|', {0})"
query("inc_audit_customer", f"""
SELECT 'CUSTOMER' AS table_name, CAST(customer_id AS STRING) AS pk_value, op AS action_type, CASE WHEN op <> 'I' THEN {_IMG.format('status')} END AS old_row, CASE WHEN op <> 'D' THEN {_IMG.format('ns')} END AS new_row
FROM (SELECT *, CASE WHEN customer_id % 5 = 0 THEN 'I' WHEN customer_id % 7 = 0 THEN 'D' WHEN ns <> status THEN 'U' END AS op FROM (
  SELECT *, CASE WHEN customer_id % 3 = 0 THEN 'CLOSED' ELSE status END AS ns FROM rt_customer) WHERE NOT (customer_id % 5 = 0 AND customer_id % 7 = 0)) WHERE op IS NOT NULL""")(audited)

# table, SQL of its rows, the number that decides whether a row is new (0), gone (1) or changed (2), and what changes
AUDITED = [
    ("customer", "SELECT customer_id, customer_ref, last_name, status FROM rt_customer", "customer_id", {"status": "'CLOSED'"}),
    ("loyalty_account", "SELECT loyalty_id, tier_code, points_balance FROM rt_loyalty_account", "loyalty_id", {"points_balance": "points_balance + 5"}),
    ("gl_journal_line", "SELECT journal_id, line_no FROM rt_gl_journal_line", "journal_id", {}),
    ("store", "SELECT store_id, closed_date FROM rt_store", "store_id", {"closed_date": "CAST('2001-02-03' AS TIMESTAMP)"}),
    ("order_payment", "SELECT payment_id, status FROM rt_order_payment", "payment_id", {"status": "'CAPTURED'"}),
    ("coupon", "SELECT coupon_id, coupon_code, promotion_id, redemption_count FROM rt_coupon", "coupon_id", {}),
    ("customer_address", "SELECT customer_id, primary_address_id AS address_id, 'HOME' AS address_type FROM rt_customer", "customer_id", {}),
    ("supplier_product", "SELECT supplier_id, variant_id FROM rt_supplier_product", "variant_id", {}),
    ("promotion_product", "SELECT DISTINCT o.promotion_id, l.variant_id FROM rt_sales_order o JOIN rt_sales_order_line l ON l.order_id = o.order_id WHERE o.promotion_id IS NOT NULL", "variant_id", {}),
    ("price_list_item", "SELECT price_list_id, variant_id FROM rt_price_list_item", "variant_id", {}),
    ("gl_period", "SELECT period_id FROM rt_gl_period", "period_id", {}),
    ("exchange_rate", "SELECT rate_date, from_currency, to_currency FROM rt_exchange_rate", "EXTRACT(MONTH FROM rate_date)", {}),
]


def audited_frames(t):
    orders = t.sales_order.filter(c("promotion_id").isNotNull()).select("order_id", "promotion_id")
    made = {"customer_address": t.customer.select("customer_id", c("primary_address_id").alias("address_id"), F.lit("HOME").alias("address_type")),
            "promotion_product": orders.join(t.sales_order_line.select("order_id", "variant_id"), "order_id").select("promotion_id", "variant_id").distinct()}
    for table, _, number, sets in AUDITED:
        df = made[table] if table in made else getattr(t, table)
        kind = F.expr(f"pmod({number}, 3)")
        new = F.struct(*[F.expr(sets[n]).cast(df.schema[n].dataType).alias(n) if n in sets else F.col(n) for n in df.columns])
        yield table, df.select(F.element_at(F.array(F.lit("I"), F.lit("D"), F.lit("U")), (kind + 1).cast("int")).alias("op"), F.when(kind > 0, F.struct(*df.columns)).alias("old"), F.when(kind == 0, F.struct(*df.columns)).when(kind == 2, new).alias("new"))


def audited_all(t):
    """Changes of all audited tables in one stream."""
    path = fresh(t, "mixed")
    mixed = functools.reduce(lambda a, b: a.unionByName(b), [h.as_mixed(df, table) for table, df in audited_frames(t)])
    mixed.write.parquet(path)
    stream = t.spark.readStream.schema(mixed.schema).option("maxFilesPerTrigger", in_batches(t.spark, path, BATCHES)).parquet(path)
    return drained(t, stream, h.audit_mixed, "audit").drop("batch", "batch_id")


def _audit_sql() -> str:
    sources, parts = {a[0]: a for a in AUDITED}, []
    for r in h.AUDIT_RULES:
        table, rows, number, sets = sources[r.table]

        def text(side, parts_, sets=sets):
            if parts_ is None or isinstance(parts_, str):
                return "CAST(NULL AS VARCHAR)" if parts_ is None else f"'{parts_}'"
            value = lambda f: (sets.get(f.split(":")[0], f.split(":")[0]) if side == "new" else f.split(":")[0])
            cell = lambda f: f"COALESCE(CAST(CAST({value(f)} AS DATE) AS VARCHAR), '')" if ":" in f else f"COALESCE(CAST({value(f)} AS VARCHAR), '')"
            return " || ".join(f"'{p}' || {cell(f)}" for p, f in parts_)

        key = " || '/' || ".join(f"COALESCE(CAST(CAST({k[:-5]} AS DATE) AS VARCHAR), '')" if k.endswith(":date") else f"COALESCE(CAST({k} AS VARCHAR), '')" for k in r.key)
        when = {"store": "closed_date IS NULL", "order_payment": "status <> 'CAPTURED'"}.get(r.table, "TRUE")
        fresh_image = text("old", r.new)  # a new row shows its own values
        parts.append(f"""SELECT '{table.upper()}' AS table_name, {key} AS pk_value, op AS action_type, CASE WHEN op <> 'I' THEN {text('old', r.old)} END AS old_row,
  CASE WHEN op = 'I' THEN {fresh_image} WHEN op = 'U' THEN {text('new', r.new)} END AS new_row FROM (SELECT *, ['I', 'D', 'U'][CAST({number} % 3 AS INT) + 1] AS op FROM ({rows})) WHERE op IN ({', '.join(repr(o) for o in r.ops)}) AND {when}""")
    return "\nUNION ALL ".join(parts)


query("inc_audit", _audit_sql())(audited_all)

query("inc_audit_payment", """
SELECT CAST(payment_id AS STRING) AS pk_value, status AS old_row, 'CAPTURED' AS new_row FROM rt_order_payment WHERE payment_id % 3 = 0 AND status <> 'CAPTURED'""")(
    lambda t: h.audit_payment_status(ch.diff_changes(t.order_payment, t.order_payment.withColumn("status", F.when(c("payment_id") % 3 == 0, "CAPTURED").otherwise(c("status"))), ["payment_id"]))
    .select("pk_value", "old_row", "new_row"))
query("inc_audit_coupon", """
SELECT CAST(coupon_id AS STRING) AS pk_value, CONCAT(coupon_code, '|promo=', CAST(promotion_id AS STRING), '|redemptions=', CAST(redemption_count AS STRING)) AS old_row FROM rt_coupon WHERE coupon_id % 3 = 0""")(
    lambda t: h.audit_coupon_delete(ch.diff_changes(t.coupon, t.coupon.filter("coupon_id % 3 <> 0"), ["coupon_id"])).select("pk_value", "old_row"))

# ---- ingest -----------------------------------------------------------------------------------------------------


def ingested(t):
    """Customers arriving as a stream of raw rows."""
    path = fresh(t, "raw")
    raw = t.customer.select("customer_id", F.when(c("customer_id") % 2 == 0, c("customer_ref")).alias("customer_ref"), F.concat(F.lit("  "), F.upper("email"), F.lit(" ")).alias("email"),
                            F.when(c("customer_id") % 3 == 0, c("created_ts")).alias("created_ts"), F.when(c("customer_id") % 4 == 0, "   ").otherwise(c("last_name")).alias("last_name"))
    raw.write.parquet(path)
    stream = t.spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", in_batches(t.spark, path, BATCHES)).parquet(path)
    good, _ = h.normalise_stream(stream, "customer", AS_OF, ["last_name"])
    return drained(t, good, lambda b: b, "ingest").drop("batch", "batch_id")


query("inc_normalise_ingest", f"""
SELECT customer_id, customer_ref, LOWER(email) AS email, CASE WHEN customer_id % 3 = 0 THEN created_ts ELSE {NOW} END AS created_ts, CASE WHEN customer_id % 4 <> 0 THEN last_name END AS last_name FROM rt_customer""")(ingested)
query("inc_normalise_rejects", """
SELECT order_id AS promotion_id, 'Promotion end_ts must be after start_ts' AS reject_reason FROM rt_sales_order WHERE order_id % 4 = 0""")(
    lambda t: h.normalise_stream(t.sales_order.select(c("order_id").alias("promotion_id"), c("order_ts").alias("start_ts"), F.lit(None).cast("decimal(14,2)").alias("spent_amount"), F.when(
        c("order_id") % 4 == 0, c("order_ts")).otherwise(c("order_ts") + F.expr("INTERVAL 1 DAY")).alias("end_ts")), "promotion", AS_OF)[1].select("promotion_id", "reject_reason"))

LAST_ID = 1_000_000_000  # ids given on ingest follow it
_ID = "CASE WHEN {0} % 5 = 0 THEN 1000000000 + {0} ELSE {0} END"


def raw_arrivals(t):
    """Rows of seven tables as they might arrive: every fifth without an id, some without what the rules supply."""
    fifth = lambda df, key: df.withColumn("seq", c(key)).withColumn(key, F.when(c(key) % 5 != 0, c(key)))
    some = lambda key, n, col: F.when(c(key) % n == 0, c(col)).alias(col)
    padded = lambda e, col: F.concat(F.lit("  "), e, F.lit(" ")).alias(col)
    frames = {
        "address": (t.address, "address_id", [padded(c("line1"), "line1"), padded(c("city"), "city")]),
        "customer": (t.customer, "customer_id", [some("seq", 2, "customer_ref"), padded(F.upper("email"), "email"), some("seq", 3, "created_ts")]),
        "employee": (t.employee, "employee_id", [some("seq", 2, "employee_number"), padded(F.upper("first_name"), "first_name"), padded(F.lower("last_name"), "last_name")]),
        "supplier": (t.supplier, "supplier_id", ["contact_name", F.when(c("seq") % 3 == 0, "nobody").otherwise(c("contact_email")).alias("contact_email"), "is_approved", F.lit(None).cast("timestamp").alias("onboarded_ts")]),
        "promotion": (t.promotion, "promotion_id", ["start_ts", F.when(c("seq") % 4 == 0, c("start_ts")).otherwise(c("end_ts")).alias("end_ts"), some("seq", 2, "spent_amount")]),
        "return_request": (t.return_request, "return_id", [some("seq", 2, "rma_number"), some("seq", 3, "requested_ts")]),
        "sales_order": (t.sales_order, None, ["order_id", "channel_code", some("seq", 2, "shipping_amount"), "sales_employee_id"]),
    }
    parts = []
    for table, (df, key, cols) in frames.items():
        df = df.withColumn("seq", c("order_id")) if key is None else fifth(df, key)
        parts.append(h.as_arrivals(df.select("seq", *([] if key is None else [key]), *cols), table, c("seq")))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def normalised(t, batches: int = BATCHES):
    """Arrivals of seven tables in one stream, accepted and rejected rows from one pass."""
    path, raw = fresh(t, "arrivals"), raw_arrivals(t)
    raw.write.parquet(path)
    stream = t.spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", in_batches(t.spark, path, batches)).parquet(path)
    done = drained(t, h.normalise_mixed(stream, AS_OF, {n: LAST_ID for n in h.INGEST_IDS}), lambda b: b, "normalise")
    on = lambda f: F.date_format(f, "yyyy-MM-dd")
    text = lambda *fs: F.concat_ws("|", *[F.coalesce((c(f) if isinstance(f, str) else f).cast("string"), F.lit("-")) for f in fs])
    shown = {
        "address": ("address_id", text("address.line1", "address.city")),
        "customer": ("customer_id", text("customer.customer_ref", "customer.email", on("customer.created_ts"))),
        "employee": ("employee_id", text("employee.employee_number", "employee.first_name", "employee.last_name")),
        "supplier": ("supplier_id", text("supplier.is_approved", on("supplier.onboarded_ts"))),
        "promotion": ("promotion_id", text("promotion.spent_amount", on("promotion.end_ts"))),
        "return_request": ("return_id", text("return_request.rma_number", on("return_request.requested_ts"))),
        "sales_order": ("order_id", text("sales_order.shipping_amount", "sales_order.sales_employee_id")),
    }
    here = lambda n, e: F.when(c("table_name") == n, e)
    return done.select("table_name", F.coalesce(*[here(n, c(f"{n}.{k}")) for n, (k, _) in shown.items()]).alias("row_id"),
                       F.coalesce(*[here(n, e) for n, (_, e) in shown.items()]).alias("detail"), "reject_reason")


def _ingest_sql() -> str:
    on = lambda e: f"CAST(CAST({e} AS DATE) AS STRING)"
    text = lambda *es: " || '|' || ".join(f"COALESCE(CAST({e} AS STRING), '-')" for e in es)
    words = lambda e: f"ARRAY_TO_STRING(LIST_TRANSFORM(STRING_SPLIT({e}, ' '), LAMBDA w: UPPER(w[1]) || LOWER(w[2:])), ' ')"
    now, none = on(NOW), "CAST(NULL AS STRING)"
    ref = lambda prefix, key, width: f"'{prefix}' || LPAD(CAST({_ID.format(key)} AS STRING), CAST(GREATEST({width}, LENGTH(CAST({_ID.format(key)} AS STRING))) AS INT), '0')"
    rma = f"'RMA' || STRFTIME({NOW}, '%y') || LPAD(CAST(({_ID.format('return_id')} - 1) % 999999 + 1 AS STRING), 6, '0')"
    bad = "contact_name IS NOT NULL AND (supplier_id % 3 = 0 OR contact_email IS NULL OR NOT REGEXP_MATCHES(contact_email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}$'))"
    sources = [
        ("address", "address_id", text("TRIM(line1)", "TRIM(city)"), none),
        ("customer", "customer_id", text(f"CASE WHEN customer_id % 2 = 0 AND customer_ref IS NOT NULL THEN customer_ref ELSE {ref('CU', 'customer_id', 12)} END", "LOWER(TRIM(email))", f"CASE WHEN customer_id % 3 = 0 AND created_ts IS NOT NULL THEN {on('created_ts')} ELSE {now} END"), none),
        ("employee", "employee_id", text(f"CASE WHEN employee_id % 2 = 0 AND employee_number IS NOT NULL THEN employee_number ELSE {ref('E', 'employee_id', 8)} END", words("TRIM(first_name)"), words("TRIM(last_name)")), none),
        ("supplier", "supplier_id", text(f"CASE WHEN {bad} THEN 'N' ELSE is_approved END", now), none),
        ("promotion", "promotion_id", text("CASE WHEN promotion_id % 2 = 0 THEN COALESCE(spent_amount, 0) ELSE CAST(0 AS DECIMAL(14,2)) END", on("CASE WHEN promotion_id % 4 = 0 THEN start_ts ELSE end_ts END")),
         "CASE WHEN promotion_id % 4 = 0 OR end_ts <= start_ts THEN 'Promotion end_ts must be after start_ts' END"),
        ("return_request", "return_id", text(f"CASE WHEN return_id % 2 = 0 AND rma_number IS NOT NULL THEN rma_number ELSE {rma} END", f"CASE WHEN return_id % 3 = 0 AND requested_ts IS NOT NULL THEN {on('requested_ts')} ELSE {now} END"), none),
        ("sales_order", None, text("CASE WHEN order_id % 2 = 0 AND shipping_amount IS NOT NULL THEN shipping_amount WHEN channel_code = 'WEB' THEN CAST(0 AS DECIMAL(14,2)) END", "CASE WHEN channel_code <> 'WEB' THEN sales_employee_id END"), none),
    ]
    return "\nUNION ALL ".join(f"SELECT '{n}' AS table_name, {'order_id' if k is None else _ID.format(k)} AS row_id, {e} AS detail, {r} AS reject_reason FROM rt_{n}" for n, k, e, r in sources)


query("inc_normalise_all", _ingest_sql())(normalised)

# ---- stock, ledger, payments ----------------------------------------------------------------------------------------


def in_state(t, rows, name: str, values: list[str]):
    """What a stateful stream keeps once its input is drained."""
    where = fresh(t, f"state_{name}")
    ch.run_kept(rows, where, f"{name}_{uuid.uuid4().hex[:8]}")
    return ch.read_state(t.spark, where, values)


def as_stream(t, df, name: str):
    """A table written once and read as a stream."""
    path = fresh(t, name)
    df.write.parquet(path)
    return t.spark.readStream.schema(df.schema).parquet(path)


def reserved(t):
    lines = t.sales_order_line.filter(c("fulfil_location_id").isNotNull()).select("order_id", "line_no", "variant_id", "qty", "fulfil_location_id")
    state = in_state(t, h.reservation_state(feed(t, as_inserts(lines), lines)), "reserve", ["total", "floor"])
    return h.with_reservations(t.inventory_stock, state, AS_OF).select("location_id", "variant_id", "qty_reserved", "qty_available")


query("inc_reservation_delta", f"""
SELECT s.location_id, s.variant_id, {d('s.qty_reserved + COALESCE(x.q, 0)')} AS qty_reserved, {d('s.qty_on_hand - s.qty_reserved - COALESCE(x.q, 0)')} AS qty_available FROM rt_inventory_stock s
LEFT JOIN (SELECT fulfil_location_id AS l, variant_id AS v, SUM(qty) AS q FROM rt_sales_order_line GROUP BY 1, 2) x ON x.l = s.location_id AND x.v = s.variant_id""")(reserved)

query("inc_negative_alert", """
SELECT CONCAT(CAST(location_id AS STRING), '/', CAST(variant_id AS STRING)) AS entity_key, CONCAT('qty_available went negative: ', CAST(CAST(qty_on_hand - qty_reserved AS DECIMAL(15,3)) AS STRING)) AS detail
FROM rt_inventory_stock WHERE qty_on_hand < qty_reserved""")(
    lambda t: drained(t, feed(t, as_inserts(t.inventory_stock), t.inventory_stock), h.negative_alert, "alert").select("entity_key", "detail"))


def drift(t):
    ledger, accounts = t.loyalty_transaction, t.loyalty_account
    return drained(t, feed(t, as_inserts(ledger), ledger, 1), lambda b: h.ledger_drift_batch(b, ledger, accounts), "drift").select("entity_key", "detail")


query("inc_ledger_drift", """
SELECT CAST(a.loyalty_id AS STRING) AS entity_key, CONCAT('ledger sum ', CAST(CAST(l.s AS BIGINT) AS STRING), ' <> account balance ', CAST(a.points_balance AS STRING)) AS detail
FROM rt_loyalty_account a JOIN (SELECT loyalty_id, SUM(points_delta) AS s FROM rt_loyalty_transaction GROUP BY 1) l ON l.loyalty_id = a.loyalty_id
WHERE l.s <> a.points_balance""")(drift)


def captured(t):
    old = t.order_payment.select("payment_id", "order_id", "status")
    changes = ch.diff_changes(old, old.withColumn("status", F.when(c("payment_id") % 2 == 0, "CAPTURED").otherwise(c("status"))), ["payment_id"])
    orders = as_stream(t, t.sales_order.select("order_id", "status"), "orders")
    return h.captured_orders(in_state(t, h.payment_state(orders, feed(t, changes, old)), "pay", ["status", "paid"]))


query("inc_payment_capture", """
SELECT o.order_id, CASE WHEN o.status = 'CART' AND p.payment_id IS NOT NULL THEN 'PLACED' ELSE o.status END AS status FROM rt_sales_order o
LEFT JOIN rt_order_payment p ON p.order_id = o.order_id AND p.payment_id % 2 = 0 AND p.status <> 'CAPTURED'""")(captured)

ROUTE = ["order_id", "channel_code"]
query("inc_channel_route", """
SELECT CONCAT('ROUTE_', channel_code) AS rule_code, CAST(order_id AS STRING) AS entity_key FROM rt_sales_order WHERE channel_code IN ('WEB', 'APP')""")(
    lambda t: drained(t, feed(t, as_inserts(t.sales_order.select(*ROUTE)), t.sales_order.select(*ROUTE)), h.channel_route, "route").select("rule_code", "entity_key"))
query("inc_batch_event", """
SELECT 'STATEMENT' AS rule_code, CONCAT('rows=', CAST(COUNT(*) AS STRING), ' I=', CAST(COUNT(*) AS STRING), ' U=0 D=0') AS detail FROM rt_sales_order""")(
    lambda t: drained(t, feed(t, as_inserts(t.sales_order.select(*ROUTE)), t.sales_order.select(*ROUTE), 1), lambda b: h.batch_event(b, "sales_order"), "event").select("rule_code", "detail"))


def ordered(t):
    """Journal lines streamed through two steps, faults before descriptions."""
    lines = t.gl_journal_line.select("journal_id", "line_no", "debit_amount", "credit_amount", "currency_code", "fx_rate")
    heads = t.gl_journal.select("journal_id", "status", F.when(c("journal_id") % 4 == 0, "kept").alias("description"))
    added = feed(t, as_inserts(lines), lines)
    faults = drained(t, added, h.line_faults, "faults").groupBy("rule_code").agg(F.count("*").alias("n"))
    state = in_state(t, h.journal_state(as_stream(t, heads, "journals"), added), "journals", ["status", "description", "touched"])
    described = F.coalesce("description", F.lit("<null>")).startswith("Journal ").cast("string").alias("rule_code")
    return h.described_journals(state).groupBy(described).agg(F.count("*").alias("n")).unionByName(faults)


query("inc_ordered_handlers", """
SELECT CASE WHEN status = 'DRAFT' AND journal_id % 4 <> 0 THEN 'true' ELSE 'false' END AS rule_code, COUNT(*) AS n FROM rt_gl_journal GROUP BY 1
UNION ALL SELECT 'LINE_NEEDS_RATE', COUNT(*) FROM rt_gl_journal_line WHERE fx_rate IS NULL AND currency_code <> 'GBP'
UNION ALL SELECT 'LINE_BOTH_SIDES', COUNT(*) FROM rt_gl_journal_line WHERE debit_amount > 0 AND credit_amount > 0 HAVING COUNT(*) > 0""")(ordered)


def rolled(t):
    """Two loads into monthly partitions; the second replaces the months it brings."""
    path = fresh(t, "rolled")
    po = t.purchase_order.select("po_id", "status", F.date_format("order_date", "yyyy-MM").alias("part_month"))
    write_dynamic(po, path, ["part_month"])
    write_dynamic(po.filter("part_month >= '2000-01'").withColumn("status", F.lit("REPLACED")).filter("po_id % 2 = 0"), path, ["part_month"])
    return t.spark.read.parquet(path).select("po_id", "status")


# all orders of a month share the parity of their ids, so the odd months are not in the second load
query("inc_partition_roll", """
SELECT po_id, CASE WHEN order_date >= CAST('2000-01-01' AS TIMESTAMP) AND po_id % 2 = 0 THEN 'REPLACED' ELSE status END AS status FROM rt_purchase_order""")(rolled)
