"""Reconciliation of two copies, and the snapshot and export readers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tillweave.catalog.registry import d, i, query
from tillweave.operators.scalars import beside
from tillweave.reconcile import canonical as can
from tillweave.reconcile import compare as cmp
from tillweave.reconcile import schema as sch
from tillweave.reconcile import verdict as ver
from tillweave.session import shared_dir
from tillweave.sources import snapshot as snap

c = F.col
ORDER_COLS = ["order_id", "order_number", "customer_id", "status", "order_ts", "subtotal_amount", "discount_amount"]


def fresh(t, name: str) -> str:
    return os.path.join(shared_dir(t.spark), name, uuid.uuid4().hex)


def visible(df):
    """The NULL token as readable text."""
    return df.select(*[F.when(c(n) == can.NULL_TOKEN, "<null>").otherwise(c(n)).alias(n) for n in df.columns])


def strip(expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL THEN '<null>' ELSE RTRIM(RTRIM(CAST({expr} AS STRING), '0'), '.') END"


query("rec_canonical", f"""
SELECT CAST(order_id AS STRING) AS order_id, order_number, COALESCE(CAST(customer_id AS STRING), '<null>') AS customer_id, status,
  STRFTIME(order_ts, '%Y-%m-%dT%H:%M:%S') AS order_ts, {strip('subtotal_amount')} AS subtotal_amount,
  CASE WHEN discount_amount = 0 THEN '0' ELSE {strip('discount_amount')} END AS discount_amount FROM rt_sales_order""")(
    lambda t: visible(can.canonicalize(t.sales_order.select(*ORDER_COLS))))

query("rec_canonical_types", """
SELECT CAST(o.order_id AS STRING) AS order_id, LOWER(HEX(o.order_number)) AS raw_bytes, CONCAT('0|0|', CAST(s.opening_minutes * 60 AS STRING)) AS opening,
  CONCAT(CAST(s.refit_months AS STRING), '|0|0') AS refit, CONCAT('VARR[', o.status, CHR(31), o.channel_code, ']') AS tags,
  CONCAT('OBJ<T_LINE>(status=', o.status, CHR(31), 'amount=', RTRIM(RTRIM(CAST(o.tax_amount AS STRING), '0'), '.'), ')') AS obj,
  CONCAT('MSET{', LEAST(o.status, o.channel_code), CHR(31), GREATEST(o.status, o.channel_code), '}') AS bag,
  CONCAT('<a x="1">', o.status, '</a>') AS doc FROM rt_sales_order o JOIN rt_store s ON s.store_id = o.store_id""")(
    lambda t: can.canonicalize(
        t.sales_order.join(t.store.select("store_id", "opening_offset", "refit_cycle"), "store_id").select(
            "order_id", c("order_number").cast("binary").alias("raw_bytes"), c("opening_offset").alias("opening"), c("refit_cycle").alias("refit"),
            F.array("status", "channel_code").alias("tags"), F.struct("status", c("tax_amount").alias("amount")).alias("obj"),
            F.array("status", "channel_code").alias("bag"), F.concat(F.lit("<a   x='1'>"), c("status"), F.lit("</a>")).alias("doc")),
        {"bag": "collection_nested", "doc": "xml"}, {"obj": "T_LINE"}))

query("rec_bound_cell", """
SELECT doc_id, CASE WHEN STRLEN(text) > 2000 THEN CONCAT('BIG:len=', CAST(STRLEN(text) AS STRING), ':sha256=', SHA256(text)) ELSE text END AS text FROM documents""")(
    lambda t: t.base("documents").select("doc_id", can.bound_cell("text", 2000).alias("text")))

query("rec_classify", """
SELECT 'numeric' AS rule, CAST(COUNT(order_id) + COUNT(customer_id) + COUNT(subtotal_amount) + COUNT(discount_amount) AS BIGINT) AS cells FROM rt_sales_order
UNION ALL SELECT 'varchar', COUNT(order_number) + COUNT(status) FROM rt_sales_order UNION ALL SELECT 'date', COUNT(order_ts) FROM rt_sales_order""")(
    lambda t: (lambda rules, df: df.agg(*[F.count(n).alias(n) for n in ORDER_COLS]).select(F.inline(F.array(*[
        F.struct(F.lit(rules[n]).alias("rule"), c(n).alias("n")) for n in ORDER_COLS]))).groupBy("rule").agg(F.sum("n").alias("cells")))(
        can.classify([{"name": n, "type": k} for n, k in zip(ORDER_COLS, ("NUMBER", "VARCHAR2", "NUMBER", "VARCHAR2", "DATE", "NUMBER", "NUMBER"))]),
        t.sales_order.select(*ORDER_COLS)))


def pair(t):
    """Orders and a copy with known damage: some changed, some missing, some added."""
    src = t.sales_order.select(*ORDER_COLS)
    kept = src.filter("order_id % 97 <> 0").withColumns({
        "subtotal_amount": F.when(c("order_id") % 101 == 0, c("subtotal_amount") + F.lit("0.01").cast("decimal(3,2)")).otherwise(c("subtotal_amount")).cast("decimal(14,2)"),
        "status": F.when(c("order_id") % 103 == 0, F.lit("")).otherwise(c("status"))})
    added = src.filter("order_id % 89 = 0").withColumn("order_id", c("order_id") + 100_000_000)
    tgt = kept.unionByName(added).select(*reversed(ORDER_COLS))
    return can.canonicalize(src), can.canonicalize(tgt)


_M, _CH = "order_id % 97 = 0", "order_id % 97 <> 0 AND (order_id % 101 = 0 OR order_id % 103 = 0)"
for _name in ("rec_compare", "join_full_key_compare"):
    query(_name, f"""
SELECT COUNT(*) AS source_rows, COUNT(*) FILTER (NOT ({_M})) + COUNT(*) FILTER (order_id % 89 = 0) AS target_rows, COUNT(*) FILTER ({_M}) AS missing_keys,
  COUNT(*) FILTER (order_id % 89 = 0) AS extra_keys, COUNT(*) FILTER ({_CH}) AS changed_rows, CAST(0 AS BIGINT) AS duplicate_keys, CAST(0 AS BIGINT) AS empty_keys, 'failed' AS status FROM rt_sales_order""")(
        lambda t: cmp.compare(*pair(t), ["order_id"])[0].drop("refused"))
query("rec_compare_samples", f"SELECT CAST(order_id AS STRING) AS order_id FROM rt_sales_order WHERE {_CH} ORDER BY CAST(order_id AS STRING) LIMIT 10")(
    lambda t: cmp.compare(*pair(t), ["order_id"])[1])
query("rec_compare_refused", """
SELECT COUNT(*) AS duplicate_keys, 'refused' AS status, 'duplicate comparison key' AS refused FROM (SELECT order_id, line_no FROM rt_sales_order_line GROUP BY 1, 2 HAVING COUNT(*) > 1)""")(
    lambda t: (lambda df: cmp.compare(df, df, ["order_id", "line_no"])[0].select("duplicate_keys", "status", "refused"))(
        can.canonicalize(t.sales_order_line.select("order_id", "line_no", "variant_id", "qty"))))

query("rec_cell_diff", " UNION ALL ".join(
    f"SELECT '{n}' AS column_name, COUNT(*) AS cells, {cond} AS mismatches FROM rt_sales_order WHERE NOT ({_M})" for n, cond in (
        ("order_number", "CAST(0 AS BIGINT)"), ("customer_id", "CAST(0 AS BIGINT)"), ("order_ts", "CAST(0 AS BIGINT)"), ("discount_amount", "CAST(0 AS BIGINT)"),
        ("subtotal_amount", "COUNT(*) FILTER (order_id % 101 = 0)"), ("status", "COUNT(*) FILTER (order_id % 103 = 0)"))))(
    lambda t: cmp.cell_diff(*pair(t), ["order_id"]))

query("rec_counts", """
SELECT '*' AS column_name, COUNT(*) AS source_count, COUNT(*) FILTER (customer_id % 5 <> 0) AS target_count, CASE WHEN COUNT(*) = COUNT(*) FILTER (customer_id % 5 <> 0) THEN 'Y' ELSE 'N' END AS equal FROM rt_customer
UNION ALL SELECT 'email', COUNT(email), COUNT(email) FILTER (customer_id % 5 <> 0), CASE WHEN COUNT(email) = COUNT(email) FILTER (customer_id % 5 <> 0) THEN 'Y' ELSE 'N' END FROM rt_customer
UNION ALL SELECT 'gdpr_erasure_ts', COUNT(gdpr_erasure_ts), COUNT(gdpr_erasure_ts) FILTER (customer_id % 5 <> 0), CASE WHEN COUNT(gdpr_erasure_ts) = COUNT(gdpr_erasure_ts) FILTER (customer_id % 5 <> 0) THEN 'Y' ELSE 'N' END FROM rt_customer""")(
    lambda t: cmp.count_check(t.customer, t.customer.filter("customer_id % 5 <> 0"), ["email", "gdpr_erasure_ts"]))

query("rec_id_highwater", """
SELECT 'customer' AS table_name, MAX(customer_id) AS high_water FROM rt_customer UNION ALL SELECT 'sales_order', MAX(order_id) FROM rt_sales_order
UNION ALL SELECT 'empty', NULL""")(
    lambda t: cmp.id_highwater({"customer": (t.customer, "customer_id"), "sales_order": (t.sales_order, "order_id"), "empty": (t.sales_order.filter("order_id < 0"), "order_id")}))

query("rec_name_match", f"SELECT order_id, order_number AS number, {d('subtotal_amount')} AS subtotal_amount FROM rt_sales_order")(
    lambda t: (lambda df, m: df.select(*[c(s).alias(n) for n, s in m.items()]))(
        t.sales_order.select(c("order_id").alias("ORDER_ID"), c("order_number").alias("OrderNumber"), c("subtotal_amount").alias("SUBTOTAL_AMOUNT")),
        sch.match_names(["ORDER_ID", "OrderNumber", "SUBTOTAL_AMOUNT"], ["order_id", "number", "subtotal_amount"], {"number": "OrderNumber"})))


def load_inputs(t):
    """Source metadata profiled from the tables' data; target metadata as declared."""
    prof = sch.profile_schema(t.customer.select("customer_id", "email", "status"), "CUSTOMER").unionByName(
        sch.profile_schema(t.sales_order.select("order_id", "order_number", "subtotal_amount"), "SALES_ORDER")).unionByName(
        sch.profile_schema(t.store.select("store_id", "store_code"), "STORE"))
    src = prof.select("table", F.upper("name").alias("name"), c("data_type").alias("type"), F.lit(False).alias("is_udt"))
    rows = [("customer", "customer_id", "scalar", "bigint", False, False, False), ("customer", "email", "scalar", "text", False, False, False),
            ("customer", "status", "scalar", "text", False, False, False), ("customer", "loaded_at", "scalar", "timestamp", False, False, True),
            ("customer", "email_domain", "scalar", "text", True, False, False), ("sales_order", "order_id", "scalar", "bigint", False, False, False),
            ("sales_order", "order_number", "composite", "t_ref", False, False, False), ("sales_order", "channel", "scalar", "text", False, False, False)]
    return src, t.spark.createDataFrame(rows, "table string, name string, kind string, type string, generated boolean, identity boolean, has_default boolean")


query("rec_load_plan", """
SELECT * FROM (VALUES ('customer_id', 'insert', 'CUSTOMER_ID'), ('email', 'insert', 'EMAIL'), ('status', 'insert', 'STATUS'), ('loaded_at', 'auto_filled', NULL), ('email_domain', 'generated', NULL)) v(name, role, source_name)""")(
    lambda t: sch.load_plan(*load_inputs(t))[0].select("name", "role", "source_name"))
query("rec_load_plan_blockers", """
SELECT * FROM (VALUES ('table_match', 'STORE', NULL), ('type_mismatch', 'sales_order', 'order_number'), ('missing_source_column', 'sales_order', 'channel'), ('dropped_source_column', 'SALES_ORDER', 'SUBTOTAL_AMOUNT')) v(kind, "table", name)""")(
    lambda t: sch.load_plan(*load_inputs(t))[1].select("kind", "table", "name"))


def applied(t):
    path = fresh(t, "applied")
    sch.apply_plan(t.sales_order, [("id", "order_id", "bigint"), ("number", "order_number", "string"), ("discounted", "discount_amount", "boolean")], path)
    return t.spark.read.parquet(path)


query("rec_apply_plan", "SELECT order_id AS id, order_number AS number, discount_amount <> 0 AS discounted FROM rt_sales_order")(applied)
query("rec_bool_encode", "SELECT order_id, line_no, variant_id, discount_amount <> 0 AS flag FROM rt_sales_order_line")(
    lambda t: t.sales_order_line.select("order_id", "line_no", "variant_id", can.bool_flag("discount_amount").alias("flag")))
query("rec_json_null", """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'null' WHEN event_id % 10 = 1 THEN NULL WHEN event_id % 10 = 2 THEN CONCAT('{"n":', CAST(event_id AS STRING), '12345678901234567890123}') ELSE REPLACE(props, ' ', '') END AS doc FROM events""")(
    lambda t: t.base("events").select("event_id", can.json_text(
        F.when(c("event_id") % 10 == 0, " null ").when(c("event_id") % 10 == 1, F.lit(None)).when(
            c("event_id") % 10 == 2, F.concat(F.lit('{"n": '), c("event_id").cast("string"), F.lit("12345678901234567890123}"))).otherwise(c("props"))).alias("doc")))


def gate(t):
    """Declared metadata of two tables against what their data supports."""
    spark = t.spark
    cu, so = t.customer.select("customer_id", "email", "status"), t.sales_order.select("order_id", "customer_id", "order_number")
    actual = sch.profile_schema(cu, "customer").unionByName(sch.profile_schema(so, "sales_order"))
    expected = sch.metadata(spark, [
        ("customer", "customer_id", "numeric", False, False, None, None, None), ("customer", "email", "varchar", False, False, None, None, None),
        ("customer", "status", "varchar", False, False, None, None, 7), ("sales_order", "order_id", "numeric", False, False, None, None, None),
        ("sales_order", "customer_id", "numeric", True, False, None, None, None), ("sales_order", "order_number", "date", False, False, None, None, None),
        ("absent", "x", "varchar", True, False, None, None, None)], expected=True)
    keys = lambda rows: spark.createDataFrame(rows, "table string, kind string, columns array<string>")
    claimed = [("customer", "primary", ["customer_id"]), ("sales_order", "primary", ["order_id"]), ("sales_order", "unique", ["customer_id"])]
    frames = {"customer": cu, "sales_order": so}
    held = [sch.key_holds(frames[tab], cols).filter("repeated = 0 and incomplete = 0").select(
        F.lit(tab).alias("table"), F.lit(kind).alias("kind"), F.array(*[F.lit(x) for x in cols]).alias("columns")) for tab, kind, cols in claimed]
    actual_keys = held[0].unionByName(held[1]).unionByName(held[2])
    return sch.schema_gate(expected, actual, keys(claimed), actual_keys)


query("rec_schema_gate", """
SELECT 'customer' AS "table", TRUE AS present, TRUE AS columns_match, TRUE AS type_family_ok, (SELECT COUNT(*) FILTER (email IS NULL) = 0 FROM rt_customer) AS not_null_ok, TRUE AS generated_ok,
  (SELECT MAX(LENGTH(status)) = 7 FROM rt_customer) AS quantitative_ok, (SELECT COUNT(*) = COUNT(DISTINCT customer_id) FROM rt_customer) AS primary_key_ok, TRUE AS unique_ok, 'mismatch' AS verdict
UNION ALL SELECT 'sales_order', TRUE, TRUE, FALSE, TRUE, TRUE, TRUE, (SELECT COUNT(*) = COUNT(DISTINCT order_id) FROM rt_sales_order), (SELECT COUNT(*) = COUNT(DISTINCT customer_id) FROM rt_sales_order), 'mismatch'
UNION ALL SELECT 'absent', FALSE, FALSE, TRUE, TRUE, TRUE, TRUE, FALSE, TRUE, 'missing'""")(gate)

query("rec_key_choice", """
SELECT 'order_id' AS key_columns, COUNT(*) AS repeated, CAST(0 AS BIGINT) AS incomplete FROM (SELECT order_id FROM rt_sales_order GROUP BY 1 HAVING COUNT(*) > 1)""")(
    lambda t: (lambda key: sch.key_holds(t.sales_order, key).select(F.lit(",".join(key)).alias("key_columns"), "repeated", "incomplete"))(
        sch.choose_key([{"name": "order_number", "nullable": "Y"}, {"name": "order_id", "nullable": "N"}],
                       [{"kind": "primary", "columns": ["order_number"]}, {"kind": "unique", "columns": ["order_id"]}])))


def verdicts(t):
    """Dispositions of several table pairs, each from its own comparison."""
    src, tgt = pair(t)
    cust = can.canonicalize(t.customer.select("customer_id", "email", "status"))
    none = t.sales_order.filter("order_id < 0")

    def fact(name, a, b, keys, verdict="ok", present=True, renderable=True):
        if keys:
            s = cmp.compare(a, b, keys)[0].select("source_rows", "target_rows", F.when(c("refused").isNull(), c("status")).alias("parity"))
        else:
            s = beside(a.agg(F.count("*").alias("source_rows")), b.agg(F.count("*").alias("target_rows"))).withColumn("parity", F.lit(None).cast("string"))
        return s.select(F.lit(name).alias("table"), "source_rows", F.lit(present).alias("target_present"), F.lit(verdict).alias("schema_verdict"), "target_rows",
                        F.lit(bool(keys)).alias("has_key"), F.lit(renderable).alias("renderable"), "parity")

    facts = [
        fact("orders", src, tgt, ["order_id"]), fact("customers", cust, cust, ["customer_id"]), fact("empty_both", none, none, None),
        fact("empty_source", none, t.sales_order, None), fact("no_key", t.sales_order_line, t.sales_order_line, None), fact("bad_schema", cust, cust, ["customer_id"], verdict="mismatch"),
        fact("absent", cust, cust, ["customer_id"], present=False), fact("empty_pending", none, none, None, verdict="pending"),
        fact("complex", t.product, t.product, None, renderable=False)]
    out = facts[0]
    for f in facts[1:]:
        out = out.unionByName(f)
    return ver.disposition(out)


_COUNTS = """SELECT 'orders' AS "table", (SELECT COUNT(*) FROM rt_sales_order) AS source_rows, 'parity_fail' AS result
UNION ALL SELECT 'customers', (SELECT COUNT(*) FROM rt_customer), 'parity_pass' UNION ALL SELECT 'empty_both', 0, 'empty_verified' UNION ALL SELECT 'empty_source', 0, 'empty_mismatch'
UNION ALL SELECT 'no_key', (SELECT COUNT(*) FROM rt_sales_order_line), 'blocked_no_comparable_key' UNION ALL SELECT 'bad_schema', (SELECT COUNT(*) FROM rt_customer), 'schema_mismatch'
UNION ALL SELECT 'absent', (SELECT COUNT(*) FROM rt_customer), 'target_table_missing' UNION ALL SELECT 'empty_pending', 0, 'empty_schema_unverified'
UNION ALL SELECT 'complex', (SELECT COUNT(*) FROM rt_product), 'blocked_complex_target_render'"""
query("rec_disposition", _COUNTS)(lambda t: verdicts(t).select("table", "source_rows", "result"))
query("rec_empty_table", f"""SELECT "table", result FROM ({_COUNTS}) WHERE "table" LIKE 'empty%'""")(lambda t: verdicts(t).filter(c("table").startswith("empty")).select("table", "result"))
query("rec_rollup", """
SELECT CAST(9 AS BIGINT) AS tables, CAST(2 AS BIGINT) AS tables_passed, 'absent,bad_schema,complex,empty_pending,empty_source,no_key,orders' AS failed_tables, 'failed' AS value_gates,
  'failed' AS status, 'subset' AS coverage, 'FAIL' AS overall WHERE (SELECT COUNT(*) FROM rt_sales_order) > 0""")(
    lambda t: ver.rollup(verdicts(t), 9, 12).withColumn("failed_tables", F.array_join("failed_tables", ",")))

# ---- readers ------------------------------------------------------------------------------------------

SNAP = [{"name": "order_id", "rule": "numeric", "precision": 18, "scale": 0}, {"name": "order_number", "rule": "varchar"}, {"name": "customer_id", "rule": "numeric", "precision": 12, "scale": 0},
        {"name": "status", "rule": "varchar"}, {"name": "order_ts", "rule": "date"}, {"name": "subtotal_amount", "rule": "numeric", "precision": 14, "scale": 2},
        {"name": "discount_amount", "rule": "numeric", "precision": 14, "scale": 2}]


def snapshot_lines(t):
    """Orders as snapshot lines, some spoiled by an unknown tag, a short row or broken text."""
    lines = snap.encode_lines(t.sales_order.select(*ORDER_COLS), {s["name"]: s["rule"] for s in SNAP}).withColumn(
        "k", F.regexp_extract("value", r'^\[\{"\$decimal":"(\d+)"', 1).cast("bigint"))
    value = F.when(c("k") % 50 == 0, F.replace("value", F.lit("$datetime"), F.lit("$epoch"))).when(c("k") % 50 == 1, "[1,2]").when(
        c("k") % 50 == 2, "not json").otherwise(c("value"))
    return lines.select(value.alias("value"))


def snapshot_read(t):
    path = fresh(t, "snapshot")
    snapshot_lines(t).write.text(path)
    return snap.read_snapshot(t.spark, path, SNAP)


query("src_snapshot", f"""
SELECT CAST(order_id AS DOUBLE) AS order_id, order_number, CAST(customer_id AS DOUBLE) AS customer_id, status, order_ts, {d('subtotal_amount')} AS subtotal_amount, {d('discount_amount')} AS discount_amount
FROM rt_sales_order WHERE order_id % 50 > 2""")(lambda t: snapshot_read(t)[0])
query("src_snapshot_errors", """
SELECT CASE order_id % 50 WHEN 0 THEN 'Unknown source tag in order_ts' WHEN 1 THEN 'wrong number of cells' ELSE 'line is not JSON' END AS reject_reason, COUNT(*) AS n
FROM rt_sales_order WHERE order_id % 50 <= 2 GROUP BY 1""")(lambda t: snapshot_read(t)[1].groupBy("reject_reason").agg(F.count("*").alias("n")))


def manifest_faults(t):
    """Members written from two tables, with a wrong hash, a wrong count and an unsafe name put in."""
    from pyarrow import fs

    folder = fresh(t, "members")
    members = {}
    for name, df in (("SALES_ORDER", t.sales_order.select("order_id")), ("CUSTOMER", t.customer.select("customer_id"))):
        sub = os.path.join(folder, name)
        df.select(F.to_json(F.array(c(df.columns[0]))).alias("value")).write.text(sub)
        system, root = fs.FileSystem.from_uri(sub) if "://" in sub else (fs.LocalFileSystem(), sub)
        members[name] = (sub, sorted(f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-")))
    manifest = {"tables": [], "blockers": []}
    for name, (sub, files) in members.items():
        manifest["tables"] += snap.build_manifest(t.spark, sub, {name: files})["tables"]
    good = [snap.verify_manifest(t.spark, {"tables": [e for e in manifest["tables"] if e["table"] == n]}, sub) for n, (sub, _) in members.items()]
    orders, (sub, _) = [e for e in manifest["tables"] if e["table"] == "SALES_ORDER"], members["SALES_ORDER"]
    total = sum(e["rows"] for e in orders)
    bad = [{**orders[0], "sha256": "0" * 64}, {**orders[0], "rows": orders[0]["rows"] + 1, "table": "COUNT"}, {**orders[0], "file": "../x", "table": "PATH"}, {"table": "SHORT"}]
    faults = snap.verify_manifest(t.spark, {"tables": bad, "blockers": ["late"]}, sub)
    return good[0].unionByName(good[1]).unionByName(faults).select("kind", "table").withColumn("rows_hashed", F.lit(total).cast("bigint"))


query("src_manifest", """
SELECT v.*, (SELECT COUNT(*) FROM rt_sales_order) AS rows_hashed FROM (VALUES ('export_blocker', NULL), ('file_validation', 'SALES_ORDER'), ('file_validation', 'COUNT'), ('file_validation', 'PATH'), ('file_validation', 'SHORT')) v(kind, "table")""")(manifest_faults)


def csv_pair(t):
    path = fresh(t, "export")
    src = pair(t)[0]
    visible(src).withColumn("note", F.concat(F.lit('a, "b"\n'), c("status"))).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return snap.read_export(t.spark, path, ["order_id"])


query("src_csv_keyed", """
SELECT CAST(order_id AS STRING) AS order_id, COALESCE(CAST(customer_id AS STRING), '<null>') AS customer_id, CONCAT('a, "b"', CHR(10), status) AS note FROM rt_sales_order""")(
    lambda t: csv_pair(t).select("order_id", "customer_id", "note"))


def other_side(t):
    path = fresh(t, "copy")
    t.sales_order.select("order_id", "status").write.json(path)
    return snap.read_copy(t.spark, path, "order_id long, status string", "json")


query("src_other_side", "SELECT order_id, status FROM rt_sales_order")(other_side)
