"""Purchasing jobs: drafts, lines, status changes, receipts and closing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.functions.values import By, nvl
from tillweave.operators.merge import quarantine
from tillweave.operators.positions import assign_ids, rank_cols
from tillweave.sources.tables import RetailTables


def receipts(t: RetailTables, batch: DataFrame, faithful: bool = True) -> tuple[RetailTables, DataFrame]:
    """Post receipts: good rows are kept, bad rows become issues, purchase order lines are updated.

    The source adds rejected receipts to the lines as well; `faithful=False` leaves them out.
    """
    rows = batch.withColumn("qty_rejected", nvl("qty_rejected", 0))
    good, bad = quarantine(
        rows, {"RECEIPT_BULK_REJECT": (F.col("qty_received") >= 0) & (F.col("qty_rejected") >= 0)}, "GOODS_RECEIPT",
        F.concat(F.col("po_id").cast("string"), F.lit("/"), F.col("po_line_no").cast("string")))
    counted = (rows if faithful else good).groupBy("po_id", F.col("po_line_no").alias("line_no")).agg(F.sum("qty_received").alias("_in"))
    lines = t.purchase_order_line
    total = nvl("qty_received", 0) + F.col("_in")
    hit = F.col("_in").isNotNull()
    updated = lines.join(counted, ["po_id", "line_no"], "left").withColumns({
        "status": F.when(hit, F.when(total >= F.col("qty_ordered"), "RECEIVED").otherwise("PART_RECV")).otherwise(F.col("status")),
        "qty_received": F.when(hit, total).otherwise(F.col("qty_received")).cast("decimal(12,3)"),
    }).select(*lines.columns)
    return t.replace(purchase_order_line=updated, goods_receipt=good), bad


def po_close(t: RetailTables, tol_pct=None) -> DataFrame:
    """Purchase orders with every line received within tolerance become RECEIVED.

    The tolerance is a parameter text; one that is not a number counts as 5.
    """
    try:
        tol = float(tol_pct)
    except (TypeError, ValueError):
        tol = 5.0
    share = F.lit(f"{1 - tol / 100:.6f}").cast("decimal(9,6)")
    short = t.purchase_order_line.filter(nvl("qty_received", 0) < F.col("qty_ordered") * share).select("po_id").distinct()
    flagged = t.purchase_order.join(short.withColumn("_short", F.lit(True)), "po_id", "left")
    return flagged.withColumn("status", F.when(F.col("_short").isNull(), "RECEIVED").otherwise(F.col("status"))).select(*t.purchase_order.columns)


def po_create(requests: DataFrame, t: RetailTables, start_id: int) -> tuple[DataFrame, DataFrame]:
    """Draft orders for (request_id, supplier_id, warehouse_id, order_date); unknown suppliers and
    suppliers marked as not approved are rejected. A supplier without a mark passes. Numbers follow
    request_id; requests that share one go by supplier, warehouse and date, so a rerun agrees."""
    known = t.supplier.select("supplier_id", "is_approved", "currency_code", F.lit(True).alias("_known"))
    sid = F.col("supplier_id").cast("string")
    reason = F.when(F.col("_known").isNull(), F.concat(F.lit("Unknown supplier "), sid)).when(
        F.col("is_approved") != "Y", F.concat(F.lit("Supplier "), sid, F.lit(" is not approved for purchasing")))
    judged = requests.join(known, "supplier_id", "left").withColumn("reject_reason", reason)
    ok = assign_ids(judged.filter(F.col("reject_reason").isNull()), [F.col(c) for c in ("request_id", "supplier_id", "warehouse_id", "order_date")], start_id, "po_id", "PO", 12, "po_number")
    new = ok.select(
        "request_id", "po_id", "po_number", "supplier_id", "warehouse_id", "order_date",
        (F.col("order_date") + F.expr("INTERVAL 14 DAYS")).alias("expected_date"), F.lit("DRAFT").alias("status"), "currency_code",
        F.lit(0).cast("decimal(14,2)").alias("order_total"))
    return new, judged.filter(F.col("reject_reason").isNotNull()).select(*requests.columns, "reject_reason")


def _priced(requests: DataFrame, t: RetailTables) -> DataFrame:
    """Requested lines with `_qty` and `_cost` as a line holds them; a missing cost is the primary source's, else 0.

    Only requests without a cost look for a source.
    """
    source = t.supplier_product.filter(F.col("is_primary_source") == "Y").groupBy("supplier_id", "variant_id").agg(
        F.min("unit_cost").alias("_found"))
    asks = requests.filter(F.col("unit_cost").isNull()).join(t.purchase_order.select("po_id", "supplier_id"), "po_id", "left").join(
        source, ["supplier_id", "variant_id"], "left").select(*requests.columns, "_found")
    return requests.filter(F.col("unit_cost").isNotNull()).withColumn("_found", F.lit(None).cast(asks.schema["_found"].dataType)).unionByName(asks).select(
        "po_id", "seq", "variant_id", F.col("qty").cast("decimal(12,3)").alias("_qty"), F.coalesce("unit_cost", "_found", F.lit(0)).cast("decimal(12,4)").alias("_cost"))


def po_lines(requests: DataFrame, t: RetailTables) -> tuple[DataFrame, DataFrame]:
    """Append (po_id, seq, variant_id, qty, unit_cost) lines; a missing cost is the primary source's,
    else 0. Returns the new lines and the orders with their new totals."""
    last = t.purchase_order_line.groupBy("po_id").agg(F.max("line_no").alias("_last"))
    rows = rank_cols(_priced(requests, t).join(last, "po_id", "left"), ["po_id"], [By("seq")], {"_n": "row_number"}, ["variant_id"])
    lines = rows.select(
        "po_id", (nvl("_last", 0) + F.col("_n")).cast("bigint").alias("line_no"), "variant_id", F.col("_qty").alias("qty_ordered"),
        F.lit(0).cast("decimal(12,3)").alias("qty_received"), F.col("_cost").alias("unit_cost"),
        F.lit("OPEN").alias("status"))
    return lines, po_totals(requests, t)


def po_totals(requests: DataFrame, t: RetailTables) -> DataFrame:
    """The orders with the totals they have once the requested lines are appended.

    A total asks for no line numbers, so no line is ranked; each side is summed per order before it
    meets the orders.
    """
    value = lambda qty, cost: F.sum(F.col(qty) * F.col(cost))
    new = _priced(requests, t).groupBy("po_id").agg(value("_qty", "_cost").alias("_new"))
    live = t.purchase_order_line.filter(nvl("status", "OPEN") != "CANCELLED").groupBy("po_id").agg(value("qty_ordered", "unit_cost").alias("_live"))
    known = F.coalesce(F.col("_new") + F.col("_live"), "_new", "_live")
    totals = new.join(live, "po_id", "left").select("po_id", known.cast("decimal(14,2)").alias("_total"))
    return t.purchase_order.join(totals, "po_id", "left").withColumn("order_total", F.coalesce("_total", "order_total")).select(*t.purchase_order.columns)


def po_transition(t: RetailTables, requests: DataFrame) -> tuple[RetailTables, DataFrame]:
    """APPROVE, SEND or CANCEL orders, one request per order; illegal steps are rejected.

    Approving needs DRAFT, sending needs an approver and not SENT, cancelling needs DRAFT or SENT
    and cancels the lines too.
    """
    po = t.purchase_order
    ask = requests.select("po_id", "action", F.col("employee_id").alias("_emp"))
    both = ask.join(po.select("po_id", F.col("status").alias("_st"), F.col("approved_by_employee_id").alias("_app")).withColumn("_known", F.lit(True)),
                    "po_id", "left")
    pid = F.concat(F.lit("Purchase order "), F.col("po_id").cast("string"))
    act, st = F.col("action"), F.col("_st")
    reason = (
        F.when(F.col("_known").isNull(), F.concat(F.lit("Unknown purchase order "), F.col("po_id").cast("string")))
        .when((act == "APPROVE") & (st != "DRAFT"), F.concat(pid, F.lit(" has already left DRAFT (status "), st, F.lit(")")))
        .when((act == "SEND") & (st == "SENT"), F.concat(pid, F.lit(" already sent")))
        .when((act == "SEND") & F.col("_app").isNull(), F.concat(pid, F.lit(" is not approved")))
        .when((act == "CANCEL") & ~st.isin("DRAFT", "SENT"), F.concat(pid, F.lit(" cannot be cancelled in its current status")))
    )
    judged = both.withColumn("reject_reason", reason)
    good = judged.filter(F.col("reject_reason").isNull()).select("po_id", "action", "_emp")
    new = po.join(good, "po_id", "left").withColumns({
        "status": F.when(F.col("action") == "SEND", "SENT").when(F.col("action") == "CANCEL", "CANCELLED").otherwise(F.col("status")),
        "approved_by_employee_id": F.when(F.col("action") == "APPROVE", F.col("_emp")).otherwise(F.col("approved_by_employee_id")),
    }).select(*po.columns)
    gone = good.filter(F.col("action") == "CANCEL").select("po_id", F.lit(True).alias("_gone"))
    lines = t.purchase_order_line
    new_lines = lines.join(gone, "po_id", "left").withColumn(
        "status", F.when(F.col("_gone"), "CANCELLED").otherwise(F.col("status"))).select(*lines.columns)
    return t.replace(purchase_order=new, purchase_order_line=new_lines), judged.filter(
        F.col("reject_reason").isNotNull()).select("po_id", "action", "reject_reason")
