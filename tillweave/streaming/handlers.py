"""Change-driven jobs: audit rows, normalisation on ingest, reservations, alerts, payments, routes.

Each takes a (batch or streaming) frame of changes and returns rows. The ones that keep state return
a stateful stream, whose state is read back when it is wanted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.functions.values import as_time, empty_to_null, nvl, pad_ref, valid_email
from tillweave.plans.quality import dq_ledger_drift, issues
from tillweave.streaming.changes import Handler

# Columns whose values form the audit image of a table.
AUDIT_IMAGES = {
    "customer": ("customer_ref", "last_name", "status"),
    "loyalty_account": ("tier_code", "points_balance"),
    "gl_journal_line": (),
}


def _pick(field: str) -> Column:
    return F.coalesce(F.col(f"new.{field}"), F.col(f"old.{field}"))


def _image(row: str, cols: tuple[str, ...]) -> Column:
    if not cols:
        return F.lit(None).cast("string")
    text = F.concat(*[x for k, c in enumerate(cols) for x in ((F.lit("|"),) if k else ()) + (nvl(F.col(f"{row}.{c}").cast("string"), ""),)])
    return F.when(F.col(row).isNotNull(), text)


def audit_row(table: str, key: Column, action: Column, old: Column, new: Column) -> list[Column]:
    return [F.substring(F.upper(F.lit(table)), 1, 30).alias("table_name"), F.substring(key.cast("string"), 1, 200).alias("pk_value"),
            F.substring(F.upper(action), 1, 1).alias("action_type"), old.alias("old_row"), new.alias("new_row")]


def audit_stream(changes: DataFrame, table: str, key: list[str], image: tuple[str, ...] | None = None) -> DataFrame:
    """One audit row per row change, with the images the table is audited by."""
    cols = AUDIT_IMAGES[table] if image is None else image
    pk = F.concat_ws("/", *[_pick(k).cast("string") for k in key])
    return changes.select(*audit_row(table, pk, F.col("op"), _image("old", cols), _image("new", cols)))


def audit_coupon_delete(changes: DataFrame) -> DataFrame:
    gone = changes.filter(F.col("op") == "D")
    text = F.concat(F.col("old.coupon_code"), F.lit("|promo="), F.col("old.promotion_id").cast("string"), F.lit("|redemptions="), F.col("old.redemption_count").cast("string"))
    return gone.select(*audit_row("coupon", F.col("old.coupon_id"), F.lit("D"), text, F.lit(None).cast("string")))


def audit_payment_status(changes: DataFrame) -> DataFrame:
    moved = changes.filter((F.col("op") == "U") & (F.col("new.status") != F.col("old.status")))
    return moved.select(*audit_row("order_payment", F.col("old.payment_id"), F.lit("U"), nvl("old.status", "UNKNOWN"), nvl("new.status", "UNKNOWN")))


def audit_store_closing(changes: DataFrame) -> DataFrame:
    shut = changes.filter((F.col("op") == "U") & F.col("new.closed_date").isNotNull() & F.col("old.closed_date").isNull())
    return shut.select(*audit_row("store", F.col("old.store_id"), F.lit("U"), F.lit("closed_date=NULL"),
                                  F.concat(F.lit("closed_date="), F.date_format("new.closed_date", "yyyy-MM-dd"))))


@dataclass(frozen=True)
class AuditRule:
    """What one trigger writes: key fields, and per image either (prefix, field) pairs, a fixed text
    or nothing; `when` limits the changes that are written. Fields named like `f:date` are dates."""

    table: str
    key: tuple[str, ...]
    old: tuple[tuple[str, str], ...] | str | None = None
    new: tuple[tuple[str, str], ...] | str | None = None
    ops: str = "IUD"
    when: Callable[[Callable[[str, str], Column]], Column] | None = None

    @property
    def fields(self) -> set[str]:
        images = [f for image in (self.old, self.new) if isinstance(image, tuple) for _, f in image]
        return {*self.key, *images}


def _bars(*fields: str) -> tuple[tuple[str, str], ...]:
    return tuple(("|" if k else "", f) for k, f in enumerate(fields))


_CUSTOMER, _LOYALTY, _STATUS = _bars("customer_ref", "last_name", "status"), _bars("tier_code", "points_balance"), (("", "status"),)
_ELSEWHERE = "see application journal"
# The audited tables, their keys and images.
AUDIT_RULES = [
    AuditRule("customer", ("customer_id",), _CUSTOMER, _CUSTOMER),
    AuditRule("loyalty_account", ("loyalty_id",), _LOYALTY, _LOYALTY),
    AuditRule("gl_journal_line", ("journal_id", "line_no")),
    AuditRule("store", ("store_id",), "closed_date=NULL", (("closed_date=", "closed_date:date"),), "U", lambda f: f("new", "closed_date:date").isNotNull() & f("old", "closed_date:date").isNull()),
    AuditRule("order_payment", ("payment_id",), _STATUS, _STATUS, "U", lambda f: f("new", "status") != f("old", "status")),
    AuditRule("coupon", ("coupon_id",), (("", "coupon_code"), ("|promo=", "promotion_id"), ("|redemptions=", "redemption_count")), None, "D"),
    *[AuditRule(table, key, _ELSEWHERE, _ELSEWHERE) for table, key in (
        ("customer_address", ("customer_id", "address_id", "address_type")), ("supplier_product", ("supplier_id", "variant_id")), ("promotion_product", ("promotion_id", "variant_id")),
        ("price_list_item", ("price_list_id", "variant_id")), ("loyalty_account", ("loyalty_id",)), ("coupon", ("coupon_id",)), ("gl_period", ("period_id",)),
        ("exchange_rate", ("rate_date:date", "from_currency", "to_currency")),
    )],
]


def _text_of(row: str, field: str) -> Column:
    """A field of an image as a rule names it."""
    name, _, kind = field.partition(":")
    value = F.col(f"{row}.{name}")
    return F.date_format(value.cast("timestamp"), "yyyy-MM-dd") if kind else value.cast("string")


def as_mixed(changes: DataFrame, table: str, rules: list[AuditRule] = AUDIT_RULES) -> DataFrame:
    """Changes of one table in the form that all tables share: table_name, op, and both images as
    maps from field to text, with the fields its rules name."""
    wanted = sorted(set().union(*[r.fields for r in rules if r.table == table]))
    image = lambda side: F.when(F.col(side).isNotNull(), F.create_map(*[x for f in wanted for x in (F.lit(f), _text_of(side, f))])).alias(side)
    return changes.select(F.lit(table).alias("table_name"), "op", image("old"), image("new"))


def audit_mixed(changes: DataFrame, rules: list[AuditRule] = AUDIT_RULES) -> DataFrame:
    """The audit rows of a stream in which changes of all tables lie mixed, one per change and rule.

    A row is joined with its table's rules as values, and one expression serves all of them: an
    expression per rule grows the compiled method past what the JVM optimises.
    """
    texts = lambda values: F.array(*map(F.lit, values)) if values else F.lit(None).cast("array<string>")

    def parts(image) -> Column:
        pairs = image if isinstance(image, tuple) else ()
        return F.struct(F.lit(image if isinstance(image, str) else None).cast("string").alias("fixed"),
                        texts([p for p, _ in pairs]).alias("prefix"), texts([f for _, f in pairs]).alias("field"))

    def stated(number: int, rule: AuditRule) -> Column:
        return F.struct(F.lit(number).alias("number"), F.lit(rule.ops).alias("ops"), texts(rule.key).alias("key"), parts(rule.old).alias("old"), parts(rule.new).alias("new"))

    by_table: dict[str, list[Column]] = {}
    for number, rule in enumerate(rules):
        by_table.setdefault(rule.table, []).append(stated(number, rule))
    mine = F.coalesce(*[F.when(F.col("table_name") == table, F.array(*own)) for table, own in by_table.items()])
    n_key, n_part = max(len(r.key) for r in rules), max(len(i) for r in rules for i in (r.old, r.new) if isinstance(i, tuple))

    def image(side: str) -> Column:
        at = lambda what, k: F.get(F.col(f"_rule.{side}.{what}"), F.lit(k))
        text = F.when(F.col(f"_rule.{side}.field").isNotNull(), F.concat_ws("", *[x for k in range(n_part) for x in (at("prefix", k), F.col(side)[at("field", k)])]))
        return F.when(F.col(side).isNotNull(), F.coalesce(F.col(f"_rule.{side}.fixed"), text))

    value = lambda side, name: F.col(side)[name]
    ruled = changes.select("table_name", "op", "old", "new", F.explode(mine).alias("_rule")).filter(F.col("_rule.ops").contains(F.col("op")))
    for number, rule in enumerate(rules):
        if rule.when is not None:
            ruled = ruled.filter((F.col("_rule.number") != number) | F.coalesce(rule.when(value), F.lit(False)))
    shown = F.when(F.col("op") == "D", F.col("old")).otherwise(F.col("new"))
    part = lambda k: F.get(F.col("_rule.key"), F.lit(k))
    key = F.concat_ws("/", *[F.when(part(k).isNotNull(), nvl(F.col("_shown")[part(k)], "")) for k in range(n_key)])
    row = audit_row("", key, F.col("op"), image("old"), image("new"))
    return ruled.withColumn("_shown", shown).select(F.substring(F.upper("table_name"), 1, 30).alias("table_name"), *row[1:])


# ---- normalisation on ingest ---------------------------------------------------------------------------

# The tables cleaned on ingest and the id each is given when it comes without.
INGEST_IDS = {"address": "address_id", "customer": "customer_id", "employee": "employee_id", "supplier": "supplier_id",
              "promotion": "promotion_id", "return_request": "return_id", "sales_order": None}


def normalise_rules(table: str, as_of, c: Callable[[str], Column] = F.col) -> tuple[dict[str, Column], dict[str, Column]]:
    """(column defaults and cleaning, rules a row must meet) applied when rows of a table arrive;
    `c` gives the value of a field."""
    now = as_time(as_of)
    trim = lambda f: empty_to_null(F.trim(c(f)))  # blank text arrives as NULL
    if table == "address":
        return {"line1": trim("line1"), "city": trim("city")}, {}
    if table == "customer":
        return {"customer_ref": nvl(c("customer_ref"), pad_ref("CU", c("customer_id"), 12)), "email": F.lower(trim("email")), "created_ts": nvl(c("created_ts"), now)}, {}
    if table == "employee":
        return {"employee_number": nvl(c("employee_number"), pad_ref("E", c("employee_id"), 8)), "first_name": F.initcap(trim("first_name")), "last_name": F.initcap(trim("last_name"))}, {}
    if table == "supplier":
        bad = c("contact_name").isNotNull() & (valid_email(c("contact_email")) != "Y")
        return {"is_approved": F.when(bad, "N").otherwise(c("is_approved")), "onboarded_ts": nvl(c("onboarded_ts"), now)}, {}
    if table == "promotion":
        return {"spent_amount": nvl(c("spent_amount"), 0).cast("decimal(14,2)")}, {"Promotion end_ts must be after start_ts": c("end_ts") > c("start_ts")}
    if table == "return_request":
        ref = F.concat(F.lit("RMA"), F.date_format(now, "yy"), F.lpad((F.pmod(c("return_id") - 1, F.lit(999_999)) + 1).cast("string"), 6, "0"))
        return {"rma_number": nvl(c("rma_number"), ref), "requested_ts": nvl(c("requested_ts"), now)}, {}
    if table == "sales_order":
        web = c("channel_code") == "WEB"
        return {"shipping_amount": F.when(web, nvl(c("shipping_amount"), 0)).otherwise(c("shipping_amount")).cast("decimal(14,2)"),
                "sales_employee_id": F.when(~web, c("sales_employee_id"))}, {}
    raise ValueError(f"no ingest rules for {table}")


def _reject_reason(must: dict[str, Column]) -> Column:
    """The first rule that is broken; a rule over NULL is not."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(text)) for text, ok in must.items()], F.lit(None).cast("string"))


def as_arrivals(rows: DataFrame, table: str, seq: Column) -> DataFrame:
    """Raw rows of one table in the form that all tables share: table_name, seq and the row as a
    struct named like its table; union them by name, with missing columns allowed. `seq` numbers the
    arrivals of a table from 1, without repeats."""
    return rows.select(F.lit(table).alias("table_name"), seq.cast("bigint").alias("seq"), F.struct(*rows.columns).alias(table))


def normalise_mixed(arrivals: DataFrame, as_of, last_ids: dict[str, int]) -> DataFrame:
    """Arrivals of all tables, cleaned by the rules of their table, and the reason of a reject.

    One projection without state: a row that comes without an id gets the last id before the stream
    plus its own number in the feed. Such ids are unique and ascend with the arrivals, as those of a
    sequence do (with gaps), and neither the cut into batches nor a repeated batch changes them.
    """
    out, reasons = [], []
    for table in [n for n in arrivals.columns if n in INGEST_IDS]:
        fields = arrivals.schema[table].dataType.fieldNames()
        key = INGEST_IDS[table]

        def value(field: str, table=table, key=key, fields=fields) -> Column:
            raw = F.col(f"{table}.{field}") if field in fields else F.lit(None)
            return nvl(raw, F.col("seq") + last_ids.get(table, 0)) if field == key else raw

        cols, must = normalise_rules(table, as_of, value)
        here = F.col(table).isNotNull()
        out.append(F.when(here, F.struct(*[cols.get(f, value(f)).alias(f) for f in fields])).alias(table))
        reasons.append(F.when(here, _reject_reason(must)))
    return arrivals.select("table_name", "seq", *out, F.coalesce(*reasons).alias("reject_reason"))


def normalise_stream(df: DataFrame, table: str, as_of, trim_to_null: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejects); both stay streaming frames when the input is one."""
    have = lambda f: F.col(f) if f in df.columns else F.lit(None)
    cols, must = normalise_rules(table, as_of, have)
    out = df.withColumns({k: v for k, v in cols.items() if k in df.columns})
    for name in trim_to_null or []:
        out = out.withColumn(name, empty_to_null(F.trim(name)))
    if not must:
        return out, out.filter(F.lit(False)).withColumn("reject_reason", F.lit(None).cast("string"))
    judged = out.withColumn("reject_reason", _reject_reason(must))
    return judged.filter(F.col("reject_reason").isNull()).drop("reject_reason"), judged.filter(F.col("reject_reason").isNotNull())


# ---- stock ----------------------------------------------------------------------------------------------------

def reservation_rows(changes: DataFrame) -> DataFrame:
    """Reserved quantity by change: +new on insert, -old on delete, the difference on update, booked
    at the place of the new image (the old one for deletes)."""
    delta = nvl("new.qty", 0) - nvl("old.qty", 0)
    gone = F.col("op") == "D"
    place = lambda f: F.when(gone, F.col(f"old.{f}")).otherwise(F.col(f"new.{f}"))
    seq = F.col("seq") if "seq" in changes.columns else F.lit(0).cast("bigint")
    rows = changes.select(place("fulfil_location_id").alias("location_id"), place("variant_id").alias("variant_id"), seq.alias("seq"), delta.alias("delta"))
    return rows.filter(F.col("delta") != 0)


PAGE_BITS = 8  # of a location's variants, so many neighbours (2 ** 8) share one state
RESERVED = "total map<bigint,bigint>, floor map<bigint,bigint>"  # thousandths by variant


def reservation_state(changes: DataFrame) -> DataFrame:
    """What the changes so far do to the reservation of each place, kept as state per page, a bounded
    run of a location's variants: a call for every place would cost more than its few rows.

    A change by d takes a reservation q to max(q + d, 0). Any row of such steps takes q to
    max(q + total, floor), and a further step of (t, f) makes that (total + t, max(floor + t, f)),
    so a place is two numbers. The rows of a page inside one micro-batch are taken in order of
    `seq`, whatever the cut into batches; at most a batch's rows of one page are sorted at once.
    """
    thousandths = (F.col("delta") * 1000).cast("bigint").alias("delta")

    def step(key, frames, state):
        rows = pd.concat(list(frames)).sort_values(["variant_id", "seq"], kind="stable")
        variants, delta = rows["variant_id"].to_numpy(), rows["delta"].to_numpy()
        first = np.flatnonzero(np.r_[True, variants[1:] != variants[:-1]])
        run = delta.cumsum()
        run -= np.repeat(run[first] - delta[first], np.diff(np.r_[first, len(run)]))
        last = run[np.r_[first[1:], len(run)] - 1]
        total, floor = map(dict, state.get) if state.exists else ({}, {})
        for v, t, f in zip(variants[first].tolist(), last.tolist(), (last - np.minimum.reduceat(run, first)).tolist()):
            total[v], floor[v] = (total[v] + t, max(floor[v] + t, f)) if v in total else (t, f)
        state.update((total, floor))
        yield pd.DataFrame({"location_id": [key[0]], "page": [key[1]], "places": [len(first)]})

    rows = reservation_rows(changes).filter("location_id IS NOT NULL AND variant_id IS NOT NULL").select(
        "location_id", F.shiftright("variant_id", PAGE_BITS).alias("page"), "variant_id", "seq", thousandths)
    return rows.groupBy("location_id", "page").applyInPandasWithState(step, "location_id bigint, page bigint, places bigint", RESERVED, "update", "NoTimeout")


def with_reservations(stock: DataFrame, state: DataFrame, as_of) -> DataFrame:
    """Stock with its reservations as the state has them."""
    places = state.select("location_id", F.explode("total").alias("variant_id", "total"), "floor").withColumn("floor", F.col("floor")[F.col("variant_id")])
    got = places.select("location_id", "variant_id", *[(F.col(n).cast("decimal(20,0)") / 1000).cast("decimal(14,3)").alias(f"_{n}") for n in ("total", "floor")])
    hit = F.col("_total").isNotNull()
    new = F.greatest(nvl("qty_reserved", 0) + F.col("_total"), F.col("_floor"), F.lit(0)).cast("decimal(14,3)")
    out = stock.join(got, ["location_id", "variant_id"], "left").withColumns({
        "qty_reserved": F.when(hit, new).otherwise(F.col("qty_reserved")), "last_movement_ts": F.when(hit, as_time(as_of)).otherwise(F.col("last_movement_ts"))})
    return out.withColumn("qty_available", (F.col("qty_on_hand") - F.col("qty_reserved")).cast("decimal(15,3)")).select(*stock.columns)


def negative_alert(changes: DataFrame) -> DataFrame:
    """An issue per inserted or updated stock row whose availability is negative."""
    free = F.col("new.qty_on_hand") - F.col("new.qty_reserved")
    bad = changes.filter(F.col("op").isin("I", "U") & (free < 0))
    return issues(bad, "NEGATIVE_AVAILABLE", "INVENTORY_STOCK", F.concat_ws("/", "new.location_id", "new.variant_id"),
                  F.concat(F.lit("qty_available went negative: "), free.cast("decimal(15,3)").cast("string")))


# ---- loyalty, payments, orders -----------------------------------------------------------------------------------

def ledger_drift_batch(changes: DataFrame, ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Drift of the accounts a batch touches, against the ledger that includes the batch."""
    touched = changes.filter(F.col("op") != "D").select(F.col("new.loyalty_id").alias("loyalty_id")).distinct()
    return dq_ledger_drift(accounts.join(touched, "loyalty_id", "left_semi"), ledger.join(touched, "loyalty_id", "left_semi"))


def payment_state(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Status of each order and whether a payment of it became CAPTURED, as a streaming aggregate;
    `orders` has each order once, `payments` are changes."""
    done = payments.filter((F.col("op") == "U") & (F.col("new.status") == "CAPTURED") & (F.col("old.status") != "CAPTURED"))
    rows = orders.select("order_id", "status", F.lit(False).alias("paid")).unionByName(
        done.select(F.col("new.order_id").alias("order_id"), F.lit(None).cast("string").alias("status"), F.lit(True).alias("paid")))
    return rows.groupBy("order_id").agg(F.max("status").alias("status"), F.max("paid").alias("paid"))


def captured_orders(state: DataFrame) -> DataFrame:
    """A CART whose payment became CAPTURED is PLACED; payments of unknown orders change nothing."""
    paid = F.col("paid") & (F.col("status") == "CART")
    return state.filter("status IS NOT NULL").select("order_id", F.when(paid, "PLACED").otherwise(F.col("status")).alias("status"))


def channel_route(changes: DataFrame, channels: tuple[str, ...] = ("WEB", "APP")) -> DataFrame:
    """Side records for new orders of the routed channels."""
    return changes.filter((F.col("op") == "I") & F.col("new.channel_code").isin(*channels)).select(
        F.concat(F.lit("ROUTE_"), F.col("new.channel_code")).alias("rule_code"), F.lit("sales_order").alias("entity_name"),
        F.col("new.order_id").cast("string").alias("entity_key"), F.col("new.channel_code").alias("detail"))


def batch_event(changes: DataFrame, table: str, gate: int = 1) -> DataFrame:
    """One event per batch that holds at least `gate` changes, with its counts by kind."""
    n = lambda o: F.count_if(F.col("op") == o)
    one = changes.agg(F.count("*").alias("n"), n("I").alias("i"), n("U").alias("u"), n("D").alias("d")).filter(F.col("n") >= gate)
    return one.select(F.lit("STATEMENT").alias("rule_code"), F.lit(table).alias("entity_name"), F.concat(
        F.lit("rows="), F.col("n").cast("string"), F.lit(" I="), F.col("i").cast("string"), F.lit(" U="), F.col("u").cast("string"), F.lit(" D="), F.col("d").cast("string")).alias("detail"))


def append_handler(path: str, to_rows) -> Handler:
    """Rows of each batch under the batch's own folder, so a repeated batch replaces itself."""
    def run(batch: DataFrame, batch_id: int) -> None:
        to_rows(batch).withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return run


def line_faults(batch: DataFrame) -> DataFrame:
    """Faults of added journal lines, the first of two ordered steps."""
    both = (F.col("new.debit_amount") > 0) & (F.col("new.credit_amount") > 0)
    rate = F.col("new.fx_rate").isNull() & (F.col("new.currency_code") != "GBP")
    key = F.concat_ws("/", "new.journal_id", "new.line_no")
    added = batch.filter(F.col("op") == "I")
    return issues(added.filter(both), "LINE_BOTH_SIDES", "GL_JOURNAL_LINE", key, "both sides").unionByName(
        issues(added.filter(rate), "LINE_NEEDS_RATE", "GL_JOURNAL_LINE", key, "no rate"))


def journal_state(journals: DataFrame, lines: DataFrame) -> DataFrame:
    """The second step: journals and whether a line of theirs was added, as a streaming aggregate."""
    text = F.lit(None).cast("string")
    rows = journals.select("journal_id", "status", "description", F.lit(False).alias("touched")).unionByName(
        lines.filter(F.col("op") == "I").select(F.col("new.journal_id").alias("journal_id"), text.alias("status"), text.alias("description"), F.lit(True).alias("touched")))
    return rows.groupBy("journal_id").agg(F.max("status").alias("status"), F.max("description").alias("description"), F.max("touched").alias("touched"))


def described_journals(state: DataFrame) -> DataFrame:
    """Draft journals that lines were added to have a description."""
    text = F.substring(nvl("description", F.concat(F.lit("Journal "), F.col("journal_id").cast("string"))), 1, 300)
    drafted = F.col("touched") & (F.col("status") == "DRAFT")
    return state.filter("status IS NOT NULL").select("journal_id", "status", F.when(drafted, text).otherwise(F.col("description")).alias("description"))
