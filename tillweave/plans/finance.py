"""Ledger jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.functions.values import as_time, day_of, nvl
from tillweave.operators.aggregates import explode_legs, limit_then_sort
from tillweave.operators.positions import assign_ids
from tillweave.operators.scalars import beside
from tillweave.sources.tables import RetailTables

MONEY = "decimal(16,2)"


def sales_journal(orders: DataFrame, periods: DataFrame, start_id: int, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One draft journal with three legs per order, in the latest OPEN period; without such a
    period every order is rejected.

    Debtors and revenue carry the net amount and VAT the tax, so the legs do not balance when tax
    is due; the source posts them so.
    """
    open_ = periods.filter(F.col("status") == "OPEN").agg(
        F.max(F.struct("fiscal_year", "period_no", "period_id"))["period_id"].alias("period_id"))
    rows = beside(orders, open_)
    oid = F.col("order_id").cast("string")
    rejects = rows.filter(F.col("period_id").isNull()).select(
        "order_id", F.concat(F.lit("No OPEN GL period to post order "), oid, F.lit(" into")).alias("reject_reason"))
    heads = assign_ids(rows.filter(F.col("period_id").isNotNull()), [F.col("order_id")], start_id, "journal_id", "SAL", 12, "journal_ref")
    net = (nvl("subtotal_amount", 0) - nvl("discount_amount", 0)).cast(MONEY)
    heads = heads.withColumns({"_net": net, "_tax": nvl("tax_amount", 0).cast(MONEY)})
    journals = heads.select(
        "journal_id", "journal_ref", "period_id", F.lit("SALES").alias("source_module"), day_of(as_time(as_of)).alias("journal_date"),
        F.concat(F.lit("Sales order "), oid).alias("description"), F.lit("DRAFT").alias("status"))
    zero = F.lit(0).cast(MONEY)
    leg = lambda n, acc, dr, cr, text: F.struct(
        F.lit(n).cast("bigint").alias("line_no"), F.lit(acc).alias("account_code"), dr.alias("debit_amount"), cr.alias("credit_amount"),
        F.lit(1).cast("decimal(18,8)").alias("fx_rate"), F.lit(text).alias("line_description"))
    lines = explode_legs(heads, [leg(1, "1100", F.col("_net"), zero, "Debtors"), leg(2, "4000", zero, F.col("_net"), "Sales revenue"),
                                 leg(3, "2200", zero, F.col("_tax"), "Output VAT")], ["journal_id", "currency_code"])
    return journals, lines, rejects


def journal_post(requests: DataFrame, periods: DataFrame, start_id: int, as_of) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Post two-leg journals: journals, lines, control totals and rejects.

    Requests: (request_id, period_id, source_module, journal_date, description, debit_account,
    credit_account, debit_amount, credit_amount, currency_code). The period must exist and not be
    CLOSED, amounts must be present, non-negative and equal.
    """
    known = periods.select("period_id", F.col("status").alias("_ps"))
    dr, cr = F.col("debit_amount"), F.col("credit_amount")
    pid = F.col("period_id").cast("string")
    reason = (
        F.when(F.col("_ps").isNull(), F.concat(F.lit("Unknown GL period: "), pid))
        .when(F.col("_ps") == "CLOSED", F.concat(F.lit("GL period "), pid, F.lit(" is closed; journal not posted")))
        .when((nvl(dr, -1) < 0) | (nvl(cr, -1) < 0), "Journal amounts must be non-negative")
        .when(dr != cr, F.concat(F.lit("Unbalanced journal: debit "), dr.cast("string"), F.lit(" <> credit "), cr.cast("string")))
    )
    judged = requests.join(known, "period_id", "left").withColumn("reject_reason", reason)
    good = assign_ids(judged.filter(F.col("reject_reason").isNull()), [F.col("request_id")], start_id, "journal_id")
    good = good.withColumn("journal_ref", F.concat(F.substring(F.upper("source_module"), 1, 3), F.lit("-"), F.col("journal_id").cast("string")))
    journals = good.select("journal_id", "journal_ref", "period_id", "source_module", "journal_date", "description",
                           as_time(as_of).alias("posted_ts"), F.lit("POSTED").alias("status"))
    zero = F.lit(0).cast(MONEY)
    leg = lambda n, acc, d, c: F.struct(F.lit(n).cast("bigint").alias("line_no"), F.col(acc).alias("account_code"),
                                        d.cast(MONEY).alias("debit_amount"), c.cast(MONEY).alias("credit_amount"))
    lines = explode_legs(good.withColumn("currency_code", nvl("currency_code", "USD")),
                         [leg(1, "debit_account", dr, zero), leg(2, "credit_account", zero, cr)], ["journal_id", "currency_code"])
    control = good.select(
        F.lit("GL_CONTROL_TOTAL").alias("table_name"), F.col("journal_ref").alias("pk_value"), F.lit("I").alias("action_type"),
        F.concat(F.lit("DR="), dr.cast("string"), F.lit(" CR="), cr.cast("string"), F.lit(" LINES=2")).alias("new_row"))
    return journals, lines, control, judged.filter(F.col("reject_reason").isNotNull()).select("request_id", "reject_reason")


def gl_close(t: RetailTables, periods_to_close: DataFrame, as_of, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Close the listed periods; unknown or closed ones are rejected, and so are periods with
    unbalanced or draft journals unless forced. All periods are judged in one pass."""
    sums = t.gl_journal_line.groupBy("journal_id").agg(F.sum("debit_amount").alias("dr"), F.sum("credit_amount").alias("cr"))
    state = t.gl_journal.join(sums, "journal_id", "left").groupBy("period_id").agg(
        F.count_if(F.col("dr") != F.col("cr")).alias("unbalanced"), F.count_if(F.col("status") == "DRAFT").alias("draft"))
    asked = periods_to_close.select("period_id").distinct().join(t.gl_period.select("period_id", "status"), "period_id", "left").join(
        state, "period_id", "left")
    pid = F.col("period_id").cast("string")
    dirty = (nvl("unbalanced", 0) > 0) | (nvl("draft", 0) > 0)
    reason = F.when(F.col("status").isNull(), F.concat(F.lit("Unknown GL period "), pid)).when(
        F.col("status") == "CLOSED", F.concat(F.lit("GL period "), pid, F.lit(" is already closed"))).when(
        dirty & F.lit(not force), F.concat(F.lit("Cannot close period "), pid, F.lit(": "), nvl("unbalanced", 0).cast("string"),
                                            F.lit(" unbalanced journal(s), "), nvl("draft", 0).cast("string"), F.lit(" draft journal(s)")))
    judged = asked.withColumn("reject_reason", reason)
    done = judged.filter(F.col("reject_reason").isNull()).select("period_id", F.lit(True).alias("_close"))
    periods = t.gl_period.join(done, "period_id", "left").withColumns({
        "status": F.when(F.col("_close"), "CLOSED").otherwise(F.col("status")), "closed_ts": F.when(F.col("_close"), as_time(as_of))}).drop("_close")
    return periods, judged.filter(F.col("reject_reason").isNotNull()).select("period_id", "reject_reason")


def journal_batch(journals: DataFrame, n: int = 50) -> DataFrame:
    """Any n draft journals, then sorted."""
    return limit_then_sort(journals.filter(F.col("status") == "DRAFT").select("journal_id", "journal_date"), n,
                           [F.col("journal_date"), F.col("journal_id")])
