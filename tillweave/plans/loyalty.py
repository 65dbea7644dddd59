"""Loyalty jobs over whole ledgers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.functions.values import add_months_keep_end, as_time, day_of, nvl
from tillweave.operators.merge import update_where_changed
from tillweave.operators.scalars import beside
from tillweave.sources.tables import RetailTables


def loyalty_accrue(t: RetailTables, earned: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points for (loyalty_id, order_id, amount): floor(amount * multiplier), expiring after 24
    months. Returns ledger rows, updated accounts and rejects (unknown or not ACTIVE)."""
    known = t.loyalty_account.select("loyalty_id", "status", "tier_code").join(
        t.loyalty_tier.select("tier_code", "points_multiplier"), "tier_code").drop("tier_code")
    lid = F.col("loyalty_id").cast("string")
    rows = earned.join(known, "loyalty_id", "left").withColumn("reject_reason", F.when(
        F.col("status").isNull(), F.concat(F.lit("Unknown loyalty account "), lid)).when(
        F.col("status") != "ACTIVE", F.concat(F.lit("Loyalty account "), lid, F.lit(" is "), F.col("status"))))
    good = rows.filter(F.col("reject_reason").isNull())
    points = F.floor(nvl("amount", 0).cast("decimal(16,2)") * nvl("points_multiplier", 1).cast("decimal(5,2)")).cast("bigint")
    ledger = good.select(
        F.lit("ACCRUE").alias("txn_type"), "loyalty_id", points.alias("points_delta"), "order_id", F.lit("ORDER_ACCRUAL").alias("reason_code"),
        as_time(as_of).alias("txn_ts"), add_months_keep_end(as_time(as_of), 24).cast("timestamp_ntz").alias("expires_on"))
    gained = ledger.groupBy("loyalty_id").agg(F.sum("points_delta").alias("_p"))
    accounts = t.loyalty_account.join(gained, "loyalty_id", "left").withColumns({
        "points_balance": (F.col("points_balance") + nvl("_p", 0)).cast("bigint"),
        "lifetime_points": F.when(F.col("_p").isNull(), F.col("lifetime_points")).otherwise(nvl("lifetime_points", 0) + F.col("_p")).cast("bigint"),
    }).select(*t.loyalty_account.columns)
    return ledger, accounts, rows.filter(F.col("reject_reason").isNotNull()).select(*earned.columns, "reject_reason")


def _take_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk rows sorted by (account, order), carrying the balance of the current account only."""
    account, left = None, 0
    for pdf in batches:
        taken = []
        for lid, balance, points in zip(pdf["loyalty_id"], pdf["points_balance"], pdf["points"]):
            if lid != account:
                account, left = lid, balance
            fits = left >= points
            if fits:
                left -= points
            taken.append(bool(fits))
        yield pdf.assign(accepted=taken)


def loyalty_redeem(t: RetailTables, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Redeem (loyalty_id, request_no, points) in request order; a request larger than what is left
    is rejected and takes nothing.

    Accounts whose requests all fit need no order, and requests larger than the opening balance
    can never fit; both are settled by aggregation. What remains is sorted by account and order
    and streamed through its partition in Arrow batches, holding one balance at a time.
    """
    asked = requests.join(t.loyalty_account.select("loyalty_id", "points_balance"), "loyalty_id", "left")
    sums = requests.groupBy("loyalty_id").agg(F.sum("points").alias("_want"), F.min("points").alias("_least"))
    asked = asked.join(sums, "loyalty_id")
    easy = (F.col("_want") <= F.col("points_balance")) & (F.col("_least") >= 0)
    never = F.col("points_balance").isNull() | ((F.col("points") > F.col("points_balance")) & (F.col("_least") >= 0))
    state = asked.withColumn("_state", F.when(easy, "yes").when(never, "no").otherwise("walk"))
    cols = ["loyalty_id", "request_no", "points", "points_balance"]
    walked = state.filter(F.col("_state") == "walk").select(*cols).repartition("loyalty_id").sortWithinPartitions("loyalty_id", "request_no")
    schema = "loyalty_id bigint, request_no bigint, points bigint, points_balance bigint, accepted boolean"
    judged = walked.select(*[F.col(c).cast("bigint").alias(c) for c in cols]).mapInPandas(_take_in_order, schema).unionByName(
        state.filter(F.col("_state") != "walk").select(
            *[F.col(c).cast("bigint").alias(c) for c in cols], (F.col("_state") == "yes").alias("accepted")))
    used = judged.filter("accepted").groupBy("loyalty_id").agg(F.sum("points").alias("_used"))
    accounts = t.loyalty_account.join(used, "loyalty_id", "left").withColumn(
        "points_balance", (F.col("points_balance") - nvl("_used", 0)).cast("bigint")).select(*t.loyalty_account.columns)
    ledger = judged.filter("accepted").select(
        F.lit("REDEEM").alias("txn_type"), "loyalty_id", "request_no", (-F.col("points")).alias("points_delta"), F.lit("REDEMPTION").alias("reason_code"))
    return ledger, accounts, judged.filter(~F.col("accepted")).select("loyalty_id", "request_no", "points")


def loyalty_expire(t: RetailTables, as_of) -> tuple[DataFrame, DataFrame]:
    """Expire accruals past their date; the balance stops at zero.

    Nothing marks an accrual as expired, so running the job again expires it again, as in the source.
    """
    due = t.loyalty_transaction.filter((F.col("txn_type") == "ACCRUE") & (F.col("expires_on") < as_time(as_of)))
    lost = due.groupBy("loyalty_id").agg(F.sum("points_delta").alias("points")).filter(F.col("points") > 0)
    ledger = lost.select(F.lit("EXPIRE").alias("txn_type"), "loyalty_id", (-F.col("points")).alias("points_delta"),
                         F.lit("AGE_EXPIRY").alias("reason_code"), as_time(as_of).alias("txn_ts"), F.lit("BATCH").alias("created_by"))
    accounts = t.loyalty_account.join(lost, "loyalty_id", "left").withColumn(
        "points_balance", F.when(F.col("points").isNull(), F.col("points_balance")).otherwise(
            F.greatest(F.col("points_balance") - F.col("points"), F.lit(0))).cast("bigint")).select(*t.loyalty_account.columns)
    return ledger, accounts


def tiers_for(df: DataFrame, tiers: DataFrame, points: str, name: str = "new_tier") -> DataFrame:
    """Attach the tier with the highest min_points not above `points`; below all tiers it is NULL.

    The few tiers travel as one sorted array, so the rows need neither join nor shuffle.
    """
    ladder = tiers.agg(F.array_sort(F.collect_list(F.struct("min_points", "tier_code"))).alias("_ladder"))
    with_all = beside(df, ladder)
    fit = F.filter("_ladder", lambda x: x["min_points"] <= nvl(points, 0))
    return with_all.withColumn(name, F.when(F.size(fit) > 0, F.element_at(fit, -1)["tier_code"])).drop("_ladder")


def loyalty_review(t: RetailTables, as_of) -> DataFrame:
    """Move ACTIVE accounts to the tier of their balance where it differs.

    `old <> new` is not true for a NULL new tier, so accounts below every tier stay as they are.
    """
    active = tiers_for(t.loyalty_account.filter(F.col("status") == "ACTIVE"), t.loyalty_tier, "points_balance")
    source = active.filter(F.col("new_tier").isNotNull()).select("loyalty_id", F.col("new_tier").alias("tier_code"))
    return update_where_changed(t.loyalty_account, source, ["loyalty_id"], ["tier_code"], {"tier_reviewed_date": day_of(as_time(as_of))})
