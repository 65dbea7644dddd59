"""One disposition per table and the roll-up of all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GOOD = ("parity_pass", "empty_verified")


def disposition(facts: DataFrame) -> DataFrame:
    """Result per table from (table, source_rows, target_present, schema_verdict, target_rows,
    has_key, renderable, parity).

    schema_verdict is ok, mismatch or pending (an input of the gate is missing); parity is the
    comparison status or NULL where none ran.
    """
    empty = F.col("source_rows") == 0
    pending, mismatch = F.col("schema_verdict") == "pending", F.col("schema_verdict") == "mismatch"
    result = (
        F.when(~F.col("target_present"), "target_table_missing")
        .when(mismatch, "schema_mismatch")
        .when(empty & pending, "empty_schema_unverified")
        .when(empty & (F.col("target_rows") == 0), "empty_verified").when(empty, "empty_mismatch")
        .when(~F.col("renderable"), "blocked_complex_target_render").when(~F.col("has_key"), "blocked_no_comparable_key")
        .when((F.col("parity") == "passed") & (F.col("target_rows") == F.col("source_rows")), "parity_pass").otherwise("parity_fail"))
    return facts.withColumn("result", result)


def rollup(dispositions: DataFrame, selected: int, total: int, source_only: bool = False) -> DataFrame:
    """Overall PASS, FAIL or INCOMPLETE with coverage; a table without a result cannot pass."""
    sums = dispositions.agg(
        F.count("*").alias("tables"), F.count("result").alias("definitive"), F.count_if(F.col("result").isin(*GOOD)).alias("passed"),
        F.array_sort(F.collect_list(F.when(F.col("result").isNotNull() & ~F.col("result").isin(*GOOD), F.col("table")))).alias("failed_tables"))
    ran = not source_only
    all_in = F.lit(ran) & (F.col("tables") > 0) & (F.col("definitive") == F.col("tables"))
    status = (
        F.lit("prepared") if source_only else F.when(F.col("tables") == 0, "no_tables").when(all_in & (F.col("passed") == F.col("tables")), "passed").otherwise("failed"))
    gate = F.when(all_in & (F.col("passed") == F.col("tables")), "passed").when(F.lit(ran) & (F.col("definitive") > 0), "failed").otherwise("not_executed")
    return sums.select(
        "tables", F.col("passed").alias("tables_passed"), "failed_tables", gate.alias("value_gates"), status.alias("status"),
        F.lit("all" if selected == total else "subset").alias("coverage"),
    ).withColumn("overall", F.when(F.col("status") == "passed", "PASS").when(F.col("status") == "failed", "FAIL").otherwise("INCOMPLETE"))
