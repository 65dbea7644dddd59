"""Outbound files: the sales extract, order documents, yearly archives, staged feeds, partitioned
tables, and the run log around batch jobs."""

from __future__ import annotations

import contextlib
import datetime
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillweave.functions.rules import valid_amount, valid_qty
from tillweave.functions.values import as_time, empty_to_null, nvl
from tillweave.plans.reports import in_days
from tillweave.sources.tables import RetailTables


# ---- sales extract ---------------------------------------------------------------------------------

def sales_extract(t: RetailTables, start: str, stop: str) -> DataFrame:
    """Orders of the days start..stop, as text columns in file order."""
    orders = t.sales_order.filter(in_days("order_ts", start, stop)).join(t.store.select("store_id", "store_code"), "store_id")
    net = (nvl("subtotal_amount", 0) - nvl("discount_amount", 0)).cast("decimal(14,2)")
    return orders.select(
        "order_id", "order_number", F.date_format("order_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("order_ts"), "store_code",
        F.col("channel_code").alias("channel"), F.col("currency_code").alias("currency"), net.cast("string").alias("net_amount"))


def write_extract(extract: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with header, ordered by order_id across the numbered part files.

    A single file gathers the rows in one task; ask for it only for extracts known to be small.
    """
    ordered = extract.orderBy("order_id")
    (ordered.coalesce(1) if single_file else ordered).write.mode("errorifexists").option("header", True).csv(path)


# ---- order documents -------------------------------------------------------------------------------

def order_documents(t: RetailTables, stamp: str = "") -> DataFrame:
    """One fixed-width text document per order: header, lines in line order, trailer.

    Each line is rendered to text before the shuffle, so only its key and text travel. An order's
    lines are bounded by the four-digit line number of the model.
    """
    lp = lambda c, n: F.lpad(c, n, " ")
    rp = lambda c, keep, n: F.rpad(F.substring(c, 1, keep), n, " ")
    names = t.product_variant.select("variant_id", "variant_sku", "product_id").join(t.product.select("product_id", "product_name"), "product_id")
    text = F.concat(
        lp(F.col("line_no").cast("string"), 4), F.lit(" "), rp("variant_sku", 20, 22), rp("product_name", 40, 42),
        lp(F.col("qty").cast("decimal(12,3)").cast("string"), 12), lp(F.col("unit_price").cast("decimal(12,4)").cast("string"), 14),
        lp(F.round("line_total", 2).cast("decimal(16,2)").cast("string"), 14), F.lit("\n"))
    lines = t.sales_order_line.join(names, "variant_id").select("order_id", F.struct("line_no", "variant_id", text.alias("text")).alias("l"))
    body = lines.groupBy("order_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda l: l["text"]), "").alias("body"))
    head = F.concat(
        F.lit("ORDER "), F.col("order_number"), F.lit(" / "), F.col("store_code"), F.lit(" / "), F.col("channel_code"), F.lit("\nPlaced: "),
        F.date_format("order_ts", "yyyy-MM-dd HH:mm:ss"), F.lit("\nStatus: "), F.col("status"), F.lit("\n" + "-" * 40 + "\n"))
    orders = t.sales_order.join(t.store.select("store_id", "store_code"), "store_id")
    return orders.join(body, "order_id", "left").select(
        "order_id", F.concat(head, nvl("body", ""), F.lit(f"-- generated {stamp}\n" if stamp else "")).alias("doc"))


# ---- yearly archives ----------------------------------------------------------------------------------

def archive_orders(t: RetailTables, years: list[int], amount_limit: int = 100_000, qty_limit: int = 1000) -> DataFrame:
    """Order lines of the listed years with their range checks, one scan for all years.

    Write it partitioned by archive_year: each year is then one folder.
    """
    ts, span = F.col("order_ts"), (min(years), max(years))
    orders = t.sales_order.filter((ts >= as_time(f"{span[0]}-01-01")) & (ts < as_time(f"{span[1] + 1}-01-01"))).withColumn(
        "archive_year", F.year("order_ts")).filter(F.col("archive_year").isin(*years))
    lines = t.sales_order_line.drop("status", "fulfil_location_id")
    return orders.select("order_id", "archive_year", "order_ts", "store_id", "currency_code", "status").join(lines, "order_id").withColumns({
        "amount_ok": valid_amount("line_total", amount_limit), "qty_ok": valid_qty("qty", qty_limit)})


def write_archive(archive: DataFrame, path: str) -> None:
    archive.write.mode("errorifexists").partitionBy("archive_year").parquet(path)


# ---- staged feeds ----------------------------------------------------------------------------------------

def stage_feed(df: DataFrame, system: str, category: str, as_of) -> DataFrame:
    """Staged supplier or product rows: normalised SKU, load stamp and status.

    A row is REJECTED when it has no SKU, its quantity is out of range, or its currency is not in
    upper case; otherwise it is VALID.
    """
    sku = empty_to_null(F.upper(F.trim("variant_sku")))
    ok = sku.isNotNull() & (F.col("qty").isNull() | (F.abs("qty") <= 1_000_000)) & (
        F.col("currency_code").isNull() | (F.col("currency_code") == F.upper("currency_code")))
    return df.withColumns({
        "variant_sku": sku, "source_system": F.lit(system), "category_code": F.lit(category), "load_ts": as_time(as_of),
        "status": F.when(ok, "VALID").otherwise("REJECTED")})


def stage_audit(staged: DataFrame, table: str, key: str) -> DataFrame:
    """The audit row written for each staged row."""
    return staged.select(
        F.lit(table).alias("table_name"), F.col(key).cast("string").alias("pk_value"), F.lit("I").alias("action_type"),
        F.concat_ws("|", nvl("variant_sku", ""), F.col("qty").cast("string"), F.col("list_price").cast("string")).alias("new_row"))


# ---- partitioned tables -------------------------------------------------------------------------------------

@dataclass(frozen=True)
class PartitionSpec:
    """Time bucket ('month' or a number of days) and a value list with a DEFAULT bucket."""

    ts: str | None = None
    every: str | int = "month"
    list_col: str | None = None
    values: tuple[str, ...] = field(default=())
    origin: str = "2024-01-01"


def bucket_columns(spec: PartitionSpec) -> dict[str, Column]:
    cols: dict[str, Column] = {}
    if spec.ts:
        if spec.every == "month":
            cols["part_month"] = F.date_format(spec.ts, "yyyy-MM")
        else:
            since = F.datediff(F.col(spec.ts), F.lit(spec.origin).cast("date"))
            cols["part_bucket"] = F.floor(since / int(spec.every)).cast("int")
    if spec.list_col:
        cols["part_list"] = F.when(F.col(spec.list_col).isin(*spec.values), F.col(spec.list_col)).otherwise("DEFAULT")
    return cols


def write_partitioned(df: DataFrame, spec: PartitionSpec, path: str, mode: str = "errorifexists") -> None:
    """Rows of one partition are gathered before the write, in several tasks when the partition is
    large (AQE splits the rebalanced partitions), so files are few and none is a whole hot bucket."""
    cols = bucket_columns(spec)
    out = df.withColumns(cols)
    out.hint("rebalance", *cols).write.mode(mode).partitionBy(*cols).parquet(path)


def read_partitioned(spark: SparkSession, path: str, spec: PartitionSpec, start: str | None = None, stop: str | None = None,
                     values: tuple[str, ...] = ()) -> DataFrame:
    """Read back with the filters on the partition columns as well as on the data, so that folders
    are pruned before any file is opened. `stop` is exclusive."""
    df = spark.read.parquet(path)
    if spec.ts and start is not None:
        df = df.filter(F.col(spec.ts) >= as_time(start))
        df = df.filter(F.col("part_month") >= start[:7] if spec.every == "month" else F.col("part_bucket") >= _bucket_no(spec, start))
    if spec.ts and stop is not None:
        df = df.filter(F.col(spec.ts) < as_time(stop))
        df = df.filter(F.col("part_month") <= stop[:7] if spec.every == "month" else F.col("part_bucket") <= _bucket_no(spec, stop))
    if spec.list_col and values:
        listed = [v if v in spec.values else "DEFAULT" for v in values]
        df = df.filter(F.col("part_list").isin(*listed) & F.col(spec.list_col).isin(*values))
    return df


def _bucket_no(spec: PartitionSpec, day: str) -> int:
    days = (datetime.date.fromisoformat(day[:10]) - datetime.date.fromisoformat(spec.origin)).days
    return days // int(spec.every)


def copartition_child(parent: DataFrame, child: DataFrame, key: str, spec: PartitionSpec) -> DataFrame:
    """The child with its parent's bucket columns, ready for the same partitioning."""
    cols = bucket_columns(spec)
    return child.join(parent.select(key, *[c.alias(n) for n, c in cols.items()]), key)


def write_dynamic(df: DataFrame, path: str, cols: list[str]) -> None:
    """Replace only the partitions present in `df`; new months appear by themselves."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cols).parquet(path)


# ---- run log -------------------------------------------------------------------------------------------------

RUN_SCHEMA = "job_name string, started_ts timestamp, finished_ts timestamp, elapsed double, status string, rows_processed long, message string"


class JobRun:
    rows: int | None = None
    message: str | None = None
    skipped: bool = False


@contextlib.contextmanager
def job_run(spark: SparkSession, name: str, path: str, swallow: bool = False):
    """Append one run record around a job: SUCCESS, FAILED with the error text, or SKIPPED.

    With `swallow` a failure is recorded and not raised again.
    """
    run, started = JobRun(), datetime.datetime.now(datetime.timezone.utc)
    status, error = "SUCCESS", None
    try:
        yield run
        status = "SKIPPED" if run.skipped else "SUCCESS"
    except Exception as exc:
        status, error = "FAILED", str(exc)[:4000]
        if not swallow:
            raise
    finally:
        done = datetime.datetime.now(datetime.timezone.utc)
        row = (name, started, done, (done - started).total_seconds(), status, run.rows, error or run.message)
        spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def publish(df: DataFrame, path: str) -> None:
    """Replace the published copy at `path` by Spark's dynamic partition overwrite: rows are staged
    and the old copy goes when the job commits, so a failed write leaves it alone, and `df` may read
    it. An extra row marks the copy, because an overwrite without rows would replace nothing."""
    filler = df.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields], F.lit(True).alias("_filler"))
    rows = df.withColumn("_filler", F.lit(False)).union(filler).withColumn("_copy", F.lit("current"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_copy").parquet(path)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The copy published last."""
    return spark.read.parquet(path).filter(~F.col("_filler")).drop("_filler", "_copy")
