"""Row policies, masks and optional filters over whole tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.functions.values import mask_email, nvl, order_nulls


@dataclass(frozen=True)
class Reader:
    """Who reads: role, and the store or country the session is bound to."""

    role: str
    store_id: int | None = None
    country_code: str | None = None


# The roles each policy exempts.
ORDER_ROLES = ("HQ_FINANCE", "HQ_MERCH", "BATCH")
CUSTOMER_ROLES = ("HQ_FINANCE", "HQ_MERCH", "BATCH", "DPO")
CONTACT_ROLES = ("HQ_FINANCE", "CS_AGENT", "DPO")
CONTACT_COLUMNS = ("email", "mobile_phone", "birth_date")


def apply_store_policy(orders: DataFrame, reader: Reader) -> DataFrame:
    """Head office and batch see all orders; others their own store, or nothing without one."""
    if reader.role in ORDER_ROLES:
        return orders
    return orders.filter(F.lit(False) if reader.store_id is None else F.col("store_id") == reader.store_id)


def apply_country_policy(customers: DataFrame, reader: Reader) -> DataFrame:
    """Others see the customers of their country that are not erased, or nothing without one."""
    if reader.role in CUSTOMER_ROLES:
        return customers
    if reader.country_code is None:
        return customers.filter(F.lit(False))
    return customers.filter((F.col("home_country_code") == reader.country_code) & (F.col("status") != "ERASED"))


def mask_columns(df: DataFrame, reader: Reader, cols: tuple[str, ...] = CONTACT_COLUMNS) -> DataFrame:
    """All rows stay; contact columns are NULL for roles without the right to them."""
    if reader.role in CONTACT_ROLES:
        return df
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in cols if c in df.columns})


def mask_pii(df: DataFrame, email_cols: list[str]) -> DataFrame:
    return df.withColumns({c: mask_email(c) for c in email_cols})


def where_if(df: DataFrame, cond: Column | None) -> DataFrame:
    """A parameter that was not given filters nothing."""
    return df if cond is None else df.filter(cond)


def filter_text(df: DataFrame, predicate: str | None = None) -> DataFrame:
    """Filter by a predicate held as text; an absent predicate keeps every row.

    The text must be one boolean expression over the frame's columns; the parser rejects
    statements, and the type check rejects anything that is not a condition.
    """
    cond = F.expr(predicate or "1 = 1")
    kind = df.select(cond.alias("p")).schema["p"].dataType.simpleString()
    if kind != "boolean":
        raise ValueError(f"predicate is {kind}, not boolean: {predicate}")
    return df.filter(cond)


def store_label(df: DataFrame, stores: DataFrame) -> DataFrame:
    """Attach 'code - name'; an unknown store id shows as STORE?<id>."""
    labels = stores.select("store_id", F.concat("store_code", F.lit(" - "), "store_name").alias("store_label"))
    return df.join(labels, "store_id", "left").withColumn(
        "store_label", nvl("store_label", F.concat(F.lit("STORE?"), F.col("store_id").cast("string"))))


def orders_by_status(orders: DataFrame, store_id: int, status: str, start=None, stop=None) -> DataFrame:
    """Orders of a store in a status, optionally within a half-open window."""
    out = orders.filter((F.col("store_id") == store_id) & (F.col("status") == status))
    if start is not None:
        out = out.filter(F.col("order_ts") >= F.lit(start).cast("timestamp_ntz"))
    if stop is not None:
        out = out.filter(F.col("order_ts") < F.lit(stop).cast("timestamp_ntz"))
    return out.orderBy(order_nulls("order_ts"), "order_id")


def order_feed(orders: DataFrame, start, stop) -> DataFrame:
    """The feed of orders in [start, stop)."""
    ts = F.col("order_ts")
    return orders.filter((ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(stop).cast("timestamp_ntz"))).select(
        "order_id", "order_number", "channel_code", "status", "order_ts", nvl("subtotal_amount", 0).alias("subtotal_amount"))


def local_time(df: DataFrame, stores: DataFrame, regions: DataFrame, countries: DataFrame, ts: str,
               store_col: str = "store_id", name: str = "local_ts") -> DataFrame:
    """The wall clock of the store's zone (store -> region -> country); no zone leaves it as is."""
    zones = (
        stores.select(F.col("store_id").alias("_store"), "region_id")
        .join(regions.select("region_id", "country_code"), "region_id")
        .join(countries.select("country_code", "tz_name"), "country_code")
        .select("_store", F.col("tz_name").alias("_zone"))
    )
    moved = F.convert_timezone(F.lit("UTC"), F.col("_zone"), F.col(ts).cast("timestamp_ntz"))
    return df.join(zones, F.col(store_col) == F.col("_store"), "left").withColumn(
        name, F.coalesce(moved, F.col(ts).cast("timestamp_ntz"))).drop("_store", "_zone")
