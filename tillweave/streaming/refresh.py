"""Incremental upkeep of the additive aggregates from change batches.

A change is its new image counted +1 and its old image counted -1. Images are summed per group
before the shuffle, so the stored aggregate sees one row per task and touched group; a group whose
count reaches zero disappears.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tillweave.functions.values import day_of, month_of
from tillweave.sources.extracts import publish
from tillweave.streaming.changes import read_state, run_kept


@dataclass(frozen=True)
class AggregateSpec:
    """Group keys, the row count's name and the summed measures, each with a count beside it."""

    keys: tuple[str, ...]
    count: str
    sums: tuple[str, ...]


DAILY = AggregateSpec(("store_id", "sales_date", "currency_code"), "line_count", ("total_qty", "gross_amount", "discount_amount", "tax_amount"))
MONTHLY = AggregateSpec(("month_start", "category_id", "category_code", "currency_code", "channel_code"), "line_count", ("total_qty", "net_amount", "tax_amount"))
STOCK = AggregateSpec(("variant_id",), "location_count", ("qty_on_hand", "qty_reserved", "below_reorder"))


def signed(changes: DataFrame) -> DataFrame:
    """Both images of each change as rows (`row`, `sign`)."""
    return changes.select(F.inline(F.array(
        F.struct(F.col("new").alias("row"), F.lit(1).alias("sign")), F.struct(F.col("old").alias("row"), F.lit(-1).alias("sign"))))
    ).filter(F.col("row").isNotNull())


def deltas(rows: DataFrame, spec: AggregateSpec, measures: dict[str, Column]) -> DataFrame:
    """Signed sums and counts per group; `rows` carries the keys, `sign` and the measured columns."""
    sign = F.col("sign")
    cols = [F.sum(sign).cast("bigint").alias(spec.count)]
    for n in spec.sums:
        m = measures[n]
        cols += [F.sum(m * sign).alias(n), F.sum(F.when(m.isNotNull(), sign).otherwise(0)).cast("bigint").alias(f"{n}_cnt")]
    return rows.groupBy(*spec.keys).agg(*cols)


def image_deltas(changes: DataFrame, spec: AggregateSpec, measures: dict[str, Column], keys: dict[str, Column] | None = None) -> DataFrame:
    """Rows to be summed, one per image of a change: keys, the sign as count, signed measures and
    their counts. The images carry all that the keys need, so no table is joined per batch."""
    sign = F.col("sign")
    cols = [sign.cast("bigint").alias(spec.count)]
    for n in spec.sums:
        cols += [(measures[n] * sign).alias(n), F.when(measures[n].isNotNull(), sign).otherwise(0).cast("bigint").alias(f"{n}_cnt")]
    rows = signed(changes).select("row.*", "sign")
    return rows.select(*[(keys or {}).get(k, F.col(k)).alias(k) for k in spec.keys], *cols)


def numbers(spec: AggregateSpec) -> list[str]:
    return [spec.count, *[x for n in spec.sums for x in (n, f"{n}_cnt")]]


class KeptSums:
    """An additive aggregate whose groups live in Spark's state store.

    One streaming aggregation sums the first copy and then the deltas of every micro-batch; a batch
    touches the groups its changes name and nothing else, however many batches came before. The
    aggregate is read back from the state of the last committed batch. Exactly-once and recovery
    are those of the query's checkpoint, which lies in the shared folder.
    """

    def __init__(self, spark: SparkSession, spec: AggregateSpec, schema: T.StructType, checkpoint: str):
        self.spark, self.spec, self.checkpoint = spark, spec, checkpoint
        self.schema = T.StructType([schema[n] for n in (*spec.keys, *numbers(spec))])

    def _typed(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])

    def run(self, start: DataFrame, deltas: DataFrame, name: str) -> StreamingQuery:
        """Sum both streams until they are drained; `start` has the stored rows."""
        rows = self._typed(start).union(self._typed(deltas))
        total = rows.groupBy(*self.spec.keys).agg(*[F.sum(n).alias(n) for n in numbers(self.spec)])
        return run_kept(total, self.checkpoint, name)

    def read(self) -> DataFrame:
        """The groups as of the last batch: empty ones are gone, a sum over no values is NULL."""
        fields = []
        for n in numbers(self.spec):  # a decimal sum keeps a second field in the state
            fields.append(n)
            if isinstance(self.schema[n].dataType, T.DecimalType):
                fields.append(f"_{n}_empty")
        rows = read_state(self.spark, self.checkpoint, fields)
        rows = self._typed(rows).filter(F.col(self.spec.count) != 0)
        return rows.withColumns({n: F.when(F.col(f"{n}_cnt") != 0, F.col(n)) for n in self.spec.sums})


def fast_refresh(mv: DataFrame, delta: DataFrame, spec: AggregateSpec) -> DataFrame:
    """Stored aggregate plus deltas; empty groups go, and a sum over no values is NULL again."""
    cols = numbers(spec)
    both = mv.select(*spec.keys, *cols).unionByName(delta.select(*spec.keys, *[F.col(n).cast(mv.schema[n].dataType).alias(n) for n in cols]))
    total = both.groupBy(*spec.keys).agg(*[F.sum(n).cast(mv.schema[n].dataType).alias(n) for n in cols]).filter(F.col(spec.count) != 0)
    return total.withColumns({n: F.when(F.col(f"{n}_cnt") != 0, F.col(n)) for n in spec.sums}).select(*spec.keys, *cols)


def daily_deltas(line_changes: DataFrame) -> DataFrame:
    """Deltas of the daily store aggregate; the line images carry their order's store, time and currency."""
    return image_deltas(line_changes, DAILY, {
        "total_qty": F.col("qty"), "gross_amount": F.col("qty") * F.col("unit_price"), "discount_amount": F.col("discount_amount"), "tax_amount": F.col("tax_amount")},
        {"sales_date": day_of("order_ts")})


def monthly_deltas(line_changes: DataFrame) -> DataFrame:
    """Deltas of the monthly category aggregate; the line images carry their order's time, currency
    and channel and their variant's category."""
    net = F.col("qty") * F.col("unit_price") - F.col("discount_amount")
    return image_deltas(line_changes, MONTHLY, {"total_qty": F.col("qty"), "net_amount": net, "tax_amount": F.col("tax_amount")}, {"month_start": month_of("order_ts")})


def stock_deltas(stock_changes: DataFrame) -> DataFrame:
    """Deltas of the stock aggregate; the below-reorder flag is a measure like the quantities."""
    low = F.col("reorder_point").isNotNull() & (F.col("qty_on_hand") < F.col("reorder_point") + F.col("qty_reserved"))
    return image_deltas(stock_changes, STOCK, {
        "qty_on_hand": F.col("qty_on_hand"), "qty_reserved": F.col("qty_reserved"), "below_reorder": F.when(low, 1).otherwise(0).cast("bigint")})


def complete(rows: DataFrame, spec: AggregateSpec, measures: dict[str, Column]) -> DataFrame:
    """The aggregate from scratch, as deltas of all rows counted +1."""
    return deltas(rows.withColumn("sign", F.lit(1)), spec, measures)


def covers(log: DataFrame, since: int) -> bool:
    """Whether a change log holds every change after number `since`: none purged, none missing."""
    got = log.filter(F.col("seq") > since).agg(F.min("seq"), F.max("seq"), F.count_distinct("seq")).first()
    return got[0] is None or (got[0] == since + 1 and got[1] - got[0] + 1 == got[2])


def refresh(mode: str, path: str, full: Callable[[], DataFrame], fast: Callable[[], DataFrame] | None = None, eligible: Callable[[], bool] = lambda: True) -> str:
    """Refresh the published copy at `path` by mode: F fast, C complete, ? fast where possible and
    complete otherwise. Returns what was done, FAST or COMPLETE.

    The attempt is the write itself: a fast refresh that fails at any point of its run, also on an
    executor half-way through, leaves the published copy as it was, and under '?' the complete one
    follows. `fast` is None for aggregates that cannot be kept from deltas (ranks, quintiles,
    extremes); `eligible` says whether the change log reaches back to the published copy.
    """
    if mode not in ("F", "C", "?"):
        raise ValueError(f"no refresh mode {mode}")
    if mode != "C":
        possible = fast is not None and eligible()
        if mode == "F" and not possible:
            raise ValueError("this aggregate can only be refreshed completely")
        if possible:
            try:
                publish(fast(), path)
                return "FAST"
            except Exception:
                if mode == "F":
                    raise
    publish(full(), path)
    return "COMPLETE"
