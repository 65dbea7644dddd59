"""Aggregations and windows over aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillweave.functions.values import as_col, order_nulls
from tillweave.operators.positions import with_percentile
from tillweave.operators.scalars import beside


def group_agg(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs)


def count_distinct_by(df: DataFrame, keys: list[str], cols: dict[str, str]) -> DataFrame:
    """Distinct counts per group: duplicates go in a partial aggregate keyed by (group, value),
    so a hot group is spread over its values before it is counted."""
    return df.groupBy(*keys).agg(*[F.count_distinct(F.col(c)).alias(n) for n, c in cols.items()])


def count_where(df: DataFrame, keys: list[str], conds: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in conds.items()])


def having(df: DataFrame, keys: list[str], aggs: list[Column], cond: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs).filter(cond)


def keep_first_over(df: DataFrame, part: list[str], order: str, value: str, name: str, desc: bool = True) -> DataFrame:
    """Attach the least `value` among the rows tied at the first `order` of the group."""
    ties = df.groupBy(*part, order).agg(F.min(value).alias("_v"))
    pick = F.max if desc else F.min
    best = ties.groupBy(*part).agg(pick(F.struct(order, "_v"))["_v"].alias(name))
    return df.join(best, part, "left")


def median_over(df: DataFrame, part: list[str], col: str, name: str) -> DataFrame:
    """Continuous median of each group, attached to its rows."""
    return with_percentile(df, part, col, 0.5, name)


def pivot_fixed(df: DataFrame, keys: list[str], col: str, values: list[str], aggs: list[Column]) -> DataFrame:
    """Pivot over a declared value list, which spares the pass that would look the values up."""
    return df.groupBy(*keys).pivot(col, values).agg(*aggs)


def listagg_by(df: DataFrame, keys: list[str], col: str, sep: str, name: str) -> DataFrame:
    """Text list of distinct values in order; the distinct step keeps a group to its value set."""
    small = df.select(*keys, col).filter(F.col(col).isNotNull()).distinct()
    return small.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(col)), sep).alias(name))


def agg_then_window(df: DataFrame, keys: list[str], aggs: list[Column], windows: dict[str, Column]) -> DataFrame:
    """Aggregate first, then ordered measures over the aggregated rows."""
    return df.groupBy(*keys).agg(*aggs).withColumns(windows)


def ordered_list(df: DataFrame, keys: list[str], order: list[str], col: str, name: str) -> DataFrame:
    """One ordered array per group, for groups bounded by the model (lines of an order, prices of a
    variant, leaves of a subtree)."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.col(col).alias("_v"))))
    return df.groupBy(*keys).agg(F.transform(packed, lambda r: r["_v"]).alias(name))


# ---- window columns for groups bounded by the model --------------------------------------------

def running_sum(part: list, order: list[Column], col: str) -> Column:
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(col).over(w)


def rolling(part: list, order: list[Column], col: str, n: int, agg: str = "sum") -> Column:
    """Aggregate over the row and the n - 1 before it; the mean is an exact sum over a count."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(-(n - 1), 0)
    if agg == "avg":
        return F.sum(col).over(w).cast("double") / F.count(col).over(w)
    return getattr(F, agg)(col).over(w)


def lag_lead(part: list, order: list[Column], col: str, n: int, default=None) -> Column:
    """Value n rows before (n > 0) or after (n < 0), with a default outside the group."""
    w = Window.partitionBy(*part).orderBy(*order)
    return F.lag(col, n, default).over(w) if n > 0 else F.lead(col, -n, default).over(w)


def first_last(part: list, order: list[Column], col: str) -> tuple[Column, Column]:
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.first_value(col).over(w), F.last_value(col).over(w)


def nth_from_last(part: list, order: list[tuple[str, bool]], col: str, n: int) -> Column:
    """The n-th value counted from the end: the order is reversed, NULL placement included."""
    reverse = [order_nulls(c, desc=not desc, nulls="last" if desc else "first") for c, desc in order]
    w = Window.partitionBy(*part).orderBy(*reverse).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.nth_value(col, n).over(w)


def limit_then_sort(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """Any n rows, sorted afterwards; which rows is not defined."""
    return df.limit(n).orderBy(*order)


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in order; each task keeps its own n before one merge."""
    return df.orderBy(*order).limit(n)


def checksum_pair(df: DataFrame, id: str, order: list[Column], n: int) -> DataFrame:
    """Sum of ids of limit-then-sort against sort-then-limit."""
    a = limit_then_sort(df, n, order).agg(F.sum(id).alias("limit_first"), F.count("*").alias("n_limit_first"))
    b = top_n(df, order, n).agg(F.sum(id).alias("sort_first"), F.count("*").alias("n_sort_first"))
    return beside(a, b)


def union_checks(checks: list[DataFrame]) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def explode_legs(df: DataFrame, legs: list[Column], keep: list[str]) -> DataFrame:
    """One row per leg of each row."""
    return df.select(*keep, F.inline(F.array(*legs)))


def split_rows(df: DataFrame, col: str, delim: str = ",", name: str = "part") -> DataFrame:
    """Split text to rows with positions; empty parts and the last part are kept, NULL gives none."""
    quoted = "\\Q" + delim.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return df.select("*", F.posexplode(F.split(as_col(col), quoted)).alias("part_no", name)).withColumn(
        "part_no", F.col("part_no") + 1)
