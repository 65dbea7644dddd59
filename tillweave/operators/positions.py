"""Positions, ranks and running totals that never put a whole group into one task.

A range shuffle sorts all rows by (group, order); each slice numbers its own rows and a table with
one row per slice supplies the offsets. A group that holds a third of the data is then spread over
a third of the slices instead of landing in one window task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillweave.functions.values import By
from tillweave.operators.scalars import beside
from tillweave.session import stash

_LOW_BITS = (1 << 33) - 1


def _slices(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def number_rows(df: DataFrame, order: list[Column], name: str = "pos", sums: dict[str, str] | None = None) -> DataFrame:
    """Add the 1-based position of every row in the total order given.

    `sums` maps an output name to a column whose running total (including the row) is wanted in
    the same order. The sorted copy is written once, because a second range shuffle could pick
    other boundaries.
    """
    sums = sums or {}
    sliced = (
        df.repartitionByRange(_slices(df), *order)
        .sortWithinPartitions(*order)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS)))
    )
    kept = stash(sliced)
    totals = kept.groupBy("_slice").agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()]
    )
    # one row per slice, so the unpartitioned window is over a few thousand rows at most
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *[F.sum(f"_t_{o}").over(before).alias(f"_b_{o}") for o in sums],
    )
    out = kept.join(offsets, "_slice")
    inside = Window.partitionBy("_slice").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    for o, c in sums.items():
        out = out.withColumn(o, F.coalesce(F.col(f"_b_{o}"), F.lit(0)) + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    out = out.withColumn(name, (F.col("_before") + F.col("_seq") + 1).cast("bigint"))
    return out.drop("_slice", "_seq", "_before", *[f"_b_{o}" for o in sums])


def _ntile(pos: Column, n: Column, tiles: int) -> Column:
    """Bucket of a 1-based position when the first n % tiles buckets get one extra row."""
    size, extra = F.floor(n / tiles), n % tiles
    cut = extra * (size + 1)
    return F.when(pos <= cut, F.floor((pos - 1) / (size + 1)) + 1).otherwise(
        extra + F.floor((pos - cut - 1) / F.greatest(size, F.lit(1))) + 1
    ).cast("int")


def rank_cols(
    df: DataFrame,
    part: list[str],
    order: list[By],
    kinds: dict[str, str | tuple[str, int]],
    tie: list[str],
) -> DataFrame:
    """Add ranking columns: `kinds` maps a name to row_number, rank, dense_rank, percent_rank,
    cume_dist or ("ntile", n).

    `tie` completes `order` to a total order, so row_number and ntile are reproducible. All kinds
    follow from positions in one global order: of a row, of the first and last row it ties with,
    and of its group's first and last row.
    """
    keys = {f"_o{k}": F.col(o.col) for k, o in enumerate(order)}
    df = df.withColumns(keys)
    again = [o.key(k) for k, o in zip(keys, order)]
    pos = number_rows(df, [*[F.col(p) for p in part], *again, *[F.col(c) for c in tie]], "_p")
    if all(isinstance(k, tuple) or k == "row_number" for k in kinds.values()):
        out = _null_safe(pos, _bounds(pos, part, "_p", "_p"), part)
    else:
        names = [*part, *keys]
        ties = pos.groupBy(*names).agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi"))
        dense = any(k == "dense_rank" for k in kinds.values())
        if dense:
            ties = number_rows(ties, [*[F.col(p) for p in part], *again], "_d")
        ties = _null_safe(ties, _bounds(ties, part, "_lo", "_hi", ["_d"] if dense else []), part)
        out = _null_safe(pos, ties, names)
    n = F.col("_g_last") - F.col("_g_first") + 1
    row = F.col("_p") - F.col("_g_first") + 1
    rank = F.col("_lo") - F.col("_g_first") + 1 if "_lo" in out.columns else None
    made = {"row_number": lambda: row.cast("int"), "rank": lambda: rank.cast("int"), "dense_rank": lambda: (F.col("_d") - F.col("_d0") + 1).cast("int"),
            "percent_rank": lambda: F.when(n > 1, (rank - 1) / (n - 1)).otherwise(0.0), "cume_dist": lambda: (F.col("_hi") - F.col("_g_first") + 1) / n}
    cols = {name: _ntile(row, n, kind[1]) if isinstance(kind, tuple) else made[kind]() for name, kind in kinds.items()}
    return out.select(*[c for c in df.columns if c not in keys], *[c.alias(k) for k, c in cols.items()])


def _bounds(df: DataFrame, part: list[str], low: str, high: str, also: list[str] = ()) -> DataFrame:
    """First and last position of each group; of the whole frame when there is no group."""
    return df.groupBy(*part).agg(F.min(low).alias("_g_first"), F.max(high).alias("_g_last"), *[F.min(c).alias(f"{c}0") for c in also])


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys that may be NULL, keeping the left side's columns."""
    if not keys:
        return beside(left, right)
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    return left.join(r, cond).drop(*[f"_r_{k}" for k in keys])


def with_part_total(df: DataFrame, part: list[str], totals: dict[str, Column]) -> DataFrame:
    """Attach per-group aggregates to every row without a window over the group.

    The aggregate is partial before its shuffle and has one row per group, so joining it back
    costs a broadcast or, for very many groups, a sort-merge join whose hot side AQE can split.
    """
    if not part:
        return _null_safe(df, df.agg(*[c.alias(n) for n, c in totals.items()]), [])
    agg = df.groupBy(*part).agg(*[c.alias(n) for n, c in totals.items()])
    return _null_safe(df, agg, part)


def percentile_by(df: DataFrame, part: list[str], col: str, p: float, name: str) -> DataFrame:
    """Continuous percentile `p` of each group, one row per group; NULL for a group without values.

    Equal values are counted together before they are sorted, and the two neighbours of the wanted
    rank are found from running counts, so no task holds the values of a group.
    """
    counts = df.groupBy(*part, F.col(col).cast("double").alias("_x")).agg(F.count(F.col(col).cast("double")).alias("_n"))
    run = number_rows(counts, [*[F.col(k) for k in part], F.col("_x")], "_p", {"_to": "_n"}).withColumn("_from", F.col("_to") - F.col("_n"))
    groups = run.groupBy(*part).agg(F.min("_from").alias("_base"), F.max("_to").alias("_end"))
    rows = _null_safe(run, groups, part).withColumn("_at", (F.col("_end") - F.col("_base") - 1) * F.lit(p))
    at = lambda k: F.max(F.when((F.col("_from") - F.col("_base") <= k) & (k < F.col("_to") - F.col("_base")), F.col("_x")))
    low, high = F.floor("_at"), F.ceil("_at")
    found = rows.groupBy(*part).agg(F.max("_at").alias("_at"), at(low).alias("_lo"), at(high).alias("_hi"))
    between = (high - F.col("_at")) * F.col("_lo") + (F.col("_at") - low) * F.col("_hi")
    return found.select(*part, F.when(low == high, F.col("_lo")).otherwise(between).alias(name))


def with_percentile(df: DataFrame, part: list[str], col: str, p: float, name: str) -> DataFrame:
    """Attach the continuous percentile `p` of a row's group."""
    return _null_safe(df, percentile_by(df, part, col, p, name), part)


def top_k(df: DataFrame, part: list[str], order: list[Column], k: int, name: str = "rn") -> DataFrame:
    """The k first rows of each group. The rank filter is pushed below the shuffle
    (WindowGroupLimit), so each map task sends at most k rows of a group, hot or not."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def assign_ids(
    df: DataFrame, order: list[Column], start: int | Column = 0, name: str = "id",
    prefix: str | None = None, width: int = 12, ref: str = "ref", cycle: int | None = None,
) -> DataFrame:
    """Consecutive ids after `start`, and optionally a formatted reference; `cycle` wraps the
    number used in the reference to 1..cycle."""
    from tillweave.functions.values import pad_ref

    start = start if isinstance(start, Column) else F.lit(start)
    out = number_rows(df, order, name).withColumn(name, (F.col(name) + start).cast("bigint"))
    if prefix is not None:
        number = F.col(name) if cycle is None else F.pmod(F.col(name) - 1, F.lit(cycle)) + 1
        out = out.withColumn(ref, pad_ref(prefix, number, width))
    return out


def running_total(df: DataFrame, part: list[str], order: list[Column], col: str, name: str) -> DataFrame:
    """Running sum per group up to and including each row; `order` must be total."""
    whole = number_rows(df, [*[F.col(p) for p in part], *order], "_p", {"_run": col})
    base = whole.groupBy(*part).agg(F.min_by(F.col("_run") - F.coalesce(F.col(col), F.lit(0)), "_p").alias("_base"))
    return _null_safe(whole, base, part).withColumn(name, F.col("_run") - F.col("_base")).drop("_p", "_run", "_base")


def carry_last(df: DataFrame, part: list[str], order: list[Column], cols: list[str]) -> DataFrame:
    """Each column's last value that is not NULL, of the group's rows up to and including each row."""
    return _scan(df, part, order, cols, lambda c, seq: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))),
                 lambda c, w: F.last(c, ignorenulls=True).over(w), lambda own, before: F.coalesce(own, before))


def running_min(df: DataFrame, part: list[str], order: list[Column], cols: list[str]) -> DataFrame:
    """Each column's least value of the group's rows up to and including each row."""
    return _scan(df, part, order, cols, lambda c, seq: F.min(c), lambda c, w: F.min(c).over(w), F.least)


def _scan(df: DataFrame, part: list[str], order: list[Column], cols: list[str], total: Callable, run: Callable, join: Callable) -> DataFrame:
    """A segmented scan with a fold given as a total of rows, its running form and its join of two.

    Slices of one range shuffle fold inside themselves; of each slice a row remains with its first
    and last group and what that last group's values end with, and from these rows, a few
    thousand, comes what a slice's first group starts with.
    """
    keys = [F.col(k) for k in part]
    sliced = df.repartitionByRange(_slices(df), *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_slice", F.spark_partition_id())
    kept = stash(sliced.withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))))
    group = F.struct(*keys)
    inside = Window.partitionBy("_slice", *part).orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    out = kept.withColumns({f"_c_{c}": run(F.col(c), inside) for c in cols}).withColumn("_group", group)
    ends = kept.groupBy("_slice", *part).agg(F.min("_seq").alias("_first"), F.max("_seq").alias("_last"), *[total(c, "_seq").alias(c) for c in cols])
    ends = ends.groupBy("_slice").agg(
        F.min_by(group, "_first").alias("_head"), F.max_by(group, "_last").alias("_tail"), *[F.max_by(F.struct(c), "_last").alias(c) for c in cols])
    same_tail = Window.partitionBy("_tail").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumns({c: run(F.col(f"{c}.{c}"), same_tail) for c in cols})
    before = Window.orderBy("_slice")  # one row per slice
    carry = ends.select("_slice", "_head", F.lag("_tail").over(before).alias("_tail"), *[F.lag(c).over(before).alias(f"_b_{c}") for c in cols])
    carry = carry.filter(F.col("_head").eqNullSafe(F.col("_tail"))).drop("_tail")
    joined = out.join(carry, "_slice", "left")
    comes = F.col("_group").eqNullSafe(F.col("_head"))
    values = {c: join(F.col(f"_c_{c}"), F.when(comes, F.col(f"_b_{c}"))) for c in cols}
    return joined.withColumns(values).select(*df.columns)
