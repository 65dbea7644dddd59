"""Keyed comparison of two frames of canonical text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _check_columns(src: DataFrame, tgt: DataFrame, keys: list[str]) -> list[str]:
    if not keys or len(keys) != len(set(keys)):
        raise ValueError("a comparison needs at least one key, each named once")
    for df in (src, tgt):
        if len(df.columns) != len(set(df.columns)) or any(not c for c in df.columns):
            raise ValueError("two columns share a name, or one has none")
        if not set(keys) <= set(df.columns):
            raise ValueError(f"no column {sorted(set(keys) - set(df.columns))} to compare by")
    if sorted(src.columns) != sorted(tgt.columns):
        raise ValueError(f"columns on one side only: {sorted(set(src.columns) ^ set(tgt.columns))}")
    return sorted(src.columns)


WORDS = 4  # a SHA-256 as four longs


def _payload(cols: list[str]) -> list[Column]:
    """SHA-256 of all cells, each with its length before it, so no two rows share a text.

    The digest is cut into longs: fixed-width values keep the aggregate below a hash aggregate,
    where a text maximum would force both of its sides to be sorted.
    """
    cells = [F.concat(F.coalesce(F.length(F.col(f"`{c}`")).cast("string"), F.lit("n")), F.lit(":"), F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in cols]
    digest = F.sha2(F.concat(*cells).cast("binary"), 256)
    return [F.conv(F.substring(digest, 16 * w + 1, 16), 16, -10).cast("bigint").alias(f"_h{w}") for w in range(WORDS)]


def keyed_sides(src: DataFrame, tgt: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with its row count and digest on either side.

    Only keys and digests are shuffled, once, after a partial aggregate on each map task; a key
    repeated very often collapses there and is reported instead of joined.
    """
    cols = _check_columns(src, tgt, keys)
    side = lambda df, n: df.select(*[F.col(f"`{k}`").alias(k) for k in keys], *_payload(cols), F.lit(n).alias("_side"))
    both = side(src, 0).unionByName(side(tgt, 1))
    pick = lambda n, w: F.max(F.when(F.col("_side") == n, F.col(f"_h{w}")))
    return both.groupBy(*keys).agg(
        F.count_if(F.col("_side") == 0).alias("ns"), F.count_if(F.col("_side") == 1).alias("nt"),
        *[pick(n, w).alias(f"{'st'[n]}{w}") for n in (0, 1) for w in range(WORDS)])


def compare(src: DataFrame, tgt: DataFrame, keys: list[str], sample: int = 10) -> tuple[DataFrame, DataFrame]:
    """(summary, samples): uncapped counts of missing, extra and changed keys, and the first
    changed keys in key order.

    The summary's status is passed, failed or refused; repeated keys, empty keys and two empty
    sides are refused.
    """
    sides = keyed_sides(src, tgt, keys)
    empty = reduce(lambda a, b: a | b, [F.col(k).isNull() | (F.col(k) == "") for k in keys])
    differs = reduce(lambda a, b: a | b, [F.col(f"s{w}") != F.col(f"t{w}") for w in range(WORDS)])
    changed = (F.col("ns") > 0) & (F.col("nt") > 0) & differs
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    counts = sides.agg(
        total("ns").alias("source_rows"), total("nt").alias("target_rows"), F.count_if(F.col("nt") == 0).alias("missing_keys"),
        F.count_if(F.col("ns") == 0).alias("extra_keys"), F.count_if(changed).alias("changed_rows"),
        F.count_if((F.col("ns") > 1) | (F.col("nt") > 1)).alias("duplicate_keys"), F.count_if(empty).alias("empty_keys"))
    reason = (
        F.when(F.col("source_rows") + F.col("target_rows") == 0, "both sides are empty")
        .when(F.col("empty_keys") > 0, "empty comparison key").when(F.col("duplicate_keys") > 0, "duplicate comparison key"))
    bad = F.col("missing_keys") + F.col("extra_keys") + F.col("changed_rows")
    summary = counts.withColumns({"refused": reason}).withColumn(
        "status", F.when(F.col("refused").isNotNull(), "refused").when(bad == 0, "passed").otherwise("failed"))
    samples = sides.filter(changed).select(*keys).orderBy(*keys).limit(sample)
    return summary, samples


def compare_or_raise(src: DataFrame, tgt: DataFrame, keys: list[str], sample: int = 10) -> dict:
    """Run a comparison and return its summary row with samples; a refusal raises."""
    summary, samples = compare(src, tgt, keys, sample)
    row = summary.first().asDict()
    if row["status"] == "refused":
        raise ValueError(row["refused"])
    return {**row, "changed_key_samples": [list(r) for r in samples.collect()]}


def cell_diff(src: DataFrame, tgt: DataFrame, keys: list[str]) -> DataFrame:
    """Mismatching cells per column over the keys both sides hold."""
    cols = [c for c in _check_columns(src, tgt, keys) if c not in keys]
    s = src.select(*keys, *[F.col(f"`{c}`").alias(f"_s_{c}") for c in cols])
    t = tgt.select(*keys, *[F.col(f"`{c}`").alias(f"_t_{c}") for c in cols])
    sums = s.join(t, keys).agg(F.count("*").alias("n"), *[F.count_if(~F.col(f"_s_{c}").eqNullSafe(F.col(f"_t_{c}"))).alias(c) for c in cols])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col("n").alias("cells"), F.col(f"`{c}`").alias("mismatches")) for c in cols])))


def _profile(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Row count and non-null count per column in one pass."""
    one = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in cols])
    return one.select(F.inline(F.array(
        F.struct(F.lit("*").alias("column_name"), F.col("_rows").alias(name)),
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias(name)) for c in cols])))


def count_check(src: DataFrame, tgt: DataFrame, cols: list[str]) -> DataFrame:
    """Row counts and non-null counts of both sides with whether they agree."""
    return _profile(src, cols, "source_count").join(_profile(tgt, cols, "target_count"), "column_name").withColumn(
        "equal", F.when(F.col("source_count") == F.col("target_count"), "Y").otherwise("N"))


def id_highwater(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Greatest key per table, NULL for an empty one: where its sequence must continue."""
    parts = [df.agg(F.max(k).cast("bigint").alias("high_water")).select(F.lit(n).alias("table_name"), "high_water") for n, (df, k) in tables.items()]
    return reduce(DataFrame.unionByName, parts)
