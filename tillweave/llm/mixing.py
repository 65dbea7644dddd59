"""Mixing sources to target weights, in DataFrame operations only.

Words are summed per source; the targets share the corpus by weight, stop at `MOST` times a
source's size, and pass their excess on by weight. A source's repetition rate is its target over
its size; each document is emitted floor(rate) times, plus once more when a coin seeded by its
digest falls below the rate's fraction.

Targets in closed form: with the level L, a source's target is min(MOST * size, L * weight).
Sources in order of size / weight reach their cap first, so L follows from running sums over that
order. Those sums, and the places that give the weights, run over slices of a range shuffle with
one offset per slice, not over all sources in one task.

Defined cases: NULL text has size 0; the NULL source is a source of its own, after all others; a
source of size 0 has target 0 and rate 0 and emits nothing; rows equal in every used column share
one coin; an empty table gives an empty mix. Other columns are kept, taken names get an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillweave.llm.words import fresh, n_words
from tillweave.operators.scalars import beside
from tillweave.session import stash

# The weights, dealt to the sources in order and repeated.
WEIGHTS = (5, 2, 1)
MOST = 3
_COIN_BITS = 52


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], position: str) -> DataFrame:
    """0-based `position` and running totals before each row, in a total order.

    The sorted copy is written once with its slice numbers; totals per slice give the offsets.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = {f"_v_{k}": v for k, v in sums.items()}
    cut = df.withColumns(held).repartitionByRange(n, *order).sortWithinPartitions(*order)
    kept = stash(cut.withColumns({"_slice": F.spark_partition_id(), "_seq": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    totals = kept.groupBy("_slice").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t{c}") for c in held])
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    offsets = totals.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"), *[F.coalesce(F.sum(f"_t{c}").over(before), F.lit(0)).alias(f"_o{c}") for c in held])
    inside = Window.partitionBy("_slice").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    out = kept.join(F.broadcast(offsets), "_slice").withColumn(position, F.col("_o") + F.col("_seq"))  # offsets: as many rows as slices
    out = out.withColumns({k: F.col(f"_o_v_{k}") + F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in sums})
    return out.drop("_slice", "_seq", "_o", *held, *[f"_o{c}" for c in held])


def targets(sized: DataFrame, source: str, size: str, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row per source: source, source_size, weight, target, rate."""
    sources = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    placed = running(sources, [F.col("source").isNull(), F.col("source")], {}, "_place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int")).cast("bigint")
    placed = placed.withColumn("weight", weight)
    # size / weight in order, exactly: a common multiple of the weights makes both whole numbers
    multiple = 1
    for w in weights:
        multiple *= w
    full = F.col("source_size") * (multiple / F.col("weight")).cast("bigint")
    run = running(placed, [full, F.col("_place")], {"_cap_before": most * F.col("source_size"), "_weight_before": F.col("weight")}, "_rank")
    total = run.agg(F.sum("source_size").alias("_all"), F.sum("weight").alias("_weights"))
    run = beside(run, total)
    # what a source and all after it would get for a unit of weight; the first that stays below its cap sets the level
    share = (F.col("_all") - F.col("_cap_before")) / (F.col("_weights") - F.col("_weight_before"))
    run = stash(run.withColumn("_share", share))
    level = run.filter(F.col("_share") * F.col("weight") <= most * F.col("source_size")).agg(F.min_by("_share", "_rank").alias("_level"))
    target = F.least(F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("weight"), (most * F.col("source_size")).cast("double"))
    return beside(run, level).select(
        "source", "source_size", "weight", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate")
    )


def copies(rate: Column, key: Column) -> Column:
    """floor(rate), and one more with the rate's fraction as probability; the coin is `key`'s digest."""
    coin = F.conv(F.substring(F.md5(key), 1, _COIN_BITS // 4), 16, 10).cast("double") / float(1 << _COIN_BITS)
    return (F.floor(rate) + F.when(coin < rate - F.floor(rate), 1).otherwise(0)).cast("bigint")


def mixture(docs: DataFrame, key: Column, seed: str = "mix", text: str = "text", source: str = "source") -> DataFrame:
    """`docs` with a struct `_mix` of size, source_size, weight, target, rate and copies."""
    name = fresh(docs.columns, "_mix")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(source).alias("_source"), n_words(F.col(text)).alias("_size"), key.alias("_key"))
    # few narrow rows, and of a size the planner knows: it broadcasts them if they are small enough
    plan = stash(targets(sized.select("_source", "_size"), "_source", "_size"))
    joined = sized.join(plan, F.col("_source").eqNullSafe(F.col("source")), "left")
    made = F.struct(F.col("_size").alias("size"), "source_size", "weight", "target", "rate", copies(F.col("rate"), F.concat_ws(":", F.lit(seed), "_key")).alias("copies"))
    return joined.select("_doc.*", made.alias(name))


def document_key(docs: DataFrame) -> Column:
    return F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce(F.col("text"), F.lit(""))))


def mix(docs: DataFrame, key: Column | None = None, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every document as often as its copies, columns unchanged."""
    made = mixture(docs, document_key(docs) if key is None else key, seed)
    name = made.columns[-1]
    n = F.col(f"{name}.copies")
    return made.filter(n > 0).withColumn(name, F.explode(F.array_repeat(n, n.cast("int")))).drop(name)


def report(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """One row per document: size, its source's size and target, words taken with repeats."""
    made = mixture(docs.select("doc_id", "text", "source"), document_key(docs), seed)
    m = made.columns[-1]
    return made.select("doc_id", F.col(f"{m}.size").alias("size"), F.col(f"{m}.source_size").alias("source_size"), F.col(f"{m}.target").alias("target"), (F.col(f"{m}.size") * F.col(f"{m}.copies")).alias("taken"))


_WORDS = r"CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT)"
REPORT_SQL = f"""
WITH d AS (SELECT doc_id, source, {_WORDS} AS size, md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), '-'), '/', md5(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1] AS weight, row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") AS place FROM s),
r AS (SELECT *, row_number() OVER o AS rk,
  (CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
  / (CAST(sum(weight) OVER () AS DOUBLE) - CAST(coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)) AS share
  FROM w WINDOW o AS (ORDER BY source_size * (10 // weight), place)),
l AS (SELECT arg_min(share, rk) AS level FROM r WHERE share * weight <= 3 * source_size),
t AS (SELECT source, source_size, least(coalesce(level, 0) * weight, CAST(3 * source_size AS DOUBLE)) AS target FROM r, l),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate, CAST('0x' || substr(h, 1, 13) AS BIGINT) / 4503599627370496.0 AS coin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
