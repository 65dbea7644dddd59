"""Filter interaction audit: which filter of several removes what, in every order and on average.

Each document gets a mask of the filters it fails; parts are reduced to counts per mask, of which
there are at most 2**n. From them v(S), the documents that a coalition S of filters removes, is
tabulated for all coalitions. What a step of an order removes is v(before and this) - v(before), so
all orders and steps are differences of that table. The Shapley value of a filter comes from the
constrained least squares problem

    minimise  sum over S of k(S) * (v(S) - sum of x_i, i in S)**2   so that  sum of x = v(all)

with the Shapley kernel k(S) = (n - 1) / (C(n, |S|) |S| (n - |S|)). Its normal equations with the
multiplier of the constraint are solved in rationals, once, for every coalition's v at a time: the
solution is a matrix of n rows and 2**n columns that holds for all parts. Times n! its entries are
whole numbers, so the values are exact.

Duplicates are found by digest: the smallest doc_id of each text stays, and the rows look for
themselves among those by (digest, doc_id), so a text that a third of all rows share is no hot key.

Defined cases: NULL text is the empty text, a NULL part the empty string; a row with a NULL doc_id
is no duplicate, and none of others; repeated rows count each, and are no duplicates of each other,
since none has the smaller doc_id; of several labels of one doc_id any 1 counts, a NULL label is
not 1; an empty table gives no rows. Columns that are not named are neither read nor returned.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.llm.words import let, words
from tillweave.session import stash

MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3  # words, then percent of words and of code points


def shapley_matrix(n: int) -> list[list[Fraction]]:
    """Row i, column S: the weight of v(S) in the Shapley value of filter i; S is a bit mask."""
    full = (1 << n) - 1
    left = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    right = [[Fraction(0)] * (full + 1) for _ in range(n + 1)]  # one right-hand side per coalition
    for s in range(1, full):
        size = bin(s).count("1")
        weight = Fraction(n - 1, comb(n, size) * size * (n - size))
        inside = [i for i in range(n) if s >> i & 1]
        for i in inside:
            right[i][s] += weight
            for j in inside:
                left[i][j] += weight
    for i in range(n):  # the multiplier of "all values sum to v(all)"
        left[i][n] = left[n][i] = Fraction(1)
    right[n][full] = Fraction(1)
    return _solved(left, right)[:n]


def _solved(left: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    rows = [a + b for a, b in zip(left, right)]
    for k in range(len(rows)):
        pivot = next(r for r in range(k, len(rows)) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(len(rows)):
            if r != k and rows[r][k]:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k])]
    return [r[len(left) :] for r in rows]


def text_failures(text: Column) -> list[Column]:
    """Failures A to D: too few words, too few distinct words, too many capitals, odd symbols."""
    whole = F.coalesce(text, F.lit(""))
    counted = let(words(whole), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    capitals = F.length(whole) - F.length(F.regexp_replace(whole, "[A-Z]+", ""))
    return [
        counted["n"] < MIN_WORDS, F.lit(100).cast("bigint") * counted["d"] < F.lit(MIN_DISTINCT) * counted["n"].cast("bigint"),
        F.lit(100).cast("bigint") * capitals > F.lit(MAX_CAPITALS) * F.length(whole).cast("bigint"), whole.rlike(r"[#$%&*|]"),
    ]


def later_copies(rows: DataFrame, digest: str, doc_id: str, name: str) -> DataFrame:
    """`rows` with a boolean: a smaller doc_id has the same digest."""
    firsts = rows.filter(F.col(doc_id).isNotNull()).groupBy(digest).agg(F.min(doc_id).alias(doc_id)).withColumn(name, F.lit(False))
    return rows.join(firsts, [digest, doc_id], "left").withColumn(name, F.coalesce(name, F.col(doc_id).isNotNull()))


def coalitions(masks: DataFrame, n: int, measures: list[str]) -> DataFrame:
    """A row per part: `total` documents, and `v`, an array over coalitions of what each removes;
    `masks` holds (part, mask, documents, *measures)."""
    named = ["documents", *measures]
    every = F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))).alias("s")
    small = masks.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in named])
    removed = small.select("part", "mask", *named, every).groupBy("part", "s").agg(
        F.sum("documents").alias("total"), *[F.sum(F.when(F.col("mask").bitwiseAND(F.col("s")) != 0, F.col(c)).otherwise(0)).alias(c) for c in named]
    )
    table = F.sort_array(F.collect_list(F.struct("s", *named)))  # 2**n entries
    return removed.groupBy("part").agg(F.max("total").alias("total"), table.alias("v"))


def steps(table: DataFrame, names: str, measures: dict[str, str]) -> DataFrame:
    """A row per part, order of all filters and step: kept, removed, redundant, unique_fails, the
    lost of each measure, shapley (times n!)."""
    n = len(names)
    full, whole = (1 << n) - 1, factorial(n)
    values = []
    for i, row in enumerate(shapley_matrix(n)):
        scaled = [x * whole for x in row]
        assert all(x.denominator == 1 for x in scaled)
        values.append(sum((F.col("v")[s]["documents"] * int(x) for s, x in enumerate(scaled) if x), F.lit(0).cast("bigint")))
    table = table.withColumn("values", F.array(*values))
    plan = []
    for order in permutations(range(n)):
        before = 0
        for k, i in enumerate(order):
            plan.append({"filter_order": "".join(names[j] for j in order), "step": k + 1, "i": i, "own": 1 << i, "before": before, "after": before | 1 << i})
            before |= 1 << i
    # n * n! constant entries
    entries = F.from_json(F.lit(json.dumps(plan)), "array<struct<filter_order string, step int, i int, own int, before int, after int>>")
    each = table.select("*", F.explode(entries).alias("p"))

    def v(at: Column, what: str) -> Column:
        return F.col("v")[at][what]

    def gone(what: str) -> Column:
        return v(F.col("p.after"), what) - v(F.col("p.before"), what)

    return each.select(
        "part", "p.filter_order", "p.step", (F.col("total") - v(F.col("p.after"), "documents")).alias("kept"), gone("documents").alias("removed"),
        (v(F.col("p.own"), "documents") - gone("documents")).alias("redundant"), (v(F.lit(full), "documents") - v(F.lit(full) - F.col("p.own"), "documents")).alias("unique_fails"),
        *[gone(m).alias(name) for name, m in measures.items()], F.col("values")[F.col("p.i")].alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text") -> DataFrame:
    """The audit of the filters A to E (E: the text of a smaller doc_id) over `docs`, per part."""
    failed = text_failures(F.col(text))
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    facts = stash(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), digest.alias("digest"), mask.alias("mask")))
    judged = later_copies(facts, "digest", "doc_id", "copy")
    flags = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("bigint")).alias(c) for c in ("quality", "toxic")])
    known = judged.join(flags, "doc_id", "left")
    masks = known.groupBy("part", (F.col("mask") + F.when(F.col("copy"), 1 << len(failed)).otherwise(0)).alias("mask")).agg(
        F.count("*").alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("quality", "toxic")]
    )
    return steps(coalitions(masks, len(failed) + 1, ["quality", "toxic"]), "ABCDE", {"good_lost": "quality", "toxic_lost": "toxic"})


REPORT_SQL = r"""
WITH l AS (SELECT doc_id, CAST(coalesce(max(CAST(quality = 1 AS INT)), 0) AS BIGINT) AS good, CAST(coalesce(max(CAST(toxic = 1 AS INT)), 0) AS BIGINT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
e AS (SELECT doc_id, part, (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask FROM d),
m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM e LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT f1.f || f2.f || f3.f || f4.f || f5.f AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bits FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.b + f2.b + f3.b + f4.b + f5.b = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
