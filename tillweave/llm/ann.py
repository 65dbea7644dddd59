"""Approximate nearest neighbours by learned partitions.

1. On a bounded sample of distinct vectors (`SAMPLE`, least digest first) the graph of nearest
   neighbours is built and cut into parts of equal size: bisections along principal directions
   first, then moves of single vectors to the part most of their neighbours are in, as long as no
   part leaves its size by more than `SLACK`.
2. A small classifier (one hidden layer) learns to predict, from a vector, the parts its neighbours
   lie in. A part of the sample is held out; on it the number of parts to probe is chosen, the
   least one at which the probed parts hold `WANTED` of the true neighbours. Vectors without any
   structure get many probes that way, clustered ones few.
3. Every vector is put into its most probable part. A query goes to its most probable parts; a part
   is searched in blocks of about `BLOCK` vectors, each with the part's queries as a task of its
   own, so neither a hot part nor a hot query vector is held in one place. Distances inside a block
   are exact; the best of all blocks are merged per query.

Equal vectors are collapsed first: of the rows that share a vector only the k + 1 smallest ids can
be among the k nearest of anything, so the others are searched for but never searched through, and
equal queries are searched once. Equality is decided by 128 bits of hash.

Sizes on the driver: the sample, the model and a row per part.

Defined cases: vectors that are NULL, zero or hold NULL or non-finite components take no part, nor
do rows without id and vectors of another length than the commonest (the smaller at a tie); rows
that repeat an id and its vector count once; two vectors under one id are two queries, the nearer of
them is the candidate, and neither is a candidate of the other; a query without candidates gives no row; fewer candidates than k
give fewer rows; an empty table gives none. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillweave.session import stash

SAMPLE = 8192  # vectors the parts and the classifier are fitted on
DEGREE = 10  # neighbours of a vector in the graph
PART_ROWS, LEAST_PARTS, MOST_PARTS = 1024, 4, 64  # distinct vectors a part should hold, and how many parts there are
SLACK = 0.05
HIDDEN, EPOCHS, RATE = 128, 40, 3e-3
HELD_OUT, WANTED = 4, 0.95  # one in so many of the sample; share of true neighbours in the probed parts
BLOCK = 8192


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]
    parts: int
    probes: int

    @property
    def size(self) -> int:
        return len(self.mean)


def _logits(mean: np.ndarray, scale: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    h = np.clip((x - mean) / scale, -1e4, 1e4).astype(np.float32)
    for k, (w, b) in enumerate(layers):
        h = h @ w + b
        if k + 1 < len(layers):
            h = np.maximum(h, 0)
    return h


def nearest(base: np.ndarray, queries: np.ndarray, k: int, itself: bool = False) -> np.ndarray:
    """Indices of the k nearest rows of `base` per query; with `itself` the query's own row is left out."""
    norms, out = (base * base).sum(1), []
    for at in range(0, len(queries), 512):
        q = queries[at : at + 512]
        d = norms - 2 * (q @ base.T)
        if itself:
            d[np.arange(len(q)), np.arange(at, at + len(q))] = np.inf
        out.append(np.argpartition(d, min(k, len(base)) - 1, axis=1)[:, :k])
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 30) -> np.ndarray:
    """Part of each row of x: few edges of `graph` (row, neighbours) between parts, sizes near equal."""
    part = np.zeros(len(x), np.int64)

    def split(rows: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            part[rows] = first
            return
        centred = x[rows] - x[rows].mean(0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        left = count // 2
        order = rows[np.argsort(centred @ axis, kind="stable")]
        cut = len(rows) * left // count
        split(order[:cut], first, left)
        split(order[cut:], first + left, count - left)

    split(np.arange(len(x)), 0, parts)
    even = len(x) / parts
    most, least = int(np.ceil(even * (1 + SLACK))), int(even * (1 - SLACK))
    one, other = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    size, best, fewest = np.bincount(part, minlength=parts), part.copy(), np.inf
    for k in range(rounds):
        cut = int((part[one] != part[other]).sum())
        if cut < fewest:
            best, fewest = part.copy(), cut
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (one, part[other]), 1)
        np.add.at(votes, (other, part[one]), 1)
        own = votes[np.arange(len(x)), part]
        votes[np.arange(len(x)), part] = -1
        to = votes.argmax(1)
        gain = votes[np.arange(len(x)), to] - own
        wish = np.flatnonzero((gain > 0) & (np.arange(len(x)) % 2 == k % 2))  # half a round, so that neighbours do not swap for ever
        moved = 0
        for i in wish[np.argsort(-gain[wish], kind="stable")].tolist():
            if size[to[i]] < most and size[part[i]] > least:
                size[part[i]] -= 1
                size[to[i]] += 1
                part[i] = to[i]
                moved += 1
        if not moved and k % 2:
            break
    return best


def _trained(x: np.ndarray, wanted: np.ndarray, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights by which softmax of the logits follows the rows of `wanted` (Adam on cross entropy)."""
    rng = np.random.default_rng(seed)
    shapes = [(x.shape[1], HIDDEN), (HIDDEN, wanted.shape[1])]
    values = [v for a, b in shapes for v in (rng.normal(0, np.sqrt(2 / a), (a, b)).astype(np.float32), np.zeros(b, np.float32))]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for epoch in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.maximum(x[rows] @ values[0] + values[1], 0)
            z = h @ values[2] + values[3]
            p = np.exp(z - z.max(1, keepdims=True))
            back = (p / p.sum(1, keepdims=True) - wanted[rows]) / len(rows)
            inner = (back @ values[2].T) * (h > 0)
            step += 1
            for k, g in enumerate((x[rows].T @ inner, inner.sum(0), h.T @ back, back.sum(0))):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                rate = RATE * (1 - epoch / EPOCHS)
                values[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return [(values[0], values[1]), (values[2], values[3])]


def fit_sample(x: np.ndarray, rows: int, wanted: float = WANTED) -> Model:
    """The model for a table of `rows` distinct vectors, from the sample x."""
    parts = max(1, min(MOST_PARTS, max(LEAST_PARTS, -(-rows // PART_ROWS)), len(x) // (4 * DEGREE)))
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    scale = np.full(x.shape[1], max(float(np.sqrt(((x - mean) ** 2).mean())) if len(x) else 1.0, 1e-30))
    if parts == 1:
        return Model(mean, scale, [(np.zeros((x.shape[1], 1), np.float32), np.zeros(1, np.float32))], 1, 1)
    z = (x - mean) / scale  # one scale for all components: distances keep their order
    held = np.arange(len(z)) % HELD_OUT == 0  # digests come in order, which is as good as chance
    base = z[~held]
    graph = nearest(base, base, DEGREE, itself=True)
    part = balanced_parts(base, graph, parts)
    aim = np.zeros((len(base), parts), np.float32)
    np.add.at(aim, (np.repeat(np.arange(len(base)), DEGREE), part[graph].ravel()), 1 / (2 * DEGREE))
    aim[np.arange(len(base)), part] += 0.5
    layers = _trained(base.astype(np.float32), aim)
    # held-out vectors are queries and candidates here, so nothing judged was trained on
    seen = _logits(mean, scale, layers, x[held])
    true = nearest(z[held], z[held], min(DEGREE, int(held.sum()) - 1), itself=True)
    place = (-seen).argsort(1, kind="stable").argsort(1, kind="stable")  # of each part for each query
    reached = np.sort(place[np.arange(len(seen))[:, None], seen.argmax(1)[true]].ravel())
    probes = int(reached[min(len(reached) - 1, int(np.ceil(wanted * len(reached))))]) + 1
    return Model(mean, scale, layers, parts, probes)


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def usable(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v, d1, d2) of the rows that take part, repeated ones once."""
    size = F.size(F.col(vector))
    known = vectors.select(F.col(id_).cast("bigint").alias("id"), F.col(vector).alias("v"), size.alias("n")).filter("id IS NOT NULL AND v IS NOT NULL AND n > 0")
    length = known.groupBy("n").count().orderBy(F.desc("count"), "n").select("n").first()
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = known.filter((F.col("n") == (length[0] if length else 0)) & ~odd & F.exists("v", lambda x: x != 0))
    keyed = fine.select("id", "v", F.xxhash64("v").alias("d1"), F.xxhash64(F.lit(1), "v").alias("d2"))
    return keyed.groupBy("id", "d1", "d2").agg(F.first("v").alias("v"))


def fit(rows: DataFrame, wanted: float = WANTED) -> Model | None:
    """The model from a bounded sample of `usable` rows; None for an empty table."""
    distinct = rows.select("d1", "d2").distinct()
    least = distinct.orderBy("d1", "d2").limit(SAMPLE)
    sample = rows.join(F.broadcast(least), ["d1", "d2"]).groupBy("d1", "d2").agg(F.first("v").alias("v")).orderBy("d1", "d2").select("v").toArrow()  # SAMPLE rows
    if not sample.num_rows:
        return None
    column = sample.column("v").combine_chunks()
    x = _vectors(column, len(column[0]))
    return fit_sample(x, distinct.count(), wanted)


def _with_parts(rows: DataFrame, model: Model, is_query: Column) -> DataFrame:
    """`rows` with `parts`: the own one, and for queries those to probe, most probable first."""
    shared = rows.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scale, layers, _, probes = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _logits(mean, scale, layers, _vectors(batch.column("v"), len(mean)))
            order = np.argsort(-z, axis=1, kind="stable")[:, :probes].astype(np.int32)
            many = np.where(batch.column("query").to_numpy(zero_copy_only=False), probes, 1)
            flat = order[np.arange(probes) < many[:, None]]
            parts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts], names=[*batch.schema.names, "parts"])

    kind = rows.schema["v"].dataType.simpleString()
    return rows.select("id", "d1", "d2", "v", is_query.alias("query")).mapInArrow(run, f"id long, d1 long, d2 long, v {kind}, query boolean, parts array<int>")


def _best(candidates: tuple[np.ndarray, np.ndarray, np.ndarray, bool], q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest candidates, nearest first, ties to smaller ids."""
    ids, c, norms, distinct = candidates
    near = norms - 2 * (c @ q)
    if distinct and len(ids) > k:  # distances by norms are inexact by less than this
        limit = np.partition(near, k - 1)[k - 1] + 1e-11 * (norms.max() + q @ q)
        chosen = np.flatnonzero(near <= limit)
    else:
        chosen = np.arange(len(ids))
    d = np.sqrt(((c[chosen] - q) ** 2).sum(1))
    order = np.lexsort((ids[chosen], d))
    if not distinct:  # the nearest vector of each id
        order = order[np.sort(np.unique(ids[chosen][order], return_index=True)[1])]
    return ids[chosen][order[:k]], d[order[:k]]


def _search(size: int, k: int):
    """Rows come sorted by task, candidates before queries; one block is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            tasks = batch.column("task").to_numpy()
            query = batch.column("query").to_numpy(zero_copy_only=False)
            ids, d1, d2 = (batch.column(c).to_numpy() for c in ("id", "d1", "d2"))
            x = _vectors(batch.column("v"), size)
            edges = np.flatnonzero(np.diff(tasks) | np.diff(query)) + 1
            out: list[list] = [[], [], [], []]
            for a, b in zip(np.append(0, edges), np.append(edges, len(tasks))):
                if tasks[a] != at:
                    at, kept, block = tasks[a], [], None
                if not query[a]:
                    kept.append((ids[a:b], x[a:b]))
                    continue
                if block is None:
                    own = np.concatenate([np.zeros((0, size)), *[v for _, v in kept]])
                    named = np.concatenate([np.zeros(0, np.int64), *[i for i, _ in kept]])
                    block, kept = (named, own, (own * own).sum(1), len(np.unique(named)) == len(named)), []
                for i in range(a, b) if len(block[0]) else ():
                    found, d = _best(block, x[i], k)
                    for part, values in zip(out, (np.full(len(d), d1[i]), np.full(len(d), d2[i]), found, d)):
                        part.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in out], names=["d1", "d2", "id", "score"])

    return run


def search(vectors: DataFrame, k: int, is_query, id_: str = "vec_id", vector: str = "embedding", model: Model | None = None, wanted: float = WANTED) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id fulfils `is_query` (a function of the
    id column) its k nearest others as found."""
    rows = stash(usable(vectors, id_, vector))
    model = fit(rows, wanted) if model is None else model
    if model is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    placed = stash(_with_parts(rows, model, is_query(F.col("id"))))
    # of the ids that share a vector, the k + 1 smallest; `last` is the largest of these
    shared = placed.groupBy("d1", "d2").count().filter(F.col("count") > k + 1).select("d1", "d2")
    nth = F.row_number().over(Window.partitionBy("d1", "d2").orderBy("id"))
    last = placed.select("id", "d1", "d2").join(shared, ["d1", "d2"], "left_semi").withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy("d1", "d2").agg(F.max("id").alias("last"))
    found = placed.join(stash(last), ["d1", "d2"], "left").filter("last IS NULL OR id <= last").withColumn("part", F.col("parts")[0])
    candidates = stash(found.select("id", "d1", "d2", "v", "part"))
    counted = {r["part"]: r["count"] for r in candidates.groupBy("part").count().collect()}  # a row per part
    blocks = F.array(*[F.lit(max(1, -(-counted.get(p, 0) // BLOCK))) for p in range(model.parts)])
    most = F.lit(1 << 40)

    def task(part: Column, block: Column) -> Column:
        return (part.cast("bigint") * most + block).alias("task")

    own = candidates.select(task(F.col("part"), F.pmod(F.xxhash64("id", "d1"), blocks[F.col("part")])), F.lit(False).alias("query"), "id", "d1", "d2", "v")
    asked = placed.filter("query").groupBy("d1", "d2").agg(F.first("v").alias("v"), F.first("parts").alias("parts"))
    sent = asked.select("d1", "d2", "v", F.explode("parts").alias("part"))
    sent = sent.select("d1", "d2", "v", "part", F.explode(F.sequence(F.lit(0), blocks[F.col("part")] - 1)).alias("block"))
    sent = sent.select(task(F.col("part"), F.col("block")), F.lit(True).alias("query"), F.lit(0).cast("bigint").alias("id"), "d1", "d2", "v")
    dealt = own.union(sent).repartition("task").sortWithinPartitions("task", "query")
    hits = dealt.mapInArrow(_search(model.size, k + 1), "d1 long, d2 long, id long, score double")
    # one shuffle for both windows: the nearest vector of each id, then the nearest ids
    near = hits.repartition("d1", "d2").withColumn("of_id", F.row_number().over(Window.partitionBy("d1", "d2", "id").orderBy("score"))).filter("of_id = 1")
    best = near.withColumn("nth", F.row_number().over(Window.partitionBy("d1", "d2").orderBy("score", "id"))).filter(F.col("nth") <= k + 1)
    lists = best.groupBy("d1", "d2").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("near"))  # k + 1 entries
    answered = placed.filter("query").select("id", "d1", "d2").join(lists, ["d1", "d2"])
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    each = answered.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return each.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def report(vectors: DataFrame) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    return search(vectors, 10, lambda id_: F.pmod(id_, F.lit(100)) == 0)
