"""Near-duplicates: many universal hash minima with banding, links confirmed on full sets,
components by alternating large-star and small-star.

1. Each text's set of five-word shingles (64-bit hashes) gives its size, a digest and band values of
   a few minima each, as many as the threshold needs. Texts with equal sets become one representative.
2. Representatives that share a band value form a bucket. Buckets with the same members are kept
   once. A pair at the threshold shares no bucket with a chance below `MISS`.
3. The sets of bucket members travel to their buckets, where the signatures screen pairs and the
   full sets confirm them. Only a spanning forest of the confirmed links leaves a bucket, not its
   pairs. A bucket with more shingles than `BLOCK` is split into blocks, every two of which meet
   in one task; nothing is dropped, and no task holds more than two blocks.
4. Large-star and small-star rounds over those links give the components.

Defined cases: texts without words have an empty set and link with nothing; a text of one to four
words is one shingle; a NULL doc_id links with nothing, has a NULL component and is kept; rows of
one doc_id with different texts are linked by their texts; `deduplicate` judges these texts apart,
and keeps one of rows that repeat a doc_id and its text; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tillweave.llm.words import NOT_SPACE, Words, fresh, mix, pieces
from tillweave.session import stash

SHINGLE, PERCENT = 5, 85
MISS = 1e-5  # chance that a pair at the threshold shares no band
MOST_ROWS, MOST_BANDS = 5, 24
PIECE = 4 << 20
BLOCK = 1 << 16  # shingles of one block of a bucket


class Banding(NamedTuple):
    bands: int
    rows: int
    screen: int  # equal minima that a linked pair has, seven standard errors below the threshold


@cache
def banding(percent: int) -> Banding:
    """The most rows a band that miss few enough pairs of this similarity: 20 x 5 at 85, 22 x 4 at 80."""
    p = percent / 100
    for rows in range(MOST_ROWS, 0, -1):
        bands = max(1, math.ceil(math.log(MISS) / math.log(max(1e-300, 1 - p**rows))))
        if bands <= MOST_BANDS:
            break
    n = bands * rows
    return Banding(bands, rows, max(0, math.floor(n * p - 7 * math.sqrt(n * p * (1 - p)))))


@cache
def _seeds(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, (2, n), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a batch, by text, and the bounds of each text's."""
    at, h = w.windows(size)
    counts = w.counts()
    cut = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.maximum(counts - size + 1, 0), out=cut[1:])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = []
        for k in short:
            value = np.uint64(counts[k])
            for x in w.hash[w.first[k] : w.first[k + 1]]:
                value = mix(np.array([value ^ x]))[0]
            whole.append(value)
        h = np.insert(h, cut[short], whole)
        more = np.zeros(len(counts), np.int64)
        more[short] = 1
        cut[1:] += np.cumsum(more)
    return h, cut


def minima(h: np.ndarray, cut: np.ndarray, n: int) -> np.ndarray:
    """Signatures (a row a text, `n` minima each) of texts with at least one shingle."""
    out, seeds = np.empty((len(cut) - 1, n), np.uint64), _seeds(n)
    for k in range(n):
        out[:, k] = np.minimum.reduceat(h * seeds[0, k] + seeds[1, k], cut[:-1])
    return out


def _bands(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signature), bands), np.uint64)
    for k in range(rows):
        out = mix(out * np.uint64(3) + signature[:, k::rows])
    return mix(out + np.arange(bands, dtype=np.uint64))


SETS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
])
MEMBERS = T.StructType([T.StructField("task", T.LongType()), T.StructField("rep", T.LongType()), T.StructField("set", T.BinaryType())])
LINKS = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def _unique(h: np.ndarray, cut: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    sets = [np.unique(h[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    n = np.array([len(s) for s in sets], np.int64)
    d1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    d2 = np.array([mix(s + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    return sets, n, d1, d2


def _describe(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, (bands, rows, _) = to_arrow_schema(SETS), banding(percent)
        for batch in pieces(batches, "text", PIECE):
            h, cut = shingles(Words(batch.column("text"), True, NOT_SPACE))
            _, n, d1, d2 = _unique(h, cut)
            some = np.flatnonzero(n)
            values = _bands(minima(h, np.append(cut[:-1][some], len(h)), bands * rows), bands, rows) if len(some) else np.zeros((0, bands), np.uint64)
            offsets = np.zeros(len(n) + 1, np.int32)
            offsets[1:] = np.cumsum(np.where(n > 0, bands, 0))
            lists = pa.ListArray.from_arrays(offsets, pa.array(values.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(d1), pa.array(d2), lists.cast(arrow.field(4).type)], schema=arrow)

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each task that a representative takes part in, with its set."""
    arrow = to_arrow_schema(MEMBERS)
    for batch in pieces(batches, "text", PIECE):
        h, cut = shingles(Words(batch.column("text"), True, NOT_SPACE))
        sets, _, d1, _ = _unique(h, cut)
        want, tasks, ids = batch.column("d1").to_pylist(), batch.column("tasks").to_pylist(), batch.column("doc_id").to_pylist()
        rows, size = [], 0
        for k, s in enumerate(sets):
            if d1[k] != want[k]:
                continue  # another text of a repeated doc_id
            body = s.tobytes()
            for t in tasks[k]:
                rows.append((t, ids[k], body))
                size += len(body)
            if size > PIECE:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)


def link(ids: list[int], sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links between these sets: (id, least id of its component here)."""
    order = np.argsort(np.array(ids), kind="stable")
    ids, sets = [ids[k] for k in order], [sets[k] for k in order]
    n = np.array([len(s) for s in sets], np.int64)
    k = len(ids)
    label = np.arange(k)
    joined = np.concatenate(sets)
    values, code = np.unique(joined, return_inverse=True)
    shared = np.bincount(code) > 1
    owner = np.repeat(np.arange(k), n)
    use = shared[code]
    column = (np.cumsum(shared) - 1)[code[use]]
    owner, width = owner[use], int(shared.sum())
    cut = np.searchsorted(owner, np.arange(k + 1))
    bands, per_band, screen = banding(percent)
    signature = minima(joined, np.append(0, np.cumsum(n)), bands * per_band) if k > 2 else None

    def common(rows: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of some sets with all sets, from slices of the shared shingles."""
        out = np.zeros((len(rows), k), np.float32)
        for lo in range(0, width, 2048):
            inside = (column >= lo) & (column < lo + 2048)
            table = np.zeros((k, min(2048, width - lo)), np.float32)
            table[owner[inside], column[inside] - lo] = 1
            out += table[rows] @ table.T
        return out

    def join(row: int, near: np.ndarray) -> None:
        old = np.unique(label[np.append(near, row)])
        if len(old) > 1:
            label[np.isin(label, old)] = old[0]

    def confirmed(rows: np.ndarray) -> None:
        both = common(rows).astype(np.int64)
        linked = (100 * both >= percent * (n[rows][:, None] + n[None, :] - both)) & (both > 0)
        for r, row in zip(rows, linked):
            join(int(r), np.flatnonzero(row))

    if not width:
        return []
    rest = np.arange(k)
    if k > 32:
        # the member whose signature is the most common one first: what links with it needs no
        # comparison with the others that do
        votes = np.zeros(k)
        for c in range(signature.shape[1]):
            _, inverse, count = np.unique(signature[:, c], return_inverse=True, return_counts=True)
            votes += count[inverse]
        first = int(np.argmax(votes))
        confirmed(np.array([first]))
        rest = np.flatnonzero(label != label[first])
    for lo in range(0, len(rest), 64):
        rows = rest[lo : lo + 64]
        if signature is not None:
            alike = np.zeros((len(rows), k), np.int32)
            for c in range(signature.shape[1]):
                alike += signature[rows, c][:, None] == signature[None, :, c]
            rows = rows[(alike >= screen).sum(axis=1) > 1]  # itself is one
        if len(rows):
            confirmed(rows)
    return [(ids[i], ids[label[i]]) for i in range(k) if label[i] != i]


def _link_tasks(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Members arrive sorted by task; one task's members are held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(LINKS)
        at, ids, sets, found = None, [], [], []
        for batch in batches:
            for task, rep, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if task != at:
                    found += link(ids, sets, percent) if len(ids) > 1 else []
                    at, ids, sets = task, [], []
                ids.append(rep)
                sets.append(np.frombuffer(body, np.uint64))
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], schema=arrow)
                found = []
        found += link(ids, sets, percent) if len(ids) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], schema=arrow)

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of a link (u, v).

    Large-star: a node's larger neighbours take the least node known to it. Small-star: its smaller
    neighbours and itself do. Both aggregate before they join, and a node with very many links is a
    skewed join key with one row on the other side. Rounds end when the links stay as they are.
    """
    edges = stash(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        state = mark
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(down.select("u", F.col("m").alias("v"))).distinct()
        edges = stash(small)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select("v", "v").distinct())


def with_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; texts link at `percent` of Jaccard similarity."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sets = stash(texts.mapInArrow(_describe(percent), SETS))
    reps = sets.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("d1", "d2", "n").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("rep"))
    reps = stash(reps)
    banded = reps.select("rep", "d1", "n", F.explode("bands").alias("bucket"))
    buckets = (
        banded.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who")).filter("k > 1")
        .groupBy("who", "k", "total").agg(F.min("bucket").alias("bucket"))
    )
    blocks = F.ceil(F.col("total") / BLOCK).cast("bigint")
    member = banded.join(buckets.select("bucket", blocks.alias("blocks")), "bucket").withColumn("own", F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")))
    pair = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda j: F.xxhash64("bucket", F.least(j, F.col("own")), F.greatest(j, F.col("own"))))
    wanted = member.select("rep", "d1", pair.alias("tasks")).groupBy("rep", "d1").agg(F.flatten(F.collect_list("tasks")).alias("tasks"))
    found = texts.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id").mapInArrow(_members, MEMBERS)
    links = found.repartition("task").sortWithinPartitions("task").mapInArrow(_link_tasks(percent), LINKS)
    reached = components(links).withColumnRenamed("node", "rep")
    of_rep = reps.select("d1", "d2", "n", "rep").join(reached, "rep", "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("_c"))
    out = sets.join(of_rep, ["d1", "d2", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "d1", "d2")


def report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: set size, component, and whether it is the one that stays."""
    out = with_components(docs, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component, the one with the smallest doc_id, columns unchanged; rows with a
    NULL doc_id stay.

    Here a row is what its doc_id and text make it: two texts of one doc_id are judged by what each
    links with, and of rows with equal doc_id and text one stays.
    """
    row, nth = fresh(docs.columns, "_row"), fresh(docs.columns, "_nth")
    keyed = docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    known = keyed.filter(F.col(row).isNotNull())
    classes = with_components(known.select(F.col(row).alias("doc_id"), "text"), percent).select(F.col("doc_id").alias(row), "component_id")
    least = known.select(row, "doc_id").join(classes.distinct(), row).groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("least"))
    stay = known.join(stash(least.select(F.col("least")[row].alias(row))), row, "left_semi")
    first = stay.withColumn(nth, F.row_number().over(Window.partitionBy(row).orderBy(F.lit(1)))).filter(F.col(nth) == 1)
    return first.drop(row, nth).unionByName(keyed.filter(F.col(row).isNull()).drop(row))
