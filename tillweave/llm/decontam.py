"""Benchmark decontamination with suffix arrays of training shards.

Every run of some megabytes of training text is a shard. Its suffixes that can match at all (they
start with enough consecutive benchmark words) are sorted by their first words; every benchmark
window is binary-searched in that array, which gives all its locations, and windows that continue
each other on one diagonal are joined into the longest verbatim matches. Shards need nothing from
each other, so documents are neither shuffled nor collected; the benchmark travels in blocks of
bounded size, one pass a block.

Defined cases: NULL or wordless text has no words, hits or items; an item without words never
occurs; rows with the same item_id are one item; a NULL item_id is written as an empty string;
repeated documents are judged one by one; an empty benchmark hits nothing. Other columns of the
documents are passed through, also those named like a result, since results come in one struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tillweave.llm.words import ALNUM, Words, fresh, pieces
from tillweave.session import stash

WINDOW = 10
#: Bytes of benchmark text that one pass carries, and of training text in a shard.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 4 << 20

MATCH = T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("doc_word", T.LongType()),
    T.StructField("item_word", T.LongType()), T.StructField("length", T.LongType()),
])
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("matches", T.ArrayType(MATCH)),
])


class Block:
    """The windows of some benchmark items, ready to be searched for."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        self.ids, self.window = ids, window
        w = Words(pa.array(texts, pa.large_string()), True, ALNUM)
        self.vocabulary, code = np.unique(w.hash, return_inverse=True)
        code = (code + 1).astype(">u4")
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k in range(len(ids)):
            own = code[w.first[k] : w.first[k + 1]]
            if size := min(window, len(own)):
                at = np.arange(len(own) - size + 1)
                found.setdefault(size, []).append((own[at[:, None] + np.arange(size)], np.full(len(at), k), at))
        #: by window length: sorted distinct windows, and for each its (item, place) pairs as slices
        self.windows = {}
        for size, parts in found.items():
            rows, item, place = (np.concatenate(x) for x in zip(*parts))
            keys = np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * size}").ravel()  # byte order is word order
            order = np.argsort(keys, kind="stable")
            distinct, first = np.unique(keys[order], return_index=True)
            self.windows[size] = (distinct, rows[order][first].astype(np.int64), np.append(first, len(keys)), item[order], place[order])
        self.least = min(self.windows, default=0)

    @classmethod
    def of(cls, state: dict) -> Block:
        """A block from the plain values that were broadcast; workers need not have this module."""
        out = cls.__new__(cls)
        out.__dict__ = state
        return out

    def search(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word index, item, item's word, window length) of each occurrence of each window."""
        none = (np.zeros(0, np.int64),) * 4
        if not len(w) or not self.least:
            return none
        code = np.searchsorted(self.vocabulary, w.hash)
        code[code == len(self.vocabulary)] = 0
        code = np.where(self.vocabulary[code] == w.hash, code + 1, 0)
        # words up to the next one that is unknown or belongs to another text
        stop = np.zeros(len(w) + 1, bool)
        stop[:-1][code == 0] = True
        stop[w.first] = True
        stops = np.flatnonzero(stop)
        left = stops[np.searchsorted(stops, np.arange(len(w)), "right")] - np.arange(len(w))
        left[code == 0] = 0
        suffix = np.flatnonzero(left >= self.least)
        if not len(suffix):
            return none
        depth = self.window
        spread = np.minimum(suffix[:, None] + np.arange(depth), len(w) - 1)
        first_words = np.where(np.arange(depth) < left[suffix][:, None], code[spread], 0).astype(">u4")
        keys = np.ascontiguousarray(first_words).view(f"S{4 * depth}").ravel()
        order = np.argsort(keys, kind="stable")
        keys, suffix = keys[order], suffix[order]
        present = np.zeros(len(self.vocabulary) + 1, bool)
        present[code[code > 0]] = True
        out = []
        for size, (windows, rows, first, item, place) in self.windows.items():
            can = np.flatnonzero(present[rows].all(axis=1))
            low = np.searchsorted(keys, windows[can], "left")
            # no word has the code 0xFFFFFFFF, so no suffix that starts with the window lies beyond this
            above = np.full((len(can), depth), 0xFFFFFFFF, ">u4")
            above[:, :size] = rows[can]
            high = np.searchsorted(keys, np.ascontiguousarray(above).view(f"S{4 * depth}").ravel(), "right") if len(can) else low
            hit = high > low
            can, low, high = can[hit], low[hit], high[hit]
            if not len(can):
                continue
            n, m = high - low, first[can + 1] - first[can]
            of = np.repeat(np.arange(len(can)), n * m)  # every location with every item of the window
            k = np.arange(len(of)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            at, which = suffix[low[of] + k // m[of]], first[can[of]] + k % m[of]
            out.append((at, item[which], place[which], np.full(len(of), size)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else none


def _runs(at: np.ndarray, item: np.ndarray, place: np.ndarray, size: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Longest matches: windows whose text and item positions advance together are one."""
    order = np.lexsort((at, at - place, item))
    at, item, place, size = (x[order] for x in (at, item, place, size))
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | (at[1:] - place[1:] != at[:-1] - place[:-1]) | (at[1:] > at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return [(int(item[a]), int(at[a]), int(place[a]), int(at[b] + size[b] - at[a])) for a, b in zip(first, last)]


def _scan(batch: pa.RecordBatch, text: str, block: Block) -> list[dict]:
    w = Words(batch.column(text), True, ALNUM)
    at, item, place, size = block.search(w)
    mark = np.zeros(len(w) + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + size, -1)
    covered = np.cumsum(mark)[:-1] > 0
    total = np.append(0, np.cumsum(covered))
    hit = total[w.first[1:]] - total[w.first[:-1]]
    rows = [{"n_words": int(n), "n_hit": int(h), "hits": [], "matches": []} for n, h in zip(w.counts(), hit)]
    order = np.argsort(at, kind="stable")
    doc = np.searchsorted(w.first, at[order], "right") - 1
    bound = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
    for a, b in zip(bound[:-1], bound[1:]):
        own, base = order[a:b], w.first[doc[a]]
        inside = covered[base : w.first[doc[a] + 1]]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], inside, [0]))))
        rows[doc[a]]["hits"] = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])]
        rows[doc[a]]["matches"] = [
            {"item_id": block.ids[i], "doc_word": p - int(base), "item_word": q, "length": n} for i, p, q, n in _runs(at[own], item[own], place[own], size[own])
        ]
    return rows


def _merged(old: dict, new: dict) -> dict:
    """Findings of one text in two blocks of items."""
    spans = sorted((x["start"], x["end"]) for x in [*old["hits"], *new["hits"]])
    hits: list[dict] = []
    for s, e in spans:
        if hits and s <= hits[-1]["end"]:
            hits[-1]["end"] = max(hits[-1]["end"], e)
        else:
            hits.append({"start": s, "end": e})
    return {"n_words": new["n_words"], "n_hit": sum(x["end"] - x["start"] for x in hits), "hits": hits, "matches": [*old["matches"], *new["matches"]]}


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items in blocks of about `block_bytes`, read one at a time. The rows of one item may be
    dealt to several blocks, so an item_id that many rows share makes no block larger."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield Block([r[0] for r in rows], [r[1] for r in rows], window)
    if not n:
        yield Block([], [], window)


def with_findings(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, name: str = "_found", block_bytes: int = BLOCK_BYTES, only_clean: bool = False) -> DataFrame:
    """`docs` with a struct of word counts, hit spans (in words) and longest verbatim matches; a
    taken `name` gets an underscore.

    With `only_clean`, documents with a hit are left out. Blocks beyond the first read the result
    of the one before from the shared folder, and a block is given up once its pass is written, so
    one block is in memory at a time.
    """
    spark, out, name = docs.sparkSession, docs, fresh(docs.columns, name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, FOUND)])
    arrow, shared = to_arrow_schema(schema), None
    for k, block in enumerate(benchmark_blocks(benchmark, window, block_bytes)):
        if shared is not None:
            out = stash(out)
            shared.destroy()
        shared, again = spark.sparkContext.broadcast(block.__dict__), k > 0

        def run(batches: Iterator[pa.RecordBatch], shared=shared, again=again) -> Iterator[pa.RecordBatch]:
            block = Block.of(shared.value)
            for batch in pieces(batches, text, SHARD_BYTES):
                found = _scan(batch, text, block)
                if again:
                    found = [_merged(o, f) for o, f in zip(batch.column(name).to_pylist(), found)]
                keep = pa.array([not (only_clean and f["n_hit"]) for f in found], pa.bool_())
                columns = [batch.column(i).cast(arrow.field(i).type) for i in range(len(arrow) - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, arrow.field(len(arrow) - 1).type)], schema=arrow).filter(keep)

        out = out.mapInArrow(run, schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without a benchmark window, columns unchanged."""
    name = fresh(docs.columns, "_found")
    return with_findings(docs, benchmark, text, window, name, only_clean=True).drop(name)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, hit words, items that occur and their digest."""
    found = with_findings(docs.select("doc_id", "text"), benchmark, window=window).drop("text")
    items = F.array_sort(F.array_distinct(F.transform("_found.matches", lambda m: m["item_id"])))
    return found.select(
        "doc_id", F.col("_found.n_words").alias("n_words"), F.col("_found.n_hit").alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.col("_found.n_hit") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("_found.matches", lambda m: m["length"])), F.lit(0)).cast("bigint").alias("longest"),
    )


_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' +'), lambda x: x <> '')"
REPORT_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT item, i AS at, least(len(ws), {WINDOW}) AS size, ws[i:i + least(len(ws), {WINDOW}) - 1] AS w FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, i, s.size, ws[i:i + s.size - 1] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) x, (SELECT DISTINCT size FROM bw) s WHERE i + s.size - 1 <= len(ws)),
hit AS (SELECT dw.doc_id, dw.i, dw.size, bw.item, dw.i - bw.at AS diagonal FROM dw JOIN bw ON bw.w = dw.w),
word AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY doc_id),
run AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, diagonal, size ORDER BY i) AS g FROM (SELECT DISTINCT * FROM hit)),
long AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, max(i) - min(i) + size AS n FROM run GROUP BY doc_id, item, diagonal, size, g) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item COLLATE "C") AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(word.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(item.n, 0) AS BIGINT) AS n_items, sha256(coalesce(item.items, '')) AS items_sha256,
  coalesce(word.n, 0) > 0 AS contaminated, CAST(coalesce(long.longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN word ON word.doc_id = d.doc_id LEFT JOIN item ON item.doc_id = d.doc_id LEFT JOIN long ON long.doc_id = d.doc_id
"""
