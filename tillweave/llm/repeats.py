"""Repeated passages: super-k-mers of words in minimiser buckets, windows counted by sorting.

Consecutive windows of `WINDOW` words that share a minimiser (the least hash of the `MINIMISER`-word
pieces inside the window) form one super-k-mer.

1. Each document yields a small row per super-k-mer: minimiser, place, number of windows. A
   minimiser that only one document has cannot belong to a repeated window; its super-k-mers stop
   here, before any text has moved.
2. The others travel, each as one packed string of words, to the bucket of their minimiser. Within
   a bucket all windows are sorted by content, then document; a window is repeated when its
   content also starts in a smaller document.
3. A minimiser with more than `BUCKET` super-k-mers is salted over several buckets. There the least
   document of each window content is passed on, and those few rows are compared across the salts
   of the minimiser in a second, pre-aggregated step. Nothing is capped.
4. The words covered by repeated windows are removed. A repeated window is found on the input, not on
   what is left.

Window contents are compared by 128-bit digests of their words.

Defined cases: NULL or wordless texts and texts of fewer than `WINDOW` words lose nothing; a window
repeated only within one document stays, as do repeats between rows of one doc_id; rows with a NULL
doc_id neither remove nor are removed from; an empty table gives no rows; the kept words are joined
by one space, so no words give the digest of the empty string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tillweave.llm.words import NOT_SPACE, Words, mix, pieces
from tillweave.session import stash

WINDOW, MINIMISER = 50, 10
BUCKET = 512  # super-k-mers of one minimiser that are sorted together
PIECE = 4 << 20
_OTHER = np.uint64(0x632BE59BD9B4E019)


def super_kmers(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, number of windows, minimiser) of every super-k-mer of a batch."""
    n = len(w) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    least = np.full(len(w), np.iinfo(np.uint64).max, np.uint64)
    at, h = w.windows(MINIMISER)
    least[at] = h
    span, width = WINDOW - MINIMISER + 1, 1
    while width < span:  # minimum over `span` neighbours, by doubling
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    last = np.repeat(w.first[1:], w.counts())
    start = np.flatnonzero(np.arange(len(w)) + WINDOW <= last)
    value, owner = least[start], w.owner()[start]
    new = np.ones(len(start), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    return owner[first], start[first] - w.first[owner[first]], count, value[first].view(np.int64)


PLACES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("tag", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("n", T.ShortType()), T.StructField("mini", T.LongType()),
])
PACKED = T.StructType([
    T.StructField("bucket", T.LongType()), T.StructField("mini", T.LongType()), T.StructField("salted", T.BooleanType()), T.StructField("doc_id", T.LongType()),
    T.StructField("tag", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("words", T.StringType()),
])
FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("tag", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("n", T.IntegerType()),
    T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(PLACES)
    for batch in pieces(batches, "text", PIECE):
        text, first, n, mini = super_kmers(Words(batch.column("text"), False, NOT_SPACE))
        # a run within one low-entropy passage may be long; more than a short holds is cut
        while len(n) and n.max() > 30_000:
            long = n > 30_000
            text, mini = np.append(text, text[long]), np.append(mini, mini[long])
            first, n = np.append(first, first[long] + 30_000), np.append(np.where(long, 30_000, n), n[long] - 30_000)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(text)), batch.column("tag").take(pa.array(text)), pa.array(first, pa.int32()), pa.array(n, pa.int16()), pa.array(mini, pa.int64())], schema=arrow
        )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted super-k-mers of each document, as strings of words."""
    arrow = to_arrow_schema(PACKED)
    for batch in pieces(batches, "text", PIECE):
        rows: list[tuple] = []
        for doc, tag, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text", "wanted"))):
            words = text.encode().split()
            rows += [(x["bucket"], x["mini"], x["salted"], doc, tag, x["first"], b" ".join(words[x["first"] : x["first"] + x["n"] + WINDOW - 1]).decode()) for x in wanted]
            if len(rows) >= 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def _sorted_windows(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """All windows of some super-k-mers: digests, document, tag, place, salted."""
    w = Words(pa.array([r[3] for r in rows], pa.string()), False, NOT_SPACE)
    at, h1 = w.windows(WINDOW)
    w.hash = mix(w.hash ^ _OTHER)
    h2 = w.windows(WINDOW)[1]
    own = np.searchsorted(w.first, at, "right") - 1
    doc, tag, first, salted = (np.array([r[k] for r in rows], np.int64)[own] for k in (0, 1, 2, 4))
    place = first + at - w.first[own]
    order = np.lexsort((place, tag, doc, h2, h1))
    return tuple(x[order] for x in (h1, h2, doc, tag, place, salted))


def _runs(doc: np.ndarray, tag: np.ndarray, place: np.ndarray) -> list[tuple]:
    """Repeated windows as stretches of covered words: (doc, tag, first word, words)."""
    order = np.lexsort((place, tag, doc))
    doc, tag, place = doc[order], tag[order], place[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (place[1:] > place[:-1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(doc)) - 1
    return [(int(doc[i]), int(tag[i]), int(place[i]), int(place[j] - place[i]) + WINDOW, None, None) for i, j in zip(a, b)]


def _sort_buckets(rows: list[tuple]) -> list[tuple]:
    """Whole buckets of super-k-mers (doc, tag, first, words, salted), sorted together: windows of
    equal content have equal minimisers, so buckets cannot disturb each other."""
    h1, h2, doc, tag, place, salted = _sorted_windows(rows)
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    again = doc > least
    out = _runs(doc[again], tag[again], place[again]) if again.any() else []
    rest = ~again & (salted > 0)
    out += [(int(d), int(t), int(p), 0, a, b) for d, t, p, a, b in zip(doc[rest], tag[rest], place[rest], h1[rest].view(np.int64).tolist(), h2[rest].view(np.int64).tolist())]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows arrive sorted by bucket; full buckets are sorted together, some at a time."""
    arrow = to_arrow_schema(FOUND)
    at, held = None, []

    def emit() -> Iterator[pa.RecordBatch]:
        if out := _sort_buckets(held) if held else []:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    for batch in batches:
        for bucket, _, salted, doc, tag, first, words in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != at and len(held) >= BUCKET:
                yield from emit()
                held = []
            at = bucket
            held.append((doc, tag, first, words, salted))
    yield from emit()


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stretches of words to remove (doc_id, tag of the text, first, n), and the texts of all
    documents that share a minimiser with another (doc_id, tag, text), which may have such stretches.

    `docs` has doc_id, text and tag.
    """
    texts = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    places = texts.mapInArrow(_places, PLACES)
    minis = places.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("k")).filter("lo < hi")
    salts = F.ceil(F.col("k") / BUCKET).cast("bigint")
    wanted = places.join(minis.select("mini", salts.alias("salts")), "mini")
    salted = F.col("salts") > 1
    bucket = F.when(salted, F.xxhash64("mini", F.pmod(F.xxhash64("doc_id"), F.col("salts")))).otherwise(F.col("mini"))
    per_doc = wanted.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("first", "n", "mini", bucket.alias("bucket"), salted.alias("salted"))).alias("wanted"))
    shared = stash(texts.join(per_doc, ["doc_id", "tag"]))
    packed = shared.mapInArrow(_pack, PACKED)
    found = stash(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count, FOUND))
    firsts = found.filter("n = 0")
    least = firsts.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    across = firsts.join(least, ["h1", "h2"]).filter("doc_id > lo").select("doc_id", "tag", "first", F.lit(WINDOW).alias("n"))
    return found.filter("n > 0").select("doc_id", "tag", "first", "n").union(across), shared.select("doc_id", "tag", "text")


CLEANED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("tag", T.IntegerType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()),
])


def _cleaned(digest_only: bool):
    """Cuts the words given in a column `cuts` (none where there is no such column)."""
    arrow = to_arrow_schema(CLEANED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            rows = []
            stretches = batch.column("cuts").to_pylist() if "cuts" in batch.schema.names else [None] * batch.num_rows
            for doc, tag, text, cuts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text")), stretches):
                words = (text or "").encode().split()
                total = len(words)
                if cuts:
                    mark = np.zeros(total + 1, np.int64)
                    np.add.at(mark, [c["first"] for c in cuts], 1)
                    np.add.at(mark, [c["first"] + c["n"] for c in cuts], -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(mark)[:-1] == 0)]
                kept = b" ".join(words)
                rows.append((doc, tag, total, total - len(words), hashlib.sha256(kept).hexdigest() if digest_only else kept.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return run


def without_repeats(docs: DataFrame, digest_only: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (or only their SHA-256) of every row.

    Texts are cut only where something may be cut; for the digests of the others no text moves.
    """
    tagged = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.hash("text").alias("tag"))
    stretches, texts = repeated(tagged)
    cuts = stretches.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("first", "n")).alias("cuts"))
    changed = texts.join(cuts, ["doc_id", "tag"]).mapInArrow(_cleaned(digest_only), CLEANED).dropDuplicates(["doc_id", "tag"])
    changed = changed.select("doc_id", "tag", F.col("n_removed").alias("_removed"), F.col("kept").alias("_kept"))
    whole = tagged.mapInArrow(_cleaned(digest_only), CLEANED)
    out = whole.join(changed, ["doc_id", "tag"], "left")
    return out.select("doc_id", "n_words", F.coalesce("_removed", "n_removed").alias("n_removed"), F.coalesce("_kept", "kept").alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: words, removed words, digest of what is kept."""
    return without_repeats(docs, digest_only=True).withColumnRenamed("kept", "kept_sha256")


REPORT_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
place AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW}),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS h FROM place),
cut AS (SELECT DISTINCT w.doc_id, w.i + o.o AS k FROM win w JOIN (SELECT h, min(doc_id) AS least FROM win GROUP BY h) f ON f.h = w.h AND f.least < w.doc_id, (SELECT unnest(range(0, {WINDOW})) AS o) o),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM d),
kept AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.k) AS text, count(*) AS n FROM word w ANTI JOIN cut c ON c.doc_id = w.doc_id AND c.k = w.k GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(len(d.ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
