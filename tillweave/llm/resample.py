"""Importance resampling towards a target distribution, with n-grams interned per batch.

Texts are reduced to runs of lower-case words, hashed into buckets (CRC-32 modulo the number of
buckets). With s and S the counts of a bucket and of all in the documents, t and T those in the
target texts, a bucket's gain is floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))). A document's
weight is the floored mean of its features' gains; Gumbel noise seeded by its id is added, and the
documents with the highest scores are drawn, which samples without replacement.

Two passes over the texts, both in Arrow batches without a shuffle of texts. In each, the n-grams
of a batch are interned in an open-addressed NumPy table: the key is the xxhash64 of an n-gram's
bytes, probing is linear, and an occurrence joins a slot only if its bytes equal those of the
slot's first occurrence, so nothing rests on the hash. A slot holds its bucket and its count: the
CRC is computed once per distinct n-gram of the batch. The first pass adds the slots' counts to its
task's buckets, of which one row each leaves the task; in the second the slot ids of all
occurrences gather the gains. The gains are broadcast: as many numbers as there are buckets.

Ranks come from a range shuffle of (score, doc_id) rows without texts.

Defined cases: NULL and wordless texts have no features, weight 0 and rank NULL; a NULL doc_id is
hashed as an empty text and comes last among equal scores; repeated rows are drawn each for
themselves and have ranks of their own; empty target or document tables count as 0; with nothing
to draw all ranks are NULL. Other columns are kept, taken names get an underscore.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tillweave.llm.mixing import running
from tillweave.llm.words import ALNUM, fresh, pieces
from tillweave.operators.scalars import beside
from tillweave.session import stash

LONGEST, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
BATCH_BYTES = 2 << 20  # of text that is interned at once

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxhash64(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """xxHash64 (seed 0) of the spans of `raw`, which has eight spare bytes at its end."""
    eight, four = (np.ndarray((len(raw) - 7,), kind, raw, 0, (1,)) for kind in ("<u8", "<u4"))
    h = _P5 + length.astype(np.uint64)
    at, left = start.copy(), length.copy()
    todo = np.flatnonzero((left >= 8) & (length < 32))
    while len(todo):
        lane = _turned(eight[at[todo]] * _P2, 31) * _P1
        h[todo] = _turned(h[todo] ^ lane, 27) * _P1 + _P4
        at[todo] += 8
        left[todo] -= 8
        todo = todo[left[todo] >= 8]
    todo = np.flatnonzero((left >= 4) & (length < 32))
    h[todo] = _turned(h[todo] ^ (four[at[todo]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at[todo] += 4
    left[todo] -= 4
    todo = np.flatnonzero((left >= 1) & (length < 32))
    while len(todo):
        h[todo] = _turned(h[todo] ^ (raw[at[todo]].astype(np.uint64) * _P5), 11) * _P1
        at[todo] += 1
        left[todo] -= 1
        todo = todo[left[todo] >= 1]
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(length >= 32):  # at least 32 bytes of work per call
        h[k] = xxhash.xxh64_intdigest(memoryview(raw[start[k] : start[k] + length[k]]))
    return h


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans of `length` bytes at a and at b hold the same bytes."""
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    same = np.ones(len(a), bool)
    for k in np.flatnonzero(length >= 64):
        same[k] = np.array_equal(raw[a[k] : a[k] + length[k]], raw[b[k] : b[k] + length[k]])
    todo, done = np.flatnonzero((length > 0) & (length < 64)), 0
    while len(todo):
        spare = np.uint64(8) * np.maximum(8 - (length[todo] - done), 0).astype(np.uint64)  # bits beyond the span
        differ = (eight[a[todo] + done] ^ eight[b[todo] + done]) << spare
        same[todo[differ != 0]] = False
        done += 8
        todo = todo[(differ == 0) & (length[todo] > done)]
    return same


class Interned:
    """The n-grams of a batch of texts in an open-addressed table.

    `slot` is the slot of each occurrence, text by text; `first` bounds the occurrences of a text;
    `n_words` counts words. Slots hold `bucket` and `count`; `used` lists the filled ones.
    """

    def __init__(self, texts: list[str | None], longest: int = LONGEST, buckets: int = BUCKETS):
        raw, start, end, words = _compact(texts)
        self.n_words = np.diff(words)
        begins, ends, owners = [], [], []
        of = np.repeat(np.arange(len(texts)), self.n_words)
        for n in range(1, longest + 1):  # words of one text lie side by side, one space between
            whole = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :]) if len(of) >= n else np.zeros(0, np.int64)
            begins.append(start[whole])
            ends.append(end[whole + n - 1])
            owners.append(of[whole])
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable") if longest > 1 else slice(None)
        self.start, owner = np.concatenate(begins)[order], owner[order]
        self.length = np.concatenate(ends)[order] - self.start
        self.first = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.slot = self._insert(raw, xxhash64(raw, self.start, self.length))
        self.used = np.flatnonzero(self.keeper >= 0)
        self.count = np.bincount(self.slot, minlength=len(self.keeper))
        self.bucket = np.zeros(len(self.keeper), np.int64)
        data = raw.tobytes()
        heads = self.keeper[self.used]
        spans = zip(self.start[heads].tolist(), (self.start + self.length)[heads].tolist())
        self.bucket[self.used] = [zlib.crc32(data[a:b]) % buckets for a, b in spans]

    def _insert(self, raw: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Slots of all occurrences; `keeper` becomes the occurrence that holds each slot, or -1."""
        size = 1 << max(4, (2 * len(key)).bit_length())  # at most half full
        self.keeper = np.full(size, -1, np.int64)
        slot = (key & np.uint64(size - 1)).astype(np.int64)
        todo = np.arange(len(key))
        while len(todo):
            at = slot[todo]
            free = self.keeper[at] < 0
            self.keeper[at[free]] = todo[free]  # several may want a slot; one gets it
            head = self.keeper[at]
            same = (key[head] == key[todo]) & (self.length[head] == self.length[todo])
            maybe = np.flatnonzero(same)
            same[maybe] = _equal(raw, self.start[head[maybe]], self.start[todo[maybe]], self.length[todo[maybe]])
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & (size - 1)
        return slot

    def bucket_counts(self, buckets: int) -> np.ndarray:
        return np.bincount(self.bucket[self.used], self.count[self.used], buckets).astype(np.int64)

    def n_features(self) -> np.ndarray:
        return np.diff(self.first)

    def weights(self, gains: np.ndarray) -> np.ndarray:
        """Per text the floored mean of its occurrences' gains; 0 without any."""
        total = np.append(0, np.cumsum(gains[self.bucket][self.slot]))
        n = self.n_features()
        return (total[self.first[1:]] - total[self.first[:-1]]) // np.maximum(n, 1)


def _compact(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words with one byte after each, their start and end there, and the first word of
    each text; eight spare bytes at the end."""
    parts = [(t or "").encode() + b" " for t in texts]
    raw = _LOWER[np.frombuffer(b"".join(parts), np.uint8)]
    bounds = np.cumsum([0, *map(len, parts)])
    word = ALNUM[raw]
    before = np.append(False, word[:-1])
    keep = word | before  # words, and the first byte after each
    place = np.cumsum(keep) - keep
    begin, stop = np.flatnonzero(word & ~before), np.flatnonzero(~word & before)
    out = np.zeros(int(keep.sum()) + 8, np.uint8)
    out[: len(out) - 8] = np.where(word, raw, 0x20)[keep]
    return out, place[begin], place[stop], np.searchsorted(begin, bounds)


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts, one row per bucket that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in pieces(batches, text, BATCH_BYTES):
            total += Interned(batch.column(text).to_pylist(), longest, buckets).bucket_counts(buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return texts.select(F.col(text)).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket; `buckets` rows reach the driver."""
    counted = [bucket_counts(df, text, longest, buckets).withColumn("of", F.lit(k)) for k, df in enumerate((source, target))]
    s, t = np.zeros((2, buckets))
    for bucket, n, of in counted[0].union(counted[1]).collect():
        (t if of else s)[bucket] = n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def with_weights(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, name: str = "_weighed", keep_text: bool = True) -> DataFrame:
    """`docs` with a struct `name` of n_words, n_features and weight; without `keep_text` the text
    does not travel on."""
    name = fresh(docs.columns, name)
    shared = docs.sparkSession.sparkContext.broadcast(bucket_gains(docs, target, text, longest, buckets))
    made = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])
    schema = T.StructType([*[f for f in docs.schema.fields if keep_text or f.name != text], T.StructField(name, made)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, BATCH_BYTES):
            found = Interned(batch.column(text).to_pylist(), longest, buckets)
            values = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (found.n_words, found.n_features(), found.weights(shared.value))], fields=list(arrow.field(len(arrow) - 1).type))
            columns = [batch.column(i) for i, c in enumerate(batch.schema.names) if keep_text or c != text]
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(columns, arrow)], values], schema=arrow)

    return docs.mapInArrow(run, schema)


def _scored(weighed: DataFrame, name: str, least_words: int, seed: int, extra: list[str]) -> DataFrame:
    fit = (F.col(f"{name}.n_words") >= least_words).alias("fit")
    score = (F.col(f"{name}.weight") + noise(F.col("doc_id"), seed)).alias("score")
    return weighed.select(*extra, F.col("doc_id").cast("bigint").alias("doc_id"), f"{name}.n_features", f"{name}.weight", score, fit)


def _places(scored: DataFrame) -> DataFrame:
    """`scored` with `place`, from 0 and those that fit first, and `able`, how many fit."""
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")]
    placed = running(scored, order, {}, "place")
    return beside(placed, placed.agg(F.count_if("fit").alias("able")))


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; those drawn have a rank."""
    weighed = with_weights(docs.select("doc_id", "text"), target, longest=longest, buckets=buckets, keep_text=False)
    scored = stash(_scored(weighed, weighed.columns[-1], least_words, seed, []))  # the range shuffle reads it twice
    rank = F.when(F.col("place") < F.floor(F.lit(percent) * F.col("able") / 100), F.col("place") + 1).cast("bigint")
    return _places(scored).select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """The drawn documents, columns unchanged. Rows like the last drawn one (same doc_id, score,
    weight and features) are drawn with it."""
    weighed = stash(with_weights(docs, target, longest=longest, buckets=buckets))
    name = weighed.columns[-1]
    placed = _places(_scored(weighed, name, least_words, seed, []))
    last = placed.filter(F.col("place") == F.floor(F.lit(percent) * F.col("able") / 100) - 1).first()
    if last is None:
        return docs.limit(0)
    id_ = F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))
    key = F.struct(-(F.col(f"{name}.weight") + noise(F.col("doc_id"), seed)), id_, F.col("doc_id").isNull(), F.col(f"{name}.weight"), F.col(f"{name}.n_features"))
    end = F.struct(F.lit(-last.score).cast("bigint"), F.lit((1 << 63) - 1 if last.doc_id is None else last.doc_id).cast("bigint"), F.lit(last.doc_id is None), F.lit(last.weight).cast("bigint"), F.lit(last.n_features).cast("bigint"))
    return weighed.filter((F.col(f"{name}.n_words") >= least_words) & (key <= end)).drop(name)


_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' +'), lambda x: x <> '')"
REPORT_SQL = f"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY doc_id, w),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY w),
v AS (SELECT w, hex(w) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
c AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS b FROM v, t),
s AS (SELECT b, sum(n) AS n FROM dw JOIN c USING (w) GROUP BY b), q AS (SELECT b, sum(n) AS n FROM bw JOIN c USING (w) GROUP BY b),
total AS (SELECT CAST(coalesce((SELECT sum(n) FROM s), 0) AS DOUBLE) AS s, CAST(coalesce((SELECT sum(n) FROM q), 0) AS DOUBLE) AS t),
g AS (SELECT s.b, CAST(floor(1000 * ln((CAST(coalesce(q.n, 0) AS DOUBLE) + 1) * (total.s + {BUCKETS}) / ((CAST(s.n AS DOUBLE) + 1) * (total.t + {BUCKETS})))) AS BIGINT) AS gain FROM s LEFT JOIN q USING (b), total),
f AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM dw JOIN c USING (w) JOIN g USING (b) GROUP BY doc_id),
r AS (SELECT d.doc_id, coalesce(f.n, 0) AS n_features, coalesce(f.weight, 0) AS weight,
  coalesce(f.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN f USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS able FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= {PERCENT} * able // 100 THEN place END AS rank FROM k
"""
