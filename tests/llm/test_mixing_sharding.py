import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tillweave.llm import mixing, sharding


def sizes(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shares(rows):
    """Targets by repeated sharing of the excess."""
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += sizes(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), float(sum(total.values())), set(order)
    while left > 1e-9 and free:
        unit = left / sum(weight[s] for s in free)
        for s in free:
            target[s] += unit * weight[s]
        left = 0.0
        for s in list(free):
            if target[s] >= 3 * total[s]:
                left += target[s] - 3 * total[s]
                target[s] = 3.0 * total[s]
                free.discard(s)
    return total, target


def test_targets_and_sizes(table):
    docs = table("documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    total, target = shares(rows)
    got = mixing.report(docs).collect()
    source = {d: s for d, _, s in rows}
    text = {d: t for d, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r.size == sizes(text[r.doc_id]) and r.source_size == total[s] and abs(r.target - target[s]) < 1e-6
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.report(docs.repartition(5)).collect()))


def test_small_sources_are_capped_and_the_mix_comes_near(make):
    rows = [(k, "a b c d", "a" if k < 5 else "b" if k < 2000 else "c" if k < 3000 else None) for k in range(3200)]
    total, target = shares([(d, t, s) for d, t, s in rows])
    docs = make(rows)
    got = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.sum(F.lit(4)).alias("n")).collect()}
    assert target["a"] == 3 * total["a"] == got["a"]
    for s in ("b", "c", None):
        assert abs(got[s] - target[s]) < 0.12 * target[s]
    assert mixing.mix(docs).columns == docs.columns


def test_hostile_rows(hostile):
    docs, rows = hostile
    out = mixing.mixture(docs.withColumnRenamed("n_words", "rate"), mixing.document_key(docs))
    assert out.count() == len(rows) and out.columns[-1] == "_mix"
    assert all(r._mix.copies == 0 for r in out.filter("_mix.size = 0").filter("_mix.source_size = 0").collect())
    assert mixing.report(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_shards_are_contiguous_balanced_and_gapless(table):
    docs = table("documents")
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = sharding.report(docs).collect()
    assert len(got) == len(text)
    shards, most = defaultdict(list), 0
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id]) + 8, zlib.crc32(text[r.doc_id]), "bytes", None)
        shards[r.shard].append(r)
        most = max(most, r.size)
    assert set(shards) <= set(range(24))
    mean = sum(r.size for r in got) / 24
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - mean) <= most
    crc = [text[r.doc_id] for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert sum(a != b for a, b in zip(crc, crc[1:])) == len(set(crc)) - 1  # equal texts are neighbours


def test_sharding_hostile_rows(hostile, make):
    docs, rows = hostile
    out = sharding.with_shards(docs.withColumnRenamed("n_words", "_shard"))
    assert out.columns[-1] == "_shard_" and out.count() == len(rows)
    assert out.filter("text IS NULL").select("_shard_.size", "_shard_.text_crc32").distinct().collect() == [(8, 0)]
    assert sharding.report(docs.limit(0)).count() == 0
    same = sharding.report(make([(1, "same text", "s")] * 240)).collect()
    assert sorted((r.shard, r.slot) for r in same) == [(k // 10, k % 10) for k in range(240)]
