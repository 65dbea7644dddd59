import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tillweave.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=1):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return ws, [" ".join(ws[k : k + n]) for n in range(1, longest + 1) for k in range(len(ws) - n + 1)]


def bucket(gram, buckets):
    return zlib.crc32(gram.encode()) % buckets


def brute(rows, target, longest=1, buckets=10_000, least=20):
    s = Counter(bucket(g, buckets) for _, t in rows for g in features(t, longest)[1])
    q = Counter(bucket(g, buckets) for t in target for g in features(t, longest)[1])
    big, small = float(sum(s.values())), float(sum(q.values()))
    gain = lambda b: math.floor(1000 * math.log((q[b] + 1.0) * (big + buckets) / ((s[b] + 1.0) * (small + buckets))))
    out = []
    for i, t in rows:
        ws, gs = features(t, longest)
        weight = sum(gain(bucket(g, buckets)) for g in gs) // len(gs) if gs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(ws)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(able[: 10 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.none(), st.text("aAbB zZ09.,\né中\U0001f600", max_size=60), st.text(max_size=80), st.integers(1, 300).map(lambda n: "x" * n + " " + "x" * (n // 2))), max_size=8), st.integers(1, 3))
def test_interned_grams(texts, longest):
    found = resample.Interned(texts, longest, 97)
    assert found.n_words.tolist() == [len(features(t)[0]) for t in texts]
    for k, t in enumerate(texts):
        own = found.slot[found.first[k] : found.first[k + 1]]
        grams = features(t, longest)[1]
        assert Counter(found.bucket[own].tolist()) == Counter(bucket(g, 97) for g in grams)
    every = Counter(g for t in texts for g in features(t, longest)[1])
    assert sorted(found.count[found.used].tolist()) == sorted(every.values())


@given(st.lists(st.binary(min_size=1, max_size=80), min_size=1, max_size=20))
def test_xxhash64(spans):
    raw = np.frombuffer(b"".join(spans) + bytes(8), np.uint8).copy()
    length = np.array([len(x) for x in spans])
    start = np.cumsum(length) - length
    assert resample.xxhash64(raw, start, length).tolist() == [xxhash.xxh64_intdigest(x) for x in spans]


def test_equal_hashes_stay_apart():
    """Occurrences whose keys collide are told apart by their bytes."""
    found = resample.Interned(["aa bb aa cc bb aa"])
    raw = np.frombuffer(b"aabbaacc" + bytes(8), np.uint8).copy()
    found.start, found.length = np.array([0, 2, 4, 6]), np.full(4, 2)
    slots = found._insert(raw, np.zeros(4, np.uint64)).tolist()
    assert slots[0] == slots[2] and len(set(slots)) == 3


def test_hostile_rows(hostile, spark):
    docs, rows = hostile
    target = spark.createDataFrame([(1, "w1x1 w2x2 one"), (2, None)], "item_id long, text string")
    pairs = [r[:2] for r in rows]
    assert collected(resample.ranked(docs, target)) == brute(pairs, ["w1x1 w2x2 one", None])
    assert collected(resample.ranked(docs, target, least_words=1, longest=2, buckets=50)) == brute(pairs, ["w1x1 w2x2 one", None], 2, 50, 1)


def test_empty_tables(make, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.ranked(make([]), none).count() == 0 and resample.resample(make([]), none).count() == 0
    rows = [(k, "only a few words here " * 5, "s") for k in range(30)]
    assert collected(resample.ranked(make(rows), none)) == brute([r[:2] for r in rows], [])


def test_drawn_documents(make, spark):
    rows = [(k, ("the harbour master of words " if k % 3 else "numbers and sums and proofs ") * 5, f"s{k % 4}") for k in range(200)]
    target = spark.createDataFrame([(1, "numbers and proofs " * 500)], "item_id long, text string")
    docs = make(rows)
    drawn = resample.resample(docs, target)
    want = {r.doc_id for r in resample.ranked(docs, target).filter("rank is not null").collect()}
    assert drawn.columns == docs.columns and sorted(r.doc_id for r in drawn.collect()) == sorted(want) and len(want) == 20
    assert sum(i % 3 == 0 for i in want) >= 15  # near the target


def test_whole_table(table):
    docs, bench = table("documents"), table("benchmark")
    assert collected(resample.ranked(docs, bench)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in bench.collect()])
