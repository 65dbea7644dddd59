import random
import re

import numpy as np
import pytest

from tillweave.llm import neardup

COLS = ("n_shingles", "component_id", "kept")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def edited(base, edits, rng):
    w = base.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies():
    """A group in which some copies hang on others, a group of exact copies, chains, short texts."""
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(140))
    rows = [(100 + k, edited(base, rng.randrange(5), rng)) for k in range(150)]
    chain = base
    for k in range(12):
        chain = edited(chain, 1, rng)
        rows.append((300 + k, chain))
    rows += [(400 + k, "exact copy of one short text") for k in range(30)] + [(500, "two words"), (501, "TWO words"), (502, ""), (503, None), (504, " ")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [neardup.BLOCK, 2000])
def test_groups_match_brute_force(make, copies, monkeypatch, block, by_id):
    monkeypatch.setattr(neardup, "BLOCK", block)
    want = brute(copies)
    assert len({c for _, c, _ in want.values()}) < len(copies) - 60
    assert by_id(neardup.report(make(copies)), *COLS) == want


def test_matches_brute_force_on_the_table(table, by_id):
    docs = table("documents")
    assert by_id(neardup.report(docs), *COLS) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_components(spark):
    path = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = dict(map(tuple, neardup.components(spark.createDataFrame(path, "u long, v long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}
    assert neardup.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hostile_rows(hostile, make):
    docs, rows = hostile
    got = neardup.report(docs).collect()
    assert len(got) == len(rows)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    stay = neardup.deduplicate(docs)
    assert stay.columns == docs.columns
    texts = sorted(((r.doc_id, r.text) for r in stay.filter("doc_id IS NOT NULL").collect()), key=str)
    assert texts == sorted({(i, t) for i, t, *_ in rows if i is not None}, key=str)  # both texts of 4
    assert stay.filter("doc_id IS NULL").count() == 2
    assert neardup.report(docs.limit(0)).count() == 0


def test_link_emits_a_forest():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 100).astype(np.uint64)
    sets = [np.unique(np.append(base[k % 3 :], np.uint64(k))) for k in range(60)]
    found = neardup.link(list(range(60)), sets)
    assert sorted(found) == [(k, 0) for k in range(1, 60)]


def test_texts_of_one_doc_id_are_judged_apart(make, spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(4, a), (4, b), (2, a + " more"), (7, b + " more"), (9, c), (9, c), (4, b)]
    docs = make([(*r, "s") for r in rows]).withColumnRenamed("source", "_gone").withColumnRenamed("n_words", "_row").withColumnRenamed("_quality", "_nth")
    stay = neardup.deduplicate(docs)
    assert stay.columns == docs.columns and sorted((r.doc_id, r.text) for r in stay.collect()) == sorted([(2, a + " more"), (4, b), (9, c)])
