import hashlib
import random
import re

import pytest

from tillweave.llm import repeats

COLS = ("n_words", "n_removed", "kept_sha256")


def brute(rows):
    seen, out = {}, {}
    for d, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        cover = [False] * len(w)
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), d) < d:
                cover[k : k + 50] = [True] * 50
        kept = [x for x, c in zip(w, cover) if not c]
        out[d] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(3)
    def text(n):
        return [f"w{rng.randrange(5000)}" for _ in range(n)]

    shared = [text(n) for n in (49, 50, 51, 120)]
    rows = []
    for d in range(120):
        w = text(rng.randrange(30, 200))
        for s in rng.sample(shared, rng.randrange(3)):
            at = rng.randrange(len(w))
            w[at:at] = s
        rows.append((d, " ".join(w)))
    rows += [(200 + k, "same " * 400) for k in range(3)] + [(300, " ".join(shared[3] * 2)), (301, None), (302, "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bucket", [repeats.BUCKET, 3])
def test_matches_brute_force(make, passages, monkeypatch, bucket, by_id):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    want = brute(passages)
    assert sum(w[1] for w in want.values()) > 3000
    assert by_id(repeats.report(make(passages)), *COLS) == want


def test_matches_brute_force_on_the_table(table, by_id):
    docs = table("documents")
    assert by_id(repeats.report(docs), *COLS) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_hostile_rows(hostile):
    docs, rows = hostile
    got = repeats.report(docs).collect()
    assert len(got) == len(rows) and not any(r.n_removed for r in got)
    again = docs.unionByName(docs.filter("doc_id = 5").selectExpr("9L AS doc_id", "text", "source", "n_words", "_quality"))
    assert {r.doc_id: r.n_removed for r in repeats.report(again).collect() if r.n_removed} == {9: 60_000}
    assert repeats.report(docs.limit(0)).count() == 0
