import random

import pytest

import corpus_pipeline
from tillweave.llm import neardup


def shingle_set(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def test_stage_links_from_080(spark, make):
    """Pairs whose similarity lies about 0.80 to 0.85; brute force says which the stage must link."""
    rng = random.Random(11)
    rows, want, at85 = [], set(), set()
    for k in range(120):
        a = [f"g{k}w{j}" for j in range(204)]
        b = [*a]
        for j in range(20, 20 + 5 * rng.randrange(3, 7), 5):
            b[j] = f"new{k}x{j}"
        both, either = len(shingle_set(a) & shingle_set(b)), len(shingle_set(a) | shingle_set(b))
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want |= {2 * k} if 100 * both >= 80 * either else {2 * k, 2 * k + 1}
        at85 |= {2 * k} if 100 * both >= 85 * either else {2 * k, 2 * k + 1}
    assert len(at85) > len(want) + 30
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, make(rows), "").collect()} == want
    assert {r.doc_id for r in neardup.report(make(rows)).filter("kept").collect()} == at85


def test_stage_on_the_table(spark, table):
    docs = table("documents")
    kept = sorted(r.doc_id for r in neardup.report(docs, 80).filter("kept").collect())
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == kept


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 100])
def test_bands_fit_the_threshold(percent):
    bands, rows, screen = neardup.banding(percent)
    assert (1 - (percent / 100) ** rows) ** bands <= neardup.MISS and screen <= bands * rows * percent / 100
