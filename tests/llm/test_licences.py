import pytest

from tillweave.llm import licences

LINES = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC": "Licensed under CC BY-NC 4.0.", "reserved": "All rights reserved."}


@pytest.fixture(scope="module")
def model(spark):
    return licences.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_held_out_accuracy(model):
    assert model.accuracy > 0.9 and len(model.features.vocabulary) <= licences.VOCABULARY


def test_table(model, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in licences.scan(docs, model).collect():
        want = {f for f, line in LINES.items() if line in r.text}
        assert (r._licence.licence in want and r._licence.confirmed) if want else r._licence.licence is None


def test_unknown_and_hostile_rows(model, hostile, make):
    docs, rows = hostile
    out = licences.scan(docs, model)
    assert out.columns == [*docs.columns, "_licence"] and out.count() == len(rows)
    assert all(r._licence.licence is None for r in out.collect())
    strange = make([(1, "Plain text.\nReleased under the Northern Lights Data License."), (2, "word " * 300 + LINES["GPL"] + " word" * 300), (3, LINES["MIT"]), (3, LINES["MIT"])])
    got = sorted((r.doc_id, r._licence.licence, r._licence.confirmed) for r in licences.scan(strange, model).collect())
    assert got == [(1, "unknown", False), (2, "GPL", True), (3, "MIT", True), (3, "MIT", True)]
    assert licences.scan(docs.limit(0), model).count() == 0


def test_fitting_without_documents(make):
    assert licences.fit(make([])).accuracy > 0.8
