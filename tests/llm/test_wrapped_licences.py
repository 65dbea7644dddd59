import textwrap

import pytest

from tillweave.llm import licences

NOTICES = {f: t for f, t in licences.TEMPLATES if f in ("MIT", "BSD", "GPL", "ISC") and len(t) > 100}


@pytest.fixture(scope="module")
def model(spark):
    return licences.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


@pytest.mark.parametrize("width,mark", [(80, ""), (72, "# "), (60, " * ")])
def test_wrapped_headers(model, make, width, mark):
    rows, want = [], {}
    for k, (family, notice) in enumerate(NOTICES.items()):
        body = "\n".join(mark + x for x in textwrap.wrap(notice, width))
        assert "\n" in body
        rows += [(2 * k, body), (2 * k + 1, f"A file about boats.\nIt has two plain lines.\n\n{body}\n\nint main() and so on.")]
        want |= {2 * k: (family, True, 1), 2 * k + 1: (family, True, 1)}
    got = {r.doc_id: (r._licence.licence, r._licence.confirmed, r._licence.n_licence) for r in licences.scan(make(rows), model).collect()}
    assert len(NOTICES) == 4 and got == want


def test_notices_on_neighbouring_lines_still_count(model, make):
    text = "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\n\nPlain words follow here."
    r = licences.scan(make([(1, text)]), model).first()._licence
    assert r.confirmed and r.n_paragraphs == 3 and r.n_licence == 2
