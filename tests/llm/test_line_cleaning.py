import corpus_pipeline
from tillweave.llm import quality

BAD = ["Home | About | Contact", "word### other*** thing$$$ more%%%", "All rights reserved."]
GOOD = [" ".join(f"word{k}x{j}" for j in range(9)) + "." for k in range(12)]


def test_the_stage_removes_failing_lines(spark, make):
    text = "\n".join([*BAD[:1], *GOOD[:6], "", *BAD[1:], *GOOD[6:]])
    rows = [(1, text, "s"), (2, "\n".join(GOOD), "t"), (3, "\n".join(BAD * 30 + GOOD), "u"), (4, None, "v"), (5, "too short", "w")]
    docs = make(rows)
    out = corpus_pipeline.quality_rules(spark, docs, "")
    assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
    assert {r.doc_id: (r.text, r.source) for r in out.collect()} == {1: ("\n".join([*GOOD[:6], "", *GOOD[6:]]), "s"), 2: ("\n".join(GOOD), "t")}


def test_texts_of_the_table(table):
    docs = table("documents")
    want = {r.doc_id: r.text for r in quality.with_quality(docs).filter("_quality.kept").select("doc_id", quality.clean_text(docs.text).alias("text")).collect()}
    assert {r.doc_id: r.text for r in quality.accepted(docs).collect()} == want
