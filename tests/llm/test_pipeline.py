import corpus_pipeline
from tillweave.llm import decontam, neardup, quality


def test_stages_follow_each_other(spark, table, tmp_path):
    docs = table("documents")
    kept = None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        ids = sorted(r.doc_id for r in docs.collect())
        if name == "quality_rules":
            kept = sorted(r.doc_id for r in quality.report(before).filter("kept").collect())
        if name == "near_duplicates":
            kept = sorted(r.doc_id for r in neardup.report(before, corpus_pipeline.NEAR_PERCENT).filter("kept").collect())
        if name == "decontamination":
            kept = sorted(r.doc_id for r in decontam.report(before, table("benchmark")).filter("NOT contaminated").collect())
        if name in ("quality_rules", "near_duplicates", "decontamination"):
            assert ids == kept and docs.columns == before.columns
        if name == "mix_sources":
            assert set(ids) <= set(kept) and docs.columns == before.columns
    assert set(docs.columns) == {*table("documents").columns, "shard", "slot"}
    rows = docs.collect()
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
