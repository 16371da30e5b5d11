import pytest

from . import brute

pipeline = pytest.importorskip("corpus_pipeline")


def test_run(spark):
    """run() against a plain version of each stage over the operators' own verdicts."""
    from eventloom.llm import mixing, quality

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, sf)
    kept = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept and good.columns == docs.columns
    first = stages["near_duplicates"](spark, good, sf)
    top = brute.jaccard([(r["doc_id"], r["text"]) for r in good.collect()])
    assert {r["doc_id"] for r in first.collect()} == {i for i, (_, c) in top.items() if i == c} and first.columns == docs.columns
    clean = stages["personal_data"](spark, first, sf)
    assert clean.columns == docs.columns and clean.count() == first.count()
    assert not any(brute.pii(r["text"]) for r in clean.collect())
    mixed = stages["source_mix"](spark, clean, sf)
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect() if r["copies"] and r["size"]}
    assert {r[0]: r[1] for r in mixed.groupBy("doc_id").count().collect()} == want and mixed.columns == docs.columns
    out = pipeline.run(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in out) == sorted((i, brute.sha(texts[i])) for i, n in want.items() for _ in range(n))
