"""The loop over hybrid search sees more than the best BM25 chunk."""

from pyspark.sql import functions as F

from retrievo import plans


def test_evidence_beyond_the_first(spark, sf_dir):
    rows = plans.queries()["evidence_hybrid"](spark, sf_dir).collect()
    assert {r["rank"] for r in rows} == {1, 2, 3, 4, 5}
    assert {"vector_only", "bm25_only"} <= {r.retrieval_source for r in rows}
    assert all((r.vector_rank is None) == (r.retrieval_source == "bm25_only") for r in rows)
    assert all(r.rrf_score == r.score > 0 for r in rows)


def test_several_chunks_are_relevant(spark, sf_dir):
    out = plans.queries()["verify_evidence_hybrid"](spark, sf_dir)
    chunks = F.regexp_extract("verification_reason", "chunks=([0-9]+)", 1).cast("int")
    assert out.filter(chunks >= 2).count() > 0 and out.agg(F.max(chunks)).first()[0] == 5
