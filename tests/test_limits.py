"""Cases on both sides of limits, and inputs that the registered queries do not show."""

import hashlib
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from retrievo import staging
from retrievo.operators import adaptive, ingestion, lexical, telemetry, traces, vector
from retrievo.plans.evaluation import containment
from retrievo.streaming.sinks import batch_files, drain, progress

WORDS = ["apple apple banana", "apple", "orange pear", "banana pear apple kiwi", "kiwi", ""]


def _rows(df):
    return sorted((str(r.query_id), str(r.doc_id), round(r.score, 9), r["rank"]) for r in df.collect())


def test_text_ids_on_every_search_path(spark, monkeypatch):
    names = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(len(WORDS))]
    docs = spark.createDataFrame(list(zip(names, WORDS)), "doc_id string, text string")
    asks = spark.createDataFrame([("q-1", "apple banana"), ("q-2", "kiwi"), ("q-3", "!!!")], "query_id string, query string")
    scan = _rows(lexical.bm25_top(docs, asks, 3))
    assert {r[0] for r in scan} == {"q-1", "q-2"} and len(scan) == 5
    monkeypatch.setattr(lexical, "SCAN_TERMS", 0)
    assert _rows(lexical.bm25_top(docs, asks, 3)) == scan
    index = lexical.bm25_index(docs)
    assert _rows(lexical.bm25_search(index, asks, 3)) == scan == _rows(lexical.bm25_search(index, asks, 3, prune_pairs=0))

    made = [(n, [float(i), 1.0, 2.0]) for i, n in enumerate(names)]
    vectors = spark.createDataFrame(made, "doc_id string, embedding array<float>")
    wanted = vectors.select(F.concat(F.lit("q"), "doc_id").alias("query_id"), "embedding")
    exact = _rows(vector.vector_search(vectors, wanted, 3, 0.0))
    assert len(exact) == 18 and _rows(vector.vector_search(vectors, wanted, 3, 0.0, broadcast_bytes=1)) == exact
    assert _rows(vector.ivf_search(vector.build_ivf(vectors, 2), wanted, 3, 2, 0.0)) == exact


def test_short_passages(spark):
    docs = spark.createDataFrame([(1, "a big red fox"), (2, "red  fox"), (3, "tired foxes"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red fox"), (2, "red"), (3, "big red fox"), (4, ""), (5, "red  fox")],
                                  "query_id long, query string")
    got = {(r.query_id, r.doc_id) for r in containment(docs, asked).collect()}
    assert got == {(1, 1), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (5, 2)}


def test_repeats_across_gaps(spark):
    rows = [("r", s, o) for s, o in ((1020, "x"), (1021, "x"), (1030, "x"), (5000, "y"), (5001, "x"))]
    got = traces.repeated(spark.createDataFrame(rows, "run_id string, step long, observation string"))
    assert {r.step for r in got.collect() if r.repeated} == {1030}
    assert traces.TIMEOUT_MS == 180_000


def test_blank_question_bypasses_the_loop(spark):
    asked = spark.createDataFrame([(1, "  "), (2, "hello")], "query_id long, query string")
    none = lambda q: q.select("query_id", F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("rank"),
                              F.lit(1.0).alias("score"), F.lit("c").alias("content"))
    contexts, _ = adaptive.adaptive_rag(asked, none)
    got = {r.query_id: r for r in adaptive.response_source(contexts.withColumn("use_rag", F.lit(True))).collect()}
    assert (got[1].end_reason, got[1].used_adaptive, got[1].verified, got[1].verification_reason, got[1].response_source) == (
        "direct_answer_no_retrieval", False, False, "skipped", "llm_direct")
    assert (got[2].end_reason, got[2].verified, got[2].response_source) == ("direct_answer_route", True, "adaptive_direct_answer")


def test_seconds_until_retry(spark):
    rows = [(i, 1, f"2024-01-01 00:00:{10 + i:02d}", n) for i, n in enumerate((13_000, 5_000, 3_000, 3_000, 10))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, at string, n long").withColumn("ts", F.to_timestamp("at"))
    got = telemetry.token_budget(df, "user_id", F.col("n"), per_min=4_000, requests=3).orderBy("event_id").collect()
    assert [(r.decision, r.retry_after) for r in got] == [
        ("request_too_large", 0), ("request_cost_limit_exceeded", 0), ("allowed", None), ("cost_budget_exceeded", 47),
        ("rate_limit_exceeded", 46)]


def test_category_is_of_the_file_name(spark):
    names = ["/mnt/dev/store/general.jsonl", "/mnt/dev/train-1.jsonl", "test.jsonl", "C:\\dev\\x.jsonl"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(ingestion.category_of(F.col("n")).alias("c"))
    assert [r.c for r in df.collect()] == ["general", "train", "test", "general"]


def test_progress_of_many_batches(spark, tmp_path):
    for i in range(105):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.txt").write_text("a\nb\n")
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    drain(lines.coalesce(1), batch_files(str(tmp_path / "out")), str(tmp_path / "checkpoint"))
    assert progress(spark, str(tmp_path / "out")) == {"batches": 105, "rows": 210}


def test_staging_needs_a_shared_folder(spark, monkeypatch):
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default),
                            sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        staging.staging_root(unset)
    monkeypatch.setattr(staging, "_staged", [])
    table = staging.stage(spark.range(3), "gone")
    assert table.count() == 3 and staging.remove_staged(spark) == 1


def test_stale_index_is_rebuilt(spark, tmp_path):
    path = str(tmp_path / "index")
    first = spark.createDataFrame([("a", "apple")], "doc_id string, text string")
    both = spark.createDataFrame([("a", "apple"), ("b", "apple pear")], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "pear")], "query_id long, query string")
    assert lexical.bm25_search(lexical.fresh_index(first, path, "1 hour", 2), asked, 3).count() == 0
    assert lexical.bm25_search(lexical.fresh_index(both, path, "1 hour", 2), asked, 3).count() == 0  # still fresh
    assert lexical.bm25_search(lexical.fresh_index(both, path, "0 seconds", 2), asked, 3).count() == 1
