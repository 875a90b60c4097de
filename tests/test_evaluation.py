"""Evaluation fixtures with known numbers."""

import json

import pytest
from pyspark.sql import functions as F

from retrievo.operators import evaluation as e
from retrievo.sources.index import HISTORY_MAX, report_history
from retrievo.sources.readers import decode_ids, read_qrels


def test_per_case(spark):
    cases = spark.createDataFrame([(1, "general", ["doc-1", "doc-2"]), (2, "general", ["doc-3"])],
                                  "query_id long, category string, relevant_ids array<string>")
    hits1 = spark.createDataFrame([(1, "doc-1", 1)], "query_id long, doc_id string, rank int")
    one = e.summarize(e.per_case(hits1, cases, [1])).filter("scope = 'overall'").first()
    assert (one.recall, one.precision, one.empty_count, one.empty_rate) == (0.25, 0.5, 1, 0.5)
    assert one.f1 == pytest.approx(1 / 3)
    hits2 = spark.createDataFrame([(1, "doc-1", 1), (1, "other", 2), (2, "other", 1)],
                                  "query_id long, doc_id string, rank int")
    two = e.summarize(e.per_case(hits2, cases, [2])).filter("scope = 'overall'").first()
    assert (two.recall, two.precision, two.f1, two.empty_rate, two.hit_rate) == (0.25, 0.25, 0.25, 0.0, 1.0)


def test_recall_grows_with_k(spark):
    cases = spark.createDataFrame([(1, "c", [1, 5, 9])], "query_id long, category string, relevant_ids array<long>")
    hits = spark.createDataFrame([(1, d, d) for d in range(1, 11)], "query_id long, doc_id long, rank int")
    rows = e.per_case(hits, cases, [1, 3, 5, 10]).orderBy("k").collect()
    assert [r.found for r in rows] == [1, 1, 2, 3]


def test_cut_offs_and_profiles():
    assert e.sanitize_ks([3, 3]) == [3] and e.sanitize_ks([1, 0]) == [1] and e.sanitize_ks([None, -1]) == [5]
    assert e.Profile().resolved() == e.Profile("threshold=0.70,hybrid=true", 0.7, True)
    assert e.Profile("x", -1, False).resolved() == e.Profile("x", 0.7, False)


def test_deltas(spark):
    rows = lambda a, b: spark.createDataFrame([(1, "recall", a), (1, "avgLatency", b)], "k int, metric string, value double")
    out = {r.metric: r.delta for r in e.metric_deltas(rows(.5, 80.0), rows(.75, 70.0)).collect()}
    assert out == {"recall": .25, "avgLatency": -10.0}
    assert e.comparison_warnings({"topKs": [1]}, {"topKs": [1], "datasetSize": 2}) == ["datasetSize differs"]


def test_files(spark, tmp_path):
    j = tmp_path / "cases.json"
    j.write_text(json.dumps([{"question": "q1", "relevantDocIds": ["a", "a", " "], "category": "faq"},
                             {"question": " ", "relevantDocIds": ["b"]}, {"question": "q3", "relevantDocIds": []}]))
    good, bad = e.normalize_qrels(read_qrels(spark, str(j)))
    assert [(r.question, r.relevant_ids, r.category) for r in good.collect()] == [("q1", ["a"], "faq")]
    assert {r.reason for r in bad.collect()} == {"blank question", "no relevant ids"}
    c = tmp_path / "cases.csv"
    c.write_text('Question,relevant_doc_ids,type\n"say ""hi"", now",a|b;a,faq\nshort\n')
    rows = read_qrels(spark, str(c)).collect()
    assert [(r.question, r.relevant_ids, r.category) for r in rows] == [('say "hi", now', ["a", "b"], "faq")]


def test_decode(spark):
    df = spark.createDataFrame([('["a"," b","a",""]',), ("a| b;;a",), ("[broken",), ("  ",), (None,)], "x string")
    assert [r[0] for r in df.select(decode_ids(F.col("x"))).collect()] == [["a", "b"], ["a", "b"], ["[broken"], [], []]


def test_validation(spark):
    df = spark.createDataFrame([("Q  one", ["a", "a"], "x"), ("q one", ["b"], None), ("", [], "y")],
                               "question string, relevant_ids array<string>, category string")
    out = {(r.section, r.name): r.value for r in e.validate_qrels(df, "sample", 5, 1).collect()}
    assert out[("summary", "passed")] == 0 and out[("summary", "cases")] == 3 and out[("summary", "categories")] == 3
    assert out[("error", "too few cases")] == 1 and out[("error", "blank question")] == 1
    assert out[("warning", "duplicate questions")] == 1 and out[("warning", "duplicate ids within case")] == 1
    assert ("error", "category required") not in out and out[("warning", "diagnostic data")] == 1


def test_load_summary(spark):
    one = spark.createDataFrame([(5, 10.0, True, "200")], "time_stamp long, elapsed double, success boolean, response_code string")
    row = e.load_summary(one).first()
    assert row.sample_count == 1 and row.throughput_rps is None and row.p95_elapsed_ms == 10.0


def test_redact(spark):
    df = spark.createDataFrame([("/data/private/qrels.json", "Dataset=/data/x, size=3")], "dataset_source string, summary string")
    row = e.redact(df).first()
    assert row.dataset_source == "qrels.json" and row.summary == "dataset=<private>, size=3"


def test_history_limit(spark):
    rows = [(f"rag-evaluation-{1700000000000 + i}.json", i, "{}") for i in range(130)] + [("other.json", 999, "{}")]
    df = spark.createDataFrame(rows, "file_name string, modified_at long, payload string")
    assert report_history(df, 500).count() == HISTORY_MAX and report_history(df, 0).count() == 1
