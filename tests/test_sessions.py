"""Memory, cache, adaptive retrieval and agent traces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrievo.operators import adaptive, fusion, memory, traces


def test_routes(spark):
    df = spark.createDataFrame([(1, "hello"), (2, "RAG 是什么"), (3, "RRF 和加权融合的区别是什么"), (4, "  "), (5, "long enough words")],
                               "query_id long, query string")
    out = {r.query_id: r for r in adaptive.route(df).collect()}
    assert out[1].route_type == "DIRECT_ANSWER" and out[1].route_reason == "hello, short question"
    assert (out[2].route_type, out[2].planned_rounds) == ("SINGLE_HOP", 1)
    assert (out[3].route_type, out[3].planned_rounds) == ("MULTI_HOP", 2)
    assert (out[4].route_reason, out[4].route_confidence, out[4].planned_rounds) == ("empty question", 1.0, 0)
    assert (out[5].route_reason, out[5].route_confidence) == ("fallback to direct answer", 0.75)


def test_adaptive_loop(spark):
    df = spark.createDataFrame([(1, "hello"), (2, "RAG 是什么"), (3, "缓存 流程 怎么 zzz")], "query_id long, query string")
    texts = spark.createDataFrame([("RAG 文档 答案 事实",)], "content string")

    def retriever(queries):
        return queries.filter("query_id = 2").join(texts).select(
            "query_id", F.lit(7).cast("long").alias("doc_id"), F.lit(1).alias("rank"), F.lit(2.0).alias("score"), "content")

    contexts, rounds = adaptive.adaptive_rag(df, retriever)
    out = {r.query_id: r for r in contexts.collect()}
    assert out[1].end_reason == "direct_answer_route" and out[1].verified
    assert (out[2].end_reason, out[2].retrieval_rounds, out[2].chunk_count) == ("verification_high", 1, 1)
    assert (out[3].end_reason, out[3].retrieval_rounds, out[3].verified) == ("no_evidence", 2, False)
    assert {(r.query_id, r.round, r.terminal_reason) for r in rounds.collect()} == {
        (2, 1, "verification_high"), (3, 1, "verification_insufficient"), (3, 2, "max_rounds_reached")}
    assert [(r.query_id, r.round, r.doc_id) for r in adaptive.evidence(rounds).collect()] == [(2, 1, 7)]
    text = {r.query_id: r.context for r in adaptive.assemble_context(contexts).collect()}
    assert text[1] == "" and text[2].startswith("Adaptive RAG route: SINGLE_HOP\n") and "[1] RAG 文档 答案 事实\n" in text[2]


@pytest.mark.parametrize("with_vectors", [True, False])
def test_summaries(spark, with_vectors):
    vec = lambda v: v if with_vectors else None
    summaries = spark.createDataFrame([(1, 5, "refund question", vec([1.0, 0.0])), (1, 10, "delivery time", vec([0.0, 1.0]))],
                                      "conv_id long, round long, summary string, embedding array<double>")
    asked = spark.createDataFrame([(9, 1, "refund please", vec([0.95, 0.05]))],
                                  "question_id long, conv_id long, question string, embedding array<double>")
    out = memory.recall_summaries(summaries, asked).collect()
    assert [r.recalled for r in out] == ["refund question"]


def test_segments(spark):
    rows = [(1, t, "user", f"m{t}") for t in range(12)]
    msgs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = memory.summary_segments(msgs, bucket_turns=3).orderBy("round").collect()
    assert [r["round"] for r in out] == [5, 10] and out[1].conversation.split("\n")[-1] == "user: m9"
    assert memory.recent_window(msgs).first().history.startswith("user: m2\n")


def test_semantic_lookup(spark):
    entries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "entry_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0])], "query_id long, embedding array<double>")
    out = {r.query_id: (r.hit, r.entry_id) for r in memory.semantic_lookup(entries, asked).collect()}
    assert out == {1: (True, 1), 2: (False, None)}


def test_replay_matches_sequential_cache(spark):
    """Brute force over a log with repeats, a hot question and chains of similar questions."""
    rng = np.random.default_rng(3)
    angles = np.concatenate([np.zeros(60), rng.uniform(0, 2.5, 25).repeat(4)])
    rng.shuffle(angles)
    times = np.sort(rng.uniform(0, 500, len(angles))).round(2)
    log = [(i, float(t), [float(np.cos(a)), float(np.sin(a))]) for i, (t, a) in enumerate(zip(times, angles))]
    kept, want = [], {}
    for i, t, v in log:
        hit = any(t - s < 100 and round(float(np.dot(v, w)), 9) >= 0.92 for s, w in kept)
        want[i] = hit
        if not hit:
            kept.append((t, v))
    df = spark.createDataFrame([(i, t, v) for i, t, v in log], "request_id long, s double, embedding array<double>")
    df = df.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    got = {r.request_id: r.hit for r in memory.semantic_replay(df, ttl_seconds=100.0, block_rows=7).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_cache_accounting(spark):
    rows = [(1, 0, "a"), (2, 10, "a"), (3, 3599, "a"), (4, 3600, "a"), (5, 3700, "a"), (6, 5, "empty"), (7, 6, "empty")]
    log = spark.createDataFrame(rows, "request_id long, s long, cache_key string").withColumn(
        "ts", F.timestamp_seconds("s")).drop("s")
    stored = spark.createDataFrame([("a",)], "cache_key string")
    out = {r.request_id: r.hit for r in fusion.cache_accounting(log, stored).collect()}
    assert out == {1: False, 2: True, 3: True, 4: False, 5: True, 6: False, 7: False}


def test_steps(spark):
    outputs = ['{"thought":"t","action":"query_database","actionInput":{"q":1},"finalAnswer":null}',
               '```json\n{"finalAnswer":"done"}\n```', "Thought: why\nAction: lookup Action Input: x y\nObservation: z",
               "Thought: ok\nFinal Answer: all good", "just text", None]
    df = spark.createDataFrame([(1, i, o) for i, o in enumerate(outputs)], "run_id long, step long, llm_output string")
    out = [(r.thought, r.action, r.action_input, r.final_answer) for r in traces.parse_steps(df).orderBy("step").collect()]
    assert out == [("t", "query_database", '{"q":1}', None), (None, None, None, "done"), ("why", "lookup", "x y", None),
                   ("ok", None, None, "all good"), (None, None, None, None), (None, None, None, None)]


def steps(spark, rows):
    return spark.createDataFrame(rows, "run_id long, step long, action string, observation string, final_answer string, "
                                       "llm_error boolean, latency_ms long")


def test_stop_reasons(spark):
    q = "query_database"
    rows = [(1, 1, q, "a", None, False, 5), (1, 2, None, None, "done", False, 5), (1, 3, q, "x", None, False, 5),
            (2, 1, q, "s", None, False, 5), (2, 2, q, "s", None, False, 5), (2, 3, q, "s", None, False, 5),
            (3, 1, None, None, None, False, 5), (4, 1, None, None, None, True, 5),
            (5, 1, q, "Error: x", None, False, 190_000), (5, 2, q, "b", None, False, 5)]
    rows += [(6, i, q, f"o{i}", None, False, 5) for i in range(1, 11)] + [(6, 11, None, None, "late", False, 5)]
    out = {r.run_id: r for r in traces.stop_reasons(steps(spark, rows)).collect()}
    assert {k: (r.stop_reason, r.step_count) for k, r in out.items()} == {
        1: ("final_answer", 2), 2: ("repeated_observation", 3), 3: ("no_action", 1), 4: ("llm_error", 1),
        5: ("timeout", 1), 6: ("max_steps", 10)}
    assert out[5].tool_error and out[1].completed and not out[1].tool_error


def test_subtasks(spark):
    df = spark.createDataFrame([(1, "big", "SUBTASK 1: a\nSUBTASK 2:  b \n"), (2, "big", "no plan"), (3, "big", " ")],
                               "id long, task string, response string")
    assert [(r.id, r["index"], r.subtask) for r in traces.subtasks(df, "id").orderBy("id", "index").collect()] == [
        (1, 1, "a"), (1, 2, "b"), (2, 1, "big")]
