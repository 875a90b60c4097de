"""Queries over the evaluation operators.

Questions are the benchmark passages; a document is relevant to the passages it contains.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from retrievo.operators import evaluation, fusion, lexical, vector
from retrievo.plans import sqltext as q
from retrievo.plans.registry import SQL, register, table
from retrievo.plans.retrieval import corpus, questions, vector_index, vector_questions
from retrievo.sources.index import append_report, stored_reports
from retrievo.staging import new_stage_path, stage

KS = [1, 3, 5, 10]
SHORT_PASSAGES = 200  # of one or two words that one pass over the documents looks for


def containment(docs, passages):
    """(query_id, doc_id) of passages contained in documents.

    A passage's words other than the first and last stand between the same spaces in a document that contains it, so
    the longest of them is the join key; ``contains`` then decides. Passages without such a word are few and short; they
    go to every document in blocks of bounded size, as an array that each row filters.
    """
    words = F.split("query", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.aggregate(inner, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    passages = stage(passages.select("query_id", "query", longest.alias("_w")), "passages")
    shown = docs.select("doc_id", "text", F.explode(F.array_distinct(F.split("text", " "))).alias("_w"))
    held = shown.join(passages.filter("_w <> ''"), "_w").filter(F.contains("text", F.col("query"))) \
        .select("query_id", "doc_id")
    short = passages.filter("_w = '' AND query <> ''").drop("_w")
    n_blocks = -(-short.count() // SHORT_PASSAGES)
    for i in range(n_blocks):
        block = short.filter(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == i).collect()
        if not block:
            continue
        found = F.filter(F.array(*[F.struct(F.lit(p.query_id).alias("query_id"), F.lit(p.query).alias("query"))
                                   for p in block]), lambda p: F.contains(F.col("text"), p["query"]))
        held = held.unionByName(docs.select(F.explode(found).alias("p"), "doc_id").select("p.query_id", "doc_id"))
    return held


def cases(spark, sf_dir):
    """Cases (query_id, category) and the relevant documents (query_id, doc_id)."""
    relevant = stage(containment(corpus(spark, sf_dir), questions(spark, sf_dir)), "relevant")
    category = F.when(F.length("query") < 180, "short").otherwise("long")
    return questions(spark, sf_dir).join(relevant.select("query_id").distinct(), "query_id").select(
        "query_id", category.alias("category")), relevant


def lexical_hits(spark, sf_dir, k=10):
    return lexical.bm25_top(corpus(spark, sf_dir), questions(spark, sf_dir), k)


_CASES_SQL = """
rel AS MATERIALIZED (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
cases AS (SELECT item_id AS query_id, CASE WHEN length(text) < 180 THEN 'short' ELSE 'long' END AS category,
  (SELECT count(*) FROM rel WHERE rel.query_id = item_id) AS n_rel FROM benchmark
  WHERE item_id IN (SELECT query_id FROM rel))"""


def _per_case_sql(hits: str, ks=KS) -> str:
    return f"""
percase AS (SELECT c.query_id, c.category, k, count(r.doc_id) AS found, count(r.doc_id) / any_value(n_rel) AS recall,
    count(r.doc_id) / k AS "precision", count(h.doc_id) AS result_count
  FROM cases c CROSS JOIN (SELECT unnest({ks}) AS k)
  LEFT JOIN {hits} h ON h.query_id = c.query_id AND h.rank <= k
  LEFT JOIN rel r ON r.query_id = h.query_id AND r.doc_id = h.doc_id GROUP BY c.query_id, c.category, k)"""


_SUMMARY = """sample_count, round(recall, 6) AS recall, round("precision", 6) AS "precision",
  round(CASE WHEN recall + "precision" > 0 THEN 2 * recall * "precision" / (recall + "precision") ELSE 0 END, 6) AS f1,
  empty_count, round(empty_count / sample_count, 6) AS empty_rate,
  round(1 - empty_count / sample_count, 6) AS hit_rate"""


def _summary_sql(source: str = "percase", keys: str = "k") -> str:
    return f"""
SELECT {keys}, category, scope, {_SUMMARY} FROM (SELECT {keys}, category,
    CASE WHEN grouping(category) = 1 THEN 'overall' ELSE 'category' END AS scope, count(*) AS sample_count,
    avg(recall) AS recall, avg("precision") AS "precision", count(*) FILTER (result_count = 0) AS empty_count
  FROM {source} GROUP BY GROUPING SETS (({keys}), ({keys}, category)))"""


def _rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


_LEX = f"{q.bm25_ctes()}, {q.lexical_top(10)}, {_CASES_SQL}"


@register("recall_precision_at_k", f"""
WITH {_LEX}, {_per_case_sql('lex')}
SELECT query_id, category, k, found, round(recall, 6) AS recall, round("precision", 6) AS "precision", result_count
FROM percase""")
def recall_precision_at_k(spark, sf_dir):
    known, relevant = cases(spark, sf_dir)
    return _rounded(evaluation.per_case(lexical_hits(spark, sf_dir), known, KS, relevant), "recall", "precision")


def _report(df):
    return _rounded(df, "recall", "precision", "f1", "empty_rate", "hit_rate")


@register("eval_report", f"WITH {_LEX}, {_per_case_sql('lex')} {_summary_sql()}")
def eval_report(spark, sf_dir):
    known, relevant = cases(spark, sf_dir)
    return _report(evaluation.summarize(evaluation.per_case(lexical_hits(spark, sf_dir), known, KS, relevant)))


_RANK = lambda p: f"min(value) FILTER (rn >= greatest(ceil({p}::DOUBLE * n), 1))"


@register("latency_report", f"""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, {_RANK(0.50)} AS p50, {_RANK(0.95)} AS p95, {_RANK(0.99)} AS p99,
  round(avg(value), 6) AS avg_latency FROM r GROUP BY event_type""")
def latency_report(spark, sf_dir):
    return _rounded(evaluation.latency_summary(table(spark, sf_dir, "events"), ["event_type"], "value"), "avg_latency")


PROFILES = [evaluation.Profile("loose", 0.2, True), evaluation.Profile("strict", 0.4, True),
            evaluation.Profile("vector", 0.2, False)]
_PKS = [1, 3, 5]


@register("profile_comparison", f"""
WITH {q.bm25_ctes()}, {q.lexical_top(20)}, {q.vector_ctes(-1.0, 20)}, {_CASES_SQL},
profiles AS (SELECT * FROM (VALUES ('loose', 0.2, true), ('strict', 0.4, true), ('vector', 0.2, false))
  t(profile, threshold, hybrid)),
lists AS (SELECT profile, query_id, doc_id, vec.rank FROM profiles JOIN vec ON score >= threshold
  UNION ALL SELECT profile, query_id, doc_id, lex.rank FROM profiles, lex WHERE hybrid),
scored AS (SELECT profile, query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS s FROM lists GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY profile, query_id ORDER BY s DESC, doc_id) AS rank FROM scored),
percase AS (SELECT profile, c.query_id, c.category, k, count(r.doc_id) / any_value(n_rel) AS recall,
    count(r.doc_id) / k AS "precision", count(h.doc_id) AS result_count
  FROM cases c CROSS JOIN profiles CROSS JOIN (SELECT unnest({_PKS}) AS k)
  LEFT JOIN ranked h USING (profile, query_id) LEFT JOIN rel r ON r.query_id = h.query_id AND r.doc_id = h.doc_id
    AND h.rank <= k
  WHERE h.rank IS NULL OR h.rank <= k OR true GROUP BY profile, c.query_id, c.category, k)
{_summary_sql(f'''(SELECT * REPLACE ((SELECT count(*) FROM ranked h WHERE h.profile = percase.profile
    AND h.query_id = percase.query_id AND h.rank <= percase.k) AS result_count) FROM percase)''', 'profile, k')}""")
def profile_comparison(spark, sf_dir):
    near = vector.vector_search(vector_index(spark, sf_dir), vector_questions(spark, sf_dir), fusion.ROUTE_K, -1.0)
    known, relevant = cases(spark, sf_dir)
    return _report(evaluation.compare_profiles(known, PROFILES, _PKS, near,
                                               lexical_hits(spark, sf_dir, fusion.ROUTE_K), relevant))


_METRICS = ["recall", "precision", "f1"]


@register("metric_deltas", f"""
WITH {_LEX}, {q.vector_ctes(-1.0, 10)}, {_per_case_sql('lex')},
pv AS (SELECT * FROM (WITH {_per_case_sql('vec')} SELECT * FROM percase)),
b AS ({_summary_sql('pv')}), c AS ({_summary_sql()}),
lb AS (UNPIVOT (SELECT k, recall, "precision", f1 FROM b WHERE scope = 'overall') ON recall, "precision", f1
  INTO NAME metric VALUE baseline),
lc AS (UNPIVOT (SELECT k, recall, "precision", f1 FROM c WHERE scope = 'overall') ON recall, "precision", f1
  INTO NAME metric VALUE candidate)
SELECT k, metric, round(baseline, 5) AS baseline, round(candidate, 5) AS candidate,
  round(candidate - baseline, 5) AS delta FROM lb JOIN lc USING (k, metric)""")
def metric_deltas(spark, sf_dir):
    """BM25 against vectors alone."""
    return _rounded_deltas(evaluation.metric_deltas(*_two_reports(spark, sf_dir)))


@register("stored_report_deltas", SQL["metric_deltas"])
def stored_report_deltas(spark, sf_dir):
    """The same two reports saved as runs, read back by run and compared."""
    path = new_stage_path(spark, "reports")
    for run_id, report in zip(("vectors", "bm25"), _two_reports(spark, sf_dir)):
        append_report(report, path, run_id)
    stored = stored_reports(spark, path)
    of = lambda run: stored.filter(F.col("run_id") == run).select("k", "metric", "value")
    return _rounded_deltas(evaluation.metric_deltas(of("vectors"), of("bm25")))


def _two_reports(spark, sf_dir):
    known, relevant = cases(spark, sf_dir)
    near = vector.vector_search(vector_index(spark, sf_dir), vector_questions(spark, sf_dir), 10, -1.0)

    def long(hits):
        report = _report(evaluation.summarize(evaluation.per_case(hits, known, KS, relevant))).filter("scope = 'overall'")
        return evaluation.metric_rows(report, ["k"], _METRICS)

    return long(near), long(lexical_hits(spark, sf_dir))


def _rounded_deltas(out):
    return out.withColumns({c: F.round(c, 5) for c in ("baseline", "candidate", "delta")})


# Case stand-ins: conversation messages as questions, ids with blanks and repeats, categories for two of the roles.
_QRELS = """conv_id, turn, CASE WHEN turn = 6 THEN '  ' ELSE '  ' || text || ' ' END AS question,
  CASE WHEN turn = 3 THEN ARR() ELSE ARR(' ' || conv_id, CAST(conv_id AS VARCHAR(20)), ' ', 'd' || turn) END
  AS relevant_ids, CASE role WHEN 'user' THEN ' asked ' WHEN 'assistant' THEN 'answered' END AS category"""


def raw_qrels(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    return spark.sql("SELECT " + _QRELS.replace("ARR()", "CAST(array() AS ARRAY<STRING>)").replace("ARR(", "array(")
                     .replace("VARCHAR(20)", "STRING") + " FROM {conv}", conv=conv)


_RAW_SQL = "raw AS (SELECT " + _QRELS.replace("ARR()", "[]::VARCHAR[]").replace(
    "ARR(", "list_value(") + " FROM conversations)"
_BLANK = "regexp_replace(question, '\\s+', '', 'g') = ''"
_TRIMMED = "regexp_replace(question, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


@register("qrels_normalize", f"""
WITH {_RAW_SQL}
SELECT conv_id, turn, md5({_TRIMMED}) AS question_md5,
  CASE WHEN turn = 3 THEN '' ELSE CASE WHEN 'd' || turn = conv_id::VARCHAR THEN conv_id::VARCHAR
    ELSE conv_id || ',d' || turn END END AS ids, coalesce(trim(category), 'uncategorized') AS category,
  CASE WHEN {_BLANK} THEN 'blank question' WHEN turn = 3 THEN 'no relevant ids' END AS reason FROM raw""")
def qrels_normalize(spark, sf_dir):
    good, bad = evaluation.normalize_qrels(raw_qrels(spark, sf_dir))
    rows = good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)
    return rows.select("conv_id", "turn", F.md5(F.col("question").cast("binary")).alias("question_md5"),
                       F.array_join("relevant_ids", ",").alias("ids"), "category", "reason")


@register("qrels_validation", f"""
WITH {_RAW_SQL},
r AS (SELECT coalesce(trim(category), 'uncategorized') AS category, category IS NULL AS nocat, {_BLANK} AS blank,
  turn = 3 AS noid, lower(regexp_replace({_TRIMMED}, '\\s+', ' ', 'g')) AS k,
  len(list_distinct(relevant_ids)) <> len(relevant_ids) AS dupid FROM raw),
t AS (SELECT count(*) AS n, count(DISTINCT category) AS c, count(*) FILTER (blank) AS blank,
  count(*) FILTER (noid) AS noid, count(*) FILTER (nocat) AS nocat, count(*) FILTER (dupid) AS dupid,
  count(*) FILTER (NOT blank) - count(DISTINCT k) FILTER (NOT blank) AS dups FROM r),
e AS (SELECT 'error' AS section, 'too few cases' AS name, (n < 1000000)::BIGINT AS value FROM t
  UNION ALL SELECT 'error', 'too few categories', (c < 5)::BIGINT FROM t
  UNION ALL SELECT 'error', 'blank question', blank FROM t UNION ALL SELECT 'error', 'no relevant ids', noid FROM t
  UNION ALL SELECT 'error', 'category required', nocat FROM t
  UNION ALL SELECT 'warning', 'duplicate questions', dups FROM t
  UNION ALL SELECT 'warning', 'duplicate ids within case', dupid FROM t
  UNION ALL SELECT 'warning', 'relevant ids are not checked against the index', 1
  UNION ALL SELECT 'warning', 'annotation quality is not checked', 1)
SELECT * FROM e WHERE value > 0 UNION ALL SELECT 'summary', 'cases', n FROM t UNION ALL SELECT 'summary', 'categories', c
FROM t UNION ALL SELECT 'summary', 'passed', 0 UNION ALL SELECT 'category', category, count(*) FROM r GROUP BY category""")
def qrels_validation(spark, sf_dir):
    return evaluation.validate_qrels(raw_qrels(spark, sf_dir), "independent-human-labeled", 1_000_000, 5)


# Replay records: events stand in for answered questions.
_RECORDS = """CASE WHEN event_type = 'signup' THEN 'failed' ELSE 'ok' END AS status,
  CASE event_type WHEN 'view' THEN 'DIRECT_ANSWER' WHEN 'click' THEN 'SINGLE_HOP' ELSE 'MULTI_HOP' END AS route_type,
  CASE event_type WHEN 'view' THEN 'direct_answer_route' WHEN 'error' THEN '' ELSE 'verification_high' END AS end_reason,
  CASE WHEN value > 100 THEN 'HIGH' ELSE 'LOW' END AS verification_level,
  CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS retrieval_rounds,
  CASE WHEN event_type = 'view' OR value < 20 THEN 0 ELSE 5 END AS chunk_count,
  value / 1000 AS decision_confidence, value AS latency_ms"""


def records(spark, sf_dir):
    return spark.sql(f"SELECT {_RECORDS} FROM {{ev}}", ev=table(spark, sf_dir, "events"))


_REC_SQL = f"rec AS (SELECT {_RECORDS} FROM events), ok AS (SELECT * FROM rec WHERE status = 'ok')"


@register("replay_distributions", f"""
WITH {_REC_SQL}
SELECT field, CASE WHEN name = '' THEN 'unknown' ELSE name END AS name, count(*) AS n FROM (
  SELECT 'route_type' AS field, route_type AS name FROM ok UNION ALL SELECT 'end_reason', end_reason FROM ok
  UNION ALL SELECT 'verification_level', verification_level FROM ok
  UNION ALL SELECT 'evidence_status', CASE WHEN retrieval_rounds = 0 THEN 'not_requested' WHEN chunk_count > 0
    THEN 'available' ELSE 'empty' END FROM ok) GROUP BY ALL""")
def replay_distributions(spark, sf_dir):
    return evaluation.replay_distributions(records(spark, sf_dir))


def _numbers(name: str, source: str) -> str:
    return (f"SELECT '{name}' AS measure, count(*) AS n, round_even(avg({name}), 2) AS average, "
            + ", ".join(f"round_even(quantile_cont({name}::DOUBLE, {p}), 2) AS {n}"
                        for n, p in evaluation.PERCENTILES.items()) + f" FROM {source}")


@register("replay_report", f"WITH {_REC_SQL} " + " UNION ALL ".join(
    [_numbers("latency_ms", "rec")] + [_numbers(c, "ok") for c in (
        "decision_confidence", "retrieval_rounds", "chunk_count")]))
def replay_report(spark, sf_dir):
    return evaluation.replay_numbers(records(spark, sf_dir))


@register("replay_summary", f"""
WITH {_REC_SQL}
SELECT count(*) AS query_count, count(*) FILTER (status = 'ok') AS success_count,
  count(*) FILTER (status <> 'ok') AS failure_count,
  count(*) FILTER (status = 'ok' AND retrieval_rounds > 0 AND chunk_count > 0) AS evidence_ready_count,
  count(*) FILTER (status = 'ok' AND retrieval_rounds > 0 AND chunk_count = 0) AS empty_evidence_count,
  count(*) FILTER (status = 'ok' AND retrieval_rounds > 0 AND chunk_count > 0) > 0 AS benchmark_ready FROM rec""")
def replay_summary(spark, sf_dir):
    return evaluation.replay_summary(records(spark, sf_dir))


def samples(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time_stamp"), F.col("value").alias("elapsed"),
        (F.col("event_type") != "error").alias("success"), F.when(F.col("event_type") == "error", "500").when(
            F.col("event_type") == "signup", "201").otherwise("200").alias("response_code"))


@register("load_summary", f"""
WITH r AS (SELECT value, event_type, epoch_us(ts) // 1000 AS t, row_number() OVER (ORDER BY value) AS rn,
  count(*) OVER () AS n FROM events)
SELECT count(*) AS sample_count, count(*) FILTER (event_type <> 'error') AS success_count,
  count(*) FILTER (event_type = 'error') AS error_count,
  round_even(count(*) FILTER (event_type = 'error') / count(*), 4) AS error_rate,
  round_even(avg(value), 2) AS mean_elapsed_ms, round_even({_RANK(0.50)}, 2) AS p50_elapsed_ms,
  round_even({_RANK(0.95)}, 2) AS p95_elapsed_ms, round_even({_RANK(0.99)}, 2) AS p99_elapsed_ms,
  round_even((max(t) - min(t)) / 1000.0, 3)::DOUBLE AS sample_duration_seconds,
  round_even((count(*) / ((max(t) - min(t)) / 1000.0))::DOUBLE, 2) AS throughput_rps FROM r""")
def load_summary(spark, sf_dir):
    return evaluation.load_summary(samples(spark, sf_dir))


@register("response_codes", """
SELECT CASE event_type WHEN 'error' THEN '500' WHEN 'signup' THEN '201' ELSE '200' END AS response_code, count(*) AS n
FROM events GROUP BY ALL""")
def response_codes(spark, sf_dir):
    return evaluation.response_codes(samples(spark, sf_dir))
