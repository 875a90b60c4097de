"""Queries over session memory and the semantic cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from retrievo.operators import memory
from retrievo.plans import sqltext as q
from retrievo.plans.registry import register, table
from retrievo.plans.text import _strip

N, EVERY, KEEP = 4, 2, 3


def conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


_RECENT_SQL = f"""
recent AS (SELECT conv_id, count(*) AS n_messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= {N}
  GROUP BY conv_id)"""


@register("recent_window", f"WITH {_RECENT_SQL} SELECT * FROM recent")
def recent_window(spark, sf_dir):
    return memory.recent_window(conversations(spark, sf_dir), N)


_SEGMENTS_SQL = f"""
pos AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
seg AS (SELECT conv_id, (ceil(p / {EVERY}) * {EVERY})::BIGINT AS round,
    string_agg(role || ': ' || text, chr(10) ORDER BY p) AS conversation
  FROM pos GROUP BY ALL HAVING count(*) = {EVERY}),
kept AS (SELECT conv_id, round, conversation FROM (SELECT *, row_number() OVER (PARTITION BY conv_id
  ORDER BY round DESC) AS r FROM seg) WHERE r <= {KEEP})"""


@register("summary_segments", f"WITH {_SEGMENTS_SQL} SELECT * FROM kept")
def summary_segments(spark, sf_dir):
    return memory.retain(memory.summary_segments(conversations(spark, sf_dir), EVERY), KEEP)


# A segment's text stands in for its summary. Segments and questions take the vector whose id is their turn or session;
# later rounds have none and fall back to keywords.
_QUESTION_SQL = f"""
ask AS (SELECT conv_id * 100 + turn AS question_id, conv_id, text AS question, e.embedding AS qv
  FROM conversations LEFT JOIN embeddings e ON e.vec_id = conv_id WHERE role = 'user'),
sv AS (SELECT kept.*, e.embedding AS v FROM kept LEFT JOIN embeddings e ON e.vec_id = conv_id + round AND round < 6),
parts AS (SELECT question_id, unnest(list_transform(string_split_regex(question,
    '\\s+|[,，。！？、】【；;：“”"''（）()]'), lambda p: {_strip('p')})) AS p FROM ask),
kw AS (SELECT DISTINCT question_id, k FROM (SELECT question_id, p AS k FROM parts WHERE length(p) >= 2
  UNION ALL SELECT question_id, unnest(list_concat({q.windows('p', 2)}, {q.windows('p', 3)}, {q.windows('p', 4)}))
  FROM parts WHERE length(p) >= 4)),
kws AS (SELECT question_id, list(k) AS ks FROM kw GROUP BY question_id),
sc AS (SELECT ask.question_id, sv.conv_id, round, conversation AS summary, v IS NOT NULL AS has_v,
    round(CASE WHEN v IS NOT NULL AND qv IS NOT NULL THEN list_cosine_similarity(v::DOUBLE[], qv::DOUBLE[])
      ELSE len(list_filter(coalesce(ks, []), lambda k: contains(lower(conversation), lower(k)))) END, 9) AS score
  FROM sv JOIN ask USING (conv_id) LEFT JOIN kws USING (question_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, round) AS r FROM sc),
rec AS (SELECT question_id, conv_id, count(*) AS n_recalled,
    string_agg(summary, chr(10) || '---' || chr(10) ORDER BY r) AS recalled
  FROM best WHERE r <= 2 AND score >= CASE WHEN has_v THEN 0.0 ELSE 1.0 END GROUP BY ALL)"""


def _questions(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding")
    return conversations(spark, sf_dir).filter("role = 'user'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), "conv_id", F.col("text").alias("question")).join(
        vecs, "conv_id", "left")


def _recalled(spark, sf_dir):
    kept = memory.retain(memory.summary_segments(conversations(spark, sf_dir), EVERY), KEEP)
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    summaries = kept.withColumn("vec_id", F.when(F.col("round") < 6, F.col("conv_id") + F.col("round"))).join(
        vecs, "vec_id", "left").select("conv_id", "round", F.col("conversation").alias("summary"), "embedding")
    return memory.recall_summaries(summaries, _questions(spark, sf_dir), 2, 0.0)


@register("summary_recall", f"WITH {_SEGMENTS_SQL}, {_QUESTION_SQL} SELECT * FROM rec")
def summary_recall(spark, sf_dir):
    return _recalled(spark, sf_dir)


@register("session_context", f"""
WITH {_RECENT_SQL}, {_SEGMENTS_SQL}, {_QUESTION_SQL},
a AS (SELECT question_id, conv_id, recalled FROM ask LEFT JOIN rec USING (question_id, conv_id))
SELECT question_id, conv_id, CASE WHEN history <> '' THEN '【最近对话】' || chr(10) || history || chr(10) || chr(10)
    ELSE '' END || CASE WHEN recalled <> '' THEN '【相关历史摘要】' || chr(10) || recalled || chr(10) || chr(10) ELSE '' END
  AS context FROM recent FULL JOIN a USING (conv_id)""")
def session_context(spark, sf_dir):
    asked = _questions(spark, sf_dir).select("question_id", "conv_id")
    recalled = asked.join(_recalled(spark, sf_dir), ["question_id", "conv_id"], "left")
    return memory.session_context(memory.recent_window(conversations(spark, sf_dir), N), recalled)


@register("semantic_cache_lookup", """
WITH n AS (SELECT vec_id AS query_id, list_transform(range(1, 65),
    lambda i: embedding[i]::DOUBLE + 0.4::DOUBLE * embedding[65 - i]::DOUBLE) AS v FROM embeddings),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 9) AS score FROM n, embeddings),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s WHERE score >= 0)
SELECT query_id, round(coalesce(score, 0), 6) AS best_score, CASE WHEN score >= 0.92 THEN vec_id END AS entry_id,
  coalesce(score, 0) >= 0.92 AS hit FROM n LEFT JOIN (SELECT * FROM b WHERE r = 1) USING (query_id)""")
def semantic_cache_lookup(spark, sf_dir):
    """Each stored vector bent by its own reversal asks the cache again; some fall below the threshold."""
    vecs = table(spark, sf_dir, "embeddings")
    bent = F.zip_with("embedding", F.reverse("embedding"), lambda a, b: a.cast("double") + 0.4 * b.cast("double"))
    found = memory.semantic_lookup(vecs.select(F.col("vec_id").alias("entry_id"), "embedding"),
                                   vecs.select(F.col("vec_id").alias("query_id"), bent.alias("embedding")))
    return found.withColumn("best_score", F.round("best_score", 6))


TTL_DAYS = 10


@register("semantic_cache_replay", f"""
WITH RECURSIVE log AS (SELECT event_id AS id, user_id AS u, ts FROM events WHERE user_id IN (SELECT vec_id FROM embeddings)),
near AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b
    ON round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) >= 0.92),
alone AS (SELECT u FROM near GROUP BY u HAVING count(*) = 1),
miss AS (SELECT u, min(ts) AS ts FROM log GROUP BY u
  UNION ALL SELECT l.u, min(l.ts) FROM miss m JOIN log l ON l.u = m.u AND l.ts >= m.ts + INTERVAL {TTL_DAYS} DAY
  GROUP BY l.u)
SELECT id AS request_id, (u, ts) NOT IN (SELECT (u, ts) FROM miss) AS hit FROM log
WHERE u IN (SELECT u FROM alone)
UNION ALL SELECT event_id, false FROM events WHERE user_id NOT IN (SELECT vec_id FROM embeddings)""")
def semantic_cache_replay(spark, sf_dir):
    """User u asks the question with vector u; the SQL covers logs whose distinct questions are not similar. Requests
    without a vector are not looked up and miss."""
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question"), "embedding")
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), "ts", F.col("user_id").alias("question"))
    return memory.semantic_replay(log, ttl_seconds=TTL_DAYS * 86_400.0, questions=vecs)


# Lifetimes in seconds of session history, search results and embeddings.
LIFETIMES = {"click": 86_400, "view": 3_600, "purchase": 86_400}


@register("live_cache_entries", """
SELECT event_id, event_type AS kind, epoch(ts)::BIGINT AS s, expires_in FROM (SELECT *, floor(epoch(ts))::BIGINT
  + CASE event_type WHEN 'click' THEN 86400 WHEN 'view' THEN 3600 WHEN 'purchase' THEN 86400 END
  - epoch(TIMESTAMP '2024-01-20 12:00:00')::BIGINT AS expires_in FROM events) WHERE expires_in > 0""".replace(
    "epoch(ts)::BIGINT AS s, ", ""))
def live_cache_entries(spark, sf_dir):
    entries = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), "ts")
    return memory.live_entries(entries, "2024-01-20 12:00:00", LIFETIMES).select("event_id", "kind", "expires_in")
