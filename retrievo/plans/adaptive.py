"""Queries over adaptive retrieval, with patterns in the languages of the test questions.

The loop runs twice: over the five best BM25 chunks, and (``..._hybrid``) over the five best of hybrid search, as the
operators are meant to be used. A question keeps the vector of its id in all rounds; its rewritten text goes to BM25.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from retrievo.operators import adaptive, fusion, lexical
from retrievo.plans import sqltext as q
from retrievo.plans.registry import register, table
from retrievo.plans.retrieval import THRESHOLD as VECTOR_THRESHOLD, corpus, questions, vector_index
from retrievo.plans.text import DOMAIN, STOP
from retrievo.staging import stage

LANGUAGE = adaptive.Language(
    direct=("thing", "schr", "hola", "Que"), single=("tion", "heit", "mente", "eaux"), multi=("sh ", "ver", "ción", "oui"),
    action=("write", "schreib"), multi_boosters=("with", "und", "les"), single_boosters=("the", "der"),
    domain_terms=DOMAIN, stop_words=STOP)
TOP_K, THRESHOLD, MULTI_THRESHOLD = 5, 0.95, 0.99
HYBRID_K = 5

# all conversation messages, so every route occurs
_ASK = "SELECT conv_id * 100 + turn AS query_id, text AS query FROM conversations"


def _contained(text, patterns):
    return f"list_filter({q.strings(patterns)}, lambda p: contains({text}, p))"


def _any(text, patterns):
    return f"len(list_filter({q.strings(patterns)}, lambda p: contains(lower({text}), lower(p)))) > 0"


def _route_sql(ask: str) -> str:
    return f"""
norm AS (SELECT query_id, query, trim({q.clean('query')}) AS t FROM ({ask})),
pat AS (SELECT *, {_contained('t', LANGUAGE.direct)} AS pd, {_contained('t', LANGUAGE.single)} AS ps,
  {_contained('t', LANGUAGE.multi)} AS pm, length(t) <= 8 AS short FROM norm),
sc AS (SELECT *, len(pd) + short::INT + CASE WHEN {_any('t', LANGUAGE.action)} THEN 2 ELSE 0 END AS d, len(ps) AS s,
  len(pm) AS m FROM pat),
rt AS (SELECT *, CASE WHEN m > 0 AND m >= s THEN 'MULTI_HOP' WHEN s > 0 THEN 'SINGLE_HOP' ELSE 'DIRECT_ANSWER' END
  AS route_type, CASE WHEN m > 0 AND m >= s THEN list_concat(pm, ps) WHEN s > 0 THEN ps WHEN d > 0
    THEN list_concat(pd, CASE WHEN short THEN ['short question'] ELSE [] END) ELSE ['fallback to direct answer'] END
  AS rs FROM sc),
routed AS MATERIALIZED (SELECT query_id, query, t, route_type, CASE WHEN t = '' THEN 'empty question' WHEN len(rs) = 0
    THEN 'heuristic route' ELSE array_to_string(rs, ', ') END AS route_reason,
  CASE WHEN t = '' THEN 1.0 WHEN greatest(d, s, m) = 0 THEN 0.75 ELSE least(1.0, 0.35 + greatest(d, s, m) * 0.2) END::DOUBLE
    AS route_confidence,
  CASE WHEN t = '' THEN 0 WHEN m > 0 AND m >= s THEN 2 WHEN s > 0 THEN 1 ELSE 0 END AS planned_rounds FROM rt)"""


def asked(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


@register("route_questions", f"""
WITH {_route_sql(_ASK)} SELECT query_id, route_type, route_reason, round(route_confidence, 6) AS route_confidence,
  planned_rounds FROM routed""")
def route_questions(spark, sf_dir):
    return adaptive.route(asked(spark, sf_dir), LANGUAGE).select(
        "query_id", "route_type", "route_reason", F.round("route_confidence", 6).alias("route_confidence"),
        "planned_rounds")


def _dedupe(expr: str, n: int) -> str:
    return (f"coalesce((SELECT list(w ORDER BY pos) FROM (SELECT w, min(pos) AS pos FROM (SELECT unnest({expr}) AS w, "
            f"generate_subscripts({expr}, 1) AS pos) GROUP BY w ORDER BY pos LIMIT {n})), []::VARCHAR[])")


def _rewrite_sql(source: str, name: str, missing: str | None = None) -> str:
    """CTE ``name`` with keywords kw and rewritten query rq; the source holds the extracted keywords base."""
    boost = (f"CASE route_type WHEN 'MULTI_HOP' THEN {q.strings(LANGUAGE.multi_boosters)} WHEN 'SINGLE_HOP' "
             f"THEN {q.strings(LANGUAGE.single_boosters)} ELSE []::VARCHAR[] END")
    parts = f"list_concat(base, {missing + ', ' if missing else ''}{boost})"
    return f"""
{name} AS MATERIALIZED (SELECT * EXCLUDE (kw0), CASE WHEN array_to_string(kw0, ' ') = '' THEN [t] ELSE kw0 END AS kw,
  CASE WHEN array_to_string(kw0, ' ') = '' THEN t ELSE array_to_string(kw0, ' ') END AS rq
  FROM (SELECT *, {_dedupe('allkw', 10)} AS kw0 FROM (SELECT *, {parts} AS allkw FROM {source})))"""


_BASE = f"base AS MATERIALIZED (SELECT *, {q.keywords('t', 8, DOMAIN, STOP)} AS base FROM routed)"


@register("rewrite_questions", f"""
WITH {_route_sql(_ASK)}, {_BASE}, {_rewrite_sql('base', 'rw')}
SELECT query_id, array_to_string(kw, '|') AS keywords, rq AS rewritten_query, rq <> t AS changed,
  'initial rewrite' AS rewrite_reason FROM rw""")
def rewrite_questions(spark, sf_dir):
    out = adaptive.rewrite(adaptive.route(asked(spark, sf_dir), LANGUAGE), LANGUAGE)
    return out.select("query_id", F.array_join("keywords", "|").alias("keywords"), "rewritten_query", "changed",
                      "rewrite_reason")


def _scores_sql(source: str, tag: str) -> str:
    """CTE s_<tag>: BM25 scores of the questions of ``source``."""
    return f"""
qt_{tag} AS (SELECT query_id, term, count(*) AS qtf
  FROM (SELECT query_id, unnest({q.tokens('rq')}) AS term FROM {source}) GROUP BY ALL),
tf_{tag} AS (SELECT doc_id, dl, term, count(*) AS tf
  FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM doc_tok)
  WHERE term IN (SELECT term FROM qt_{tag}) GROUP BY ALL),
df_{tag} AS (SELECT term, count(*) AS df FROM tf_{tag} GROUP BY term),
s_{tag} AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5))
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 9) AS score
  FROM tf_{tag} JOIN qt_{tag} USING (term) JOIN df_{tag} USING (term), stats GROUP BY ALL)"""


def _retrieve_sql(source: str, tag: str) -> str:
    """CTE hit_<tag>: the best chunk per question of ``source``."""
    return f"""{_scores_sql(source, tag)},
hit_{tag} AS MATERIALIZED (SELECT h.*, text AS content FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY score DESC, doc_id) AS rank FROM s_{tag} WHERE score > 0) h JOIN documents USING (doc_id)
  WHERE rank <= {TOP_K})"""


_VECTORS = q.vector_ctes(VECTOR_THRESHOLD, fusion.ROUTE_K, index="""SELECT vec_id AS doc_id, embedding FROM embeddings
  WHERE vec_id IN (SELECT doc_id FROM documents)""").replace("vec AS MATERIALIZED", "vecs AS MATERIALIZED")


def _hybrid_sql(source: str, tag: str) -> str:
    """CTE hit_<tag>: the best chunks per question of ``source`` by hybrid search, scored by rank fusion."""
    return f"""{_scores_sql(source, tag)},
hit_{tag} AS MATERIALIZED (WITH vec AS (SELECT * FROM vecs WHERE query_id IN (SELECT query_id FROM {source})),
  bm25 AS (SELECT * FROM s_{tag}), {q.lexical_top(fusion.ROUTE_K)}, {q.fused(HYBRID_K)}
  SELECT f.*, rrf_score AS score, text AS content FROM fused f JOIN documents USING (doc_id))"""


def _verify_sql(source: str, tag: str) -> str:
    """CTE ver_<tag>: level, score, matched and missing keywords."""
    limit = f"CASE WHEN route_type = 'MULTI_HOP' THEN {MULTI_THRESHOLD} ELSE {THRESHOLD} END"
    return f"""
m_{tag} AS (SELECT query_id, rank, score, len(kw) AS n, list_filter(kw, lambda k: contains(content, k)) AS hit
  FROM hit_{tag} JOIN {source} USING (query_id)),
a_{tag} AS (SELECT query_id, count(*) AS chunks, sum(len(hit) / n + least(0.1, greatest(score, 0) * 0.05)) AS acc,
  flatten(list(hit ORDER BY rank)) AS hits FROM m_{tag} WHERE len(hit) > 0 GROUP BY query_id),
v_{tag} AS (SELECT s.*, coalesce(chunks, 0) AS chunks, coalesce(acc, 0) AS acc,
  list_filter(kw, lambda k: list_contains(coalesce(hits, []), k)) AS matched FROM {source} s LEFT JOIN a_{tag}
  USING (query_id)),
w_{tag} AS (SELECT *, round(greatest(len(matched) / len(kw), least(1.0, acc)), 9) AS vs,
  list_filter(kw, lambda k: NOT contains(lower(array_to_string(matched, ' ')), lower(k))) AS missing FROM v_{tag}),
ver_{tag} AS MATERIALIZED (SELECT *, CASE WHEN len(matched) = 0 THEN 'NONE'
    WHEN vs >= {limit} AND (route_type <> 'MULTI_HOP' OR chunks >= 2 OR vs >= {limit} + 0.08) THEN 'HIGH'
    WHEN vs >= {limit} / 2 THEN 'MEDIUM' ELSE 'LOW' END AS level,
  'matched=' || len(matched) || ', missing=' || len(missing) || ', chunks=' || chunks AS reason FROM w_{tag})"""


_DOCS = f"""doc_tok AS MATERIALIZED (SELECT doc_id, {q.tokens('text')} AS toks FROM documents),
stats AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_dl FROM doc_tok)"""
_ITEMS = "SELECT item_id AS query_id, text AS query FROM benchmark"


def _loop_sql(retrieve_sql, docs: str) -> str:
    return f"""
{_route_sql(_ITEMS)}, {_BASE}, {docs},
todo1 AS (SELECT * FROM base WHERE route_type <> 'DIRECT_ANSWER'),
{_rewrite_sql('todo1', 'rw1')}, {retrieve_sql('rw1', 'r1')}, {_verify_sql('rw1', 'r1')},
todo2 AS (SELECT query_id, query, t, route_type, route_reason, route_confidence, planned_rounds, base,
  missing AS prev_missing, reason AS prev_reason FROM ver_r1 WHERE level <> 'HIGH'),
{_rewrite_sql('todo2', 'rw2', 'prev_missing')}, {retrieve_sql('rw2', 'r2')}, {_verify_sql('rw2', 'r2')},
rounds AS (SELECT query_id, 1 AS round, rq, kw, level, vs, matched, missing, reason, level = 'HIGH' AS terminal FROM ver_r1
  UNION ALL SELECT query_id, 2, rq, kw, level, vs, matched, missing, reason, true FROM ver_r2),
hits AS (SELECT 1 AS round, * FROM hit_r1 UNION ALL SELECT 2, * FROM hit_r2),
final AS (SELECT r.*, (SELECT count(*) FROM hits h WHERE h.query_id = r.query_id AND h.round = r.round) AS chunk_count
  FROM rounds r WHERE terminal),
ctx AS (SELECT q.query_id, q.query, route_type, route_reason, coalesce(rq, q.query) AS rewritten_query,
  coalesce(level, 'NONE') AS verification_level, vs, coalesce(f.round, 0) AS retrieval_rounds,
  coalesce(chunk_count, 0) AS chunk_count, CASE WHEN route_type = 'DIRECT_ANSWER' THEN 'direct_answer_route'
    WHEN level = 'HIGH' THEN 'verification_high' WHEN level = 'NONE' THEN 'no_evidence'
    ELSE 'max_rounds_reached_partial' END AS end_reason, f.round AS last_round
  FROM routed q LEFT JOIN final f USING (query_id))"""


_LOOP, _HYBRID_LOOP = _loop_sql(_retrieve_sql, _DOCS), _loop_sql(_hybrid_sql, f"{_DOCS}, {_VECTORS}")


def resolve(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    scan = lexical.CorpusScan(docs)

    def retriever(queries):
        hits = scan.top(queries, TOP_K)
        return hits.join(docs.select("doc_id", F.col("text").alias("content")), "doc_id")

    return adaptive.adaptive_rag(questions(spark, sf_dir), retriever, LANGUAGE, 2, THRESHOLD, MULTI_THRESHOLD)


def resolve_hybrid(spark, sf_dir):
    """The loop over hybrid search. BM25 cuts the texts into words in the first round and keeps what the questions ask for,
    as postings of all words take more disk than the texts do; the vectors are staged once."""
    docs = corpus(spark, sf_dir)
    scan = lexical.CorpusScan(docs)
    index = stage(vector_index(spark, sf_dir).join(docs.select("doc_id"), "doc_id", "left_semi"), "vectors")
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")

    def retriever(queries):
        hits = fusion.hybrid_search(index, queries.join(vecs, "query_id", "left"),
                                    fusion.SearchOptions(HYBRID_K, VECTOR_THRESHOLD, True), bm25=scan)
        return hits.withColumn("score", F.col("rrf_score")).join(
            docs.select("doc_id", F.col("text").alias("content")), "doc_id")

    return adaptive.adaptive_rag(questions(spark, sf_dir), retriever, LANGUAGE, 2, THRESHOLD, MULTI_THRESHOLD)


_VERIFIED = """SELECT query_id, round, rq AS rewritten_query, array_to_string(kw, '|') AS keywords,
  level AS verification_level, round(vs, 6) AS verification_score, array_to_string(list_sort(matched), '|') AS matched,
  array_to_string(missing, '|') AS missing, reason AS verification_reason, terminal FROM rounds"""


def _verified(traces):
    return traces.select(
        "query_id", "round", "rewritten_query", F.array_join("keywords", "|").alias("keywords"), "verification_level",
        F.round("verification_score", 6).alias("verification_score"),
        F.array_join(F.sort_array("matched"), "|").alias("matched"), F.array_join("missing", "|").alias("missing"),
        "verification_reason", "terminal")


@register("verify_evidence", f"""
WITH {_LOOP} {_VERIFIED}""")
def verify_evidence(spark, sf_dir):
    return _verified(resolve(spark, sf_dir)[1])


@register("verify_evidence_hybrid", f"WITH {_HYBRID_LOOP} {_VERIFIED}")
def verify_evidence_hybrid(spark, sf_dir):
    return _verified(resolve_hybrid(spark, sf_dir)[1])


_RESOLVED = """SELECT query_id, route_type, rewritten_query, verification_level, retrieval_rounds, chunk_count, end_reason
FROM ctx"""
_RESOLVED_COLUMNS = ("query_id", "route_type", "rewritten_query", "verification_level", "retrieval_rounds", "chunk_count",
                     "end_reason")


@register("adaptive_rag", f"""
WITH {_LOOP} {_RESOLVED}""")
def adaptive_rag(spark, sf_dir):
    return resolve(spark, sf_dir)[0].select(*_RESOLVED_COLUMNS)


@register("adaptive_rag_hybrid", f"WITH {_HYBRID_LOOP} {_RESOLVED}")
def adaptive_rag_hybrid(spark, sf_dir):
    return resolve_hybrid(spark, sf_dir)[0].select(*_RESOLVED_COLUMNS)


@register("evidence", f"""
WITH {_LOOP} SELECT query_id, round, level AS verification_level, doc_id, rank, round(score, 6) AS score
FROM hits JOIN rounds USING (query_id, round)""")
def evidence(spark, sf_dir):
    _, traces = resolve(spark, sf_dir)
    return adaptive.evidence(traces).select("query_id", "round", "verification_level", "doc_id", "rank",
                                            F.round("score", 6).alias("score"))


@register("evidence_hybrid", f"""
WITH {_HYBRID_LOOP} SELECT query_id, round, level AS verification_level, doc_id, rank, round(score, 9) AS score,
  retrieval_source, vector_rank, bm25_rank, round(rrf_score, 9) AS rrf_score FROM hits JOIN rounds USING (query_id, round)""")
def evidence_hybrid(spark, sf_dir):
    out = adaptive.evidence(resolve_hybrid(spark, sf_dir)[1])
    return out.withColumns({c: F.round(c, 9) for c in ("score", "rrf_score")})


_CONTEXT = """SELECT query_id, md5(CASE WHEN route_type = 'DIRECT_ANSWER' THEN '' ELSE 'Adaptive RAG route: ' || route_type
  || chr(10) || 'Route reason: ' || route_reason || chr(10) || 'Rewritten query: ' || rewritten_query || chr(10)
  || 'Verification: ' || verification_level || ' (score=' || printf('%.2f', vs) || ')' || chr(10)
  || 'Relevant reference information:' || chr(10) || coalesce((SELECT string_agg('[' || rank || '] ' || content || chr(10), ''
    ORDER BY rank) FROM hits h WHERE h.query_id = ctx.query_id AND h.round = last_round), '') END) AS context_md5
FROM ctx"""


def _context_md5(contexts):
    return adaptive.assemble_context(contexts).select(
        "query_id", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@register("rag_context", f"""
WITH {_LOOP} {_CONTEXT}""")
def rag_context(spark, sf_dir):
    return _context_md5(resolve(spark, sf_dir)[0])


@register("rag_context_hybrid", f"WITH {_HYBRID_LOOP} {_CONTEXT}")
def rag_context_hybrid(spark, sf_dir):
    return _context_md5(resolve_hybrid(spark, sf_dir)[0])


@register("response_source", f"""
WITH {_route_sql(_ASK)}
SELECT query_id, CASE WHEN query_id % 100 = 0 THEN 'llm_direct' WHEN route_type = 'DIRECT_ANSWER'
  THEN 'adaptive_direct_answer' WHEN length(t) > 200 THEN 'adaptive_rag' ELSE 'adaptive_rag_no_evidence' END
  AS response_source FROM routed""")
def response_source(spark, sf_dir):
    """First turns were asked without retrieval; long messages stand for questions with evidence."""
    routed = adaptive.route(asked(spark, sf_dir), LANGUAGE)
    rows = routed.select(
        "query_id", "route_type", (F.col("query_id") % 100 != 0).alias("use_rag"), F.lit(True).alias("used_adaptive"),
        F.when(F.length(adaptive.normalize(F.col("query"))) > 200, 5).otherwise(0).alias("chunk_count"))
    return adaptive.response_source(rows).select("query_id", "response_source")
