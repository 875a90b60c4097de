"""SQL fragments shared by the oracle statements."""

from __future__ import annotations

from collections.abc import Sequence


def tokens(expr: str) -> str:
    kept = (f"trim(regexp_replace(regexp_replace(lower({expr}), '[\\p{{P}}\\p{{S}}\\s]+', ' ', 'g'), "
            f"'[^\\p{{L}}\\p{{Nd}} ]|[\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))")
    return (f"flatten(list_transform(regexp_extract_all({kept}, '\\p{{Han}}+|[^\\p{{Han}} ]+'), lambda r: "
            "CASE WHEN regexp_matches(r, '^\\p{Han}') AND length(r) > 1 "
            "THEN list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) ELSE [r] END))")


def clean(expr: str) -> str:
    return (f"coalesce(regexp_replace(regexp_replace({expr}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), "
            "'\\s+', ' ', 'g'), '')")


def strings(values: Sequence[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


def distinct_in_order(expr: str) -> str:
    """First occurrences of a list, order kept."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def windows(token: str, size: int) -> str:
    return f"list_transform(range(1, length({token}) - {size} + 2), lambda j: substring({token}, j, {size}))"


def keywords(expr: str, limit: int, domain: Sequence[str], stop: Sequence[str]) -> str:
    """Keyword list of a text expression. Every distinct token is itself a keyword, so ``limit`` tokens suffice."""
    stops = strings(stop)
    not_stop = lambda t: f"NOT (list_contains({stops}, {t}) OR list_contains({stops}, lower({t})))"
    norm = clean(expr)
    cleaned = f"regexp_replace({norm}, '[[:punct:]\\p{{P}}]+', ' ', 'g')"
    toks = f"list_filter(string_split_regex({cleaned}, '\\s+'), lambda t: length(t) >= 2 AND {not_stop('t')})"
    first = (f"(SELECT list(tok ORDER BY pos) FROM (SELECT tok, min(pos) AS pos FROM "
             f"(SELECT unnest({toks}) AS tok, generate_subscripts({toks}, 1) AS pos) GROUP BY tok "
             f"ORDER BY pos LIMIT {limit}))")
    expand = (f"flatten(list_transform(coalesce({first}, []), lambda t: list_concat([t], CASE WHEN length(t) >= 4 THEN "
              f"list_filter(list_concat({windows('t', 2)}, {windows('t', 3)}, {windows('t', 4)}), "
              f"lambda w: {not_stop('w')}) ELSE [] END)))")
    dom = f"list_filter({strings(domain)}, lambda d: contains({norm}, d))"
    both = f"list_concat({dom}, {expand})"
    dedup = (f"coalesce((SELECT list(w ORDER BY pos) FROM (SELECT w, min(pos) AS pos FROM "
             f"(SELECT unnest({both}) AS w, generate_subscripts({both}, 1) AS pos) GROUP BY w ORDER BY pos "
             f"LIMIT {limit})), [])")
    return (f"CASE WHEN {norm} = '' THEN []::VARCHAR[] WHEN len({dedup}) = 0 THEN [{norm}] ELSE {dedup} END")


def bm25_ctes(docs: str = "SELECT doc_id, text FROM documents",
              asks: str = "SELECT item_id AS query_id, text AS query FROM benchmark") -> str:
    """CTEs doc_tok, stats, tf, df, qt, bm25(query_id, doc_id, score) for a corpus and a question select."""
    return f"""
doc_tok AS MATERIALIZED (SELECT doc_id, {tokens('text')} AS toks FROM ({docs})),
stats AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_dl FROM doc_tok),
qt AS MATERIALIZED (SELECT query_id, term, count(*) AS qtf
  FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM ({asks})) GROUP BY ALL),
tf AS MATERIALIZED (SELECT doc_id, dl, term, count(*) AS tf
  FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM doc_tok)
  WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm25 AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5))
      * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 9) AS score
  FROM tf JOIN qt USING (term) JOIN df USING (term), stats GROUP BY query_id, doc_id)"""


def vector_ctes(min_score: float, k: int,
                asks: str = "SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id",
                index: str = "SELECT vec_id AS doc_id, embedding FROM embeddings") -> str:
    """CTE vec(query_id, doc_id, score, rank)."""
    return f"""
vec AS MATERIALIZED (SELECT * FROM (SELECT query_id, doc_id, score,
      row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
    FROM (SELECT q.query_id, d.doc_id,
        round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS score
      FROM ({asks}) q, ({index}) d) WHERE score >= {min_score}) WHERE rank <= {k})"""


def lexical_top(k: int) -> str:
    """CTE lex(query_id, doc_id, score, rank) over ``bm25``."""
    return f"""
lex AS MATERIALIZED (SELECT * FROM (SELECT query_id, doc_id, score,
      row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
    FROM bm25 WHERE score > 0) WHERE rank <= {k})"""


def fused(k: int) -> str:
    """CTE fused(query_id, doc_id, rrf_score, vector_rank, bm25_rank, retrieval_source, rank) over vec and lex."""
    return f"""
fused AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY rrf_score DESC, doc_id) AS rank
    FROM (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.doc_id, l.doc_id) AS doc_id,
        round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0), 12) AS rrf_score,
        v.rank AS vector_rank, l.rank AS bm25_rank,
        CASE WHEN v.rank IS NOT NULL AND l.rank IS NOT NULL THEN 'both'
             WHEN v.rank IS NOT NULL THEN 'vector_only' ELSE 'bm25_only' END AS retrieval_source
      FROM vec v FULL JOIN lex l ON v.query_id = l.query_id AND v.doc_id = l.doc_id)) WHERE rank <= {k})"""
