"""Queries over the ingestion operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from retrievo.operators import ingestion
from retrievo.plans import derived as d, sqltext as q
from retrievo.plans.registry import register, table
from retrievo.plans.sources import _TYPE_SQL, CHAT_SQL, FILE_NAME_SQL, named_documents, parsed_chat
from retrievo.plans.text import _format_sql, _strip
from retrievo.sources.readers import parse_chat_lines


def _md5(c):
    return F.md5(F.col(c).cast("binary"))


@register("ingest_status", f"""
WITH t AS (SELECT *, {_TYPE_SQL} AS file_type FROM (SELECT *, {FILE_NAME_SQL} AS file_name FROM documents)),
e AS (SELECT *, CASE WHEN file_type NOT IN ('txt', 'md') THEN 'Unsupported file type: ' || file_type
    WHEN regexp_replace(text, '\\s+', '', 'g') = '' THEN 'text is blank' END AS error_message,
  list_filter(string_split({q.clean('text')}, ' '), lambda x: x <> '') AS ws FROM t)
SELECT doc_id, file_name, file_type, CASE WHEN error_message IS NULL THEN 'COMPLETED' ELSE 'FAILED' END
    AS processing_status,
  CASE WHEN error_message IS NOT NULL THEN 0 WHEN file_type = 'txt' AND {_format_sql('text')} <> 'PLAIN' THEN -1
    ELSE greatest(ceil((len(ws) - 50) / 450), 1) END::BIGINT AS chunk_count, error_message FROM e""")
def ingest_status(spark, sf_dir):
    docs = named_documents(spark, sf_dir).select("doc_id", "file_name", "file_type", F.col("text").alias("raw"))
    _, status = ingestion.ingest_documents(docs)
    return status.withColumn("chunk_count", F.col("chunk_count").cast("long"))


_GOOD = "NOT bad AND n_messages >= 3 AND u <> ''"
_QA_SQL = f"""
qa AS (SELECT conv_id, turn, substring({q.clean('u')}, 1, 1024) AS question, {q.clean('a')} AS answer,
  substring('用户问题：' || {q.clean('u')} || ' 客服回答：' || {q.clean('a')}, 1, 3072) AS qa_text,
  CASE WHEN contains(file_name, 'train') THEN 'train' WHEN contains(file_name, 'dev') THEN 'dev'
    WHEN contains(file_name, 'test') THEN 'test' ELSE 'general' END AS category, file_name AS source_file
  FROM chat WHERE {_GOOD})"""


@register("qa_extract", f"""
WITH {CHAT_SQL}, {_QA_SQL}
SELECT conv_id, turn, question, answer, md5(qa_text) AS text_md5, category, source_file FROM qa""")
def qa_extract(spark, sf_dir):
    good, _ = ingestion.extract_qa(parsed_chat(spark, sf_dir), keep=("conv_id", "turn"))
    return good.select("conv_id", "turn", "question", "answer", _md5("qa_text").alias("text_md5"), "category",
                       "source_file")


@register("qa_rejects", f"""
WITH {CHAT_SQL}
SELECT conv_id, turn, file_name, CASE WHEN bad THEN 'malformed' WHEN n_messages < 3 THEN 'too few messages'
  ELSE 'empty question' END AS reason FROM chat WHERE NOT ({_GOOD})""")
def qa_rejects(spark, sf_dir):
    _, rejected = ingestion.extract_qa(parsed_chat(spark, sf_dir), keep=("conv_id", "turn"))
    return rejected


@register("qa_from_sessions", f"""
WITH g AS (SELECT conv_id, count(*) AS n, arg_max(text, turn) FILTER (role = 'user') AS u,
  coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS a FROM conversations GROUP BY conv_id)
SELECT conv_id, substring({q.clean('u')}, 1, 1024) AS question, {q.clean('a')} AS answer,
  substring('用户问题：' || {q.clean('u')} || ' 客服回答：' || {q.clean('a')}, 1, 3072) AS qa_text
FROM g WHERE n >= 3 AND u <> ''""")
def qa_from_sessions(spark, sf_dir):
    """Pairs of whole conversations, folded from message rows."""
    return ingestion.extract_qa_from_messages(table(spark, sf_dir, "conversations"), ["conv_id"])


_COUNTS = f"""
WITH {CHAT_SQL}
SELECT file_name, count(*) FILTER ({_GOOD}) AS success_count, count(*) FILTER (NOT ({_GOOD})) AS fail_count,
  count(*) AS total FROM chat GROUP BY file_name"""


@register("import_counts", _COUNTS)
def import_counts(spark, sf_dir):
    return ingestion.import_counts(parsed_chat(spark, sf_dir))


@register("import_by_file", f"""
SELECT *, CASE WHEN contains(file_name, 'train') THEN 1 WHEN contains(file_name, 'dev') THEN 2
    WHEN contains(file_name, 'test') THEN 3 ELSE 4 END AS step,
  round(100.0::DOUBLE * success_count / total, 2) AS success_pct FROM ({_COUNTS})""")
def import_by_file(spark, sf_dir):
    return ingestion.import_by_file(parsed_chat(spark, sf_dir))


@register("import_preview", f"""
WITH {CHAT_SQL}, {_QA_SQL}
SELECT conv_id, turn, question, length(qa_text) AS qa_text_length, (SELECT count(*) FROM qa) AS total
FROM qa ORDER BY conv_id, turn LIMIT 5""")
def import_preview(spark, sf_dir):
    good, _ = ingestion.extract_qa(parsed_chat(spark, sf_dir), keep=("conv_id", "turn"))
    return ingestion.preview(good, ["conv_id", "turn"], 5).select(
        "conv_id", "turn", "question", "qa_text_length", "total")


_LINES = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"


def responses(spark, sf_dir):
    """Model responses stand-in: each document in five shapes, the last a fenced JSON array of its first lines."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    at = lambda i: F.coalesce(F.get(F.col("_l"), i), F.lit(""))
    pairs = F.array(F.struct(at(0).alias("question"), at(1).alias("answer")),
                    F.struct(at(2).alias("question"), at(3).alias("answer")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", lines.alias("_l"))
    shapes = {k: d.shaped(F.col("text"), k) for k in ("faq", "dialogue", "article", "csv")}
    shapes["jsonl"] = F.concat(F.lit("```json\n"), F.to_json(pairs), F.lit("\n```"))
    return {k: docs.select("doc_id", c.alias("response")) for k, c in shapes.items()}


def _shape_rows(kind: str, sep: str, test: str) -> str:
    parts = f"list_filter(list_transform(string_split({d.shaped_sql('text', kind)}, {sep}), lambda x: {_strip('x')}), lambda x: {test})"
    return (f"SELECT doc_id, '{kind}' AS kind, generate_subscripts(p, 1) AS entry_no, unnest(p) AS entry "
            f"FROM (SELECT doc_id, {parts} AS p FROM documents)")


_PAIRS_SQL = f"""
l AS (SELECT doc_id, {_LINES} AS l FROM documents),
pr AS (SELECT doc_id, 1 AS i, coalesce(l[1], '') AS q, coalesce(l[2], '') AS a FROM l
  UNION ALL SELECT doc_id, 2, coalesce(l[3], ''), coalesce(l[4], '') FROM l),
pc AS (SELECT doc_id, i, {q.clean('q')} AS q, {q.clean('a')} AS a FROM pr),
pairs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS entry_no, q, a FROM pc
  WHERE q <> '' AND a <> '')"""


@register("parse_generated", f"""
WITH {_PAIRS_SQL}, u AS ({_shape_rows('faq', "chr(10) || '---' || chr(10)", "regexp_matches(x, '^Q[:：]')")}
  UNION ALL {_shape_rows('dialogue', "chr(10) || '---' || chr(10)", "contains(x, 'User:') AND contains(x, 'Assistant:')")}
  UNION ALL {_shape_rows('article', "chr(10) || '===' || chr(10)", "starts_with(x, '#')")}
  UNION ALL {_shape_rows('csv', 'chr(10)', "contains(x, ',') AND (contains(x, '，') OR NOT starts_with(x, '问题'))")})
SELECT doc_id, kind, entry_no, md5(entry) AS entry_md5 FROM u
UNION ALL SELECT doc_id, 'jsonl', entry_no, md5(q || '|' || a) FROM pairs""")
def parse_generated(spark, sf_dir):
    made = responses(spark, sf_dir)
    out = None
    for kind, df in made.items():
        rows = ingestion.parse_generated(df, kind, "doc_id").withColumn("kind", F.lit(kind))
        if kind == "jsonl":  # JSON text differs between writers, so compare what it says
            content = lambda i: F.get_json_object("entry", f"$.messages[{i}].content")
            rows = rows.withColumn("entry", F.concat(content(1), F.lit("|"), content(2)))
        out = rows if out is None else out.unionByName(rows)
    return out.select("doc_id", "kind", "entry_no", _md5("entry").alias("entry_md5"))


@register("generated_pairs", f"""
WITH {_PAIRS_SQL}
SELECT doc_id, entry_no, q AS question, md5('用户问题：' || q || ' 客服回答：' || a) AS text_md5, 'generated' AS category,
  1 AS status FROM pairs""")
def generated_pairs(spark, sf_dir):
    entries = ingestion.parse_generated(responses(spark, sf_dir)["jsonl"], "jsonl", "doc_id")
    lines = parse_chat_lines(entries.withColumnRenamed("entry", "line"))
    return ingestion.generated_to_qa(lines, keep=("doc_id", "entry_no")).select(
        "doc_id", "entry_no", "question", _md5("qa_text").alias("text_md5"), "category", "status")


BUDGET = 0.05  # currency units per language: 100,000 tokens

_CALLS_SQL = """
c AS (SELECT doc_id, lang AS kind, (length(source) + length(lang)) // 2 AS it, length(text) // 2 AS ot FROM documents),
u AS (SELECT *, sum(it + ot) OVER (PARTITION BY kind ORDER BY doc_id) - (it + ot) AS before FROM c),
made AS (SELECT * FROM u WHERE before < 100000)"""


def _made(spark, sf_dir):
    calls = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("kind"), F.concat("source", "lang").alias("prompt"),
        F.col("text").alias("response"))
    return ingestion.budget_cutoff(calls, ["kind"], "doc_id", F.floor(F.col("doc_id") / 4096), BUDGET)


@register("budget_cutoff", f"WITH {_CALLS_SQL} SELECT doc_id, kind, it + ot AS tokens, before + it + ot AS used_tokens "
                           "FROM made")
def budget_cutoff(spark, sf_dir):
    return _made(spark, sf_dir).select("doc_id", "kind", "tokens", "used_tokens")


@register("generation_cost", f"""
WITH {_CALLS_SQL} SELECT kind, count(*) AS calls, sum(it)::BIGINT AS input_tokens, sum(ot)::BIGINT AS output_tokens,
  round(sum(it + ot)::DOUBLE * 0.5::DOUBLE / 1000000, 9) AS estimated_cost FROM made GROUP BY kind""")
def generation_cost(spark, sf_dir):
    return ingestion.cost_summary(_made(spark, sf_dir), ["kind"]).withColumn(
        "estimated_cost", F.round("estimated_cost", 9))
