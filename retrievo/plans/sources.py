"""Queries over sources, sinks and keyed lookups."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from retrievo.operators import documents
from retrievo.operators.ordered import spans
from retrievo.plans import sqltext as q
from retrievo.plans.registry import register, table
from retrievo.plans.text import _format_sql
from retrievo.sources import index, readers

# file names that the language of a document gives it; German ones have a type without a parser
FILE_NAME_SQL = ("'doc-' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.md' WHEN 'de' THEN '.pdf' "
                 "WHEN 'es' THEN '.v2.TXT' ELSE '' END")


def named_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("file_name", F.expr(FILE_NAME_SQL)).withColumn(
        "file_type", readers.file_type(F.col("file_name")))


_TYPE_SQL = "CASE WHEN contains(file_name, '.') THEN lower(string_split(file_name, '.')[-1]) ELSE 'unknown' END"


@register("doc_source", f"""
WITH d AS (SELECT *, {FILE_NAME_SQL} AS file_name FROM documents),
t AS (SELECT *, {_TYPE_SQL} AS file_type FROM d)
SELECT doc_id, file_name, file_type, CASE WHEN file_type = 'txt' AND regexp_replace(text, '\\s+', '', 'g') = '' THEN 0
  WHEN file_type <> 'txt' OR {_format_sql('text')} = 'PLAIN' THEN length(text) END AS n_chars FROM t""")
def doc_source(spark, sf_dir):
    docs = named_documents(spark, sf_dir)
    parsed = readers.document_text(F.col("file_type"), F.col("text"))
    return docs.select("doc_id", "file_name", "file_type", F.length(parsed).alias("n_chars"))


# One chat line per message: the message with the two before it. First turns give a cut-off line, eighth turns a blank
# one; the file follows from the conversation.
CHAT_SQL = """
w AS (SELECT conv_id, turn, role, text, lag(role, 1) OVER o AS r1, lag(text, 1) OVER o AS t1,
    lag(role, 2) OVER o AS r2, lag(text, 2) OVER o AS t2, CASE conv_id % 4 WHEN 0 THEN 'train.jsonl'
    WHEN 1 THEN 'dev.jsonl' WHEN 2 THEN 'test.jsonl' ELSE 'chat.jsonl' END AS file_name
  FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
chat AS (SELECT *, turn = 0 AS bad, 1 + (r1 IS NOT NULL)::INT + (r2 IS NOT NULL)::INT AS n_messages,
    coalesce(CASE WHEN role = 'user' THEN text END, CASE WHEN r1 = 'user' THEN t1 END,
      CASE WHEN r2 = 'user' THEN t2 END, '') AS u,
    coalesce(CASE WHEN role = 'assistant' THEN text END, CASE WHEN r1 = 'assistant' THEN t1 END,
      CASE WHEN r2 = 'assistant' THEN t2 END, '') AS a
  FROM w WHERE turn <> 7)"""


def chat_lines(spark, sf_dir):
    conv = spans(table(spark, sf_dir, "conversations"), "turn", 1024, 2)
    o = Window.partitionBy("conv_id", "span").orderBy("turn")
    message = F.struct("role", F.col("text").alias("content"))
    messages = F.array_compact(F.array(F.lag(message, 2).over(o), F.lag(message, 1).over(o), message))
    full = F.to_json(F.struct(messages.alias("messages")))
    line = (F.when(F.col("turn") == 0, F.expr("left(_full, length(_full) - 1)"))
            .when(F.col("turn") == 7, F.lit("  ")).otherwise(F.col("_full")))
    name = F.element_at(F.array(*[F.lit(f"{n}.jsonl") for n in ("train", "dev", "test", "chat")]),
                        (F.col("conv_id") % 4 + 1).cast("int"))
    return conv.select("conv_id", "turn", name.alias("file_name"), full.alias("_full"), "copied").filter(
        "NOT copied").select(
        "conv_id", "turn", "file_name", line.alias("line"))


def parsed_chat(spark, sf_dir):
    return readers.parse_chat_lines(chat_lines(spark, sf_dir))


@register("chat_jsonl_scan", f"""
WITH {CHAT_SQL}
SELECT conv_id, turn, file_name, bad, CASE WHEN NOT bad THEN n_messages END AS n_messages,
  CASE WHEN NOT bad THEN role END AS last_role FROM chat""")
def chat_jsonl_scan(spark, sf_dir):
    last = F.get(F.reverse("messages"), 0)["role"]
    return parsed_chat(spark, sf_dir).select(
        "conv_id", "turn", "file_name", "bad",
        F.when(~F.col("bad"), F.size("messages")).alias("n_messages"), F.when(~F.col("bad"), last).alias("last_role"))


_RAW_IDS = """CASE WHEN turn % 3 = 0 THEN '["' || conv_id || '", " ' || turn || ' ", "' || conv_id || '", ""]'
  WHEN turn % 3 = 1 THEN conv_id || '|' || turn || '| |' || conv_id ELSE conv_id || '; ' || turn || ';;x' END"""


@register("qrels_decode", """
SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN CASE WHEN conv_id = turn THEN conv_id || ',x'
    ELSE conv_id || ',' || turn || ',x' END
  WHEN conv_id = turn THEN conv_id::VARCHAR ELSE conv_id || ',' || turn END AS ids FROM conversations""")
def qrels_decode(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(readers.decode_ids(F.expr(_RAW_IDS)), ",").alias("ids"))


_CHUNKS = f"""
w AS (SELECT doc_id, list_filter(string_split({q.clean('text')}, ' '), lambda x: x <> '') AS ws FROM documents),
per AS (SELECT doc_id, greatest(ceil((len(ws) - 20) / 180), 1)::BIGINT AS n_chunks FROM w WHERE len(ws) > 0)"""


@register("chunks_per_document", f"WITH {_CHUNKS} SELECT doc_id, n_chunks FROM per")
def chunks_per_document(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return index.count_chunks(documents.chunk_text(docs, 200, 20))


@register("chunks_after_delete", f"""
WITH {_CHUNKS} SELECT doc_id, n_chunks FROM per WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def chunks_after_delete(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1")
    return index.count_chunks(index.delete_documents(documents.chunk_text(docs, 200, 20), toxic))


# Index input: languages differ in which of the fields are filled; Spanish ids carry a prefix and are rejected.
_FIELDS = """doc_id, CASE lang WHEN 'es' THEN 'p' || doc_id ELSE CAST(doc_id AS VARCHAR(20)) END AS qa_pair_id, text,
  CASE lang WHEN 'en' THEN text ELSE ' ' END AS question,
  CASE lang WHEN 'de' THEN 'Frage ' || source END AS query,
  CASE lang WHEN 'fr' THEN text || text ELSE '' END AS answer, CASE WHEN lang <> 'de' THEN source END AS category"""
_NONBLANK = lambda c: f"CASE WHEN regexp_replace({c}, '\\s+', '', 'g') <> '' THEN {c} END"
INDEX_SQL = f"""
f AS (SELECT {_FIELDS} FROM documents),
idx AS (SELECT substring(coalesce({_NONBLANK('question')}, {_NONBLANK('query')}, {_NONBLANK('text')}, body), 1, 1024)
    AS question, substring(coalesce({_NONBLANK('answer')}, body), 1, 2048) AS answer, body AS qa_text,
    qa_pair_id::BIGINT AS qa_pair_id, substring(coalesce({_NONBLANK('category')}, 'document'), 1, 100) AS category
  FROM (SELECT *, substring(text, 1, 3072) AS body FROM f) WHERE regexp_full_match(qa_pair_id, '[+-]?[0-9]+'))"""


def index_input(spark, sf_dir):
    fields = _FIELDS.replace("CAST(doc_id AS VARCHAR(20))", "CAST(doc_id AS STRING)")
    return table(spark, sf_dir, "documents").selectExpr(
        *[f.strip() for f in _split_columns(fields)], "CAST(NULL AS ARRAY<FLOAT>) AS embedding", "0L AS ts")


def _split_columns(text: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


@register("qa_index_rows", f"""
WITH {INDEX_SQL}
SELECT qa_pair_id, category, md5(question) AS question_md5, length(answer) AS answer_chars, md5(qa_text) AS text_md5
FROM idx""")
def qa_index_rows(spark, sf_dir):
    rows, _ = index.shape_index_rows(index_input(spark, sf_dir))
    md5 = lambda c: F.md5(F.col(c).cast("binary"))
    return rows.select("qa_pair_id", "category", md5("question").alias("question_md5"),
                       F.length("answer").alias("answer_chars"), md5("qa_text").alias("text_md5"))


@register("corpus_fetch", f"""
WITH {INDEX_SQL}
SELECT qa_pair_id::VARCHAR AS id, md5(coalesce({_NONBLANK('qa_text')}, {_NONBLANK('answer')}, {_NONBLANK('question')}))
  AS content_md5, category FROM idx
WHERE coalesce({_NONBLANK('qa_text')}, {_NONBLANK('answer')}, {_NONBLANK('question')}) IS NOT NULL""")
def corpus_fetch(spark, sf_dir):
    rows, _ = index.shape_index_rows(index_input(spark, sf_dir))
    corpus = index.fetch_corpus(rows.withColumn("id", F.lit(None).cast("long")))
    return corpus.select("id", F.md5(F.col("content").cast("binary")).alias("content_md5"),
                         F.col("metadata")["category"].alias("category"))


_REPORTS = """
SELECT CASE WHEN event_type = 'signup' THEN 'notes-' || ms || '.json' ELSE 'rag-evaluation-' || ms || '.json' END
  AS file_name, ts AS modified_at, CASE WHEN event_type = 'error' THEN 'cut off ' || props ELSE props END AS payload"""


@register("report_history", f"""
WITH r AS ({_REPORTS} FROM (SELECT *, (epoch_us(ts) // 1000)::VARCHAR AS ms FROM events)),
n AS (SELECT * FROM r WHERE regexp_matches(file_name, '^rag-evaluation-\\d{{13}}(?:-[0-9a-fA-F-]{{36}})?\\.json$')
  ORDER BY modified_at DESC, file_name LIMIT 50)
SELECT file_name, modified_at FROM n WHERE json_valid(payload)""")
def report_history(spark, sf_dir):
    src = table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")).cast("string"))
    reports = spark.sql(_REPORTS + " FROM {src}", src=src)
    return index.report_history(reports, 50).select("file_name", "modified_at")


@register("session_messages", """
SELECT conv_id, turn, role, length(text) AS n_chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position
FROM conversations""")
def session_messages(spark, sf_dir):
    return index.session_messages(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", "role", F.length("text").alias("n_chars"), "position")
