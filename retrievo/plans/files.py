"""Queries over real files: documents in several shapes are written as text files, read, parsed, ingested and searched."""

from __future__ import annotations

from pyspark.sql import functions as F

from retrievo.operators import documents, evaluation, fusion, ingestion
from retrievo.operators.embedding import hashed_embedding
from retrievo.plans import derived as d, sqltext as q
from retrievo.plans.registry import register, table
from retrievo.plans.text import parsed_ctes
from retrievo.sources import readers
from retrievo.sources.files import write_text_files
from retrievo.staging import new_stage_path

KINDS = ("faq", "dialogue", "article", "csv", "mixed", "plain", "md", "pdf")
_NAME = f"CASE doc_id % {len(KINDS)} WHEN 6 THEN 'd' || doc_id || '.MD' WHEN 7 THEN 'd' || doc_id || '.pdf' " \
        "ELSE 'd' || doc_id || '.txt' END"
_TYPE = f"CASE doc_id % {len(KINDS)} WHEN 6 THEN 'md' WHEN 7 THEN 'pdf' ELSE 'txt' END"
_BODY_SQL = f"CASE doc_id % {len(KINDS)} " + " ".join(
    f"WHEN {i} THEN {d.mixed_sql('text') if k == 'mixed' else d.shaped_sql('text', k)}" for i, k in enumerate(KINDS[:5])) \
    + " ELSE text END"
_FILES_SQL = f"SELECT doc_id, {_NAME} AS file_name, {_TYPE} AS file_type, {_BODY_SQL} AS body FROM documents"


FOLDERS = 1024  # that a table's files are dealt over


def _written(spark, sf_dir) -> str:
    """The folder with one file for each document, in folders below it; its shape follows from its id."""
    body, text = F.col("text"), F.col("text")
    for i, kind in enumerate(KINDS[:5]):
        shaped = d.mixed(text) if kind == "mixed" else d.shaped(text, kind)
        body = F.when(F.col("doc_id") % len(KINDS) == i, shaped).otherwise(body)
    folder = f"{new_stage_path(spark, 'files')}/in"
    write_text_files(table(spark, sf_dir, "documents").select(F.expr(_NAME).alias("file_name"), body.alias("text")), folder,
                     folders=FOLDERS)
    return folder


_PARSED = parsed_ctes(f"SELECT file_name AS k, body FROM ({_FILES_SQL}) WHERE body <> '' AND file_type = 'txt'")


@register("read_files", f"""
WITH {_PARSED}, files AS ({_FILES_SQL})
SELECT file_name, file_type, length(t) AS n_chars, md5(t) AS text_md5 FROM (
  SELECT file_name, file_type, coalesce(text, body) AS t FROM files LEFT JOIN parsed ON k = file_name
  WHERE body <> '' AND file_type <> 'pdf')""")
def read_files(spark, sf_dir):
    """The text of every file with a parser, as it is read back."""
    found = readers.read_text_documents(spark, _written(spark, sf_dir))
    return found.select("file_name", "file_type", F.length("text").alias("n_chars"),
                        F.md5(F.col("text").cast("binary")).alias("text_md5"))


SIZE, OVERLAP = 60, 10
_CHUNKS = f"""{_PARSED}, files AS ({_FILES_SQL}),
texts AS (SELECT file_name, file_type, body, coalesce(text, body) AS t FROM files LEFT JOIN parsed ON k = file_name
  WHERE body <> ''),
judged AS (SELECT *, CASE WHEN file_type = 'pdf' THEN 'Unsupported file type: pdf'
  WHEN regexp_replace(body, '\\s+', '', 'g') = '' THEN 'text is blank' END AS error_message,
  list_filter(string_split({q.clean('t')}, ' '), lambda x: x <> '') AS ws FROM texts),
cut AS (SELECT *, CASE WHEN error_message IS NULL AND len(ws) > 0
  THEN greatest(ceil((len(ws) - {OVERLAP}) / {SIZE - OVERLAP}.0), 1)::BIGINT ELSE 0 END AS n_chunks FROM judged),
chunk AS MATERIALIZED (SELECT file_name || '#' || i AS doc_id,
    array_to_string(list_slice(ws, i * {SIZE - OVERLAP} + 1, i * {SIZE - OVERLAP} + {SIZE}), ' ') AS text
  FROM (SELECT *, unnest(range(n_chunks)) AS i FROM cut))"""


def _ingested(spark, sf_dir):
    folder = _written(spark, sf_dir)
    path = new_stage_path(spark, "ingested")
    return ingestion.ingest_index(readers.read_raw_documents(spark, folder), path, hashed_embedding, SIZE, OVERLAP)


@register("ingest_files", f"""
WITH {_CHUNKS}
SELECT file_name, file_type, CASE WHEN error_message IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS processing_status,
  n_chunks AS chunk_count, error_message FROM cut""")
def ingest_files(spark, sf_dir):
    """The status of every file's ingest, with the chunks that its parsed text gives."""
    _, status = _ingested(spark, sf_dir)
    return status.drop("doc_id").withColumn("chunk_count", F.col("chunk_count").cast("long"))


def _vectors_sql(rows: str) -> str:
    """id, embedding of a select with id and text: unit vectors of hashed terms; none for a text without terms."""
    weights = _weights_sql(rows)
    return f"""(SELECT s.id, list(coalesce((w / size)::REAL, 0) ORDER BY b.bucket) AS embedding
  FROM (SELECT id, sqrt(sum(w * w)) AS size FROM ({weights}) GROUP BY id) s CROSS JOIN range(64) b(bucket)
  LEFT JOIN ({weights}) w ON w.id = s.id AND w.bucket = b.bucket GROUP BY s.id)"""


def _weights_sql(rows: str) -> str:
    return (f"SELECT id, bucket, ln(1 + count(*)) AS w FROM (SELECT id, ('0x' || md5(t)[1:8])::BIGINT % 64 AS bucket "
            f"FROM (SELECT id, unnest({q.tokens('text')}) AS t FROM ({rows}))) GROUP BY ALL")


_ASKED = _vectors_sql("SELECT item_id AS id, text FROM benchmark")
_INDEXED = _vectors_sql("SELECT doc_id AS id, text FROM chunk")


@register("ingest_search", f"""
WITH {_CHUNKS}, asked_v AS MATERIALIZED (SELECT id AS query_id, embedding FROM {_ASKED}),
chunk_v AS MATERIALIZED (SELECT id AS doc_id, embedding FROM {_INDEXED}),
{q.bm25_ctes(docs="SELECT doc_id, text FROM chunk")}, {q.lexical_top(20)},
{q.vector_ctes(0.3, 20, asks="SELECT * FROM asked_v", index="SELECT * FROM chunk_v")}, {q.fused(5)}
SELECT query_id, doc_id AS chunk_id, round(rrf_score, 9) AS rrf_score, vector_rank, bm25_rank, retrieval_source, rank
FROM fused""")
def ingest_search(spark, sf_dir):
    """From files to answers: parse, chunk, embed, write the index, and search it with words and vectors."""
    chunks, _ = _ingested(spark, sf_dir)
    index = chunks.select(F.col("chunk_id").alias("doc_id"), "embedding")
    corpus = chunks.select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text"))
    asked = hashed_embedding(table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query")
    hits = fusion.hybrid_search(index, asked, fusion.SearchOptions(5, 0.3, True), corpus=corpus)
    return hits.withColumnRenamed("doc_id", "chunk_id").withColumn("rrf_score", F.round("rrf_score", 9))


@register("recursive_chunks")
def recursive_chunks(spark, sf_dir):
    """Chunks by paragraphs, lines, sentences, words and characters; tests compare them with a plain version."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.chunk_recursive(docs, 100, 10).select(
        "doc_id", "chunk_index", "total_chunks", F.md5(F.col("content").cast("binary")).alias("content_md5"), "char_count")


_CASES = """SELECT item_id, 'Question ' || item_id || ', "' || text[1:60] || '"' AS question,
  '["' || item_id || '", " ' || item_id % 7 || ' "]' AS as_json, item_id || '|' || item_id % 7 || '|' AS as_list,
  CASE WHEN item_id % 3 <> 0 THEN 'kind ' || item_id % 3 END AS category FROM benchmark"""
_IDS = "CASE WHEN item_id = item_id % 7 THEN item_id::VARCHAR ELSE item_id || ',' || item_id % 7 END"


def _cases(spark, sf_dir):
    item = F.col("item_id")
    seventh = (item % 7).cast("string")
    category = F.when(item % 3 != 0, F.concat(F.lit("kind "), (item % 3).cast("string")))
    return table(spark, sf_dir, "benchmark").select(
        "item_id", F.concat(F.lit("Question "), item.cast("string"), F.lit(', "'), F.substring("text", 1, 60), F.lit('"')).alias("question"),
        F.concat(F.lit('["'), item.cast("string"), F.lit('", " '), seventh, F.lit(' "]')).alias("as_json"),
        F.concat(item.cast("string"), F.lit("|"), seventh, F.lit("|")).alias("as_list"), category.alias("category"))


def _read_back(cases):
    return cases.select(F.md5(F.col("question").cast("binary")).alias("question_md5"),
                        F.array_join("relevant_ids", ",").alias("ids"), "category")


@register("eval_json_cases", f"""
SELECT md5(question) AS question_md5, item_id || ', ' || item_id % 7 || ' ' AS ids, category FROM ({_CASES})""")
def eval_json_cases(spark, sf_dir):
    """Evaluation cases written as files with a JSON array each and read back as they are; cleaning the ids is a step of
    its own."""
    path = f"{new_stage_path(spark, 'cases')}.json"
    ids = F.from_json("as_json", "array<string>").alias("relevantDocIds")
    cases = _cases(spark, sf_dir).select(F.concat("item_id", F.lit(".json")).alias("file_name"), F.to_json(
        F.array(F.struct("question", ids, "category")), {"pretty": "true"}).alias("text"))
    write_text_files(cases, path)
    return _read_back(readers.read_qrels(spark, path))


@register("eval_csv_cases", f"SELECT md5(question) AS question_md5, {_IDS} AS ids, category FROM ({_CASES})")
def eval_csv_cases(spark, sf_dir):
    """Evaluation cases written as quoted CSV with other column names, quotes and commas, and read back."""
    path = f"{new_stage_path(spark, 'cases')}.csv"
    _cases(spark, sf_dir).select(F.col("question").alias("Question"), F.col("as_list").alias("relevant_doc_ids"),
                                 F.col("category").alias("type")).write.csv(path, header=True, quote='"', escape='"')
    return _read_back(readers.read_qrels(spark, path))


@register("redacted_reports", """
SELECT doc_id, 'set-' || doc_id || '.json' AS dataset_source, 'run of dataset=<private>, size=' || n_chars || ', ok' AS summary
FROM documents""")
def redacted_reports(spark, sf_dir):
    """Reports that name a private dataset, as they may be shown."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("/data/"), "lang", F.lit("\\\\x/set-"), "doc_id", F.lit(".json")).alias("dataset_source"),
        F.concat(F.lit("run of dataset=/data/"), "lang", F.lit("/"), "source", F.lit(", size="), "n_chars",
                 F.lit(", ok")).alias("summary"))
    return evaluation.redact(rows)
