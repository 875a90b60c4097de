"""Documents and chat logs into chunks, question/answer pairs and status rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from retrievo.functions.text import (QUESTION_CHARS, clean_text, generation_tokens, is_blank, let, qa_text, strip)
from retrievo.operators.documents import CHUNK_OVERLAP, CHUNK_SIZE, chunks
from retrievo.operators.embedding import hashed_embedding
from retrievo.operators.ordered import running_total
from retrievo.sources.index import require_writable, write_chunks
from retrievo.sources.readers import SUPPORTED_TYPES, document_text
from retrievo.staging import stage

ERROR_CHARS = 1000
MIN_MESSAGES = 3
PRICE_PER_MILLION = 0.5
# Fixed value: system message of a generated chat line.
GENERATED_SYSTEM_PROMPT = "你是一个专业的电商客服助手"
GENERATED_CATEGORY = "generated"
GENERATED_SOURCE = "generated/data_generator"


def ingest_documents(docs: DataFrame, embed=None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
                     ) -> tuple[DataFrame, DataFrame]:
    """Chunk rows and status rows of documents (doc_id, file_name, file_type, raw).

    A document that cannot be processed gets status FAILED and its error; the others are not affected. The status has
    one row per document and comes from the document's own row, without a shuffle.
    """
    cut = _cut_documents(docs, size, overlap)
    return _chunk_rows(cut, embed), _status_rows(cut)


def _cut_documents(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Each document's row with its error or its chunks instead of the raw text."""
    error = (F.when(~F.col("file_type").isin(*SUPPORTED_TYPES),
                    F.concat(F.lit("Unsupported file type: "), F.col("file_type")))
             .when(is_blank(F.col("raw")), F.lit("text is blank")))
    read = docs.withColumn("error_message", F.substring(error, 1, ERROR_CHARS))
    return read.select("doc_id", "file_name", "file_type", "error_message", F.when(
        F.col("error_message").isNull(),
        chunks(document_text(F.col("file_type"), F.col("raw")), size, overlap))
        .otherwise(F.array().cast("array<string>")).alias("_chunks"))


def _status_rows(cut: DataFrame) -> DataFrame:
    return cut.select(
        "doc_id", "file_name", "file_type",
        F.when(F.col("error_message").isNull(), "COMPLETED").otherwise("FAILED").alias("processing_status"),
        F.size("_chunks").alias("chunk_count"), "error_message")


def _chunk_rows(cut: DataFrame, embed) -> DataFrame:
    rows = cut.select("doc_id", "file_name", F.size("_chunks").alias("total_chunks"),
                      F.posexplode("_chunks").alias("chunk_index", "content")).withColumn(
        "char_count", F.length("content"))
    return rows if embed is None else embed(rows, "content", "embedding")


def ingest_index(docs: DataFrame, path: str, embed=hashed_embedding, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                 read_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Ingest documents into ``path/chunks`` and ``path/status`` and return both as written.

    Each chunk has the ``chunk_id`` that searches name, its text and its vector; a chunk without a vector is kept, as words
    still find it. Documents are read and parsed once; both tables come from their staged chunks.
    """
    require_writable(read_only)
    cut = stage(_cut_documents(docs, size, overlap), "cut_documents")
    rows, status = _chunk_rows(cut, embed), _status_rows(cut)
    rows = rows.withColumn("chunk_id", F.concat_ws("#", "file_name", F.col("chunk_index").cast("string")))
    write_chunks(rows, f"{path}/chunks", read_only=read_only)
    status.write.mode("append").parquet(f"{path}/status")
    spark = docs.sparkSession
    return spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/status")


def category_of(file_name: Column) -> Column:
    """train, dev or test when the name of the file, without its folders, contains the word, else general."""
    file_name = F.regexp_extract(file_name, r"[^/\\\\]*$", 0)
    out = F.lit("general")
    for word in ("test", "dev", "train"):
        out = F.when(F.contains(file_name, F.lit(word)), F.lit(word)).otherwise(out)
    return out


def _last(messages: Column, role: str) -> Column:
    """Content of the role's last message; empty without one."""
    return F.coalesce(F.get(F.reverse(F.filter(messages, lambda m: m["role"] == role)), 0)["content"], F.lit(""))


def judged_lines(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every parsed chat line (file_name, messages, bad) with its pair, or with the ``reason`` why it has none."""
    user, answer = _last(F.col("messages"), "user"), _last(F.col("messages"), "assistant")
    reason = (F.when(F.col("bad"), "malformed")
              .when(F.col("messages").isNull() | (F.size("messages") < MIN_MESSAGES), "too few messages")
              .when(F.exists("messages", lambda m: m["role"].isNull()), "malformed")
              .when(user == "", "empty question"))
    question = clean_text(user)
    return lines.withColumn("reason", reason).select(
        *keep, "file_name", "reason", question.alias("_q"), clean_text(answer).alias("answer"),
        _last(F.col("messages"), "system").alias("system_prompt"), category_of(F.col("file_name")).alias("category")).select(
        *keep, "file_name", "reason", F.substring("_q", 1, QUESTION_CHARS).alias("question"), "answer",
        qa_text(F.col("_q"), F.col("answer")).alias("qa_text"), "system_prompt", "category")


def extract_qa(lines: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Question/answer pairs and rejects from parsed chat lines (file_name, messages, bad)."""
    judged = judged_lines(lines, keep)
    good = judged.filter(F.col("reason").isNull()).select(
        *keep, "question", "answer", "qa_text", "system_prompt", "category", F.col("file_name").alias("source_file"))
    return good, judged.filter(F.col("reason").isNotNull()).select(*keep, "file_name", "reason")


def extract_qa_from_messages(messages: DataFrame, keys: list[str], order: str = "turn", role: str = "role",
                             content: str = "text") -> DataFrame:
    """Pairs straight from message rows, one conversation per key; nothing is gathered into lists.

    A conversation of any length folds into its message count and its last user and assistant messages before the
    shuffle.
    """
    newest = lambda r: F.max(F.when(F.col(role) == r, F.struct(F.col(order), F.coalesce(F.col(content), F.lit(""))
                                                               .alias("c"))))
    folded = messages.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), newest("user").alias("_u"),
                                         newest("assistant").alias("_a"))
    user = F.coalesce("_u.c", F.lit(""))
    return folded.filter((F.col("n") >= MIN_MESSAGES) & (user != "")).select(
        *keys, clean_text(user).alias("_q"), clean_text(F.col("_a.c")).alias("answer")).select(
        *keys, F.substring("_q", 1, QUESTION_CHARS).alias("question"), "answer",
        qa_text(F.col("_q"), F.col("answer")).alias("qa_text"))


def import_counts(lines: DataFrame) -> DataFrame:
    """Success, failure and total per file, each line counted once."""
    good, bad = extract_qa(lines)
    each = good.select(F.col("source_file").alias("file_name"), F.lit(1).alias("ok")).unionByName(
        bad.select("file_name", F.lit(0).alias("ok")))
    return each.groupBy("file_name").agg(
        F.sum("ok").alias("success_count"), F.sum(1 - F.col("ok")).alias("fail_count"),
        F.count(F.lit(1)).alias("total"))


def import_by_file(lines: DataFrame) -> DataFrame:
    """Counts per file in import order: train, dev, test, then the rest."""
    order = F.when(category_of(F.col("file_name")) == "train", 1).when(
        category_of(F.col("file_name")) == "dev", 2).when(category_of(F.col("file_name")) == "test", 3).otherwise(4)
    return import_counts(lines).withColumn("step", order).withColumn(
        "success_pct", F.round(100.0 * F.col("success_count") / F.col("total"), 2))


def preview(pairs: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First ``n`` pairs with the length of their text, and the total count."""
    total = pairs.agg(F.count(F.lit(1)).alias("t")).select("t").scalar()
    return pairs.orderBy(*order).limit(n).withColumn("qa_text_length", F.length("qa_text")).withColumn(
        "total", total)


def generated_entries(response: Column, kind: str) -> Column:
    """Usable entries of one model response of the given format; jsonl entries are chat lines."""
    parts = lambda sep: F.transform(F.split(response, sep), strip)
    if kind == "faq":
        return F.filter(parts("\n---\n"), lambda b: b.rlike("^Q[:：]"))
    if kind == "dialogue":
        return F.filter(parts("\n---\n"), lambda b: F.contains(b, F.lit("User:")) & F.contains(b, F.lit("Assistant:")))
    if kind == "article":
        return F.filter(parts("\n===\n"), lambda b: F.startswith(b, F.lit("#")))
    if kind == "csv":
        return F.filter(parts("\n"), lambda b: F.contains(b, F.lit(",")) & (
            F.contains(b, F.lit("，")) | ~F.startswith(b, F.lit("问题"))))
    if kind == "jsonl":
        return F.transform(generated_pairs(response), lambda p: F.to_json(F.struct(F.array(
            F.struct(F.lit("system").alias("role"), F.lit(GENERATED_SYSTEM_PROMPT).alias("content")),
            F.struct(F.lit("user").alias("role"), p["question"].alias("content")),
            F.struct(F.lit("assistant").alias("role"), p["answer"].alias("content"))).alias("messages"))))
    raise ValueError(f"unknown format: {kind}")


def generated_pairs(response: Column) -> Column:
    """Cleaned pairs of a JSON array, fenced or not; pairs with a blank side are dropped."""
    body = let(strip(response), lambda r: F.when(
        F.startswith(r, F.lit("```")), F.regexp_extract(r, r"(?s)(\[.*\])", 1)).otherwise(r))
    pairs = F.coalesce(F.from_json(body, "array<struct<question:string,answer:string>>"),
                       F.array().cast("array<struct<question:string,answer:string>>"))
    cleaned = F.transform(pairs, lambda p: F.struct(clean_text(p["question"]).alias("question"),
                                                    clean_text(p["answer"]).alias("answer")))
    return F.filter(cleaned, lambda p: (p["question"] != "") & (p["answer"] != ""))


def parse_generated(df: DataFrame, kind: str, key: str, response: str = "response") -> DataFrame:
    """One row per entry: the key, entry number and text."""
    return df.select(key, F.posexplode(generated_entries(F.col(response), kind)).alias("_i", "entry")).select(
        key, (F.col("_i") + 1).alias("entry_no"), "entry")


def max_tokens(budget: float, price_per_million: float = PRICE_PER_MILLION) -> int:
    return int(budget / price_per_million * 1_000_000)


def budget_cutoff(calls: DataFrame, keys: list[str], order: str, bucket: Column, budget: float,
                  price_per_million: float = PRICE_PER_MILLION) -> DataFrame:
    """Calls made before the budget ran out: the tokens used so far are checked before each call.

    ``calls`` has prompt and response text; ``bucket`` cuts the call order into ranges (see ``running_total``).
    """
    costed = calls.withColumn("input_tokens", generation_tokens(F.col("prompt"))).withColumn(
        "output_tokens", generation_tokens(F.col("response"))).withColumn(
        "tokens", F.col("input_tokens") + F.col("output_tokens"))
    used = running_total(costed, keys, [order], bucket, F.col("tokens"), "used_tokens")
    return used.filter(F.col("used_tokens") - F.col("tokens") < max_tokens(budget, price_per_million))


def cost_summary(made: DataFrame, keys: list[str], price_per_million: float = PRICE_PER_MILLION) -> DataFrame:
    return made.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens")).withColumn(
        "estimated_cost", (F.col("input_tokens") + F.col("output_tokens")) * price_per_million / 1_000_000)


def generated_to_qa(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pair rows from generated chat lines (messages, bad): both sides must have text, which is kept as it is."""
    user, answer = _last(F.col("messages"), "user"), _last(F.col("messages"), "assistant")
    ok = ~F.col("bad") & (F.size("messages") >= MIN_MESSAGES) & (user != "") & (answer != "")
    return lines.filter(ok).select(
        *keep, user.alias("question"), answer.alias("answer"),
        F.concat(F.lit("用户问题："), user, F.lit(" 客服回答："), answer).alias("qa_text"),
        F.lit(GENERATED_CATEGORY).alias("category"), F.lit(GENERATED_SOURCE).alias("source_file"),
        F.lit(1).alias("status"))
