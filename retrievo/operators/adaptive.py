"""Adaptive retrieval for a batch of questions: route, rewrite, retrieve, verify, and repeat where needed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from retrievo.functions.keywords import (DEFAULT_MAX_KEYWORDS, DOMAIN_TERMS, STOP_WORDS, contained, contains_any,
                                         extract_keywords, literal_array, missing)
from retrievo.functions.text import let, normalize
from retrievo.staging import stage

# Default route patterns.
DIRECT_PATTERNS = (
    "你好", "hello", "hi", "帮我写", "写一个", "生成", "润色", "翻译", "改写",
    "代码", "示例", "模板", "总结这段", "帮我做", "帮我想", "请帮我", "起草", "排版",
)
SINGLE_HOP_PATTERNS = (
    "是什么", "怎么", "哪里", "谁", "多少", "什么时候", "有哪些", "介绍", "说明",
    "流程", "步骤", "配置", "实现", "评估", "召回", "检索", "缓存", "参数", "阈值",
)
MULTI_HOP_PATTERNS = (
    "对比", "区别", "优缺点", "为什么", "原因", "影响", "关系", "联系", "结合",
    "多跳", "如何同时", "如何结合", "方案", "总结", "链路", "演进", "比较",
)
ACTION_WORDS = ("帮我", "写", "生成", "润色", "翻译", "代码")
# Keywords a route adds to the query.
MULTI_HOP_BOOSTERS = ("对比", "关系", "原因", "流程", "多跳")
SINGLE_HOP_BOOSTERS = ("事实", "文档", "答案")

SHORT_QUESTION = 8
MAX_ROUNDS = 2
MAX_QUERY_KEYWORDS = 10
VERIFY_THRESHOLD = 0.18
MULTI_HOP_THRESHOLD = 0.28
MAX_CONTEXT_CHUNKS = 5
TOP_K = 5


@dataclass(frozen=True)
class Language:
    """Pattern and word lists; they depend on the language of the questions."""

    direct: Sequence[str] = DIRECT_PATTERNS
    single: Sequence[str] = SINGLE_HOP_PATTERNS
    multi: Sequence[str] = MULTI_HOP_PATTERNS
    action: Sequence[str] = ACTION_WORDS
    multi_boosters: Sequence[str] = MULTI_HOP_BOOSTERS
    single_boosters: Sequence[str] = SINGLE_HOP_BOOSTERS
    domain_terms: Sequence[str] = DOMAIN_TERMS
    stop_words: Sequence[str] = STOP_WORDS


# Fixed value: the reason given where no route is decided.
BYPASSED = "adaptive rag disabled or direct answer route"


def route(questions: DataFrame, language: Language = Language(), max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Add route_type, route_reason, route_confidence and planned_rounds to questions (query_id, query)."""
    def decide(text: Column) -> Column:
        found = F.struct(contained(text, language.direct).alias("d"), contained(text, language.single).alias("s"),
                         contained(text, language.multi).alias("m"))
        short = F.length(text) <= SHORT_QUESTION
        bonus = short.cast("int") + F.when(contains_any(text, literal_array(language.action)), 2).otherwise(0)

        def judge(f: Column) -> Column:
            d, s, m = F.size(f["d"]) + bonus, F.size(f["s"]), F.size(f["m"])
            multi, single = (m > 0) & (m >= s), s > 0
            reasons = (F.when(multi, F.concat(f["m"], f["s"])).when(single, f["s"])
                       .when(d > 0, F.concat(f["d"], F.when(short, literal_array(["short question"]))
                                             .otherwise(literal_array([]))))
                       .otherwise(literal_array(["fallback to direct answer"])))
            top = F.greatest(d, s, m)
            return F.struct(
                F.when(multi, "MULTI_HOP").when(single, "SINGLE_HOP").otherwise("DIRECT_ANSWER").alias("route_type"),
                F.when(F.size(reasons) == 0, "heuristic route").otherwise(F.array_join(reasons, ", "))
                .alias("route_reason"),
                F.when(top == 0, 0.75).otherwise(F.least(F.lit(1.0), 0.35 + top * 0.2)).alias("route_confidence"),
                F.when(multi, max_rounds).when(single, 1).otherwise(0).alias("planned_rounds"))

        blank = F.struct(F.lit("DIRECT_ANSWER").alias("route_type"), F.lit("empty question").alias("route_reason"),
                         F.lit(1.0).alias("route_confidence"), F.lit(0).alias("planned_rounds"))
        return F.when(text == "", blank).otherwise(let(found, judge))

    decided = questions.withColumn("_route", let(normalize(F.col("query")), decide))
    return decided.select(*questions.columns, "_route.*")


def rewrite(routed: DataFrame, language: Language = Language(), limit: int = MAX_QUERY_KEYWORDS,
            max_keywords: int = DEFAULT_MAX_KEYWORDS) -> DataFrame:
    """Add keywords, rewritten_query, changed and rewrite_reason.

    From the second round on, the input has the previous round's ``prev_missing`` keywords and ``prev_reason``.
    """
    norm = normalize(F.col("query"))
    boost = (F.when(F.col("route_type") == "MULTI_HOP", literal_array(language.multi_boosters))
             .when(F.col("route_type") == "SINGLE_HOP", literal_array(language.single_boosters))
             .otherwise(literal_array([])))
    parts = [extract_keywords(norm, max_keywords, language.domain_terms, language.stop_words)]
    again = "prev_missing" in routed.columns
    if again:
        parts.append(F.coalesce("prev_missing", literal_array([])))
    kept = F.slice(F.array_distinct(F.concat(*parts, boost)), 1, limit)
    out = routed.withColumn("keywords", kept).withColumn("_joined", F.array_join("keywords", " "))
    empty = normalize(F.col("_joined")) == ""
    reason = F.when(F.col("prev_reason").isNotNull(), F.concat(F.lit("feedback rewrite: "), F.col("prev_reason"))) \
        .otherwise("initial rewrite") if again else F.lit("initial rewrite")
    return (out.withColumn("rewritten_query", F.when(empty, norm).otherwise(F.col("_joined")))
            .withColumn("keywords", F.when(empty, F.array(norm)).otherwise(F.col("keywords")))
            .withColumn("changed", F.col("rewritten_query") != norm)
            .withColumn("rewrite_reason", reason).drop("_joined"))


def verify(rewritten: DataFrame, chunks: DataFrame, threshold: float = VERIFY_THRESHOLD,
           multi_threshold: float = MULTI_HOP_THRESHOLD) -> DataFrame:
    """Add the verification of each question's retrieved chunks.

    ``rewritten``: query_id, keywords, route_type. ``chunks``: query_id, rank, score, content. A keyword matches
    case-sensitively; it is missing when it is in none of the matched keywords, upper and lower case alike.
    """
    pairs = chunks.filter(F.col("content").isNotNull()).select("query_id", "rank", "score", "content").join(
        rewritten.select("query_id", "keywords"), "query_id")
    each = pairs.select("query_id", "rank", "score", F.size("keywords").alias("_n"), F.filter(
        "keywords", lambda k: F.contains("content", k)).alias("_hit")).filter(F.size("_hit") > 0)
    share = F.size("_hit") / F.col("_n") + F.least(F.lit(0.1), F.greatest("score", F.lit(0.0)) * 0.05)
    summed = each.groupBy("query_id").agg(  # at most top_k chunks per question
        F.count(F.lit(1)).alias("relevant_chunks"), F.sum(share).alias("_sum"),
        F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rank", "_hit"))),
                                               lambda x: x["_hit"]))).alias("matched"))
    out = rewritten.join(summed, "query_id", "left").withColumn(
        "matched", F.coalesce("matched", literal_array([]))).withColumn(
        "relevant_chunks", F.coalesce("relevant_chunks", F.lit(0)))
    base = F.size("matched") / F.greatest(F.size("keywords"), F.lit(1))
    score = F.round(F.greatest(base, F.least(F.lit(1.0), F.coalesce("_sum", F.lit(0.0)))), 9)
    multi = F.col("route_type") == "MULTI_HOP"
    limit = F.when(multi, multi_threshold).otherwise(threshold)
    got = F.col("verification_score")
    high = (got >= limit) & (~multi | (F.col("relevant_chunks") >= 2) | (got >= limit + 0.08))
    return (out.withColumn("verification_score", score)
            .withColumn("verification_level", F.when(F.size("matched") == 0, "NONE").when(high, "HIGH")
                        .when(got >= limit / 2, "MEDIUM").otherwise("LOW"))
            .withColumn("missing", missing(F.col("keywords"), F.array_join("matched", " ")))
            .withColumn("verification_reason", F.when(F.size("keywords") == 0, "no verification keywords").otherwise(
                F.format_string("matched=%d, missing=%d, chunks=%d", F.size("matched"), F.size("missing"),
                                F.col("relevant_chunks"))))
            .drop("_sum"))


_CHUNK = ("doc_id", "rank", "score", "retrieval_source", "vector_rank", "bm25_rank", "rrf_score")


def _with_columns(hits: DataFrame) -> DataFrame:
    for name, kind in (("retrieval_source", "string"), ("vector_rank", "int"), ("bm25_rank", "int"),
                       ("rrf_score", "double")):
        if name not in hits.columns:
            hits = hits.withColumn(name, F.lit(None).cast(kind))
    return hits


def adaptive_rag(questions: DataFrame, retriever: Callable[[DataFrame], DataFrame], language: Language = Language(),
                 max_rounds: int = MAX_ROUNDS, threshold: float = VERIFY_THRESHOLD,
                 multi_threshold: float = MULTI_HOP_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Resolve questions (query_id, query) in at most ``max_rounds`` rounds. Returns contexts and round traces.

    ``retriever`` takes (query_id, query) and returns ranked chunks: query_id, doc_id, rank, score, content. A question
    leaves the loop once its verification is HIGH; the others go into the next round with their missing keywords. Each
    round is one staged table, so a later round starts from stored rows.
    """
    routed = stage(route(questions, language, max_rounds), "routed")
    todo = routed.filter("route_type <> 'DIRECT_ANSWER'")
    traces = None
    for number in range(1, max(1, max_rounds) + 1):
        asked = stage(rewrite(todo, language), "rewritten")
        hits = stage(_with_columns(retriever(asked.select("query_id", F.col("rewritten_query").alias("query")))), "hits")
        checked = verify(asked, hits, threshold, multi_threshold)
        listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(
            "rank", *[c for c in _CHUNK if c != "rank"], "content"))).alias("chunks"))  # top_k rows per question
        last = number == max(1, max_rounds)
        high = F.col("verification_level") == "HIGH"
        done = stage(checked.join(listed, "query_id", "left").withColumn("round", F.lit(number)).withColumn(
            "chunk_count", F.greatest(F.coalesce(F.size("chunks"), F.lit(0)), F.lit(0))).withColumn(
            "terminal", high | F.lit(last)).withColumn(
            "terminal_reason", F.when(high, "verification_high").when(F.lit(last), "max_rounds_reached")
            .otherwise("verification_insufficient")).drop("prev_missing", "prev_reason"), "round")
        traces = done if traces is None else traces.unionByName(done)
        todo = done.filter("NOT terminal").select(
            *routed.columns, F.col("missing").alias("prev_missing"), F.col("verification_reason").alias("prev_reason"))
    return _contexts(routed, traces), traces


def _contexts(routed: DataFrame, traces: DataFrame) -> DataFrame:
    final = traces.filter("terminal").select(
        "query_id", "rewritten_query", "changed", "verification_level", "verification_score", "verification_reason",
        F.col("round").alias("retrieval_rounds"), "chunk_count", "chunks")
    direct = F.col("route_type") == "DIRECT_ANSWER"
    blank = normalize(F.col("query")) == ""  # bypasses the loop altogether
    end = (F.when(blank, "direct_answer_no_retrieval").when(direct, "direct_answer_route").when(F.col("verification_level") == "HIGH", "verification_high")
           .when(F.col("verification_level") == "NONE", "no_evidence").otherwise("max_rounds_reached_partial"))
    out = routed.join(final, "query_id", "left")
    return (out.withColumn("end_reason", end)
            .withColumn("used_adaptive", ~blank)
            .withColumn("route_reason", F.when(blank, BYPASSED).otherwise(F.col("route_reason")))
            .withColumn("verified", ~blank & (direct | (F.col("verification_level") != "NONE")))
            .withColumn("verification_level", F.coalesce("verification_level", F.lit("NONE")))
            .withColumn("verification_reason", F.coalesce(
                "verification_reason", F.when(blank, "skipped").otherwise("direct answer route")))
            .withColumn("rewritten_query", F.coalesce("rewritten_query", "query"))
            .withColumn("rewritten", F.coalesce("changed", F.lit(False)))
            .withColumn("retrieval_rounds", F.coalesce("retrieval_rounds", F.lit(0)))
            .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).drop("changed"))


def evidence(traces: DataFrame) -> DataFrame:
    """One row per question, round and retrieved chunk."""
    return traces.select("query_id", "round", "verification_level", F.explode("chunks").alias("_c")).select(
        "query_id", "round", "verification_level", *[f"_c.{c}" for c in _CHUNK])


def assemble_context(contexts: DataFrame, max_chunks: int = MAX_CONTEXT_CHUNKS) -> DataFrame:
    """The text handed to generation: query_id, context. Direct answers have an empty one."""
    listed = F.transform(F.slice(F.coalesce("chunks", F.array().cast(contexts.schema["chunks"].dataType)), 1, max_chunks),
                         lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c["content"], F.lit("\n")))
    body = F.concat(
        F.lit("Adaptive RAG route: "), "route_type", F.lit("\nRoute reason: "), "route_reason",
        F.lit("\nRewritten query: "), "rewritten_query", F.lit("\nVerification: "), "verification_level",
        F.lit(" (score="), F.format_string("%.2f", "verification_score"), F.lit(")\nRelevant reference information:\n"),
        F.array_join(listed, ""))
    return contexts.select("query_id", F.when(F.col("route_type") == "DIRECT_ANSWER", "").otherwise(body)
                           .alias("context"))


def response_source(df: DataFrame) -> DataFrame:
    """Add response_source to rows with use_rag, used_adaptive, route_type and chunk_count."""
    return df.withColumn("response_source", F.when(
        ~F.col("use_rag") | F.col("route_type").isNull() | ~F.coalesce("used_adaptive", F.lit(False)), "llm_direct")
        .when(F.col("route_type") == "DIRECT_ANSWER", "adaptive_direct_answer")
        .when(F.col("chunk_count") > 0, "adaptive_rag").otherwise("adaptive_rag_no_evidence"))
