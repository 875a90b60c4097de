"""Keyword extraction and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from retrievo.functions.text import normalize, windows

# Default stop words.
STOP_WORDS = (
    "请", "帮我", "麻烦", "一下", "一下子", "详细", "简单", "告诉我", "可以吗", "能不能",
    "帮忙", "这个", "那个", "这些", "那些", "一下吧", "请问", "给我", "谢谢",
    "关于", "相关", "问题", "内容", "一下呢", "帮我看", "帮我想", "帮我做", "帮我写",
)

# Default domain terms.
DOMAIN_TERMS = (
    "RAG", "Milvus", "BM25", "RRF", "embedding", "Embedding", "召回", "检索", "向量",
    "缓存", "路由", "改写", "验证", "多跳", "对比", "区别", "原因", "流程", "原理",
    "数据", "文档", "上下文", "多路", "融合", "阈值", "语义", "模型", "搜索", "知识",
    "答案", "配置", "参数", "评估", "延迟", "命中率", "准确率", "精确率", "召回率",
)

DEFAULT_MAX_KEYWORDS = 8


def literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def contained(text: Column, patterns: Sequence[str]) -> Column:
    """The patterns that occur in the text, in list order; case-sensitive."""
    return F.filter(literal_array(patterns), lambda p: F.contains(text, p))


def _not_stop(token: Column, stop: Sequence[str]) -> Column:
    return ~(token.isin(*stop) | F.lower(token).isin(*stop)) if stop else F.lit(True)


def extract_keywords(col: Column, limit: int = DEFAULT_MAX_KEYWORDS, domain_terms: Sequence[str] = DOMAIN_TERMS,
                     stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """First ``limit`` distinct keywords: domain terms, then tokens each followed by its 2-4 character windows.

    Every kept token is itself a keyword, so the first ``limit`` distinct tokens decide the result and the windows of
    later tokens of a long text are never built.
    """
    norm = normalize(col)
    cleaned = F.regexp_replace(norm, r"[\p{Punct}\p{IsPunctuation}]+", " ")
    tokens = F.slice(F.array_distinct(F.filter(
        F.split(cleaned, r"\s+"), lambda t: (F.length(t) >= 2) & _not_stop(t, stop_words))), 1, limit)
    expanded = F.flatten(F.transform(
        tokens,
        lambda t: F.concat(
            F.array(t),
            F.when(F.length(t) >= 4, F.filter(
                F.concat(windows(t, 2), windows(t, 3), windows(t, 4)), lambda w: _not_stop(w, stop_words)))
            .otherwise(F.array().cast("array<string>")),
        ),
    ))
    found = F.slice(F.array_distinct(F.concat(contained(norm, domain_terms), expanded)), 1, limit)
    return (F.when(norm == "", F.array().cast("array<string>"))
            .when(F.size(found) == 0, F.array(norm)).otherwise(found))


def matched(keywords: Column, text: Column) -> Column:
    """Keywords contained in the text, upper and lower case alike."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(keywords, lambda k: F.contains(low, F.lower(k)))


def missing(keywords: Column, text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(keywords, lambda k: ~F.contains(low, F.lower(k)))


def coverage(keywords: Column, text: Column) -> Column:
    """Share of the keywords that occur in the text; 0 without keywords."""
    return F.when(F.size(keywords) > 0, F.size(matched(keywords, text)) / F.size(keywords)).otherwise(F.lit(0.0))


def contains_any(text: Column, keywords: Column) -> Column:
    return F.size(matched(keywords, text)) > 0
