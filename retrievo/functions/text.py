"""Text preparation as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Text layout of a question/answer record.
QA_QUESTION_PREFIX = "用户问题："
QA_ANSWER_PREFIX = " 客服回答："

# Length caps of the question/answer index.
QUESTION_CHARS = 1024
ANSWER_CHARS = 2048
QA_TEXT_CHARS = 3072
CATEGORY_CHARS = 100

_TRIM = "".join(map(chr, range(0x21)))


def strip(col: Column) -> Column:
    """Drop control characters and spaces at both ends."""
    return F.btrim(col, F.lit(_TRIM))


def is_blank(col: Column) -> Column:
    return col.isNull() | ~col.rlike(r"\S")


def clean_text(col: Column) -> Column:
    """Trim, collapse white space to one space; null becomes empty."""
    return F.coalesce(F.regexp_replace(strip(col), r"\s+", " "), F.lit(""))


def normalize(col: Column) -> Column:
    return F.when(is_blank(col), F.lit("")).otherwise(clean_text(col))


def windows(col: Column, size: int) -> Column:
    """All substrings of ``size`` characters in order; empty when the text is shorter."""
    return F.when(
        F.length(col) >= size,
        F.transform(F.sequence(F.lit(1), F.length(col) - size + 1), lambda i: F.substring(col, i, F.lit(size))),
    ).otherwise(F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _runs(low: Column) -> Column:
    """Tokens of lower-cased text that holds ideographs or characters that vanish without splitting a run."""
    spaced = F.regexp_replace(low, r"[\p{P}\p{S}\s]+", " ")
    kept = F.regexp_replace(spaced, r"[^\p{L}\p{Nd}\p{IsIdeographic} ]|[\x{10000}-\x{10FFFF}]", "")
    runs = F.regexp_extract_all(kept, F.lit(r"(\p{IsIdeographic}+|[^\p{IsIdeographic} ]+)"), 1)
    return F.flatten(F.transform(
        runs,
        lambda r: F.when(r.rlike(r"^\p{IsIdeographic}") & (F.length(r) > 1), windows(r, 2)).otherwise(F.array(r)),
    ))


def bm25_tokenize(col: Column) -> Column:
    """Lower-cased word tokens; runs of ideographs become overlapping pairs.

    Text of letters, digits, punctuation and spaces alone takes one split; only other text is cut into runs.
    """
    other = r"[^\p{L}\p{Nd}\p{P}\p{S}\s]|\p{IsIdeographic}|[\x{10000}-\x{10FFFF}]"
    return let(
        F.lower(F.coalesce(col, F.lit(""))),
        lambda low: F.when(low.rlike(other), _runs(low))
        .otherwise(F.array_remove(F.split(low, r"[\p{P}\p{S}\s]+"), "")),
    )


def memory_keywords(col: Column) -> Column:
    """Set of parts of two characters or more, with the 2-4 character windows of parts of four or more."""
    parts = F.transform(F.split(col, r"\s+|[,，。！？、】【；;：“”\"'（）()]"), strip)
    return F.array_distinct(F.flatten(F.transform(
        parts,
        lambda p: F.concat(
            F.when(F.length(p) >= 2, F.array(p)).otherwise(F.array().cast("array<string>")),
            F.when(F.length(p) >= 4, F.concat(windows(p, 2), windows(p, 3), windows(p, 4)))
            .otherwise(F.array().cast("array<string>")),
        ),
    )))


def qa_text(question: Column, answer: Column) -> Column:
    """The text that is embedded for a question/answer pair."""
    return F.substring(F.concat(F.lit(QA_QUESTION_PREFIX), question, F.lit(QA_ANSWER_PREFIX), answer),
                       1, QA_TEXT_CHARS)


def cache_key(prefix: str, col: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(col.cast("binary")))


def query_hash(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def fingerprint(name: Column, content: Column) -> Column:
    """``name#`` and the first 16 hex digits of the content's SHA-256."""
    return F.concat(name, F.lit("#"), F.substring(query_hash(content), 1, 16))


def search_key(query: Column, top_k: Column, threshold: Column, hybrid: Column) -> Column:
    """Cache key material of one search."""
    return F.concat(query, F.lit("|topK="), top_k.cast("string"), F.lit("|threshold="),
                    F.format_string("%.4f", threshold), F.lit("|hybrid="), hybrid.cast("string"))


def estimate_tokens(col: Column, rate: float = 1.0, overhead: int = 256) -> Column:
    """Admission estimate: characters times ``rate``, rounded up, plus the prompt overhead."""
    return F.lit(max(1, overhead)).cast("long") + F.ceil(F.length(col) * F.lit(max(rate, 0.01)))


def generation_tokens(col: Column) -> Column:
    """Cost estimate of model output: two characters per token."""
    return F.floor(F.length(col) / 2)


def truncate(col: Column, n: int, suffix: str = "...") -> Column:
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit(suffix))).otherwise(col)


def first_text(*cols: Column) -> Column:
    """First value that is not blank."""
    return F.coalesce(*[F.when(~is_blank(c), c) for c in cols])
