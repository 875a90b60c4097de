"""Structured text formats: question/answer blocks, dialogues, articles, comma-separated pairs, and mixes of them.

Each parser is a Column function from text to an array of structs, so a document is parsed where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from retrievo.functions.text import is_blank, let, strip

# Markers of the formats.
FAQ_MARKS = ("Q:", "Q：")
USER_MARKS = ("User:", "用户：", "顾客：", "客户：")
AGENT_MARKS = ("Assistant:", "客服：", "助手：")
USER_ROLE = "顾客"
AGENT_ROLE = "客服"
RULE_MARK = "---"
ARTICLE_MARK = "==="

FORMAT_SHARE = 0.5
MIXED_SHARE = 0.1

_ENTRY = "struct<question:string,answer:string>"
_TURN = "struct<role:string,text:string>"
_ARTICLE = "struct<title:string,category:string,keywords:string,body:string>"
_PAIR = "struct<question:string,answer:string,category:string>"


def _starts(col: Column, marks) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.startswith(col, F.lit(m))
    return out


def lines(col: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(col, "\n"), strip), lambda t: t != "")


def significant_lines(col: Column) -> Column:
    """The lines that ``format_of`` judges: all but those that separate articles."""
    return F.filter(lines(col), lambda t: ~F.startswith(t, F.lit(ARTICLE_MARK)))


def detect_format(col: Column, ignore_rules: bool = False) -> Column:
    """FAQ, CONVERSATION, ARTICLE, CSV, MIXED or PLAIN by the share of marked lines."""
    return format_of(significant_lines(col), ignore_rules)


def format_of(significant: Column, ignore_rules: bool = False) -> Column:
    """The format of a text by its significant lines; ``ignore_rules`` leaves separator lines of dashes out of the count."""
    def decide(rows: Column) -> Column:
        total = F.size(rows)
        share = lambda test: F.size(F.filter(rows, test)) / total
        shares = F.array(
            share(lambda t: _starts(t, FAQ_MARKS)),
            share(lambda t: _starts(t, USER_MARKS)),
            share(lambda t: F.startswith(t, F.lit("# "))),
            share(lambda t: F.contains(t, F.lit(",")) & t.rlike(r"\p{IsHan}")),
        )
        names = ("FAQ", "CONVERSATION", "ARTICLE", "CSV")

        def name(s: Column) -> Column:
            out = F.when(F.size(F.filter(s, lambda x: x > MIXED_SHARE)) >= 2, F.lit("MIXED")).otherwise(F.lit("PLAIN"))
            for i in reversed(range(4)):
                out = F.when(s[i] >= FORMAT_SHARE, F.lit(names[i])).otherwise(out)
            return out

        return F.when(total == 0, F.lit("PLAIN")).otherwise(let(shares, name))

    if ignore_rules:
        significant = F.filter(significant, lambda t: t != RULE_MARK)
    return let(significant, decide)


def _blocks(col: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(col, separator), strip), lambda b: b != "")


def faq_entries(col: Column) -> Column:
    """Question and answer of each block that has both marks."""
    field = lambda b, mark: strip(F.regexp_extract(b, mark + r"[：:](.*)", 1))
    return F.transform(
        F.filter(_blocks(col, "\n---\n"), lambda b: b.rlike("Q[：:]") & b.rlike("A[：:]")),
        lambda b: F.struct(field(b, "Q").alias("question"), field(b, "A").alias("answer")),
    )


def _turn(line: Column) -> Column:
    return F.struct(
        F.when(_starts(line, USER_MARKS), F.lit(USER_ROLE)).otherwise(F.lit(AGENT_ROLE)).alias("role"),
        strip(F.regexp_replace(line, r"^[^:：]*[:：]", "")).alias("text"),
    )


def dialogues(col: Column) -> Column:
    """Turns of each block that has two or more marked lines."""
    return F.filter(
        F.transform(
            _blocks(col, "\n---\n"),
            lambda b: F.transform(F.filter(lines(b), lambda t: _starts(t, USER_MARKS + AGENT_MARKS)), _turn)),
        lambda turns: F.size(turns) >= 2,
    )


def articles(col: Column) -> Column:
    """Title, category, keywords and body of each block that has a title and a body."""
    found = lambda b, p: F.when(b.rlike(p), strip(F.regexp_extract(b, p, 1)))
    body = lambda b: strip(F.array_join(F.filter(
        lines(b), lambda t: ~_starts(t, ("# ", "## ", ARTICLE_MARK))), " "))
    return F.filter(
        F.transform(_blocks(col, "\n===\n"), lambda b: F.struct(
            found(b, "# (.+)").alias("title"), found(b, r"## 类别[：:]\s*(.+)").alias("category"),
            found(b, r"## 关键词[：:]\s*(.+)").alias("keywords"), body(b).alias("body"))),
        lambda a: a["title"].isNotNull() & ~is_blank(a["body"]),
    )


def csv_pairs(col: Column) -> Column:
    """Question, answer and category of comma-separated lines; a header line comes first or not at all."""
    def body(rows: Column) -> Column:
        return F.when(_starts(rows[0], ("question", "问题")), F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))) \
            .otherwise(rows)

    fields = F.transform(let(lines(col), body), lambda t: F.split(F.regexp_replace(t, "[，,]+$", ""), "[，,]"))
    return F.transform(
        F.filter(fields, lambda f: (F.size(f) >= 2) & (strip(F.get(f, 0)) != "") & (strip(F.get(f, 1)) != "")),
        lambda f: F.struct(strip(F.get(f, 0)).alias("question"), strip(F.get(f, 1)).alias("answer"),
                           strip(F.get(f, 2)).alias("category")),
    )


def _render(items: Column, original: Column, one) -> Column:
    """Numbered text of the parsed items, or the original text where nothing was parsed."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, one), "")).otherwise(original)


def _labelled(label: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(label), value, F.lit("\n"))).otherwise(F.lit(""))


def _head(label: str, i: Column) -> Column:
    return F.concat(F.lit(f"{label}-"), (i + 1).cast("string"), F.lit(":\n"))


def render_faq(col: Column) -> Column:
    return let(faq_entries(col), lambda e: _render(e, col, lambda x, i: F.concat(
        _head("FAQ", i), _labelled("问题：", x["question"]), _labelled("回答：", x["answer"]), F.lit("\n"))))


def render_dialogues(col: Column) -> Column:
    return let(dialogues(col), lambda e: _render(e, col, lambda x, i: F.concat(
        _head("对话", i),
        F.array_join(F.transform(x, lambda t: F.concat(t["role"], F.lit("："), t["text"], F.lit("\n"))), ""),
        F.lit("\n"))))


def render_articles(col: Column) -> Column:
    return let(articles(col), lambda e: _render(e, col, lambda x, i: F.concat(
        _head("文章", i), _labelled("标题：", x["title"]), _labelled("类别：", x["category"]),
        _labelled("关键词：", x["keywords"]), _labelled("内容：", x["body"]), F.lit("\n"))))


def render_csv(col: Column) -> Column:
    return let(csv_pairs(col), lambda e: _render(e, col, lambda x, i: F.concat(
        _head("CSV-QA", i), _labelled("问题：", x["question"]), _labelled("回答：", x["answer"]),
        _labelled("类别：", x["category"]), F.lit("\n"))))


def _by_format(fmt: Column, col: Column) -> Column:
    return (F.when(fmt == "FAQ", render_faq(col)).when(fmt == "CONVERSATION", render_dialogues(col))
            .when(fmt == "ARTICLE", render_articles(col)).when(fmt == "CSV", render_csv(col)).otherwise(col))


def mixed_blocks(col: Column) -> Column:
    """Format and text of each block that has more than two lines once parsed."""
    blocks = F.filter(_blocks(col, "\n\n+|\n---\n|\n===\n"), lambda b: ~F.startswith(b, F.lit(ARTICLE_MARK)))
    parsed = F.transform(blocks, lambda b: let(detect_format(b), lambda f: F.struct(
        f.alias("format"), _by_format(f, b).alias("content"))))
    return F.filter(parsed, lambda p: F.size(F.split(F.regexp_replace(p["content"], "\n+$", ""), "\n")) > 2)


def structured_text(col: Column) -> Column:
    """The text that is chunked: each format in its numbered form, plain text as it is, blank text empty."""
    mixed = let(mixed_blocks(col), lambda m: F.when(
        F.size(m) > 0, F.array_join(F.transform(m, lambda p: F.concat(p["content"], F.lit("\n"))), "")).otherwise(col))
    return F.when(is_blank(col), F.lit("")).otherwise(
        let(detect_format(col), lambda f: F.when(f == "MIXED", mixed).otherwise(_by_format(f, col))))
