"""Structured inputs that Spark derives row by row from the shared tables, with the SQL of the same derivation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# each starts at a line start, so a long last line is tried once
_TWO = r"^([^\n]+)\n+([^\n]+)"
_THREE = r"^([^\n]+)\n+([^\n]+)\n+([^\n]+)"

# kind -> (pattern, replacement with \1 groups, text before)
_SHAPES = {
    "faq": (_TWO, "Q: \\1\nA: \\2\n---", ""),
    "dialogue": (_TWO, "User: \\1\nAssistant: \\2\n---", ""),
    "article": (_THREE, "# \\1\n## 类别: \\2\n\\3\n===", ""),
    "csv": (_TWO, "\\1，\\2,类别", "question,answer,category\n"),
}


def shaped(col: Column, kind: str) -> Column:
    pattern, replacement, before = _SHAPES[kind]
    return F.concat(F.lit(before), F.regexp_replace(col, "(?md)" + pattern, replacement.replace("\\", "$")))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def shaped_sql(expr: str, kind: str) -> str:
    pattern, replacement, before = _SHAPES[kind]
    return f"({_literal(before)} || regexp_replace({expr}, {_literal("(?m)" + pattern)}, {_literal(replacement)}, 'g'))"


def mixed(col: Column) -> Column:
    return F.concat(shaped(col, "faq"), F.lit("\n\n"), shaped(col, "article"), F.lit("\n\n"), shaped(col, "dialogue"))


def mixed_sql(expr: str) -> str:
    nl = _literal("\n\n")
    return (f"({shaped_sql(expr, 'faq')} || {nl} || {shaped_sql(expr, 'article')} || {nl} || "
            f"{shaped_sql(expr, 'dialogue')})")
