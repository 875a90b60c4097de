"""Ad-hoc SELECT over an allow-list of tables.

Three layers: a walk over the statement's lexemes, a session of its own that holds only the allowed views, and a row limit
around the statement. The walk knows where a relation must stand, also in comma lists, nested joins and subqueries, and
refuses what it cannot place: quoted names, comments, substitutions, names of other relations and functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

MAX_ROWS = 100
# Tables that may be queried by default.
ALLOWED_TABLES = ("conversations", "messages", "documents", "document_chunks", "users", "ecommerce_qa_pairs",
                  "ecommerce_feedback", "message_classify_log", "vision_analysis_cache")
# Statements that are refused wherever the word stands.
FORBIDDEN = ("insert", "update", "delete", "drop", "alter", "truncate", "create", "grant", "revoke", "merge", "call",
             "execute", "for update")
# words that may stand before a parenthesis without being a function
_SYNTAX = frozenset("""in exists and or not on as over from where join select when then else case by having union
    intersect except all any some distinct values using lateral filter within with rollup cube sets between like
    interval limit is group""".split())
FUNCTIONS = frozenset("""abs avg bround cast ceil ceiling char_length coalesce concat concat_ws contains corr count
    count_if date date_add date_diff date_format date_sub date_trunc datediff day dayofmonth dayofweek dayofyear
    decimal dense_rank div endswith exp extract first first_value floor format_number from_unixtime get_json_object
    greatest grouping grouping_id hour if ifnull initcap instr isnull isnotnull json_array_length lag last last_day
    last_value lead least left length ln locate log log10 lower lpad ltrim max max_by mean median min min_by minute mod
    month months_between mode now ntile nth_value nullif nvl nvl2 percent_rank percentile percentile_approx
    percentile_cont percentile_disc pmod position pow power quarter rank regexp_extract regexp_like regexp_replace
    repeat replace reverse right round row_number rpad rtrim second sign size split split_part sqrt startswith std
    stddev stddev_pop stddev_samp string substr substring substring_index sum timestamp to_date to_timestamp trim
    trunc try_cast typeof unix_timestamp upper var_pop var_samp variance weekofyear year cume_dist approx_count_distinct
    bigint double int boolean varchar current_date current_timestamp""".split())
_CONFS = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled")


class RejectedSql(ValueError):
    """The statement is not allowed."""


_LEXEME = re.compile(r"""
    (?P<space>\s+)
  | (?P<comment>--|/\*|\*/|\#)
  | (?P<text>'(?:[^'\\]|'')*')
  | (?P<name>[a-z_][a-z0-9_]*(?:\s*\.\s*[a-z_][a-z0-9_]*)*)
  | (?P<number>\d+(?:\.\d*)?(?:e[+-]?\d+)?|\.\d+)
  | (?P<sign><=>|<>|!=|>=|<=|\|\||[()+\-*/%,=<>.])
""", re.VERBOSE)
# words that end the list of relations of a SELECT
_AFTER_FROM = frozenset("where group having order limit union intersect except select window sort cluster distribute".split())


def _lexemes(statement: str) -> list[tuple[str, str]]:
    """Kind and text of every lexeme; names are lower-cased and their dots stand without spaces."""
    low, at, out = statement.lower(), 0, []
    while at < len(low):
        m = _LEXEME.match(low, at)
        if m is None:
            raise RejectedSql(f"unexpected character {statement[at]!r} at {at}")
        kind = m.lastgroup
        if kind == "comment":
            raise RejectedSql(f"a comment begins at {at}")
        if kind != "space":
            out.append((kind, re.sub(r"\s*\.\s*", ".", m.group()) if kind == "name" else m.group()))
        at = m.end()
    return out


class _Frame:
    """What stands between two parentheses, or the whole statement."""

    def __init__(self, wants: bool = False):
        self.selects = False   # it has a SELECT of its own, so FROM names relations
        self.listing = False   # inside the list of relations
        self.wants = wants     # the next name is a relation


def relations(lexemes: list[tuple[str, str]]) -> list[str]:
    """Names that stand where a relation must: after FROM and JOIN, and after the commas of their list."""
    found, frames = [], [_Frame()]
    for place, (kind, text) in enumerate(lexemes):
        frame, before = frames[-1], lexemes[place - 1][1] if place else ""
        if text == "(" and kind == "sign":
            frames.append(_Frame(frame.wants))
            frame.wants = False
        elif text == ")" and kind == "sign":
            if len(frames) == 1:
                raise RejectedSql("a parenthesis is closed that was not opened")
            frames.pop()
        elif kind == "sign" and text == ",":
            frame.wants = frame.listing
        elif kind != "name":
            if frame.wants:
                raise RejectedSql(f"{text} stands where a relation must")
        elif text == "select":
            frame.selects, frame.listing, frame.wants = True, False, False
        elif text == "join" or (text == "from" and frame.selects and before != "distinct"):
            frame.listing = frame.wants = True
        elif frame.wants and text != "lateral":
            found.append(text)
            frame.wants = False
            frame.listing = True
        elif text in _AFTER_FROM:
            frame.listing = False
    if len(frames) > 1:
        raise RejectedSql("a parenthesis is not closed")
    return found


def check_select(sql: str | None, allowed: set[str], known: set[str] = frozenset(),
                 namespaces: set[str] = frozenset()) -> str:
    """The statement without semicolons at its end, or ``RejectedSql`` with the reason.

    ``known``: other relations that the session could resolve; ``namespaces``: database and catalog names.
    """
    statement = (sql or "").strip().rstrip("; \t\r\n")
    lexemes = _lexemes(statement)
    if not lexemes or lexemes[0] != ("name", "select"):
        raise RejectedSql("a statement must begin with SELECT")
    names = [(i, text) for i, (kind, text) in enumerate(lexemes) if kind == "name"]
    for i, text in names:
        parts = text.split(".")
        following = lexemes[i + 1][1] if i + 1 < len(lexemes) else ""
        for word in (*parts, f"{text} {following}"):
            if word in FORBIDDEN:
                raise RejectedSql(f"{word.upper()} may not stand in a statement")
        if following == "(" and text not in FUNCTIONS and text not in _SYNTAX:
            raise RejectedSql(f"{text} is none of the functions that may be called")
        if (parts[0] in namespaces if len(parts) > 1 else text in known):
            raise RejectedSql(f"{text} is out of reach")
    read = relations(lexemes)
    if not read:
        raise RejectedSql("no table is read")
    if other := [name for name in read if name not in allowed]:
        raise RejectedSql(f"tables that may not be read: {', '.join(other)}")
    return statement


def guarded_select(spark: SparkSession, sql: str, tables: dict[str, Callable[[SparkSession], DataFrame]],
                   max_rows: int = MAX_ROWS) -> DataFrame:
    """Run a SELECT over ``tables`` (name to loader) and return at most ``max_rows`` rows.

    Loaders run in a session of their own, so views of the caller's session cannot be reached.
    """
    session = spark.newSession()
    for conf in _CONFS:
        value = spark.conf.get(conf, None)
        if value is not None:
            session.conf.set(conf, value)
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    allowed = {name.lower() for name in tables}
    known = {t.name.lower() for t in session.catalog.listTables()} - allowed
    namespaces = ({d.name.lower() for d in session.catalog.listDatabases()}
                  | {c.name.lower() for c in session.catalog.listCatalogs()} | {"global_temp", "session", "system"})
    text = check_select(sql, allowed, known, namespaces)
    for name, load in tables.items():
        load(session).createOrReplaceTempView(name)
    return session.sql(f"SELECT * FROM ({text}) tool_query LIMIT {int(max_rows)}")


def render_rows(df: DataFrame) -> DataFrame:
    """Each row as ``name: value`` lines in one text column."""
    parts = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")), F.lit("\n"))
             for c in df.columns]
    return df.select(F.concat(*parts).alias("row"))


def render_header(n: int) -> str:
    return "No results found." if n == 0 else f"Found {n} results:\n\n"
