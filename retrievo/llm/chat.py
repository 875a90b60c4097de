"""Chat formatting with Spark expressions only, and reading formatted conversations back.

A conversation is one string: ``<s>``, then for each run of turns of one role ``[INST]``, the role, a line end, the
texts with ``</s>`` between them, and ``[/INST]``. The characters that begin a control string, and the escape character,
are escaped in roles and texts, so no text can form one, and what is read back is what was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, TURN, BETWEEN, END = "<s>", "[INST]", "</s>", "[/INST]"
#: escape sequences in the order in which they are applied; undone in reverse
_ESCAPES = [("\\", "\\b"), ("[", "\\o"), ("<", "\\l")]
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, code in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _role_out(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_mask``: spans (``start`` from 0, ``length``) of the assistant's texts.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are not read. Turns stand by ``turn``,
    null first; of equal numbers the smaller role, then the smaller text goes first, and repeated rows are repeated
    turns. Null roles and texts are empty. Rows without a ``conv_id`` are one conversation. A conversation is one row of
    the result, so its turns meet in one task; nothing else does.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    n = F.size("turns")
    heads = F.filter(F.sequence(F.lit(0), n - 1),
                     lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    said = said.withColumn("heads", heads)
    runs = F.transform("heads", lambda h, k: F.struct(
        F.get("turns", h)["role"].alias("role"),
        F.transform(F.slice("turns", h + 1, F.coalesce(F.get("heads", k + 1), n) - h),
                    lambda t: escape(t["text"])).alias("texts")))
    piece = lambda text, learned: F.struct(text.alias("text"), learned.alias("learned"))
    no = F.lit(False)
    pieces = F.flatten(F.transform(runs, lambda r: F.concat(
        F.array(piece(F.concat(F.lit(TURN), _role_out(r["role"]), F.lit("\n")), no)),
        F.flatten(F.transform(r["texts"], lambda t, i: F.when(
            i == 0, F.array(piece(t, r["role"] == LEARNED_ROLE))).otherwise(
            F.array(piece(F.lit(BETWEEN), no), piece(t, r["role"] == LEARNED_ROLE))))),
        F.array(piece(F.lit(END), no)))))
    said = said.select("conv_id", F.concat(F.array(piece(F.lit(BEGIN), no)), pieces).alias("pieces"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>")
                     .alias("spans"))
    walked = F.aggregate("pieces", start, lambda s, p: F.struct(
        (s["at"] + F.char_length(p["text"])).alias("at"),
        F.when(p["learned"], F.concat(s["spans"], F.array(F.struct(
            s["at"].alias("start"), F.char_length(p["text"]).cast("long").alias("length"))))).otherwise(s["spans"])
        .alias("spans")), lambda s: s["spans"])
    return said.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
                       walked.alias("loss_mask"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """``conv_id``, ``turns`` (array of role and text) and ``loss_text``, read from ``formatted`` and ``loss_mask``."""
    body = F.substring(F.col("formatted"), F.lit(len(BEGIN) + 1), F.char_length("formatted"))
    runs = F.transform(F.filter(F.split(body, r"\[INST\]"), lambda r: r != ""),
                       lambda r: F.substring(r, F.lit(1), F.char_length(r) - len(END)))
    turns = F.flatten(F.transform(runs, lambda r: F.transform(
        F.split(F.substring(r, F.locate("\n", r) + 1, F.char_length(r)), BETWEEN),
        lambda t: F.struct(_role_in(F.substring_index(r, "\n", 1)).alias("role"), unescape(t).alias("text")))))
    learned = F.transform("loss_mask", lambda s: unescape(
        F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("*", turns.alias("turns"), F.array_join(learned, "").alias("loss_text"))
