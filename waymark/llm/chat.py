"""Conversations as one training text each, with the mask of what is learned.

A message is ``<turn>role<text>part<part>part</turn>`` and a line feed. Neighbouring turns of one
role are one message of several parts, so the turns can be read back. Inside roles and texts a
backslash becomes two and a mark gets one after its ``<``; the result then holds no mark of its
own, and ``unescape`` gives the text back exactly.

Defined cases: NULL role or text is empty; turns sort by (turn, role, text), NULL first; repeated
rows stay; a NULL ``conv_id`` is a conversation like any other; extra columns are ignored; no rows
give no rows. A conversation is one row of the result, so it has to fit into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import text_of

TURN, TEXT, PART, END = "<turn>", "<text>", "<part>", "</turn>\n"
LEARNED = "assistant"
_MARK = r"<(turn>|text>|part>|/turn>)"
_ESCAPED = r"\\(\\|turn>|text>|part>|/turn>)"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), _MARK, r"<\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, "$1")


def format_conversations(conversations: DataFrame, learned: str = LEARNED) -> DataFrame:
    """conv_id, formatted, loss_spans: array of (start, length) in code points of ``formatted``.

    One shuffle, of the rows by ``conv_id``.
    """
    turn = F.struct(
        F.col("turn"), escape(text_of("role")).alias("role"), escape(text_of("text")).alias("text")
    )
    sorted_turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def lead_in(t: Column, i: Column) -> Column:
        before = F.get(F.col("turns"), i - 1)["role"]
        opening = F.concat(F.lit(TURN), t["role"], F.lit(TEXT))
        return F.when(i == 0, opening).when(before == t["role"], F.lit(PART)).otherwise(
            F.concat(F.lit(END), opening)
        )

    pieces = sorted_turns.select(
        "conv_id",
        F.transform("turns", lambda t, i: F.struct(
            lead_in(t, i).alias("head"), t["text"].alias("text"), (t["role"] == learned).alias("learned"),
        )).alias("pieces"),
    )
    formatted = F.concat(
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"])), ""), F.lit(END)
    )
    start = F.struct(
        F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,length:int>>)").alias("spans")
    )

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        span = F.struct(begin.alias("start"), F.length(p["text"]).alias("length"))
        return F.struct(
            (begin + F.length(p["text"])).alias("at"),
            F.when(p["learned"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return pieces.select(
        "conv_id",
        formatted.alias("formatted"),
        F.aggregate("pieces", start, step, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and loss_text, both taken from the formatted text alone."""
    messages = F.split(F.col("formatted"), END, -1)

    def turns_of(m: Column) -> Column:
        role = unescape(F.substring_index(F.substr(m, F.lit(len(TURN) + 1)), TEXT, 1))
        body = F.substr(m, F.instr(m, TEXT) + len(TEXT))
        return F.transform(
            F.split(body, PART, -1), lambda p: F.struct(role.alias("role"), unescape(p).alias("text"))
        )

    turns = F.flatten(F.transform(F.filter(messages, lambda m: m != ""), turns_of))
    under_mask = F.transform(
        "loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))
    )
    return formatted.withColumns({"turns": turns, "loss_text": F.array_join(under_mask, "")})
