"""Conversations as one training text each, with a loss mask, in DataFrame expressions only.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per block. A block is a run of adjacent turns of one role, merged with
``<|im_sep|>`` between their texts, so that every turn can be read back. Control strings inside roles and texts are
escaped: every ``<``, backslashes, ``|`` gains one backslash, hence no ``<|`` is left that the template did not write; a
line break inside a role becomes ``<|im_nl|>``. Reading takes the backslash away again.

A conversation is one output row, so its turns meet in one task; that size is bounded by what one string can hold.

Defined cases: null role and null text are empty; null turns come first; equal turns are ordered by role, then text, and
repeated rows all stay; a null conv_id is a conversation of its own; an empty table gives an empty table; columns other
than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEP, LINE = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|im_nl|>"
LEARNED_ROLE = "assistant"


def _escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _marker(text: str) -> str:
    return text.replace("|", r"\|")


def format_conversations(turns: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans array<struct<start, length>> in code points of formatted."""
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("_turn"),
    )
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    talks = talks.withColumn("_turns", F.transform("_turns", lambda t: F.struct(
        (t["role"] == F.lit(learned_role)).alias("learned"),
        F.replace(_escape(t["role"]), F.lit("\n"), F.lit(LINE)).alias("role"),
        _escape(t["text"]).alias("text"),
    )))
    at = F.col("_turns")
    # Where a run of one role starts; one past the last turn closes the last run.
    talks = talks.withColumn("_cuts", F.filter(
        F.sequence(F.lit(1), F.size(at) + 1),
        lambda i: (i == 1) | (i > F.size(at)) | (F.get(at, i - 1)["role"] != F.get(at, i - 2)["role"]),
    ))
    cuts = F.col("_cuts")
    talks = talks.withColumn("_blocks", F.transform(
        F.sequence(F.lit(0), F.size(cuts) - 2),
        lambda k: F.struct(
            F.get(at, F.get(cuts, k) - 1)["role"].alias("role"),
            F.get(at, F.get(cuts, k) - 1)["learned"].alias("learned"),
            F.transform(F.slice(at, F.get(cuts, k), F.get(cuts, k + 1) - F.get(cuts, k)), lambda t: t["text"]).alias("texts"),
        ),
    ))
    formatted = F.array_join(F.transform("_blocks", lambda b: F.concat(
        F.lit(START), b["role"], F.lit("\n"), F.array_join(b["texts"], SEP), F.lit(END + "\n"))), "")

    span_kind = "array<struct<start:bigint,length:bigint>>"
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span_kind).alias("spans"))

    def text_step(state: Column, text: Column) -> Column:
        size = F.char_length(text).cast("long")
        one = F.struct(state["at"].alias("start"), size.alias("length"))
        return F.struct((state["at"] + size + len(SEP)).alias("at"), F.concat(state["spans"], F.array(one)).alias("spans"))

    def block_step(state: Column, block: Column) -> Column:
        first = F.struct((state["at"] + len(START) + F.char_length(block["role"]) + 1).alias("at"), state["spans"].alias("spans"))
        after = F.aggregate(block["texts"], first, text_step)
        return F.struct(
            (after["at"] - len(SEP) + len(END) + 1).alias("at"),
            F.when(block["learned"], after["spans"]).otherwise(state["spans"]).alias("spans"),
        )

    return talks.select(
        "conv_id", formatted.alias("formatted"),
        F.aggregate("_blocks", begin, block_step, lambda s: s["spans"]).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, array<struct<role, text>>, in order and unescaped."""
    blocks = F.slice(
        F.split(formatted, _marker(END) + "\n", -1), F.lit(1),
        F.size(F.split(formatted, _marker(END) + "\n", -1)) - 1,
    )

    def turns(block: Column) -> Column:
        role = F.substring_index(F.substr(block, F.lit(len(START) + 1)), "\n", 1)
        body = F.substr(block, F.char_length(role) + len(START) + 2)
        plain = _unescape(F.replace(role, F.lit(LINE), F.lit("\n")))
        return F.transform(F.split(body, _marker(SEP), -1), lambda text: F.struct(plain.alias("role"), _unescape(text).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learned_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(loss_spans, lambda s: _unescape(
        F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
