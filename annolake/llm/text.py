"""Column helpers that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return: what separates words.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN, -1))


def match_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>, in code points, end exclusive.

    The text between matches comes from ``split``, the matches from ``regexp_extract_all``; their lengths give the
    positions. The pattern must not match the empty string.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<start:bigint,end:bigint,value:string>>"
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(
        F.char_length(gap).cast("long").alias("gap"), hit.alias("hit")))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.char_length(pair["hit"]).cast("long")
        one = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(one)).alias("spans"))

    found = F.aggregate(pairs, empty, step, lambda state: state["spans"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(kind))
