"""Secrets in texts: fixed patterns plus two character Markov models, in DataFrame expressions only.

Runs of 20 or more key characters, less what fixed patterns cover, are scored by the log-likelihood ratio of two first-order
character models, one of random strings, one of ordinary identifiers; a run that does not win whole is searched for stretches that do. Both are trained from labelled samples; their size is
a parameter (``samples`` of each kind), everything else covers all rows.

Defined cases: a null text is empty and has no spans; repeated rows are scanned each; an empty table gives an empty table
and, having no identifiers, still a model of random strings against a flat one; other columns are ignored or, in
``redact``, passed through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.llm.text import match_spans

# The base kinds, in order, with their patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "model")

LEAST_CHARS = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}"
FIRST, LAST = 33, 126
WIDE = LAST - FIRST + 1
#: Nats per character pair, and in all, by which "random" must win.
LEAST_MEAN, LEAST_TOTAL = 0.4, 12.0
SAMPLES = 4000
SPAN_KIND = "array<struct<start:bigint,kind:int,end:bigint>>"


def base_spans(text: Column) -> Column:
    """Spans of the fixed kinds, array<struct<start, kind, end>>, by start, then kind as listed.

    The least lengths of the access and hex kinds stand in the pattern: a run is taken from its first fitting place to its
    end, so a shorter first match cannot hide a longer one. For assign they are tested afterwards.
    """

    def of(kind: int, found: Column) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    long_enough = F.filter(
        match_spans(text, ASSIGN), lambda s: F.char_length(F.regexp_replace(s["value"], ASSIGN_HEAD, "")) >= ASSIGN_VALUE)
    return F.array_sort(F.concat(of(0, long_enough), of(1, match_spans(text, ACCESS)), of(2, match_spans(text, HEX))))


def labelled_samples(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(value, random): random strings in three alphabets, and identifier-like words of the documents.

    The words are the first ``samples`` in hash order among all distinct letter runs of 8 to 40 characters in the
    ``samples`` documents that come first in hash order.
    """
    spark = docs.sparkSession
    seeds = spark.range(samples).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    strings = seeds.select(F.explode(F.array(
        F.substr("h", F.lit(1), F.lit(40)), F.base64(F.unhex("h")), F.translate(F.base64(F.unhex("h")), "+/=", ""))).alias("value"))
    texts = docs.select("text", F.xxhash64("text").alias("_h")).where("text is not null")
    last = texts.select("_h").orderBy("_h").limit(samples).agg(F.max("_h").alias("last")).scalar()
    picked = texts.where(F.col("_h") <= last)
    names = (
        picked.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z_]{7,39}"), F.lit(0))).alias("value"))
        .distinct().orderBy(F.xxhash64("value"), "value").limit(samples)
    )
    return strings.withColumn("random", F.lit(True)).unionByName(names.withColumn("random", F.lit(False)))


def train(labelled: DataFrame) -> list[float]:
    """Log ratio of the two models for every pair of characters, row by row; add-one smoothing.

    At most two rows per pair of characters reach the driver.
    """
    pairs = labelled.select("random", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length("value") - 1, F.lit(1))),
        lambda i: F.struct(F.ascii(F.substr("value", i, F.lit(1))).alias("a"), F.ascii(F.substr("value", i + 1, F.lit(1))).alias("b")),
    )).alias("p")).where(F.col("p.a").between(FIRST, LAST) & F.col("p.b").between(FIRST, LAST))
    counts = [[1] * (WIDE * WIDE), [1] * (WIDE * WIDE)]
    for row in pairs.groupBy("random", "p.a", "p.b").count().collect():
        counts[int(row["random"])][(row["a"] - FIRST) * WIDE + row["b"] - FIRST] += row["count"]
    ratio = []
    for a in range(WIDE):
        plain, random = (c[a * WIDE:(a + 1) * WIDE] for c in counts)
        ratio += [math.log(r / sum(random)) - math.log(p / sum(plain)) for p, r in zip(plain, random)]
    return [round(x, 4) for x in ratio]


def _ratio(value: Column, i: Column, model: list[float]) -> Column:
    """Log ratio of the i-th pair of characters, counted from 1."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    return F.get(table, (F.ascii(F.substr(value, i, F.lit(1))) - FIRST) * WIDE + F.ascii(F.substr(value, i + 1, F.lit(1))) - FIRST)


def _score(value: Column, model: list[float]) -> Column:
    places = F.sequence(F.lit(1), F.char_length(value) - 1)
    return F.aggregate(places, F.lit(0.0), lambda total, i: total + _ratio(value, i, model))


def _blanked(text: Column, spans: Column) -> Column:
    """``text`` with blanks in place of the sorted spans, as long as before."""

    def step(s: Column, span: Column) -> Column:
        gap = F.substr(text, (s["at"] + 1).cast("int"), F.greatest(span["start"] - s["at"], F.lit(0)).cast("int"))
        blanks = F.repeat(F.lit(" "), F.greatest(span["end"] - F.greatest(s["at"], span["start"]), F.lit(0)).cast("int"))
        return F.struct(F.greatest(s["at"], span["end"]).alias("at"), F.concat(s["out"], gap, blanks).alias("out"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    blanked = F.aggregate(spans, begin, step, lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"))))
    return F.when(F.size(spans) > 0, blanked).otherwise(text)


def _stretches(run: Column, model: list[float]) -> Column:
    """Spans inside a run that score as random, each widened to the next of / = - _ or the end of the run.

    The sum of the log ratios less the least mean is kept from zero up. A stretch ends at its highest sum, once the sum has
    fallen to zero or by ``LEAST_TOTAL``; so a stretch has the least mean by itself.
    """
    value, kind = run["value"], "array<struct<first:int,last:int>>"
    begin = F.struct(
        F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(1).alias("first"), F.lit(0).alias("last"), F.array().cast(kind).alias("found"))

    def found(s: Column) -> Column:
        enough = s["best"] + LEAST_MEAN * (s["last"] - s["first"] + 1) >= LEAST_TOTAL
        one = F.array(F.struct(s["first"].alias("first"), s["last"].alias("last")))
        return F.when(enough, F.concat(s["found"], one)).otherwise(s["found"])

    def step(s: Column, i: Column) -> Column:
        now = s["sum"] + _ratio(value, i, model) - LEAST_MEAN
        ends, rises = (now <= 0) | (s["best"] - now >= LEAST_TOTAL), now > s["best"]
        return F.struct(
            F.when(ends, 0.0).otherwise(now).alias("sum"), F.when(ends, 0.0).otherwise(F.greatest(s["best"], now)).alias("best"),
            F.when(ends, i + 1).otherwise(s["first"]).alias("first"), F.when(ends, i).when(rises, i).otherwise(s["last"]).alias("last"),
            F.when(ends, found(s)).otherwise(s["found"]).alias("found"))

    pairs = F.aggregate(F.sequence(F.lit(1), F.char_length(value) - 1), begin, step, found)

    def widened(p: Column) -> Column:
        size = lambda part, pattern: F.char_length(F.regexp_extract(part, pattern, 0))
        # A pair that only leads to or from a separator is not part of the secret.
        core = F.substr(value, p["first"], p["last"] - p["first"] + 2)
        first = p["first"] + size(core, "^[A-Za-z0-9+]?[/=_-]+")
        last = p["last"] + 1 - size(core, "[/=_-]+[A-Za-z0-9+]?$")
        before, after = F.substr(value, F.lit(1), first - 1), F.substr(value, last + 1)
        return F.struct(
            (run["start"] + first - 1 - size(before, "[A-Za-z0-9+]*$")).alias("start"), F.lit(3).alias("kind"),
            (run["start"] + last + size(after, "^[A-Za-z0-9+]*")).alias("end"))

    return F.filter(F.array_distinct(F.transform(pairs, widened)), lambda s: s["end"] - s["start"] >= LEAST_CHARS)


def model_spans(text: Column, base: Column, model: list[float]) -> Column:
    """Spans that the models add, in what the base spans leave: runs that score as random whole, else stretches of runs."""
    scored = F.transform(match_spans(_blanked(text, base), CANDIDATE), lambda c: F.struct(
        c["start"], c["end"], c["value"], _score(c["value"], model).alias("score")))

    def of(c: Column) -> Column:
        whole = (c["score"] >= LEAST_TOTAL) & (c["score"] >= LEAST_MEAN * (c["end"] - c["start"] - 1))
        return F.when(whole, F.array(F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))).otherwise(_stretches(c, model))

    return F.flatten(F.transform(scored, of))


def find_secrets(docs: DataFrame, model: list[float]) -> DataFrame:
    """``docs`` with ``_base`` and ``_spans`` (base and added), both sorted array<struct<start, kind, end>>."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    based = docs.withColumn("_base", base_spans(text).cast(SPAN_KIND))
    added = based.withColumn("_added", model_spans(text, F.col("_base"), model).cast(SPAN_KIND))
    return added.withColumn("_spans", F.array_sort(F.concat("_base", "_added"))).drop("_added")


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: list[float], mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``, overlapping spans as one; n_chars follows the text."""
    found = find_secrets(docs.select("text", F.struct(*docs.columns).alias("_doc")), model)
    text = F.col("text")
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s: Column, span: Column) -> Column:
        joins = span["start"] < s["at"]
        gap = F.substr(text, (s["at"] + 1).cast("int"), F.greatest(span["start"] - s["at"], F.lit(0)).cast("int"))
        return F.struct(
            F.greatest(s["at"], span["end"]).alias("at"),
            F.when(joins, s["out"]).otherwise(F.concat(s["out"], gap, F.lit(mark))).alias("out"))

    clean = F.aggregate("_spans", begin, step, lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"))))
    hit = F.size("_spans") > 0
    new = found.withColumn("_clean", F.when(hit, clean).otherwise(text))

    def column(name: str) -> Column:
        own = F.col("_doc").getField(name)
        if name == "text":
            return F.col("_clean").alias(name)
        if name == "n_chars":
            return F.when(hit, F.char_length("_clean").cast(docs.schema[name].dataType)).otherwise(own).alias(name)
        return own.alias(name)

    return new.select(*map(column, docs.columns))
