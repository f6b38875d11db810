"""Quality rules per document and per host, in DataFrame expressions only.

Each document is measured once. Rule failures are summed by host (map-side first, so a hot host costs one row per task),
the failure rate of a host is shrunk towards the corpus by a beta prior fitted to all hosts (method of moments), and hosts
whose shrunk rate is above ``max_host_rate`` lose all their documents. The verdict is joined back by host.

Defined cases: a null or blank text has no words and fails; a null host is a host of its own; repeated rows count as often
as they occur; an empty table gives an empty table; other columns are ignored or, in ``keep_good``, passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.llm.text import BLANKS, words
from annolake.session import stable

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT = 10, 50
MAX_HOST_RATE = 0.6
#: Bounds of the prior's weight in documents: with no spread between hosts the fit would be infinite.
PRIOR_LEAST, PRIOR_MOST = 2.0, 1000.0
SYMBOLS = "#*$%&|<>"


def repeated_words(tokens: Column) -> Column:
    """Words that lie in a window of 8 words found twice or more in the text, the first one included.

    Windows are compared by a 64-bit hash of their words.
    """
    hashes = F.when(F.size(tokens) >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(tokens) - (WINDOW - 1), F.lit(1))),
        lambda i: F.xxhash64(F.slice(tokens, i, WINDOW)),
    )).otherwise(F.array().cast("array<bigint>"))
    return hashes


def _covered(hashes: Column) -> Column:
    """Sizes of the union of the windows whose hash is not unique."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # A neighbour in hash order with the same hash, before or after.
    pairs = F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last"))
    return F.aggregate(
        starts, begin,
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW).cast("long"), i.cast("long") - s["last"])).alias("n"), i.cast("long").alias("last")),
        lambda s: s["n"],
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_m``, a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, failed."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    step = docs.withColumn("_words", words(body)).withColumn("_hashes", repeated_words(F.col("_words")))
    step = step.withColumn("_lines", F.filter(F.split(body, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != ""))
    step = step.select(
        *docs.columns,
        F.size("_words").cast("long").alias("_n_words"),
        F.char_length(F.translate(body, BLANKS, "")).cast("long").alias("_word_chars"),
        (F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, ""))).cast("long").alias("_n_symbols"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), _covered(F.col("_hashes")))
        .otherwise(F.lit(0).cast("long")).alias("_n_repeat_words"),
    )
    base = (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_n_words"))
    more = (100 * F.col("_n_symbols") > MAX_SYMBOL_PERCENT * F.col("_word_chars")) | (
        100 * F.col("_n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("_n_lines"))
    return step.select(*docs.columns, F.struct(
        *[F.col(f"_{name}").alias(name) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")],
        base.alias("base_failed"), (base | more).alias("failed"),
    ).alias("_m"))


def host_verdicts(counts: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """From (host, n, failures): adds rate, the shrunk failure rate, and rejected.

    The prior's mean is the corpus rate; its weight comes from the spread of the hosts' rates round it.
    """
    prior = counts.agg(
        (F.sum("failures") / F.sum("n")).alias("mean"), F.var_samp(F.col("failures") / F.col("n")).alias("spread"))
    fitted = prior.select("mean", F.greatest(F.lit(PRIOR_LEAST), F.least(F.lit(PRIOR_MOST), F.coalesce(
        F.try_divide(F.col("mean") * (1 - F.col("mean")), F.col("spread")) - 1, F.lit(PRIOR_MOST)))).alias("weight"))
    one = fitted.select(F.struct("mean", "weight").alias("p")).scalar()
    return (
        counts.withColumn("_p", one)
        .withColumn("rate", (F.col("failures") + F.col("_p.mean") * F.col("_p.weight")) / (F.col("n") + F.col("_p.weight")))
        .withColumn("rejected", F.col("rate") > max_host_rate).drop("_p")
    )


def _by_host(measured: DataFrame, host: str) -> DataFrame:
    return measured.groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_m.failed").cast("long")).alias("failures"))


def judge(docs: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row. The narrow measures are staged once."""
    narrow = stable(measure(docs.select("doc_id", "text", F.col(host).alias("_key"))).select("doc_id", "_key", "_m"))
    verdicts = host_verdicts(_by_host(narrow, "_key"), max_host_rate).select("_host", "rejected")
    joined = narrow.join(verdicts, F.col("_key").eqNullSafe(F.col("_host")), "left")
    return joined.select(
        "doc_id", *[F.col(f"_m.{name}").alias(name) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
        (~F.col("_m.base_failed") & ~F.coalesce(F.col("rejected"), F.lit(False))).alias("kept"),
    )


def keep_good(docs: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns. Texts stay where they are unless a host is rejected."""
    counts = stable(_by_host(measure(docs.select("text", F.col(host).alias("_key"))), "_key"))
    bad = host_verdicts(counts, max_host_rate).where("rejected").select("_host")
    whole = docs.select("text", F.col(host).alias("_key"), F.struct(*docs.columns).alias("_doc"))
    # The row number keeps the filter above the measures; pushed below them it would work them out once per mention.
    measured = measure(whole).withColumn("_place", F.monotonically_increasing_id())
    good = measured.where((F.col("_place") >= 0) & ~F.col("_m.base_failed")).select("_key", "_doc")
    return good.join(bad, F.col("_key").eqNullSafe(F.col("_host")), "left_anti").select(
        *[F.col("_doc").getField(c).alias(c) for c in docs.columns])
