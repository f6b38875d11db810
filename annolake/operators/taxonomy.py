"""Raw label to unified category, and colour to category."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.functions.labels import canonical_label
from annolake.presets import CATEGORY_IDS, LABEL_ALIASES, PALETTE
from annolake.session import literal_table

MAPPED = ["category", "subtype", "attributes", "train_action"]


def map_taxonomy(
    df: DataFrame,
    taxonomy: DataFrame,
    raw: str = "raw_label",
    fallback: str = "other",
    aliases: dict[str, str] | None = LABEL_ALIASES,
) -> DataFrame:
    """Attach category, subtype, attributes and action to raw labels.

    ``fallback``: ``other`` tries the canonical spelling and then yields category ``other``;
    ``unknown`` takes the taxonomy's UNKNOWN row; ``drop`` removes unmapped rows.
    """
    if fallback not in ("other", "unknown", "drop"):
        raise ValueError(f"unknown fallback: {fallback}")
    packed = F.struct(*MAPPED)
    exact = taxonomy.select("dataset_id", F.col("raw_label").alias("_key"), packed.alias("_exact"))
    result = df.withColumn("_key", F.col(raw)).join(exact, ["dataset_id", "_key"], "left")
    if fallback == "drop":
        chosen = F.col("_exact")
        result = result.where(F.col("_exact").isNotNull())
    elif fallback == "unknown":
        default = taxonomy.where(F.col("raw_label") == "UNKNOWN").select("dataset_id", packed.alias("_default"))
        result = result.join(default, "dataset_id", "left")
        chosen = F.coalesce("_exact", "_default", _other(""))
    else:
        loose = (
            taxonomy.withColumn("_canon", canonical_label(F.col("raw_label"), aliases))
            .groupBy("dataset_id", "_canon")
            .agg(F.min_by(packed, "raw_label").alias("_loose"))
        )
        result = result.withColumn("_canon", canonical_label(F.col(raw), aliases)).join(
            loose, ["dataset_id", "_canon"], "left"
        )
        chosen = F.coalesce("_exact", "_loose", _other("unmapped_source_class"))
    result = result.withColumn("_mapped", chosen)
    return result.select(*df.columns, *[F.col(f"_mapped.{name}").alias(name) for name in MAPPED])


def _other(attribute: str) -> Column:
    return F.struct(
        F.lit("other").alias("category"), F.lit("").alias("subtype"),
        (F.array(F.lit(attribute)) if attribute else F.array().cast("array<string>")).alias("attributes"),
        F.lit(None).cast("string").alias("train_action"),
    )


def is_target(category: Column, action: Column, accept_missing_action: bool = False) -> Column:
    """Known category and action ``keep``; corner-box sources also accept no action."""
    keep = F.coalesce(action == "keep", F.lit(accept_missing_action))
    return keep & F.coalesce(category.isin(list(CATEGORY_IDS)), F.lit(False))


def partition_targets(df: DataFrame, accept_missing_action: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split mapped labels into training targets and ignore regions."""
    flag = is_target(F.col("category"), F.col("train_action"), accept_missing_action)
    return df.where(flag), df.where(~flag)


def category_id(category: Column) -> Column:
    result = F.lit(None).cast("int")
    for name, number in CATEGORY_IDS.items():
        result = F.when(category == name, number).otherwise(result)
    return result


def encode_rgb(r: Column, g: Column, b: Column) -> Column:
    """24-bit colour code."""
    return F.shiftleft(r.cast("int"), 16) + F.shiftleft(g.cast("int"), 8) + b.cast("int")


def palette(spark: SparkSession, taxonomy: DataFrame, dataset_id: str = "vsb") -> DataFrame:
    """Colour code to category id through the taxonomy of one dataset."""
    rows = [(dataset_id, name, (r << 16) | (g << 8) | b) for name, r, g, b in PALETTE]
    schema = pa.schema([("dataset_id", pa.string()), ("raw_label", pa.string()), ("color", pa.int32())])
    mapped = map_taxonomy(literal_table(spark, rows, schema), taxonomy)
    return mapped.select("color", "raw_label", F.coalesce(category_id(F.col("category")), F.lit(0)).alias("category_id"))


def decode_palette(pixels: DataFrame, colors: DataFrame) -> DataFrame:
    """Category id of each coloured pixel, 0 where the colour is unmapped."""
    lookup = colors.select("color", F.col("category_id").alias("_id"))
    return (
        pixels.join(lookup, "color", "left")
        .withColumn("category_id", F.coalesce("_id", F.lit(0)))
        .select(*pixels.columns, "category_id")
    )


def unknown_colors(decoded: DataFrame) -> DataFrame:
    """Histogram of non-zero colours without a category, as six hex digits."""
    return (
        decoded.where((F.col("color") != 0) & (F.col("category_id") == 0))
        .groupBy(F.lpad(F.hex("color"), 6, "0").alias("color_hex"))
        .agg(F.count(F.lit(1)).alias("pixels"))
    )
