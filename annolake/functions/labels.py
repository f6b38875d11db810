"""Key, label and state expressions. Everything here is Column in, Column out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.presets import SHAPE_CATEGORIES, VISIBILITY


def none_if_blank(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def stem(path: Column) -> Column:
    """File name without folders and last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def derive_key(name: Column, pattern: str, group: int = 1) -> Column:
    """Regex group of a file stem; the whole stem where the pattern does not match."""
    found = F.regexp_extract(name, pattern, group)
    return F.when(found == "", name).otherwise(found)


def strip_suffix(name: Column, pattern: str) -> Column:
    """Drop a trailing marker such as ``-2`` or ``C``."""
    return F.regexp_replace(name, f"(?:{pattern})$", "")


def qualified(dataset_id: Column, *parts: Column) -> Column:
    """Colon-joined identifier."""
    return F.concat_ws(":", dataset_id, *parts)


def variant_key(variant: Column, name: Column) -> Column:
    """Base id and transform name of a synthetic derivative.

    Direction variants are numbered eight per base image; others carry ``base_suffix``.
    """
    number = name.try_cast("bigint")
    base_text = F.split(name, "_").getItem(0)
    rest = name.substr(F.length(base_text) + 1, F.length(name))
    suffix = F.regexp_replace(rest, "^_+", "")
    directed = variant.contains("DirectionChange")
    padded = lambda value: F.when(F.length(value) >= 6, value).otherwise(F.lpad(value, 6, "0"))
    return F.struct(
        F.when(directed, padded((F.floor((number - 1) / 8) + 1).cast("string")))
        .otherwise(padded(base_text.try_cast("bigint").cast("string")))
        .alias("base_id"),
        F.when(directed, F.concat(F.lit("direction_"), F.pmod(number - 1, F.lit(8)).cast("string")))
        .otherwise(F.when(suffix == "", "original").otherwise(suffix))
        .alias("transform"),
    )


def label_state(targets: Column, ignored: Column, annotated: Column) -> Column:
    """positive > ignore_only > verified_negative, and missing without an annotation."""
    return (
        F.when(~annotated, "missing")
        .when(targets > 0, "positive")
        .when(ignored > 0, "ignore_only")
        .otherwise("verified_negative")
    )


def select_samples(
    df: DataFrame,
    dataset_ids: Iterable[str] | None = None,
    splits: Iterable[str] | None = None,
    roles: Iterable[str] | None = None,
) -> DataFrame:
    """Optional IN filters; ``None`` filters nothing and an empty set keeps no row."""
    for column, wanted in (("dataset_id", dataset_ids), ("split", splits), ("dataset_role", roles)):
        if wanted is not None:
            values = sorted(wanted)
            df = df.where(F.col(column).isin(values) if values else F.lit(False))
    return df


# Which targets each task may train.
TASK_FLAGS = {
    "ring": (1, 0, 0), "defect": (0, 1, 0), "bridge": (1, 1, 0), "classification": (0, 0, 1),
}


def task_mask(task: str) -> Column:
    """Constant per-row mask of the targets a task supervises (P5)."""
    ring, defect, classification = TASK_FLAGS[task]
    return F.struct(
        F.lit(ring).alias("ring"), F.lit(defect).alias("defect"),
        F.lit(classification).alias("classification"),
    )


def safe_name(value: Column) -> Column:
    """Runs of characters unfit for file names become one underscore."""
    return F.regexp_replace(value, r"[^A-Za-z0-9_.\-]+", "_")


def parse_pipe_label(value: Column) -> Column:
    """Six pipe-separated fields as a struct; null when any field breaks its enumeration."""
    fields = F.transform(F.split(value, r"\|", -1), lambda part: F.trim(part))
    at = lambda index: F.get(fields, index)
    valid = (
        (F.size(fields) == 6)
        & at(0).isin(SHAPE_CATEGORIES)
        & (at(1) != "") & (at(2) != "")
        & at(3).isin(VISIBILITY)
        & at(4).isin("0", "1") & at(5).isin("0", "1")
    )
    return F.when(
        valid,
        F.struct(
            at(0).alias("category"), at(1).alias("subtype"), at(2).alias("instance_id"),
            at(3).alias("visibility"), (at(4) == "1").alias("truncated"),
            (at(5) == "1").alias("affects_rings"),
        ),
    )


def format_pipe_label(label: Column, instance_id: Column, truncated: Column) -> Column:
    """Write a parsed label back with a replaced instance id and truncation flag."""
    flag = lambda value: F.when(value, "1").otherwise("0")
    return F.concat_ws(
        "|", label["category"], label["subtype"], instance_id, label["visibility"],
        flag(truncated), flag(label["affects_rings"]),
    )


def attribute_flags(label: Column) -> Column:
    """Attributes implied by a parsed label, in their fixed order."""
    return F.array_compact(
        F.array(
            F.when(label["truncated"], F.lit("truncated")),
            F.when(label["visibility"] != "clear", F.concat(F.lit("visibility_"), label["visibility"])),
            F.when(label["affects_rings"], F.lit("affects_rings")),
        )
    )


def resolve_reference(value: Column) -> Column:
    """File behind a reference: the archive of ``zip://archive::member``, else the path."""
    archive = F.substring_index(F.regexp_replace(value, "^zip://", ""), "::", 1)
    return F.when(value.startswith("zip://"), archive).when(value != "", value)


def split_attributes(value: Column) -> Column:
    """Semicolon list, trimmed, without blanks (P10)."""
    parts = F.transform(F.split(value, ";"), lambda part: F.trim(part))
    return F.filter(parts, lambda part: part != "")


def canonical_label(value: Column, aliases: dict[str, str] | None = None) -> Column:
    """Trimmed, lower case, blanks as underscores, known aliases replaced."""
    key = F.replace(F.lower(F.trim(value)), F.lit(" "), F.lit("_"))
    result = key
    for alias, target in (aliases or {}).items():
        result = F.when(key == alias, target).otherwise(result)
    return result


def hex_hash(value: Column) -> Column:
    """Signed 64-bit hash as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def parse_hex_hash(value: Column) -> Column:
    return F.conv(value, 16, -10).cast("long")
