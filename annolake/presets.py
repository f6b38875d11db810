"""Category ids, enumerations, label taxonomies, palette and split policy.

They are data, not logic: each must equal the published configuration for results to agree.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from annolake.session import literal_table

# Fixed values.
CATEGORY_IDS = {"knot": 1, "crack": 2}
CLASSES = ["normal", "knot", "crack"]
SHAPE_CATEGORIES = ["knot", "crack", "discoloration", "resin", "other"]
VISIBILITY = ["clear", "partial"]
IGNORE_REASON = "outside_primary_knot_crack_taxonomy"
NORMAL_SOURCES = ["vsb", "vnwoodknot", "mokume", "oulu"]
IGNORE_VALUE = 255

# Dataset, raw label, category, subtype, attributes, action.
TAXONOMY = [
    ("vsb", "Live_Knot", "knot", "sound_or_live", [], "keep"),
    ("vsb", "Dead_Knot", "knot", "dead_or_dry", [], "keep"),
    ("vsb", "Knot_missing", "knot", "missing", [], "keep"),
    ("vsb", "knot_with_crack", "knot", "cracked", [], "keep"),
    ("vsb", "Crack", "crack", "standalone", [], "keep"),
    ("vsb", "Blue_Stain", None, "", [], "exclude"),
    ("vsb", "Marrow", None, "", [], "exclude"),
    ("vsb", "Quartzity", None, "", [], "exclude"),
    ("vsb", "overgrown", None, "", [], "exclude"),
    ("vsb", "resin", None, "", [], "exclude"),
    ("vnwoodknot", "0", "normal", "", [], "keep"),
    ("vnwoodknot", "1", "knot", "sound_or_live", [], "keep"),
    ("vnwoodknot", "2", "knot", "dead_or_dry", [], "keep"),
    ("oulu", "sound_knot", "knot", "sound_or_live", [], "keep"),
    ("oulu", "dry_knot", "knot", "dead_or_dry", [], "keep"),
    ("oulu", "encased_knot", "knot", "dead_or_dry", ["encased"], "keep"),
    ("oulu", "decayed_knot", "knot", "dead_or_dry", ["decayed"], "keep"),
    ("oulu", "knot_hole", "knot", "missing", [], "keep"),
    ("oulu", "small_knot", "knot", "unknown", ["small"], "keep"),
    ("oulu", "edge_knot", "knot", "unknown", ["edge"], "keep"),
    ("oulu", "leaf_knot", "knot", "unknown", ["leaf"], "keep"),
    ("oulu", "horn_knot", "knot", "unknown", ["horn"], "keep"),
    ("oulu", "moustache_knot", "knot", "unknown", ["moustache"], "keep"),
    ("oulu", "split", "crack", "standalone", [], "keep"),
    ("oulu", "mould", None, "", ["mould"], "ignore"),
    ("oulu", "resin_pocket", None, "", ["resin_pocket"], "ignore"),
    ("oulu", "resin", None, "", ["resin"], "ignore"),
    ("oulu", "core_stripe", None, "", ["core_stripe"], "ignore"),
    ("oulu", "wane", None, "", ["wane"], "ignore"),
    ("oulu", "bark_pocket", None, "", ["bark_pocket"], "ignore"),
    ("oulu", "wave", None, "", ["wave"], "ignore"),
    ("oulu", "UNKNOWN", None, "", ["unknown_source_class"], "ignore"),
]

# Canonical raw label and its mask colour.
PALETTE = [
    ("live_knot", 0x00, 0xFF, 0x00), ("death_know", 0xFF, 0x00, 0x00),
    ("knot_missing", 0xFF, 0x64, 0x00), ("knot_with_crack", 0xFF, 0xAF, 0x00),
    ("crack", 0xFF, 0x00, 0x64), ("quartzity", 0x64, 0x00, 0x64),
    ("resin", 0xFF, 0x00, 0xFF), ("marrow", 0x00, 0x00, 0xFF),
    ("blue_stain", 0x10, 0xFF, 0xFF), ("overgrown", 0x00, 0x40, 0x00),
]
LABEL_ALIASES = {"live_knot_": "live_knot", "dead_knot": "death_know"}

# Split policy of the published configuration.
SEED = 20260729
SPLIT_POLICY = {
    "bridge": {"train": 0.6, "val": 0.2, "test": 0.2},
    "pooled": {"datasets": ["urudendro", "urudendro2"], "ratios": {"train": 0.8, "val": 0.2}},
    "single": {"mokume": {"train": 0.7, "val": 0.15, "test": 0.15}},
    "external": {
        "datasets": ["urudendro4", "vnwoodknot", "indiana", "oulu"], "split": "external_test",
    },
    "folds": {"dataset": "urudendro4", "k": 5},
}

# Default validation score weights.
SCORE_WEIGHTS = {
    "ring": 1.0, "defect_box": 1.0, "defect_mask": 1.0, "classification": 1.0,
    "bridge_ring": 0.5, "bridge_box": 0.5, "bridge_mask": 0.5,
}

IOU_THRESHOLDS = [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95]

_TAXONOMY_SCHEMA = pa.schema([
    ("dataset_id", pa.string()), ("raw_label", pa.string()), ("category", pa.string()),
    ("subtype", pa.string()), ("attributes", pa.list_(pa.string())), ("train_action", pa.string()),
])


def taxonomy(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return literal_table(spark, TAXONOMY if rows is None else rows, _TAXONOMY_SCHEMA)
