"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark import SparkConf
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from annolake.plans import all_queries  # noqa: E402

HEADLINE = [
    "split_then_profile", "allocate_groups_by_dataset", "quality_profile", "split_audit", "missing_references",
    "metadata_fingerprint", "inventory_fingerprint", "map_taxonomy_canonical", "enrich_registry", "task_samples",
    "box_errors", "crop_index", "label_lines_box", "assign_dense_ids", "dedupe_instance_ids", "classification_report",
    "regional_ring_scores", "detection_report", "average_precision_101", "near_duplicates", "duplicate_summary",
    "perceptual_hash", "multilabel_weights", "mix_tasks", "weighted_sample", "rasterize", "truncated_distance",
    "connected_components", "rle_encode", "paint_annotations", "decode_palette", "integrity_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
    )
    if not any(key == "spark.checkpoint.dir" for key, _ in SparkConf().getAll()):
        spark = spark.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="annolake-bench-"))
    spark = spark.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()[0]
    wanted = sys.argv[1:] or HEADLINE
    # Warm up, so that the first query's figure compares with the others.
    queries["read_contents"](spark, sf_dir).collect()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
