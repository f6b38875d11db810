"""Steps that make many rows of one: dealt to many tasks first, and their rows never sent whole to every task."""

import itertools
import json
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolake.operators import duplicates as D
from annolake.operators import matching as M
from annolake.operators import raster as R
from annolake.operators import sampling as N
from annolake.operators import shapes as S
from annolake.operators import spans as I
from annolake.plans import all_queries
from annolake.plans.queries_files import _xml
from annolake.plans.queries_metrics import predictions
from annolake.sinks import tables as K
from annolake.sources import files, scan

SQUARE = "array(array(2.0D, 2.0D), array(20.0D, 2.0D), array(20.0D, 20.0D), array(2.0D, 20.0D)) as points"


SF = "/root/testdata/sf0.001"


@pytest.fixture
def unknown_sizes(spark):
    """Joins as Spark plans them for tables too large to send around."""
    given = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in given.items():
        spark.conf.set(name, value)
    yield
    for name in given:
        spark.conf.unset(name)


def plan(df, capsys) -> str:
    df.explain()
    return capsys.readouterr().out


def squares(spark):
    return spark.range(3).selectExpr("id as image_id", "0 as shape_index", SQUARE, "32 as width", "32 as height")


@pytest.mark.parametrize("kind", ["polygons", "raster", "lines"])
def test_target_grids_are_not_broadcast(spark, capsys, kind):
    rows = squares(spark)
    sizes = rows.select("image_id", "width", "height")
    if kind == "polygons":
        df = R.ring_targets(rows, sizes)
    elif kind == "raster":
        df = R.ring_targets_raster(R.image_grid(sizes).withColumn("value", F.when(F.col("x") == 3, 1).otherwise(255)), sizes)
    else:
        df = R.ring_targets_lines(rows, sizes, R.image_grid(sizes).withColumn("value", F.lit(255)))
    assert "Broadcast" not in plan(df, capsys)
    assert df.count() == 3 * 32 * 32


@pytest.mark.parametrize("find", [S.outline_defects, S.self_intersections])
def test_edges_are_not_broadcast(spark, capsys, find):
    df = find(squares(spark).select("image_id", F.col("points").alias("polygon")), ["image_id"])
    assert "Broadcast" not in plan(df, capsys)
    assert df.count() == 0


def test_lines_are_dealt_by_image_before_they_are_pixels(spark, capsys):
    df = R.trace_lines(squares(spark), ["image_id"], closed=True)
    text = plan(df, capsys)
    # One exchange, of the outlines; the pixels stay where they are made.
    assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text
    assert df.count() == 3 * 72


def test_runs_are_not_broadcast(spark, capsys):
    runs = spark.range(4).selectExpr("id as a", "cast(id % 2 as int) as y", "1 as x1", "5 as x2")
    df = I.overlaps(runs, runs.withColumnRenamed("a", "b"), ["y"], ["a", "b"])
    assert "Broadcast" not in plan(df, capsys)
    assert {r["inter"] for r in df.collect()} == {4} and df.count() == 8


def test_layers_over_tile_edges(spark):
    """Tiles of 8 give the same layers as all pixels against all, also with skeleton pixels off the image and rows of sizes that repeat."""
    draw = np.random.default_rng(3)
    sizes = [("a", 21, 17), ("b", 8, 9), ("b", 8, 9), ("c", 0, 5), ("d", 12, 30), ("d", 20, 10), (None, 2, 2)]
    spots = {(i, int(y), int(x)) for i in "abd" for y, x in draw.integers(-3, 24, (6, 2))}
    valid = {(i, int(y), int(x)) for i in "abd" for y, x in draw.integers(0, 24, (300, 2))}
    frame = lambda rows, ddl: spark.createDataFrame(sorted(rows) if isinstance(rows, set) else rows, ddl)
    skeleton = frame(spots | {("b", 0, 0)}, "image_id string, y int, x int").union(frame([("a", None, 1), (None, 0, 0)], "image_id string, y int, x int"))
    spots |= {("b", 0, 0)}
    got = R.grid_layers(
        skeleton, frame(sizes, "image_id string, width int, height int"), R._LAYERS, frame(valid, "image_id string, y int, x int"), radius=2, tau=4.5, tile=8)
    want = []
    for image, width, height in sizes:
        on_image = [s for s in spots if s[0] == image and any(i == image and 0 <= s[1] < h and 0 <= s[2] < w for i, w, h in sizes)]
        for y, x in itertools.product(range(height), range(width)):
            inside = (image, y, x) in valid
            nearest = min((math.hypot(y - s[1], x - s[2]) for s in on_image), default=99.0)
            thick = any(s[0] == image and abs(y - s[1]) <= 2 and abs(x - s[2]) <= 2 for s in spots)
            want.append((image, y, x, (image, y, x) in spots, thick and inside, min(nearest / 4.5, 1.0) if inside else 1.0, 0, inside))
    order = lambda rows: sorted(((str(r[0]), *r[1:5], round(r[5], 9), *r[6:]) for r in rows))
    assert order(got.collect()) == order(want)


def test_document_pieces_hold_their_text_once(spark, tmp_path):
    from annolake.sources.documents import _pieces

    (tmp_path / "d.json").write_text('{"a": [{"t": "x\\"}y"}, {"n": [1, 2]}]}')
    pieces = _pieces(spark, str(tmp_path / "d.json"))
    assert [f.name for f in pieces.schema if f.dataType.simpleString() == "string"] == ["file", "piece"]
    assert pieces.agg(F.sum("quotes")).first()[0] == 8


def test_a_box_is_looked_up_in_few_cells(spark):
    boxes = spark.range(3000).selectExpr("id as image_id", "exp(7 * rand(1)) as w", "exp(7 * rand(2)) as h", "4000 * rand(3) as x", "4000 * rand(4) as y").selectExpr(
        "image_id", "named_struct('x1', x, 'y1', y, 'x2', x + w, 'y2', y + h) as box")
    # Before, eleven rows were shuffled for each prediction.
    assert M.box_cells(boxes, ["image_id"], "p", 0.5, around=True).count() < 4 * 3000
    assert M.box_cells(boxes, ["image_id"], "g", 0.5).count() == 3000


def test_boxes_are_made_of_items_once(spark, capsys):
    for side in predictions(spark, SF):
        assert "Exchange" not in plan(side, capsys)


def test_bounds_read_pairs_and_matches_that_are_made_once(spark, capsys):
    text = plan(all_queries()[0]["match_bounds"](spark, SF), capsys)
    assert "MapInPandas" not in text and "_lw" not in text


def test_exchange_tables_are_compressed_files_of_bounded_length(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "FILE_LINES", 10)
    images = spark.range(40).selectExpr("id", "concat(id, '.png') as file_name", "10 as width", "8 as height", "if(id % 4 = 0, 'val', 'train') as split")
    rows = images.selectExpr("split", "id", "id as image_id", "1 as category_id", "array(1.0D, 2.0D, 3.0D, 4.0D) as bbox", "array(array(0.0D, 0.0D, 1.0D, 1.0D, 2.0D, 0.0D)) as polygons")
    K.write_coco_tables(images, rows, f"{tmp_path}/t")
    for name in ("images", "annotations"):
        written = [p for p in (tmp_path / "t" / name).rglob("part-*") if p.is_file()]
        assert written and all(p.suffix == ".gz" for p in written)
        assert spark.read.text([str(p) for p in written]).groupBy(F.col("_metadata.file_path")).count().agg(F.max("count")).first()[0] <= 10
    back, annotations, _ = files.read_coco_tables(spark, f"{tmp_path}/t")
    assert sorted(r[0] for r in back.select("id").collect()) == list(range(40))
    assert {(r["id"], r["split"], len(r["polygons"][0])) for r in annotations.collect()} == {(i, "train" if i % 4 else "val", 6) for i in range(40)}


def test_no_task_reads_a_whole_split_of_a_document(spark, unknown_sizes, capsys, tmp_path):
    images = spark.range(500).selectExpr("id", "concat(id, '.png') as file_name", "10 as width", "8 as height", "'train' as split")
    rows = images.selectExpr("split", "id", "id as image_id", "1 as category_id", "array(1.0D, 2.0D, 3.0D, 4.0D) as bbox", "array(array(0.0D, 0.0D, 1.0D, 1.0D, 2.0D, 0.0D)) as polygons")
    assert "SortMergeJoin" not in plan(K.coco_document_lines(images, rows), capsys)
    K.write_coco(images, rows, f"{tmp_path}/d")
    parts = sorted((tmp_path / "d" / "split=train").glob("part-*"))
    # Before, as many parts as Spark has shuffle tasks (8 here), whatever the size.
    assert len(parts) > 8
    document = json.loads("".join(p.read_text() for p in parts))
    assert [r["id"] for r in document["images"]] == [r["id"] for r in document["annotations"]] == list(range(500))


def test_rows_are_not_dealt_by_class(spark, unknown_sizes, capsys):
    labels = spark.range(300).selectExpr("id % 100 as sample_id", "if(id % 50 = 0, 'rare', 'common') as label")
    assert "SortMergeJoin" not in plan(N.inverse_frequency_weights(labels, "label"), capsys)
    found = N.multilabel_weights(spark.range(110).withColumnRenamed("id", "sample_id"), labels)
    text = plan(found, capsys)
    # Before, the labels were dealt by class for the join with the counts, so that a class was one task.
    assert "BroadcastHashJoin" in text and "hashpartitioning(label" not in text.split("BroadcastHashJoin")[0]
    got = {r["sample_id"]: r["weight"] for r in found.collect()}
    assert got == {i: 1 / 6 if i in (0, 50) else 1 / 294 if i < 100 else 0.025 for i in range(110)}


def test_rows_without_a_file_are_spread(spark, unknown_sizes):
    rows = spark.range(4000).selectExpr("concat('img/', id) as path", "if(id % 100 = 0, concat('ann/', id), null) as defect_path")
    shapes = spark.createDataFrame([("/w/ann/100", 0, "knot|na|K01|clear|0|1", "rectangle", [[2.0, 3.0], [7.0, 11.0]], 60, 64)], scan._SHAPE_DDL)
    out = scan._with_summary(rows, shapes, "/w")
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    # Before, 3960 rows with a null key were in one task.
    assert sum(sizes) == 4000 and max(sizes) < 1500
    assert sorted(out.columns) == sorted([*rows.columns, *[c for c in scan.shape_summary(shapes).columns if c != "file"]])


def test_cube_listings_are_dealt_and_not_broadcast(spark, capsys):
    text = plan(all_queries()[0]["scan_cube_faces"](spark, SF), capsys)
    # Before, Spark took the listing for small, sent it around and made six letters of every cube in one task.
    assert "BroadcastHashJoin" not in text and "REPARTITION_BY_NUM" in text


def test_xml_documents_do_not_grow_in_number_with_their_keys(spark):
    """one file per task; it was one folder and file per key."""
    df = spark.range(400).withColumn("item", F.concat(F.lit("<annotation><object><name>n"), F.col("id"), F.lit(
        "</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>3</xmax><ymax>3</ymax></bndbox></object></annotation>")))
    rows = files.read_voc_boxes(spark, _xml(df, F.col("item"), F.col("id")))
    assert sorted(r["raw_label"] for r in rows.collect()) == sorted(f"n{i}" for i in range(400))
    assert len(rows.inputFiles()) <= 64


def test_shape_files_are_read_once_for_cleaning(spark, tmp_path, capsys):
    """every step of the cleaning read all files again."""
    shape = '{"label":"knot|na|K01|clear|0|0","shape_type":"polygon","points":[[2,2],[9,2],[9,9]]}'
    (tmp_path / "a.json").write_text('{"shapes":[%s,%s],"imageWidth":64,"imageHeight":60}' % (shape, shape))
    cleaned = S.normalize_shapes(files.read_labelme(spark, str(tmp_path)))
    assert "FileScan json" not in plan(cleaned, capsys)
    assert [r["label"] for r in cleaned.orderBy("shape_index").collect()] == ["knot|na|K01|clear|0|0", "knot|na|K02|clear|0|0"]


@pytest.mark.parametrize("hot,rows", [(2000, 10_000), (2000, 7), (6, 7), (6, 5), (3, 64)])
def test_block_keys_are_dealt_once_and_buckets_go_on_over_batches(spark, capsys, hot, rows):
    """keys were dealt to be counted, marked and joined."""
    draw = np.random.default_rng(3)
    values = {int(seed) ^ int(sum(1 << int(b) for b in draw.choice(63, size, replace=False)))
              for seed in draw.integers(0, 1 << 62, 6) for size in (0, 1, 1, 2, 2, 3, 4, 5)} | {-1, -2, -(1 << 63), 0, 1}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        near = D.near_hash_pairs(spark.createDataFrame([(v,) for v in values], "phash long"), 4, None, hot)
        if hot == 2000:
            assert "Join" not in plan(near, capsys)
        got = [tuple(r) for r in near.select("a", "b", "distance").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    apart = {(a, b, ((a ^ b) & (2**64 - 1)).bit_count()) for a, b in itertools.combinations(sorted(values), 2)}
    assert sorted(got) == sorted(p for p in apart if p[2] <= 4)


def test_annotation_ids_beyond_64_bits(spark, tmp_path):
    """ids are made of four keys, and order keys above 9.2 million made them overflow."""
    at = 53_000_000
    spark.range(40).selectExpr(
        f"id + {at} as o_orderkey", "id % 7 as o_custkey", "'P' as o_orderstatus", "1.0D as o_totalprice", "'1-URGENT' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(90).selectExpr(
        f"id % 40 + {at} as l_orderkey", "cast(id % 3 + 1 as int) as l_linenumber", "id as l_partkey", "id % 5 as l_suppkey", "2.0D as l_quantity", "3.0D as l_extendedprice",
        "'A' as l_returnflag", "'F' as l_linestatus", "date'2026-01-01' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r["split"]: r for r in all_queries()[0]["coco_document_lines"](spark, str(tmp_path)).collect()}
    assert (sum(r["images"] for r in found.values()), sum(r["annotations"] for r in found.values())) == (40, 90)
    assert all(r["lines"] == r["images"] + r["annotations"] + 3 and r["commas"] == r["images"] + r["annotations"] - 2 for r in found.values())
    images = spark.range(3).selectExpr("id", "concat(id, '.png') as file_name", "10 as width", "8 as height", "'train' as split")
    wide = images.selectExpr("split", "id + 53000000000000000000 as id", "id as image_id", "1 as category_id", "array(1.0D) as bbox")
    plain = images.selectExpr("split", "id", "id as image_id", "1 as category_id", "array(1.0D) as bbox")
    assert dict(K.coco_document_lines(images, plain).dtypes)["id"] == "bigint"
    lines = K.coco_document_lines(images, wide).orderBy("split", "part", "id").collect()
    assert [a["id"] for a in json.loads("".join(r["line"] for r in lines))["annotations"]] == [53 * 10**18 + i for i in range(3)]


def test_xml_documents_are_compressed_and_dealt_before_they_are_text(spark):
    """tags, in the shuffle and on disk, took many times the room of what they hold."""
    item = F.when(F.col("id") != 7, F.concat(F.lit("<annotation><object><name>n"), F.col("id"), F.lit(
        "</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>3</xmax><ymax>3</ymax></bndbox></object></annotation>")))
    path = _xml(spark.range(20_000), item, F.col("id"))
    rows = files.read_voc_boxes(spark, path)
    assert sorted(r["raw_label"] for r in rows.collect()) == sorted(f"n{i}" for i in range(20_000) if i != 7)
    assert all(f.endswith(".gz") for f in rows.inputFiles())
    size = sum(p.stat().st_size for p in Path(path.removeprefix("file:")).glob("part-*"))
    assert size < 20_000 * 20
