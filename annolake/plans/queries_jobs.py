"""Queries over the composed label jobs: source labels to annotation tables and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolake.functions.geometry import xywh
from annolake.operators import annotations as A
from annolake.plans.fixtures import fixture
from annolake.plans.queries_geometry import shape_rows
from annolake.plans.registry import query
from annolake.presets import taxonomy
from annolake.session import scratch_path, stable
from annolake.sinks import tables as K
from annolake.sources import files as S

c = F.col


def labelled_boxes(spark, sf):
    """The boxes of the fixture under raw labels of one source, a third of them outside the two categories."""
    raw = F.when(c("class") == "A", "small_knot").when(c("class") == "R", "split").otherwise("resin")
    return fixture(spark, sf, "fx_boxes").select(
        "image_id", "box_id", F.lit("oulu").alias("dataset_id"), raw.alias("raw_label"), (c("l_suppkey") % 2 == 1).alias("truncated"),
        xywh(c("x"), c("y"), c("w"), c("h")).alias("box"))


_BOXES = """
    bx as (select image_id, box_id, class, case class when 'A' then 'small_knot' when 'R' then 'split' else 'resin' end as source_class,
      concat(case when class = 'A' then 'small' else '' end, case when class = 'A' and l_suppkey % 2 = 1 then ',' else '' end,
        case when l_suppkey % 2 = 1 then 'truncated' else '' end) as attributes, x, y, w, h from fx_boxes)"""


@query("build_annotations", f"""
    with {_BOXES} select image_id, box_id, case class when 'A' then 1 else 2 end as category_id, case class when 'A' then 'knot' else 'crack' end as category,
      case class when 'A' then 'unknown' else 'standalone' end as subtype, attributes, source_class, x, y, w, h, w * h as area, 0 as iscrowd, 'bbox' as geometry_type
    from bx where class <> 'N'""")
def _(spark, sf):
    rows, _ = A.annotations_from_boxes(labelled_boxes(spark, sf), taxonomy(spark), ["image_id", "box_id"])
    return rows.select(
        "image_id", "box_id", "category_id", "category", "subtype", F.array_join("attributes", ",").alias("attributes"), "source_class",
        *[F.get("bbox", F.lit(i)).alias(name) for i, name in enumerate("xywh")], "area", "iscrowd", "geometry_type")


@query("build_annotations_shapes", """
    with s as (select *, split_part(label, '|', 1) as cat from fx_shapes where split_part(label, '|', 1) in ('knot', 'crack') and (shape_type = 'polygon' or (w > 0 and h > 0)))
    select concat('f', file_no) as file, cast(shape_no as int) as shape_index, cat as category, split_part(label, '|', 3) as instance_id,
      concat_ws(',', case when split_part(label, '|', 5) = '1' then 'truncated' end, case when split_part(label, '|', 4) <> 'clear' then 'visibility_partial' end,
        case when split_part(label, '|', 6) = '1' then 'affects_rings' end) as attributes,
      case when shape_type = 'polygon' then least(x, x + w - 3, x - 1) else x end as left_edge, case when shape_type = 'polygon' then y else y end as top_edge,
      case when shape_type = 'polygon' then 'true_polygon' else 'axis_aligned_rectangle_from_polygon' end as geometry_type, 8 as numbers from s""")
def _(spark, sf):
    rows, _ = A.annotations_from_shapes(shape_rows(spark, sf), ["file", "shape_index"])
    return rows.select(
        "file", "shape_index", "category", "instance_id", F.array_join("attributes", ",").alias("attributes"), F.get("bbox", F.lit(0)).alias("left_edge"),
        F.get("bbox", F.lit(1)).alias("top_edge"), "geometry_type", F.size(F.get("polygons", F.lit(0))).alias("numbers"))


@query("ignore_regions", f"""
    with {_BOXES}, im as (select distinct image_id as id from fx_boxes), g as (select image_id, count(*) as n, round(sum(x + 2 * y), 2) as s from bx where class = 'N' group by 1)
    select id, coalesce(n, 0)::int as regions, coalesce(s, 0) as weighted from im left join g on image_id = id""")
def _(spark, sf):
    boxes = labelled_boxes(spark, sf)
    _, ignored = A.annotations_from_boxes(boxes, taxonomy(spark))
    images = A.with_ignore_regions(boxes.select(c("image_id").alias("id")).distinct(), ignored)
    weighted = F.aggregate("ignore_bboxes", F.lit(0.0), lambda s, r: s + F.get(r["bbox"], F.lit(0)) + 2 * F.get(r["bbox"], F.lit(1)))
    return images.select("id", c("ignored_instance_count").alias("regions"), F.round(weighted, 2).alias("weighted"))


@query("annotation_tables_roundtrip", f"""
    with {_BOXES}, im as (select image_id, case when image_id % 4 = 0 then 'test' else 'train' end as split from (select distinct image_id from fx_boxes)),
    nm as (select image_id, split, row_number() over (partition by split order by image_id) as id from im),
    an as (select split, nm.id as image_id, row_number() over (partition by split order by bx.image_id, box_id) as id, source_class, x, w * h as area from bx join nm using (image_id) where class <> 'N')
    select split, image_id, id, source_class, x, area from an""")
def _(spark, sf):
    """Source boxes to annotations, dense ids per split, written as exchange tables and read back."""
    from annolake.plans.build import merge_annotations
    boxes = labelled_boxes(spark, sf)
    split = F.when(c("image_id") % 4 == 0, "test").otherwise("train")
    rows, ignored = A.annotations_from_boxes(boxes, taxonomy(spark), ["image_id", "box_id"])
    images = A.with_ignore_regions(boxes.select(c("image_id").alias("id"), split.alias("split")).distinct(), ignored)
    images, rows = stable(images), stable(rows.withColumn("split", split).withColumnRenamed("box_id", "id"))
    images, rows = merge_annotations([(images, rows)])
    path = scratch_path(spark, "exchange")
    K.write_coco_tables(images.drop("source", "old_id"), rows.drop("source", "old_id"), path)
    _, back, _ = S.read_coco_tables(spark, path)
    return back.select("split", "image_id", "id", "source_class", F.get("bbox", F.lit(0)).alias("x"), "area")
