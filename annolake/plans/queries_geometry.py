"""Queries over boxes, polygons and shape files."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolake.functions import geometry as G
from annolake.functions.labels import parse_pipe_label
from annolake.operators import annotations as A
from annolake.operators import shapes as H
from annolake.operators.integrity import box_errors
from annolake.plans.fixtures import FIXTURES, fixture
from annolake.plans.registry import query
from annolake.session import scratch_path
from annolake.sinks.shape_files import cleaned_documents, read_shape_documents, write_shape_files
from annolake.sources.files import read_labelme

BOX_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KEYS = ", ".join(BOX_KEYS)
c = F.col


def boxes(spark, sf):
    """fx_boxes with the xywh struct as ``box``."""
    return fixture(spark, sf, "fx_boxes").withColumn("box", G.xywh(c("x"), c("y"), c("w"), c("h")))


def shape_points(df):
    """fx_shapes with vertices: a quadrilateral, or two corners for a rectangle."""
    pair = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    x, y, w, h = c("x"), c("y"), c("w"), c("h")
    quad = F.array(pair(x, y), pair(x + w, y + 2), pair(x + w - 3, y + h), pair(x - 1, y + h + 1))
    return df.withColumn("points", F.when(c("shape_type") == "rectangle", F.array(pair(x + w, y + h), pair(x, y))).otherwise(quad))


def shape_rows(spark, sf):
    df = shape_points(fixture(spark, sf, "fx_shapes"))
    return df.select(F.concat(F.lit("f"), c("file_no").cast("string")).alias("file"), c("shape_no").cast("int").alias("shape_index"),
                     "label", "shape_type", "points", F.lit(64).alias("width"), F.lit(60).alias("height"))


_PTS = """
    pts as (select *, case when shape_type = 'rectangle' then [[x + w, y + h], [x, y]]
      else [[x, y], [x + w, y + 2], [x + w - 3, y + h], [x - 1, y + h + 1]] end as points from fx_shapes)"""


@query("corners_to_xywh", f"""
    select {_KEYS}, round(x / 100 * 640, 6) as bx, round(y / 100 * 480, 6) as "by", round(((x + w) / 100 - x / 100) * 640, 6) as bw, round(((y + h) / 100 - y / 100) * 480, 6) as bh from fx_boxes""")
def _(spark, sf):
    n = lambda value: value / 100
    box = G.corners_to_xywh(n(c("x")), n(c("y")), n(c("x") + c("w")), n(c("y") + c("h")), F.lit(640), F.lit(480))
    return boxes(spark, sf).withColumn("b", box).select(*BOX_KEYS, *[F.round(f"b.{k}", 6).alias(f"b{k}") for k in "xywh"])


@query("center_boxes", f"""
    select {_KEYS}, round((x / 100 - w / 200) * 640, 6) as x1, round((y / 100 - h / 200) * 480, 6) as y1, round(w / 100 * 640, 6) as bw, round(h / 100 * 480, 6) as bh,
      round((x / 100 + w / 200) * 640, 6) as x2, round((y / 100 + h / 200) * 480, 6) as y2 from fx_boxes""")
def _(spark, sf):
    args = [c(k) / 100 for k in "xywh"] + [F.lit(640), F.lit(480)]
    df = boxes(spark, sf).withColumn("a", G.center_to_xywh(*args)).withColumn("b", G.center_to_xyxy(*args))
    return df.select(*BOX_KEYS, F.round("b.x1", 6).alias("x1"), F.round("b.y1", 6).alias("y1"), F.round("a.w", 6).alias("bw"),
                     F.round("a.h", 6).alias("bh"), F.round("b.x2", 6).alias("x2"), F.round("b.y2", 6).alias("y2"))


@query("clip_box", f"""
    with k as (select *, greatest(0.0, x - 10) as x1, greatest(0.0, y - 10) as y1, case when l_suppkey % 2 = 0 then x + w - 10 else least(30.0, x + w - 10) end as x2,
      case when l_suppkey % 2 = 0 then y + h - 10 else least(25.0, y + h - 10) end as y2 from fx_boxes)
    select {_KEYS}, x1 as cx, y1 as cy, x2 - x1 as cw, y2 - y1 as ch from k where x2 > x1 and y2 > y1""")
def _(spark, sf):
    known = lambda size: F.when(c("l_suppkey") % 2 == 0, 0.0).otherwise(size)
    box = G.clip_box(c("x") - 10, c("y") - 10, c("x") + c("w") - 10, c("y") + c("h") - 10, known(30.0), known(25.0))
    return boxes(spark, sf).withColumn("b", box).where("b is not null").select(*BOX_KEYS, *[c(f"b.{k}").alias(f"c{k}") for k in "xywh"])


@query("polygon_geometry", f"""
    with {_PTS}, poly as (select file_no, shape_no, shape_type, case when shape_type = 'rectangle' then
        case when w > 0 and h > 0 then [[x, y], [x + w, y], [x + w, y + h], [x, y + h]] else [] end else points end as p from pts),
    g as (select *, len(p) as n, list_min(list_transform(p, lambda q: q[1])) as x1, list_min(list_transform(p, lambda q: q[2])) as y1,
      list_max(list_transform(p, lambda q: q[1])) as x2, list_max(list_transform(p, lambda q: q[2])) as y2,
      abs(list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i][1] * p[i % len(p) + 1][2] - p[i % len(p) + 1][1] * p[i][2]))) / 2 as area from poly)
    select file_no, shape_no, x1 as bx, y1 as "by", x2 - x1 as bw, y2 - y1 as bh, round(area, 6) as area,
      len(list_filter(p, lambda q: q[1] <= 1.5 or q[2] <= 1.5 or q[1] >= 64 - 1 - 1.5 or q[2] >= 60 - 1 - 1.5)) > 0 as touches,
      case when shape_type = 'polygon' then 'true_polygon' else 'axis_aligned_rectangle_from_polygon' end as geometry_type from g where n > 0""")
def _(spark, sf):
    df = shape_points(fixture(spark, sf, "fx_shapes")).withColumn("p", G.shape_to_polygon(c("shape_type"), c("points"))).where(F.size("p") > 0)
    df = df.withColumn("b", G.polygon_bbox(c("p")))
    return df.select(
        "file_no", "shape_no", *[c(f"b.{k}").alias(f"b{k}") for k in "xywh"], F.round(G.polygon_area(c("p")), 6).alias("area"),
        G.touches_frame(c("p"), F.lit(64), F.lit(60), F.lit(False)).alias("touches"), G.shape_type_geometry(c("shape_type")).alias("geometry_type"))


@query("has_point_label", """
    select user_id, count(*) filter (where event_type = 'click' and value > 200) > 0 as has_point from events group by 1""")
def _(spark, sf):
    shape = F.struct(F.col("event_type").alias("label"), F.when(F.col("value") > 200, "point").otherwise("polygon").alias("shape_type"))
    df = fixture(spark, sf, "events").groupBy("user_id").agg(F.collect_set(shape).alias("shapes"))
    return df.select("user_id", G.has_point_label(c("shapes"), "click").alias("has_point"))


@query("box_area", f"select {_KEYS}, round(greatest(0.0, w - 10) * greatest(0.0, h - 10), 4) as area from fx_boxes")
def _(spark, sf):
    return boxes(spark, sf).select(*BOX_KEYS, G.box_area(G.xywh(c("x"), c("y"), c("w") - 10, c("h") - 10)).alias("area"))


@query("scale_annotation", f"""
    select {_KEYS}, round(x * sx, 4) as bx, round(y * sy, 4) as "by", round(w * sx, 4) as bw, round(h * sy, 4) as bh, round(x * sx + y * sy * 2 + (x + w) * sx * 3 + (y + h) * sy * 4, 4) as poly
    from (select *, 320.0::double / greatest(1, l_partkey % 97) as sx, 240.0::double / greatest(1, l_suppkey % 53) as sy from fx_boxes)""")
def _(spark, sf):
    sx, sy = G.scale_factor(F.lit(320.0), c("l_partkey") % 97), G.scale_factor(F.lit(240.0), c("l_suppkey") % 53)
    poly = F.array(F.array(c("x"), c("y"), c("x") + c("w"), c("y") + c("h")))
    df = boxes(spark, sf).withColumn("b", G.scale_box(c("box"), sx, sy)).withColumn("q", G.scale_polygons(poly, sx, sy).getItem(0))
    total = F.get("q", F.lit(0)) + F.get("q", F.lit(1)) * 2 + F.get("q", F.lit(2)) * 3 + F.get("q", F.lit(3)) * 4
    return df.select(*BOX_KEYS, *[c(f"b.{k}").alias(f"b{k}") for k in "xywh"], F.round(total, 4).alias("poly"))


@query("box_iou", f"""
    select {_KEYS}, round(case when w * h + 400 - i <= 0 then 0 else i / (w * h + 400 - i) end, 6) as iou
    from (select *, greatest(0.0, least(x + w, 35) - greatest(x, 15)) * greatest(0.0, least(y + h, 25) - greatest(y, 5)) as i from fx_boxes)""")
def _(spark, sf):
    fixed = G.xyxy(F.lit(15.0), F.lit(5.0), F.lit(35.0), F.lit(25.0))
    return boxes(spark, sf).select(*BOX_KEYS, F.round(G.box_iou(G.to_xyxy(c("box")), fixed), 6).alias("iou"))


@query("crop_window", f"""
    select {_KEYS}, round(x + w / 2 - s / 2, 6) as x1, round(y + h / 2 - s / 2, 6) as y1, round(x + w / 2 + s / 2, 6) as x2, round(y + h / 2 + s / 2, 6) as y2
    from (select *, greatest(2.0, greatest(w, h) * 1.4) as s from fx_boxes)""")
def _(spark, sf):
    return boxes(spark, sf).withColumn("k", G.crop_window(c("box"))).select(*BOX_KEYS, *[F.round(f"k.{k}", 6).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query("box_pixel_span", f"""
    select {_KEYS}, greatest(0, least(40, cast(floor(x - 3.5) as int))) as x1, greatest(0, least(30, cast(floor(y - 3.25) as int))) as y1,
      greatest(0, least(40, cast(ceil(x - 3.5 + w) as int))) as x2, greatest(0, least(30, cast(ceil(y - 3.25 + h) as int))) as y2 from fx_boxes""")
def _(spark, sf):
    box = G.xywh(c("x") - 3.5, c("y") - 3.25, c("w"), c("h"))
    return boxes(spark, sf).withColumn("s", G.box_pixel_span(box, F.lit(40), F.lit(30))).select(*BOX_KEYS, "s.*")


@query("point_in_polygon", f"""
    with {_PTS}, e as (select file_no, shape_no, points[i] as a, points[i % len(points) + 1] as b from (select *, unnest(range(1, len(points) + 1)) as i from pts where shape_type = 'polygon'))
    select file_no, shape_no, count(*) filter (where (a[2] > 20.5) <> (b[2] > 20.5) and 18.25 < (b[1] - a[1]) * (20.5 - a[2]) / (b[2] - a[2]) + a[1]) % 2 = 1 as inside from e group by 1, 2""")
def _(spark, sf):
    df = shape_points(fixture(spark, sf, "fx_shapes")).where("shape_type = 'polygon'")
    return df.select("file_no", "shape_no", G.point_in_polygon(F.lit(18.25), F.lit(20.5), c("points")).alias("inside"))


_ANN = """
    a as (select n.*, i.width, i.height, i.split, i.ignored_instance_count from fx_annotations n join fx_images i on n.image_id = i.id)"""


@query("box_errors", """
    with k as (select a.*, i.width, i.height, l_partkey % 5 as seg from fx_annotations a left join (select * from fx_images where id % 13 <> 0) i on a.image_id = i.id)
    select k.id, image_id, category_id, seg in (1, 2, 3) as segmented,
      width is null or seg = 2 or (seg = 3 and height <> 50) as reference_error,
      width is not null and not (w > 0 and h > 0 and x >= -1 and y >= -1 and x + w <= width + 1 and y + h <= height + 1) as bbox_error from k""")
def _(spark, sf):
    seg = c("l_partkey") % 5
    good = F.array(F.array(c("x"), c("y"), c("x") + 1, c("y"), c("x"), c("y") + 1))
    bad = F.array(F.array(c("x"), c("y"), c("x") + 1))
    rows = fixture(spark, sf, "fx_annotations").join(
        fixture(spark, sf, "fx_images").select(c("id").alias("image_id"), c("width").alias("iw")), "image_id", "left")
    rows = rows.select(
        "id", "image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"),
        F.when(seg == 1, good).when(seg == 2, bad).alias("polygons"),
        F.when(seg == 3, F.struct(F.array(F.lit(50), c("iw")).alias("size"), F.array(F.lit(1)).alias("counts"))).alias("rle"))
    return box_errors(fixture(spark, sf, "fx_images").where("id % 13 <> 0"), rows)


def polygon_annotations(spark, sf, wide=False):
    """fx_annotations with a box struct, flat polygons on two of three rows, and no RLE.

    An id is made of four keys and passes 64 bits where orders have keys above 9.2 million. ``wide``: ids are decimals, for
    writers that need no long.
    """
    flat = F.array(F.array(c("x"), c("y"), c("x") + c("w"), c("y"), c("x"), c("y") + c("h")))
    if wide:
        # The same view over decimal order keys, so that it is worked out in decimals.
        items = fixture(spark, sf, "fx_items")
        rows = spark.sql(FIXTURES["fx_annotations"], fx_items=items.withColumn("l_orderkey", c("l_orderkey").cast("decimal(20,0)")))
        rows = rows.withColumn("image_id", c("image_id").cast("long"))
    else:
        rows = fixture(spark, sf, "fx_annotations")
    return rows.select(
        "id", "image_id", "category_id", "category", G.xywh(c("x"), c("y"), c("w"), c("h")).alias("bbox"),
        F.when(c("l_partkey") % 8 != 0, flat).alias("polygons"))


@query("label_lines_box", f"""
    with {_ANN}, l as (select image_id, string_agg(printf('%d %.6f %.6f %.6f %.6f', category_id - 1, (x + w / 2) / width, (y + h / 2) / height, w / width, h / height), chr(10) order by id) as t from a group by 1)
    select split, id as image_id, lpad(cast(id as string), 8, '0') as name, coalesce(t, '') as label_text from fx_images left join l on l.image_id = id where ignored_instance_count = 0""")
def _(spark, sf):
    return A.label_lines(fixture(spark, sf, "fx_images"), polygon_annotations(spark, sf))


@query("label_lines_polygon", f"""
    with {_ANN}, l as (select image_id, count(*) filter (where l_partkey % 8 = 0) as lacking, string_agg(printf('%d %.6f %.6f %.6f %.6f %.6f %.6f', category_id - 1,
        x / width, y / height, (x + w) / width, y / height, x / width, (y + h) / height), chr(10) order by id) as t from a group by 1)
    select split, id as image_id, lpad(cast(id as string), 8, '0') as name, coalesce(t, '') as label_text from fx_images left join l on l.image_id = id
    where ignored_instance_count = 0 and coalesce(lacking, 0) = 0""")
def _(spark, sf):
    return A.label_lines(fixture(spark, sf, "fx_images"), polygon_annotations(spark, sf), segment=True)


@query("export_counts", """
    with l as (select image_id, count(*) as n, count(*) filter (where l_partkey % 8 = 0) as lacking from fx_annotations group by 1),
    k as (select i.*, coalesce(n, 0) as n, case when source_dataset not in ('1-URGENT', '5-LOW', '2-HIGH') then 'source' when ignored_instance_count > 0 then 'ignore'
      when coalesce(lacking, 0) > 0 then 'segmentation' end as why from fx_images i left join l on i.id = l.image_id)
    select split, count(*) filter (where why is null) as images, cast(coalesce(sum(n) filter (where why is null), 0) as bigint) as annotations,
      count(*) filter (where why is null and n = 0) as empty_images, count(*) filter (where why = 'source') as skipped_images,
      count(*) filter (where why = 'ignore') as skipped_ignore_images, count(*) filter (where why = 'segmentation') as skipped_missing_segmentation from k group by 1""")
def _(spark, sf):
    return A.export_counts(fixture(spark, sf, "fx_images"), polygon_annotations(spark, sf), ["1-URGENT", "5-LOW", "2-HIGH"], segment=True)


@query("mask_source_counts", """
    select case when l_partkey % 8 <> 0 then 'polygon' when l_partkey % 16 = 0 then 'rle' else 'bbox' end as mask_source, count(*) as masks from fx_annotations group by 1""")
def _(spark, sf):
    flat = F.array(F.array(c("x"), c("y"), c("x") + 1, c("y"), c("x"), c("y") + 1))
    rle = F.struct(F.array(F.lit(4), F.lit(4)).alias("size"), F.array(F.lit(16)).alias("counts"))
    df = fixture(spark, sf, "fx_annotations").withColumn("polygons", F.when(c("l_partkey") % 8 != 0, flat)).withColumn("rle", F.when(c("l_partkey") % 16 == 0, rle))
    return A.mask_source_counts(df, G.mask_source_priority(c("polygons"), c("rle")))


@query("crop_index", """
    select concat_ws('/', 'crops', split, category, printf('%s_%06d_%07d.jpg', source_dataset, i.id, a.id)) as crop_path, file_name as source_image, source_dataset, group_id, split,
      category, 's' as subtype, 'x;y' as attributes, 'raw' as source_class, 'bbox' as annotation_geometry, concat_ws(',', cast(cast(w as int) as string), cast(cast(h as int) as string)) as bbox
    from fx_images i join fx_annotations a on a.image_id = i.id where source_dataset <> '3-MEDIUM'
    union all select concat_ws('/', 'crops', split, 'normal', printf('%s_%06d_normal.jpg', source_dataset, id)), file_name, source_dataset, group_id, split,
      'normal', '', 'verified_negative', 'verified_negative', 'image_level', '' from fx_images
    where defect_label_state = 'verified_negative' and source_dataset in ('1-URGENT', '3-MEDIUM', '5-LOW') and source_dataset <> '3-MEDIUM' and id not in (select image_id from fx_annotations)""")
def _(spark, sf):
    rows = fixture(spark, sf, "fx_annotations").select(
        "id", "image_id", "category", F.lit("s").alias("subtype"), F.array(F.lit("x"), F.lit("y")).alias("attributes"), F.lit("raw").alias("source_class"),
        F.lit(None).cast("string").alias("geometry_type"), F.array(c("w").cast("int"), c("h").cast("int")).alias("bbox"))
    return A.crop_index(fixture(spark, sf, "fx_images"), rows, normal_sources=["1-URGENT", "3-MEDIUM", "5-LOW"], exclude=["3-MEDIUM"])


@query("assign_dense_ids", """
    with i as (select row_number() over (partition by split order by source_dataset, id) as nid, * from fx_images)
    select 'image' as kind, split, source_dataset as source, id as old_id, nid as id, nid as image_id from i
    union all select 'annotation', i.split, source_dataset, a.id, row_number() over (partition by i.split order by source_dataset, a.image_id, a.id), nid
    from fx_annotations a join i on a.image_id = i.id""")
def _(spark, sf):
    images = fixture(spark, sf, "fx_images").select("id", "split", c("source_dataset").alias("source"))
    owner = images.withColumnRenamed("id", "image_id")
    rows = fixture(spark, sf, "fx_annotations").select("id", "image_id").join(owner, "image_id")
    new_images, new_rows = A.renumber(images, rows)
    one = new_images.select(F.lit("image").alias("kind"), "split", "source", "old_id", "id", c("id").alias("image_id"))
    two = new_rows.select(F.lit("annotation").alias("kind"), "split", "source", "old_id", "id", "image_id")
    return one.unionByName(two)


# The lowest free numbers by plain definition: number the repeats, list the numbers not taken.
_DEDUPE = """
    lab as (select l_orderkey as file, ((l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey) as shape_index, case l_returnflag when 'A' then 'knot' when 'R' then 'crack' else 'resin' end as cat,
      concat(case l_returnflag when 'A' then 'K' else 'C' end, lpad(cast(l_linenumber % 3 + 1 as string), 2, '0')) as iid, l_suppkey % 7 <> 0 as valid from fx_items),
    rep as (select *, row_number() over (partition by file, cat order by shape_index) as k from (
      select *, row_number() over (partition by file, cat, iid order by shape_index) as u from lab where valid) where u > 1),
    free as (select f.file, f.cat, n, row_number() over (partition by f.file, f.cat order by n) as k
      from (select file, cat, max(k) as m from rep group by 1, 2) f, range(1, 40) t(n)
      where not exists (select 1 from lab where lab.file = f.file and lab.cat = f.cat and lab.iid = concat(case f.cat when 'knot' then 'K' else 'C' end, lpad(cast(n as string), 2, '0'))))"""


@query("dedupe_instance_ids", f"""
    with {_DEDUPE} select lab.file, lab.shape_index, case when rep.k is not null then concat(case lab.cat when 'knot' then 'K' else 'C' end, lpad(cast(free.n as string), 2, '0')) end as new_id
    from lab left join rep using (file, cat, shape_index) left join free on free.file = lab.file and free.cat = lab.cat and free.k = rep.k where lab.valid""")
def _(spark, sf):
    raw = fixture(spark, sf, "fx_items")
    prefix = F.when(c("l_returnflag") == "A", "K").otherwise("C")
    label = F.concat(F.when(c("l_returnflag") == "A", "knot").when(c("l_returnflag") == "R", "crack").otherwise("resin"), F.lit("|na|"), prefix,
                     F.lpad((c("l_linenumber") % 3 + 1).cast("string"), 2, "0"), F.lit("|clear|0|0"))
    df = raw.select(c("l_orderkey").alias("file"), ((c("l_linenumber").cast("long") * 1000000 + c("l_partkey")) * 100000 + c("l_suppkey")).alias("shape_index"),
                    parse_pipe_label(label).alias("parsed"), (c("l_suppkey") % 7 != 0).alias("valid"))
    return H.dedupe_instance_ids(df).select("file", "shape_index", "new_id")


@query("self_intersections", f"""
    with {_PTS}, q as (select shape_no, points as p from pts where shape_type = 'polygon'),
    s(a, b) as (values (1, 3), (2, 4)),
    t as (select shape_no, a, b, p[a] as a1, p[a % 4 + 1] as a2, p[b] as b1, p[b % 4 + 1] as b2 from q, s),
    o as (select shape_no, sign((a2[1] - a1[1]) * (b1[2] - a1[2]) - (a2[2] - a1[2]) * (b1[1] - a1[1])) * sign((a2[1] - a1[1]) * (b2[2] - a1[2]) - (a2[2] - a1[2]) * (b2[1] - a1[1])) as u,
      sign((b2[1] - b1[1]) * (a1[2] - b1[2]) - (b2[2] - b1[2]) * (a1[1] - b1[1])) * sign((b2[1] - b1[1]) * (a2[2] - b1[2]) - (b2[2] - b1[2]) * (a2[1] - b1[1])) as v from t),
    z as (select shape_no from q where abs(list_sum(list_transform(range(1, 5), lambda i: p[i][1] * p[i % 4 + 1][2] - p[i % 4 + 1][1] * p[i][2]))) = 0)
    select distinct shape_no, 'crossing_edges' as defect from o where u < 0 and v < 0 union all select shape_no, 'zero_area' from z""")
def _(spark, sf):
    df = shape_points(fixture(spark, sf, "fx_shapes")).where("shape_type = 'polygon'").select("shape_no", c("points").alias("polygon"))
    return H.self_intersections(df, ["shape_no"], cell=16.0)


_VALID = f"""
    k as (select *, split_part(label, '|', 1) as cat, case when shape_type = 'rectangle' then w > 0 and h > 0 else true end
      and split_part(label, '|', 1) <> 'bogus' as valid from fx_shapes),
    {_PTS},
    cr as (select shape_no from (select shape_no, points as p from pts where shape_type = 'polygon' and shape_no in (select shape_no from k where valid)),
      (values (1, 3), (2, 4)) s(a, b)
      where sign((p[a % 4 + 1][1] - p[a][1]) * (p[b][2] - p[a][2]) - (p[a % 4 + 1][2] - p[a][2]) * (p[b][1] - p[a][1])) * sign((p[a % 4 + 1][1] - p[a][1]) * (p[b % 4 + 1][2] - p[a][2]) - (p[a % 4 + 1][2] - p[a][2]) * (p[b % 4 + 1][1] - p[a][1])) < 0
        and sign((p[b % 4 + 1][1] - p[b][1]) * (p[a][2] - p[b][2]) - (p[b % 4 + 1][2] - p[b][2]) * (p[a][1] - p[b][1])) * sign((p[b % 4 + 1][1] - p[b][1]) * (p[a % 4 + 1][2] - p[b][2]) - (p[b % 4 + 1][2] - p[b][2]) * (p[a % 4 + 1][1] - p[b][1])) < 0),
    flat as (select shape_no from k where shape_type = 'polygon' and valid and shape_no not in (select shape_no from cr) and
      abs(x * (y + 2) - (x + w) * y + (x + w) * (y + h) - (x + w - 3) * (y + 2) + (x + w - 3) * (y + h + 1) - (x - 1) * (y + h) + (x - 1) * y - x * (y + h + 1)) = 0)"""


@query("outline_defects", f"""
    with {_PTS}, q as (select shape_no, case when shape_type = 'polygon' then points else [[x, y], [x + w, y], [x + w, y + h], [x, y + h]] end as p
      from pts where shape_type = 'polygon' or (w > 0 and h > 0)),
    ed as (select shape_no, i, p[i][1] as x1, p[i][2] as y1, p[i % 4 + 1][1] as x2, p[i % 4 + 1][2] as y2 from q, range(1, 5) t(i)),
    pr as (select a.shape_no, b.i - a.i <> 2 as adjacent, a.x1 as ax1, a.y1 as ay1, a.x2 as ax2, a.y2 as ay2, b.x1 as bx1, b.y1 as by1, b.x2 as bx2, b.y2 as by2,
      sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) as s1, sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) as s2,
      sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) as r1, sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) as r2,
      least(greatest(a.x1, a.x2), greatest(b.x1, b.x2)) - greatest(least(a.x1, a.x2), least(b.x1, b.x2)) as cx,
      least(greatest(a.y1, a.y2), greatest(b.y1, b.y2)) - greatest(least(a.y1, a.y2), least(b.y1, b.y2)) as cy
      from ed a join ed b on a.shape_no = b.shape_no and a.i < b.i),
    kind as (select shape_no, case when s1 = 0 and s2 = 0 and cx >= 0 and cy >= 0 and cx + cy > 0 then 'overlapping' when adjacent then null
      when s1 * s2 < 0 and r1 * r2 < 0 then 'crossing'
      when (s1 = 0 and bx1 between least(ax1, ax2) and greatest(ax1, ax2) and by1 between least(ay1, ay2) and greatest(ay1, ay2))
        or (s2 = 0 and bx2 between least(ax1, ax2) and greatest(ax1, ax2) and by2 between least(ay1, ay2) and greatest(ay1, ay2))
        or (r1 = 0 and ax1 between least(bx1, bx2) and greatest(bx1, bx2) and ay1 between least(by1, by2) and greatest(by1, by2))
        or (r2 = 0 and ax2 between least(bx1, bx2) and greatest(bx1, bx2) and ay2 between least(by1, by2) and greatest(by1, by2)) then 'touching' end as defect from pr)
    select distinct shape_no, defect from kind where defect is not null
    union all select shape_no, 'flat' from q where list_sum(list_transform(range(1, 5), lambda i: p[i][1] * p[i % 4 + 1][2] - p[i % 4 + 1][1] * p[i][2])) = 0""")
def _(spark, sf):
    """Polygons and rectangles alike."""
    df = shape_points(fixture(spark, sf, "fx_shapes")).select("shape_no", G.shape_to_polygon(c("shape_type"), c("points")).alias("polygon"))
    return H.outline_defects(df.where(F.size("polygon") > 0), ["shape_no"], cell=16.0)


# The outcome of every shape: new ids by plain definition, as in _DEDUPE, then the text of its changes.
_NORMALIZED = f"""
    {_VALID},
    part as (select k.*, split_part(label, '|', 3) as iid, split_part(label, '|', 3)[1] as prefix, cat <> 'bogus' as parsed from k),
    rep as (select *, row_number() over (partition by file_no, cat, prefix order by shape_no) as r from (
      select *, row_number() over (partition by file_no, cat, iid order by shape_no) as u from part where valid) where u > 1),
    free as (select f.file_no, f.cat, f.prefix, n, row_number() over (partition by f.file_no, f.cat, f.prefix order by n) as r
      from (select file_no, cat, prefix, max(r) as m from rep group by 1, 2, 3) f, range(1, 40) t(n)
      where not exists (select 1 from part where parsed and part.file_no = f.file_no and part.cat = f.cat and part.iid = concat(f.prefix, lpad(cast(n as string), 2, '0')))),
    tch as (select shape_no, case when shape_type = 'rectangle' then x <= 1.5 or y <= 1.5 or x + w >= 61.5 or y + h >= 57.5
      else len(list_filter(points, lambda q: q[1] <= 1.5 or q[2] <= 1.5 or q[1] >= 61.5 or q[2] >= 57.5)) > 0 end as t from pts),
    normalized as (select part.*, tch.t as t, concat(part.prefix, lpad(cast(free.n as string), 2, '0')) as new_id, rep.r is not null as repeated,
        split_part(part.label, '|', 5) = '1' as was, valid and part.cat in ('knot', 'crack') as prim, shape_no in (select shape_no from flat) as lost, shape_no in (select shape_no from cr) as crossed
      from part join tch using (shape_no) left join (select shape_no, file_no, cat, prefix, r from rep) rep using (shape_no) left join free on free.file_no = part.file_no and free.cat = part.cat and free.prefix = part.prefix and free.r = rep.r),
    outcome as (select concat('f', cast(file_no as string)) as file, cast(shape_no as int) as shape_index, valid, valid and not lost as kept, prim as "primary",
      case when valid then concat_ws('|', cat, split_part(label, '|', 2), case when repeated then new_id else iid end, split_part(label, '|', 4),
        case when t then '1' else '0' end, split_part(label, '|', 6)) end as label,
      '[' || concat_ws(',', case when not valid then '{{"action":"drop_invalid_shape","from":"","to":""}}' end,
        case when valid and not prim then '{{"action":"retain_ignored_shape","from":"' || cat || '","to":""}}' end,
        case when valid and repeated then '{{"action":"deduplicate_instance_id","from":"' || iid || '","to":"' || new_id || '"}}' end,
        case when valid and t <> was then '{{"action":"normalize_truncated","from":"' || cast(was as int) || '","to":"' || cast(t as int) || '"}}' end,
        case when valid and lost then '{{"action":"drop_unrepairable_polygon","from":"","to":""}}' end,
        case when valid and crossed then '{{"action":"flag_crossing_edges","from":"","to":""}}' end) || ']' as changes,
      label as old_label, shape_type, x from normalized)"""


@query("normalize_shapes", f'with {_NORMALIZED} select file, shape_index, label, valid, kept, "primary", changes from outcome')
def _(spark, sf):
    return H.normalize_shapes(shape_rows(spark, sf)).select("file", "shape_index", "label", "valid", "kept", "primary", F.to_json("changes").alias("changes"))


@query("normalized_files_roundtrip", f"""
    with {_NORMALIZED} select file, cast(row_number() over (partition by file order by shape_index) - 1 as int) as place, label, shape_type,
      'née "' || old_label || '"' as note, cast(shape_index as bigint) * 1000000007 as stamp, x / 8 as share, true as payload_gone
    from outcome where kept""")
def _(spark, sf):
    """Shape files with fields the engine does not know, cleaned, written back under their names and read again."""
    shapes = shape_rows(spark, sf).join(fixture(spark, sf, "fx_shapes").select(c("shape_no").cast("int").alias("shape_index"), "x"), "shape_index")
    one = F.struct("shape_index", F.struct(
        "label", "shape_type", "points", F.concat(F.lit('née "'), "label", F.lit('"')).alias("note"),
        F.struct((c("shape_index").cast("long") * 1000000007).alias("stamp"), F.array(c("x") / 8, F.lit(None)).alias("shares")).alias("extra")).alias("s"))
    listed = shapes.groupBy("file").agg(F.array_sort(F.collect_list(one)).alias("l"))
    whole = F.struct(F.lit("5.4.1").alias("version"), F.transform("l", lambda e: e["s"]).alias("shapes"), F.lit("A" * 64).alias("imageData"),
                     F.lit(60).alias("imageHeight"), F.lit(64).alias("imageWidth"))
    source, target = scratch_path(spark, "shapes"), scratch_path(spark, "normalized")
    write_shape_files(listed.select("file", F.to_json(whole).alias("document")), source.removeprefix("file:"), F.concat("file", F.lit(".json")))
    name = F.regexp_extract("file", r"([^/]+)\.json$", 1)
    documents = read_shape_documents(spark, source).withColumn("file", name)
    read = read_labelme(spark, source).withColumn("file", name)
    write_shape_files(cleaned_documents(documents, H.normalize_shapes(read)), target.removeprefix("file:"), F.concat("file", F.lit(".json")))
    back = read_shape_documents(spark, target).select(name.alias("file"), F.from_json("document", """
        imageData string, imageWidth int, shapes array<struct<label:string,shape_type:string,note:string,extra:struct<stamp:bigint,shares:array<double>>>>""").alias("d"))
    return back.select("file", F.posexplode("d.shapes").alias("place", "s"), (c("d.imageData").isNull() & (c("d.imageWidth") == 64)).alias("payload_gone")).select(
        "file", "place", "s.label", "s.shape_type", "s.note", "s.extra.stamp", c("s.extra.shares")[0].alias("share"), "payload_gone")


@query("normalization_audit", f"""
    with {_VALID} select concat('f', cast(file_no as string)) as file, count(*) as input_shapes, count(*) filter (where valid and shape_no not in (select shape_no from flat)) as valid_instances,
      count(*) filter (where valid and cat in ('knot', 'crack')) as primary_instances, count(*) filter (where valid and cat not in ('knot', 'crack')) as ignored_instances,
      count(*) filter (where valid and shape_no not in (select shape_no from flat)) as output_shapes from k group by 1""")
def _(spark, sf):
    return H.normalization_audit(H.normalize_shapes(shape_rows(spark, sf)))


@query("normalization_actions", f"""
    with {_VALID},
    num as (select *, row_number() over (partition by file_no, cat, split_part(label, '|', 3) order by shape_no) as u from k where valid),
    tch as (select shape_no, case when shape_type = 'rectangle' then x <= 1.5 or y <= 1.5 or x + w >= 61.5 or y + h >= 57.5
      else len(list_filter(points, lambda q: q[1] <= 1.5 or q[2] <= 1.5 or q[1] >= 61.5 or q[2] >= 57.5)) > 0 end as t from pts)
    select action, count(*) as changes from (
      select 'drop_invalid_shape' as action from k where not valid
      union all select 'retain_ignored_shape' from k where valid and cat not in ('knot', 'crack')
      union all select 'deduplicate_instance_id' from num where u > 1
      union all select 'normalize_truncated' from k join tch using (shape_no) where valid and t <> (split_part(label, '|', 5) = '1')
      union all select 'drop_unrepairable_polygon' from flat
      union all select 'flag_crossing_edges' from (select distinct shape_no from cr)) group by 1""")
def _(spark, sf):
    return H.normalization_actions(H.normalize_shapes(shape_rows(spark, sf)))
