"""Queries that write files from the tables and read them back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolake import schema
from annolake.functions.geometry import xywh
from annolake.functions.labels import hex_hash, parse_hex_hash
from annolake.operators import metrics as E
from annolake.operators import profile as P
from annolake.operators.annotations import crop_index, label_lines
from annolake.operators.duplicates import resolve_hash
from annolake.operators.integrity import integrity_report
from annolake.plans.build import build_catalog
from annolake.plans.fixtures import fixture
from annolake.plans.queries_geometry import polygon_annotations, shape_rows
from annolake.plans.queries_metrics import hashed, near_duplicates
from annolake.plans.registry import query
from annolake.presets import taxonomy
from annolake.session import SPREAD, scratch_path, shuffle_partitions
from annolake.sinks import tables as K
from annolake.sources import files as S
from annolake.sources import scan as Z

c = F.col
_ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KEYS = ", ".join(_ROW)
_BOX_ID = "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string))"
_COLUMNS = (
    "image_path, dataset_id, sample_id, group_id, image_width, image_height, image_bytes, split, has_ring, has_pith, dataset_role, "
    "ring_label_state, defect_label_state, defect_instance_count, ring_annotation_path, defect_mask_path, supervision_scope, ring_r2_fold"
)


def full_catalog(spark, sf):
    df = fixture(spark, sf, "fx_catalog")
    return Z.catalog_rows(df, **{name: c(name) for name in df.columns})


def _text(df, value, *by) -> str:
    """Write one text column below the shared folder, one subfolder per value of ``by``."""
    path = scratch_path(df.sparkSession, "text")
    out = df.select(*by, value.alias("value"))
    writer = out.write.partitionBy(*by) if by else out.write
    writer.text(path)
    return path


def _xml(df, item, key, root="annotations") -> str:
    """Write items as XML documents, each under one root element and those of one ``key`` in the same one.

    There is one document per task, not per key: every file costs an opening, a rename and a listing, whatever it holds. Rows
    are dealt before they become text and documents are compressed, as tags take many times the room of what they hold.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "xml")
    parts = max(SPREAD, shuffle_partitions(df))
    rows = df.withColumns({"_part": F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"), "_order": F.lit(1)})
    ends = spark.range(parts).select(c("id").cast("int").alias("_part"), F.explode(F.array(F.lit(0), F.lit(2))).alias("_order"))
    dealt = rows.unionByName(ends, allowMissingColumns=True).repartitionById(parts, "_part").sortWithinPartitions("_order")
    text = F.when(c("_order") == 0, f"<{root}>").when(c("_order") == 2, f"</{root}>").otherwise(item)
    dealt.select(text.alias("value")).write.text(path, compression="gzip")
    return path


@query("catalog_roundtrip", f"select {_COLUMNS}, '' as notes from fx_catalog")
def _(spark, sf):
    path = scratch_path(spark, "catalog")
    K.write_catalog(full_catalog(spark, sf), path)
    return S.read_catalog(spark, path).select(*_COLUMNS.split(", "), "notes")


@query("group_splits_roundtrip", """
    select arg_min(dataset_id, dataset_id || chr(1) || sample_id) as dataset_id, group_id, arg_min(split, dataset_id || chr(1) || sample_id) as split,
      arg_min(ring_r2_fold, dataset_id || chr(1) || sample_id) as ring_r2_fold, count(*) as sample_count from fx_catalog group by group_id""")
def _(spark, sf):
    path = scratch_path(spark, "groups")
    K.write_group_splits(full_catalog(spark, sf), path)
    kind = T.StructType([T.StructField(n, T.LongType() if n == "sample_count" else T.StringType()) for n in schema.INDEX_COLUMNS["group"]])
    return S.read_table(spark, path, kind)


@query("list_assets", """
    select o_orderstatus as folder, cast(sum(length(o_orderpriority) + 1) as bigint) as bytes, true as stamped from orders group by 1""")
def _(spark, sf):
    path = _text(fixture(spark, sf, "orders"), c("o_orderpriority"), "o_orderstatus")
    files = S.list_assets(spark, path, ["txt"])
    return files.groupBy(F.regexp_extract("path", "o_orderstatus=([^/]+)/", 1).alias("folder")).agg(
        F.sum("size").alias("bytes"), F.bool_and(c("mtime") > 0).alias("stamped"))


@query("read_contents", """
    select concat('n', n_nationkey) as folder, sha256(concat(n_name, chr(10))) as sha256, length(n_name) + 1 as size from nation""")
def _(spark, sf):
    nation = fixture(spark, sf, "nation").withColumn("f", F.concat(F.lit("n"), c("n_nationkey").cast("string")))
    path = _text(nation, c("n_name"), "f")
    return S.read_contents(spark, path, "*.txt").select(F.regexp_extract("path", "f=([^/]+)/", 1).alias("folder"), "sha256", "size")


@query("read_key_set", "select distinct c_mktsegment as Image from customer where c_custkey % 3 <> 0")
def _(spark, sf):
    path = scratch_path(spark, "keys")
    key = F.when(c("c_custkey") % 3 == 0, " ").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")))
    fixture(spark, sf, "customer").select(key.alias("Image"), "c_name").write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return S.read_key_set(spark, path, "Image")


@query("read_labelme", """
    select concat('d', file_no // 10) as file, count(*) as shapes, cast(sum(case when shape_type = 'rectangle' then 2 else 4 end) as bigint) as points,
      count(distinct label) as label_kinds, 64 as width, 60 as height from fx_shapes group by 1""")
def _(spark, sf):
    shapes = shape_rows(spark, sf).withColumn("d", F.concat(F.lit("d"), F.floor(F.substring("file", 2, 9).cast("int") / 10).cast("string")))
    doc = shapes.groupBy("d").agg(F.collect_list(F.struct("label", "shape_type", "points")).alias("shapes")).select(
        "d", "shapes", F.lit("p.png").alias("imagePath"), F.repeat(F.lit("QUJD"), 500).alias("imageData"), F.lit(64).alias("imageWidth"), F.lit(60).alias("imageHeight"))
    path = _text(doc, F.to_json(F.struct("shapes", "imagePath", "imageData", "imageWidth", "imageHeight")), "d")
    rows = S.read_labelme(spark, path)
    return rows.groupBy(F.regexp_extract("file", "d=([^/]+)/", 1).alias("file")).agg(
        F.count(F.lit(1)).alias("shapes"), F.sum(F.size("points").cast("long")).alias("points"), F.count_distinct("label").alias("label_kinds"),
        F.max("width").alias("width"), F.max("height").alias("height"))


def _tag(name, value):
    return F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))


@query("read_voc_boxes", f"""
    with b as (select *, {_BOX_ID} as name, greatest(0.0, x - 5) as x1, greatest(0.0, y - 5) as y1, least(50.0, x + w - 5) as x2, least(30.0, y + h - 5) as y2 from fx_boxes)
    select name as raw_label, l_suppkey % 2 = 1 as truncated, x1 as x, y1 as y, x2 - x1 as w, y2 - y1 as h from b where x2 > x1 and y2 > y1""")
def _(spark, sf):
    b = fixture(spark, sf, "fx_boxes")
    box = F.concat(_tag("xmin", c("x") - 5), _tag("ymin", c("y") - 5), _tag("xmax", c("x") + c("w") - 5), _tag("ymax", c("y") + c("h") - 5))
    item = F.concat(F.lit("<annotation><size><width>50</width><height>30</height></size><object>"), _tag("name", c("box_id")),
                    _tag("truncated", (c("l_suppkey") % 2).cast("int")), F.lit("<bndbox>"), box, F.lit("</bndbox></object></annotation>"))
    rows = S.read_voc_boxes(spark, _xml(b, item, F.floor(c("image_id") / 10)))
    return rows.where("box is not null").select("raw_label", "truncated", "box.*")


@query("read_cvat_polylines", """
    select concat('s', s_suppkey, '.jpg') as image_name, 3 as points, round(s_acctbal, 2) + 2.0 as total from supplier where s_suppkey % 2 = 0""")
def _(spark, sf):
    df = fixture(spark, sf, "supplier")
    label = F.when(c("s_suppkey") % 2 == 0, "Ring").otherwise("Pith")
    item = F.concat(F.lit('<image name="a/b/s'), c("s_suppkey").cast("string"), F.lit('.jpg" width="9" height="8"><polyline label="'), label,
                    F.lit('" points="'), c("s_acctbal").cast("string"), F.lit(',1.0;0.5,2.0;0.5,3.0"/><polyline label="Ring" points="1,1"/></image>'))
    rows = S.read_cvat_polylines(spark, _xml(df, item, F.floor(c("s_suppkey") / 5)))
    total = F.aggregate("points", F.lit(0.0), lambda s, p: s + p.getItem(0)) + 1.0
    return rows.select("image_name", F.size("points").alias("points"), F.round(total, 2).alias("total"))


@query("read_corner_boxes", f"""
    select {_BOX_ID} as raw_label, round(x / 100 * 640, 4) as x, round(y / 100 * 480, 4) as y, round(w / 100 * 640, 4) as w, round(h / 100 * 480, 4) as h from fx_boxes where l_partkey % 7 <> 0""")
def _(spark, sf):
    b = fixture(spark, sf, "fx_boxes")
    parts = [c("box_id"), *[F.replace((v / 100).cast("string"), F.lit("."), F.lit(",")) for v in (c("x"), c("y"), c("x") + c("w"), c("y") + c("h"))]]
    line = F.when(c("l_partkey") % 7 == 0, "two fields").otherwise(F.concat_ws("  ", *parts))
    rows = S.read_corner_boxes(spark, _text(b, line)).withColumns({"width": F.lit(640), "height": F.lit(480)})
    return S.corner_box_pixels(rows).select("raw_label", *[F.round(f"box.{k}", 4).alias(k) for k in "xywh"])


@query("read_center_boxes", f"""
    select {_BOX_ID} as class_id, round((x / 100 - w / 200) * 640, 4) as x, round((y / 100 - h / 200) * 480, 4) as y, round(w / 100 * 640, 4) as w, round(h / 100 * 480, 4) as h from fx_boxes""")
def _(spark, sf):
    b = fixture(spark, sf, "fx_boxes")
    line = F.concat_ws(" ", "box_id", *[(c(k) / 100).cast("string") for k in "xywh"])
    rows = S.read_center_boxes(spark, _text(b, line)).withColumns({"width": F.lit(640), "height": F.lit(480)})
    return S.center_box_pixels(rows).select("class_id", *[F.round(f"box.{k}", 4).alias(k) for k in "xywh"])


@query("read_center_polygons", f"select {_BOX_ID} as class_id, 6 as numbers, round(2 * x + y + w + h, 4) as total from fx_boxes where l_partkey % 3 <> 0")
def _(spark, sf):
    b = fixture(spark, sf, "fx_boxes")
    line = F.when(c("l_partkey") % 3 == 0, F.concat_ws(" ", "box_id", F.lit("1 2 3 4 5"))).otherwise(
        F.concat_ws(" ", "box_id", *[c(k).cast("string") for k in ("x", "y", "x", "w", "h")], F.lit("0")))
    rows = S.read_center_polygons(spark, _text(b, line))
    total = F.aggregate("polygon", F.lit(0.0), lambda s, v: s + v)
    return rows.select("class_id", F.size("polygon").alias("numbers"), F.round(total, 4).alias("total"))


@query("count_nonblank_lines", "select n_nationkey as folder, count(*) filter (where s_suppkey % 4 <> 0) as lines from nation join supplier on s_nationkey = n_nationkey group by 1")
def _(spark, sf):
    text = F.when(c("s_suppkey") % 4 == 0, "  ").otherwise(c("s_name"))
    path = _text(fixture(spark, sf, "supplier"), text, "s_nationkey")
    rows = S.count_nonblank_lines(spark, path, "*.txt")
    return rows.select(F.regexp_extract("file", "s_nationkey=([^/]+)/", 1).cast("int").alias("folder"), "lines")


@query("coco_tables", """
    select i.split, a.id, a.image_id, category_id, x, y, w, h, case when l_partkey % 8 <> 0 then x end as first_x, case when l_partkey % 8 = 0 then 3 end as first_count
    from fx_annotations a join fx_images i on a.image_id = i.id""")
def _(spark, sf):
    images = fixture(spark, sf, "fx_images")
    rle = F.struct(F.array(F.lit(2), F.lit(4)).alias("size"), F.array(F.lit(3), F.lit(5)).alias("counts"))
    rows = polygon_annotations(spark, sf).withColumn("rle", F.when(c("polygons").isNull(), rle)).withColumn(
        "bbox", F.array(*[c(f"bbox.{k}") for k in "xywh"]))
    rows = rows.join(images.select(c("id").alias("image_id"), "split"), "image_id")
    path = scratch_path(spark, "coco")
    K.write_coco_tables(images, rows, path)
    _, back, _ = S.read_coco_tables(spark, path)
    return back.select("split", "id", "image_id", "category_id", *[c("bbox")[i].alias(k) for i, k in enumerate("xywh")],
                       F.get(c("polygons")[0], F.lit(0)).alias("first_x"), F.get("rle.counts", F.lit(0)).alias("first_count"))


@query("coco_document_lines", """
    with i as (select split, count(*) as n from fx_images group by 1), a as (select i.split, count(*) as n from fx_annotations n join fx_images i on n.image_id = i.id group by 1)
    select split, i.n as images, a.n as annotations, i.n + a.n + 3 as lines, i.n + a.n - 2 as commas from i join a using (split)""")
def _(spark, sf):
    images = fixture(spark, sf, "fx_images")
    rows = polygon_annotations(spark, sf, wide=True).join(images.select(c("id").alias("image_id"), "split"), "image_id")
    path = scratch_path(spark, "documents")
    K.write_coco(images, rows, path)
    text = spark.read.text(path)
    return text.groupBy("split").agg(
        F.count_if(c("value").contains('"file_name"')).alias("images"), F.count_if(c("value").contains('"category_id"')).alias("annotations"),
        F.count(F.lit(1)).alias("lines"), F.count_if(c("value").startswith(",")).alias("commas"))


@query("coco_document_roundtrip", """
    with a as (select i.split, a.id, a.image_id, category_id, case when l_partkey % 8 <> 0 then x + w end as third_x, case when l_partkey % 8 = 0 then 5 end as last_count
        from fx_annotations a join fx_images i on a.image_id = i.id)
    select 'annotations' as list, split, id, image_id, category_id as number, third_x, last_count, null as name from a
    union all select 'images', split, id, null, width, null, null, file_name from fx_images
    union all select 'categories', split, k, null, k, null, null, name from (select distinct split from fx_images), (values (1, 'knot'), (2, 'crack')) as t(k, name)""")
def _(spark, sf):
    """One JSON document per split, written by K3, read back in byte ranges by S9."""
    images = fixture(spark, sf, "fx_images")
    rle = F.struct(F.array(F.lit(2), F.lit(4)).alias("size"), F.array(F.lit(3), F.lit(5)).alias("counts"))
    rows = polygon_annotations(spark, sf).withColumn("rle", F.when(c("polygons").isNull(), rle)).join(images.select(c("id").alias("image_id"), "split"), "image_id")
    path = scratch_path(spark, "documents")
    K.write_coco_documents(images, rows.withColumn("bbox", F.array(*[c(f"bbox.{k}") for k in "xywh"])), path)
    images, annotations, categories = S.read_coco(spark, path)
    none = lambda kind: F.lit(None).cast(kind)
    return annotations.select(
        F.lit("annotations").alias("list"), "split", "id", "image_id", c("category_id").alias("number"), c("polygons")[0][2].alias("third_x"),
        F.get("rle.counts", F.lit(1)).alias("last_count"), none("string").alias("name"),
    ).union(images.select(F.lit("images"), "split", "id", none("long"), "width", none("double"), none("int"), "file_name")).union(
        categories.select(F.lit("categories"), "split", c("id").cast("long"), none("long"), "id", none("double"), none("int"), "name"))


@query("label_files_roundtrip", """
    with a as (select a.image_id, category_id - 1 as k, a.id, (x + w / 2) / width as cx, (y + h / 2) / height as cy, a.w / width as bw, a.h / height as bh
        from fx_annotations a join fx_images i on a.image_id = i.id),
    told as (select image_id, printf('%d', k) as class_id, cast(printf('%.6f', cx) as double) as cx, cast(printf('%.6f', cy) as double) as cy,
        cast(printf('%.6f', bw) as double) as w, cast(printf('%.6f', bh) as double) as h from a)
    select split || '/' || lpad(cast(id as string), 8, '0') as file, class_id, cx, cy, w, h
    from fx_images left join told on image_id = id where ignored_instance_count = 0""")
def _(spark, sf):
    """One label text per image (K4), read back as centre boxes (S8); images without a box have an empty file."""
    path = scratch_path(spark, "label-files")
    K.write_label_files(label_lines(fixture(spark, sf, "fx_images"), polygon_annotations(spark, sf)), path.removeprefix("file:"))
    name = lambda column: F.regexp_extract(column, r"([^/]+/[^/]+)\.txt$", 1)
    boxes = S.read_center_boxes(spark, f"{path}/*").select(name("file").alias("file"), "class_id", "cx", "cy", "w", "h")
    files = S.list_assets(spark, path, ["txt"]).select(name("path").alias("file"))
    return files.join(boxes, "file", "left")


_LINES = """
    lines as (select l_returnflag as folder, case l_partkey % 7
        when 0 then concat(l_returnflag, ' 1 2 3') when 1 then concat(l_returnflag, ' 1,5 2 x 4') when 2 then ' ' when 3 then concat(l_returnflag, ' 1 2 3 inf')
        when 4 then concat(l_returnflag, ' 1,25 2 3 4,75 9') else concat(l_returnflag, ' 1,25 2 ', cast(l_linenumber as string), ' 4,75') end as line,
      case l_partkey % 7 when 0 then 'fields' when 1 then 'number' when 2 then 'blank' when 3 then 'not finite' when 4 then 'fields' end as reason, l_linenumber
      from {items})"""


@query("label_line_reasons", f"""
    with {_LINES.replace('{items}', 'fx_items')}
    select folder, coalesce(reason, 'good') as reason, count(*) as lines, cast(sum(case when reason is null then l_linenumber end) as double) as good_x2 from lines group by 1, 2""")
def _(spark, sf):
    """Each malformed line once with its reason; good lines are those of S7."""
    told = spark.sql("with " + _LINES + " select folder, line from lines", items=fixture(spark, sf, "fx_items"))
    path = _text(told, c("line"), "folder")
    folder = F.regexp_extract("file", "folder=([^/]+)/", 1).alias("folder")
    lines = S.label_line_reasons(spark, path, "corner_boxes").select(folder, F.coalesce("reason", F.lit("good")).alias("reason"))
    finite = F.abs("y2") < float("inf")
    boxes = S.read_corner_boxes(spark, path).where(c("x2").isNotNull() & finite).groupBy(folder).agg(F.sum("x2").alias("good_x2")).withColumn("reason", F.lit("good"))
    return lines.groupBy("folder", "reason").agg(F.count(F.lit(1)).alias("lines")).join(boxes, ["folder", "reason"], "left")


@query("label_text_roundtrip", """
    select split, lpad(cast(id as string), 8, '0') as name, (select count(*) from fx_annotations where image_id = fx_images.id) as lines from fx_images where ignored_instance_count = 0""")
def _(spark, sf):
    path = scratch_path(spark, "labels")
    K.write_label_text(label_lines(fixture(spark, sf, "fx_images"), polygon_annotations(spark, sf)), path)
    text = spark.read.schema("name string, label_text string, split string").json(path)
    lines = F.when(c("label_text") == "", 0).otherwise(F.size(F.split("label_text", "\n"))).cast("long")
    return text.select("split", "name", lines.alias("lines"))


@query("report_roundtrip", "select dataset_id, count(*) as images, count(distinct group_id) as groups from fx_catalog group by 1")
def _(spark, sf):
    path = scratch_path(spark, "report")
    K.write_report(P.quality_profile(fixture(spark, sf, "fx_catalog")), path)
    return S.read_metrics_log(spark, path, "dataset_id string, images long, groups long")


@query("metrics_log", "select run, epoch, score, metric from fx_history")
def _(spark, sf):
    path = scratch_path(spark, "history")
    df = fixture(spark, sf, "fx_history")
    for part in (c("metric") == "click", c("metric") != "click"):
        K.append_metrics_log(df.where(part), path)
    return S.read_metrics_log(spark, path, "run long, epoch long, score double, metric string")


@query("registry_roundtrip", """
    select dataset_id, count(*) as manifest_images, concat('{', string_agg(concat('"', split, '":', n), ',' order by split), '}') as splits from (
      select dataset_id, split, count(*) as n, sum(count(*)) over (partition by dataset_id) as t from fx_catalog group by 1, 2) group by 1""".replace("count(*) as manifest_images", "cast(max(t) as bigint) as manifest_images"))
def _(spark, sf):
    from annolake.operators.catalog import enrich_registry

    catalog = fixture(spark, sf, "fx_catalog")
    registry = catalog.select("dataset_id").distinct().withColumn("title", F.lit("t"))
    path = scratch_path(spark, "registry")
    K.write_registry(enrich_registry(registry, catalog), path)
    kind = T.StructType([T.StructField(n, T.LongType() if n == "manifest_images" else T.StringType()) for n in schema.INDEX_COLUMNS["registry"]])
    return S.read_table(spark, f"{path}/csv", kind).select("dataset_id", "manifest_images", "splits")


def crops(spark, sf):
    rows = polygon_annotations(spark, sf).select(
        "id", "image_id", "category", F.lit("s").alias("subtype"), F.array(F.lit("x"), F.lit("y")).alias("attributes"), F.lit("raw").alias("source_class"),
        F.lit(None).cast("string").alias("geometry_type"), F.array(c("bbox.w"), c("bbox.h")).alias("bbox"))
    return crop_index(fixture(spark, sf, "fx_images"), rows, normal_sources=["1-URGENT", "5-LOW"])


@query("index_roundtrip", """
    select file_name as source_image, category, 'x;y' as attributes from fx_images i join fx_annotations a on a.image_id = i.id
    union all select file_name, 'normal', 'verified_negative' from fx_images where defect_label_state = 'verified_negative' and source_dataset in ('1-URGENT', '5-LOW') and id not in (select image_id from fx_annotations)""")
def _(spark, sf):
    path = scratch_path(spark, "index")
    K.write_index(crops(spark, sf), path, "crop")
    kind = T.StructType([T.StructField(n, T.StringType()) for n in schema.INDEX_COLUMNS["crop"]])
    return S.read_table(spark, path, kind).select("source_image", "category", "attributes")


@query("candidate_index", """
    with h as (select *, xor(('0x' || substr(sha256(cast(o_custkey as varchar)), 1, 15))::bigint, 1::bigint << cast(o_orderkey % 60 as int)) as phash from fx_hash)
    select cast(bit_count(xor(a.phash, b.phash)) as int) as hamming_distance, count(*) as pairs from h a join h b on a.sample_id < b.sample_id and a.split <> b.split and bit_count(xor(a.phash, b.phash)) <= 4 group by 1""")
def _(spark, sf):
    path = scratch_path(spark, "candidates")
    K.write_index(near_duplicates(spark, sf), path, "candidate")
    kind = T.StructType([T.StructField(n, T.IntegerType() if n == "hamming_distance" else T.StringType()) for n in schema.INDEX_COLUMNS["candidate"]])
    return S.read_table(spark, path, kind).groupBy("hamming_distance").agg(F.count(F.lit(1)).alias("pairs"))


@query("hash_index", """
    with h as (select *, xor(('0x' || substr(sha256(cast(o_custkey as varchar)), 1, 15))::bigint, 1::bigint << cast(o_orderkey % 60 as int)) as phash from fx_hash)
    select cast(sample_id as varchar) as sample_id, image_path, split, group_id, lpad(lower(to_hex(phash)), 16, '0') as phash_hex,
      case when sample_id % 3 = 0 then 'precomputed' else 'computed' end as hash_source, phash from h""")
def _(spark, sf):
    """The index of hashes with their source (K8), written and read back; the text form gives the hash again."""
    given = hashed(spark, sf)
    resolved = resolve_hash(given.drop("phash"), given.where("sample_id % 3 = 0").select("sample_id", "phash"), given.where("sample_id < 0").select("sample_id", "image_path", "phash"))
    fresh = resolved.join(given.select("sample_id", c("phash").alias("own")), "sample_id").withColumn("phash", F.coalesce("phash", "own"))
    path = scratch_path(spark, "hashes")
    K.write_index(fresh.withColumn("phash_hex", hex_hash(c("phash"))), path, "hash")
    kind = T.StructType([T.StructField(n, T.StringType()) for n in schema.INDEX_COLUMNS["hash"]])
    return S.read_table(spark, path, kind).withColumn("phash", parse_hex_hash(c("phash_hex")))


@query("mask_contract_roundtrip", "select sample_id, split, defect_mask_path as source_semantic_mask from fx_catalog where dataset_id = '2-HIGH'")
def _(spark, sf):
    path = scratch_path(spark, "contract")
    K.write_mask_contract(fixture(spark, sf, "fx_catalog"), path, "2-HIGH")
    kind = T.StructType([T.StructField(n, T.StringType()) for n in schema.INDEX_COLUMNS["mask_contract"]])
    return S.read_table(spark, path, kind).select("sample_id", "split", "source_semantic_mask")


@query("prebuilt_manifest", """
    select sample_id, split, image_bytes, concat('pre/', image_path) as image_path, case when image_width % 2 = 0 then image_width % 5 else 0 end as ignored_defect_instance_count from fx_catalog""")
def _(spark, sf):
    root = scratch_path(spark, "prebuilt")
    df = fixture(spark, sf, "fx_catalog")
    K._write_csv(df.select("image_path", "sample_id", "group_id", "split", "image_width", "image_height", "image_bytes", "defect_mask_path", "defect_label_state", "defect_instance_count"), f"{root}/pre/manifests/manifest.csv")
    K._write_csv(df.where("image_width % 2 = 0").select("sample_id", F.lit("a;b").alias("raw_classes"), (c("image_width") % 5).alias("excluded_instance_count")), f"{root}/pre/manifests/source_inventory.csv")
    out = Z.scan_dataset(spark, root, f"{root}/pre", "pre", "prebuilt")
    return out.select("sample_id", "split", "image_bytes", "image_path", "ignored_defect_instance_count")


# Folder layouts from an inventory table: paths and contents are made of the tables' keys. ---


def inventory(df, *paths):
    """Listing rows from path columns; null paths drop out."""
    return df.select(F.explode(F.array(*paths)).alias("path"), F.lit(10).cast("long").alias("size")).where("path is not null")


def _join(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


@query("scan_ring_and_defect_polygons", """
    select concat('ds:P', c_custkey, 'a') as sample_id, concat('ds:P', c_custkey) as group_id, c_custkey % 2 = 0 as has_ring, c_custkey % 5 = 0 as has_pith,
      case when c_custkey % 3 = 0 then 'bridge' else 'ring_main' end as dataset_role,
      case when c_custkey % 3 <> 0 then 'missing' when c_custkey % 9 = 0 then 'positive' when c_custkey % 9 = 3 then 'ignore_only' else 'verified_negative' end as defect_label_state,
      case when c_custkey % 9 = 0 then 1 else 0 end as defect_instance_count, case when c_custkey % 9 = 3 then 1 else 0 end as ignored_defect_instance_count,
      case when c_custkey % 9 = 0 then 'crack' when c_custkey % 3 = 0 then 'normal' else '' end as unified_category, case when c_custkey % 9 = 0 then 'affects_rings;truncated' else '' end as attributes
    from customer""")
def _(spark, sf):
    df = fixture(spark, sf, "customer")
    stem = _join("P", c("c_custkey").cast("string"), "a")
    defect = F.when(c("c_custkey") % 3 == 0, _join("/w/ds/annotations/defects/", stem, ".json"))
    assets = inventory(df, _join("/w/ds/images/images/", stem, ".png"), F.when(c("c_custkey") % 2 == 0, _join("/w/ds/ring_annotations/ring_annotations/", stem, ".json")), defect)
    kind = F.when(c("c_custkey") % 9 == 0, "crack|na|C01|clear|1|1").when(c("c_custkey") % 9 == 3, "resin|na|R1|clear|0|0").otherwise("bad")
    square = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (4, 0), (4, 4))])
    shapes = df.where("c_custkey % 3 = 0").select(defect.alias("file"), F.lit(0).alias("shape_index"), kind.alias("label"), F.lit("polygon").alias("shape_type"), square.alias("points"))
    pith = df.where("c_custkey % 5 = 0").select(stem.alias("Image"))
    out = Z.scan_dataset(spark, "/w", "/w/ds", "ds", "ring_and_defect_polygons", assets=assets, shapes=shapes, pith=pith)
    return out.select("sample_id", "group_id", "has_ring", "has_pith", "dataset_role", "defect_label_state", "defect_instance_count", "ignored_defect_instance_count", "unified_category", "attributes")


@query("scan_ring_polygons", """
    select concat('ds:A', c_custkey, case when c_custkey % 4 = 0 then '-2' when c_custkey % 4 = 1 then 'C' else '' end) as sample_id, concat('ds:A', c_custkey) as group_id,
      c_custkey % 2 = 0 as has_ring, (c_custkey % 5 = 0) or (c_custkey % 6 = 0) as has_pith,
      case when c_custkey % 6 = 0 then concat('ds/annotations/annual_rings/A', c_custkey, case when c_custkey % 4 = 0 then '-2' else '' end, '.json') when c_custkey % 5 = 0 then 'ds/pith_location.txt' else '' end as pith_annotation_path
    from customer""")
def _(spark, sf):
    df = fixture(spark, sf, "customer")
    mark = F.when(c("c_custkey") % 4 == 0, "-2").when(c("c_custkey") % 4 == 1, "C").otherwise("")
    stem = _join("A", c("c_custkey").cast("string"), mark)
    ring = F.when(c("c_custkey") % 2 == 0, _join("/w/ds/annotations/annual_rings/", stem, ".json"))
    assets = inventory(df, _join("/w/ds/images/", stem, ".jpg"), ring)
    shape = F.struct(F.lit("pith").alias("label"), F.when(c("c_custkey") % 6 == 0, "point").otherwise("polygon").alias("shape_type"))
    documents = df.where("c_custkey % 2 = 0").select(ring.alias("file"), F.array(shape).alias("shapes"))
    pith = df.where("c_custkey % 5 = 0").select(stem.alias("Code"))
    out = Z.scan_dataset(spark, "/w", "/w/ds", "ds", "ring_polygons", assets=assets, documents=documents, pith=pith)
    return out.select("sample_id", "group_id", "has_ring", "has_pith", "pith_annotation_path")


@query("scan_named_discs", """
    select case when o_orderkey % 3 = 0 then concat('ds:odd', o_orderkey) else concat('ds:T', o_orderkey, '_B', o_custkey, '_N', o_custkey % 7, '_v_1') end as sample_id,
      case when o_orderkey % 3 = 0 then concat('ds:odd', o_orderkey) else concat('ds:B', o_custkey, '_N', o_custkey % 7) end as group_id,
      case when o_orderkey % 3 = 0 then '' else 'v_1' end as face_id from orders""")
def _(spark, sf):
    df = fixture(spark, sf, "orders")
    s = lambda column: column.cast("string")
    stem = F.when(c("o_orderkey") % 3 == 0, _join("odd", s(c("o_orderkey")))).otherwise(
        _join("T", s(c("o_orderkey")), "_B", s(c("o_custkey")), "_N", s(c("o_custkey") % 7), "_v_1"))
    assets = inventory(df, _join("/w/ds/images/", stem, ".png"))
    out = Z.scan_dataset(spark, "/w", "/w/ds", "ds", "named_discs", assets=assets, pith=df.limit(0).select(stem.alias("Code")))
    return out.select("sample_id", "group_id", "face_id")


@query("scan_cube_faces", """
    with k as (select c_custkey, f, c_custkey % 2 = 0 or (c_custkey % 3 = 0 and f <> 'C') as has_file, c_custkey % 2 = 0 as whole from customer, (values ('A'), ('B'), ('C'), ('D'), ('E'), ('F')) t(f))
    select concat('ds:cube', c_custkey, ':', f) as sample_id, concat('ds:cube', c_custkey) as group_id, case when f in ('B', 'D') then 'transverse' else 'side' end as surface_type,
      c_custkey % 5 = 0 as has_ring, case when whole then 'bridge' else 'ring_multiface' end as dataset_role, case when whole then 'verified_negative' else 'missing' end as defect_label_state,
      case when whole then concat('ds/cube', c_custkey, '/defects/', f, case when f = 'A' then '.json' else '_col.json' end) else '' end as defect_annotation_path from k""")
def _(spark, sf):
    df = fixture(spark, sf, "customer").withColumn("f", F.explode(F.array(*[F.lit(x) for x in "ABCDEF"])))
    folder = _join("/w/ds/cube", c("c_custkey").cast("string"), "/")
    defect = (c("c_custkey") % 2 == 0) | ((c("c_custkey") % 3 == 0) & (c("f") != "C"))
    ending = F.when(c("f") == "A", ".json").otherwise("_col.json")
    assets = inventory(df, _join(folder, c("f"), "_col.png"), F.when(c("c_custkey") % 5 == 0, _join(folder, c("f"), "_ann.png")), F.when(defect, _join(folder, "defects/", c("f"), ending)))
    shapes = df.limit(0).select(folder.alias("file"), F.lit(0).alias("shape_index"), F.lit("").alias("label"), F.lit("").alias("shape_type"), F.array(F.array(F.lit(0.0))).alias("points"))
    out = Z.scan_dataset(spark, "/w", "/w/ds", "ds", "cube_faces", assets=assets, shapes=shapes)
    return out.select("sample_id", "group_id", "surface_type", "has_ring", "dataset_role", "defect_label_state", "defect_annotation_path")


@query("scan_split_class_folders", """
    select concat('vnwoodknot:', case o_orderstatus when 'O' then 'train' when 'P' then 'validation' else 'test' end, ':', o_custkey % 3, ':Im', o_orderkey) as sample_id,
      case when o_custkey % 3 = 0 then 'verified_negative' else 'positive' end as defect_label_state, case o_custkey % 3 when 0 then 'normal' else 'knot' end as unified_category,
      o_orderkey % 2 = 0 as has_defect_box, case when o_orderkey % 2 = 0 then cast(o_orderkey % 4 as int) else 0 end as defect_instance_count from orders where o_custkey % 4 <> 3 """.replace("where o_custkey % 4 <> 3", "where o_custkey % 7 <> 3"))
def _(spark, sf):
    df = fixture(spark, sf, "orders")
    part = F.when(c("o_orderstatus") == "O", "train").when(c("o_orderstatus") == "P", "validation").otherwise("test")
    kind = F.when(c("o_custkey") % 7 == 3, "9").otherwise((c("o_custkey") % 3).cast("string"))
    base = _join("/w/ds/data/", part, "/", kind, "/Im", c("o_orderkey").cast("string"))
    boxed = F.when(c("o_orderkey") % 2 == 0, _join(base, ".txt"))
    lines = df.where("o_orderkey % 2 = 0").select(boxed.alias("file"), (c("o_orderkey") % 4).alias("lines"))
    out = Z.scan_dataset(spark, "/w", "/w/ds", "vnwoodknot", "split_class_folders", taxonomy=taxonomy(spark), assets=inventory(df, _join(base, ".jpg"), boxed), lines=lines)
    return out.select("sample_id", "defect_label_state", "unified_category", "has_defect_box", "defect_instance_count")


@query("scan_cvat_surfaces", """
    select concat('ds:', case s when 'train-data' then 'cleaned' else 'rough' end, ':b', c_custkey, '-2') as sample_id, concat('ds:b', c_custkey) as group_id, '2' as face_id,
      c_custkey % 3 = 0 as has_ring, case when c_custkey % 4 = 0 then concat('ds/', s, '/ignore/b', c_custkey, '-2.jpg') else '' end as ignore_mask_path
    from customer, (values ('train-data'), ('train-data-rough')) t(s)""")
def _(spark, sf):
    df = fixture(spark, sf, "customer").withColumn("s", F.explode(F.array(F.lit("train-data"), F.lit("train-data-rough"))))
    name = _join("b", c("c_custkey").cast("string"), "-2.jpg")
    top = _join("/w/ds/", c("s"))
    assets = inventory(df, _join(top, "/image/", name), F.when(c("c_custkey") % 4 == 0, _join(top, "/ignore/", name)))
    polylines = df.where("c_custkey % 3 = 0").select(_join(top, "/label/annotations.xml").alias("file"), name.alias("image_name"))
    out = Z.scan_dataset(spark, "/w", "/w/ds", "ds", "cvat_surfaces", assets=assets, polylines=polylines)
    return out.select("sample_id", "group_id", "face_id", "has_ring", "ignore_mask_path")


@query("scan_voc", """
    select concat('oulu:v', c_custkey) as sample_id, case when c_custkey % 5 = 0 then 'missing' when c_custkey % 3 = 0 then 'positive' when c_custkey % 3 = 1 then 'ignore_only' else 'verified_negative' end as defect_label_state,
      case when c_custkey % 5 <> 0 and c_custkey % 3 = 0 then 1 else 0 end as defect_instance_count, case when c_custkey % 5 = 0 or c_custkey % 3 = 2 then 0 when c_custkey % 3 = 0 then 1 else 1 end as ignored_defect_instance_count,
      case when c_custkey % 5 = 0 or c_custkey % 3 = 2 then '' when c_custkey % 3 = 0 then 'edge_knot;strange' else 'wane' end as raw_defect_classes,
      case when c_custkey % 5 = 0 then '' when c_custkey % 3 = 0 then 'knot' when c_custkey % 3 = 2 then 'normal' else '' end as unified_category from customer""")
def _(spark, sf):
    df = fixture(spark, sf, "customer")
    key = c("c_custkey").cast("string")
    xml = F.when(c("c_custkey") % 5 != 0, _join("/w/ds/Annotations/v", key, ".xml"))
    third = c("c_custkey") % 3
    names = F.when(third == 0, F.array(F.lit("edge_knot"), F.lit("strange"))).when(third == 1, F.array(F.lit("wane"))).otherwise(F.array(F.lit(None).cast("string")))
    named = df.where("c_custkey % 5 <> 0").select(xml.alias("file"), F.explode(names).alias("raw_label"))
    out = Z.scan_dataset(spark, "/w", "/w/ds", "oulu", "voc", taxonomy=taxonomy(spark), assets=inventory(df, _join("/w/ds/JPEGImages/v", key, ".jpg"), xml), named=named)
    return out.select("sample_id", "defect_label_state", "defect_instance_count", "ignored_defect_instance_count", "raw_defect_classes", "unified_category")


@query("scan_anomaly", """
    select concat('ds:', case when p_size % 3 = 0 then 'train' else 'test' end, ':', lower(p_type), ':', p_partkey) as sample_id, case when p_size % 3 = 0 then 'aux_train_reference' else 'external_anomaly_test' end as split,
      lower(p_type) as auxiliary_label, case when p_size % 2 = 0 then concat('ds/ground_truth/', lower(p_type), '/', p_partkey, '_mask.png') else '' end as auxiliary_annotation_path from part""")
def _(spark, sf):
    df = fixture(spark, sf, "part")
    part, key = F.when(c("p_size") % 3 == 0, "train").otherwise("test"), c("p_partkey").cast("string")
    kind = F.lower("p_type")
    assets = inventory(df, _join("/w/ds/", part, "/", kind, "/", key, ".png"), F.when(c("p_size") % 2 == 0, _join("/w/ds/ground_truth/", kind, "/", key, "_mask.png")))
    return Z.scan_dataset(spark, "/w", "/w/ds", "ds", "anomaly", assets=assets).select("sample_id", "split", "auxiliary_label", "auxiliary_annotation_path")


@query("scan_synthetic_variants", """
    select concat('ds:', case when p_size % 2 = 0 then 'DirectionChange' else 'Blur' end, ':', case when p_size % 2 = 0 then cast(p_partkey + 1 as string) else concat(p_partkey, '_deep') end) as sample_id,
      concat('ds:', lpad(cast(case when p_size % 2 = 0 then p_partkey // 8 + 1 else p_partkey end as string), 6, '0')) as group_id,
      case when p_size % 2 = 0 then concat('DirectionChange:direction_', p_partkey % 8) else 'Blur:deep' end as source_variant, 'auxiliary_only' as supervision_scope from part""")
def _(spark, sf):
    df = fixture(spark, sf, "part")
    even, key = c("p_size") % 2 == 0, c("p_partkey")
    variant = F.when(even, "DirectionChange").otherwise("Blur")
    stem = F.when(even, (key + 1).cast("string")).otherwise(_join(key.cast("string"), "_deep"))
    assets = inventory(df, _join("/w/ds/", variant, "/", variant, "/Images/", stem, ".jpg"))
    return Z.scan_dataset(spark, "/w", "/w/ds", "ds", "synthetic_variants", assets=assets).select("sample_id", "group_id", "source_variant", "supervision_scope")


# Whole jobs --------------------------------------------------------------------------------


@query("build_catalog_report")
def _(spark, sf):
    """Scan two layouts, reuse sizes, split, and report on the result."""
    df = fixture(spark, sf, "customer").withColumn("f", F.explode(F.array(*[F.lit(x) for x in "ABCDEF"])))
    folder = _join("/w/cubes/cube", c("c_custkey").cast("string"), "/")
    assets = inventory(df, _join(folder, c("f"), "_col.png"), F.when(c("c_custkey") % 5 == 0, _join(folder, c("f"), "_ann.png")))
    part = fixture(spark, sf, "part")
    more = inventory(part, _join("/w/more/test/x/", c("p_partkey").cast("string"), ".png"))
    shapes = df.limit(0).select(folder.alias("file"), F.lit(0).alias("shape_index"), F.lit("").alias("label"), F.lit("").alias("shape_type"), F.array(F.array(F.lit(0.0))).alias("points"))
    catalog = Z.scan_all(spark, "/w", [
        {"root": "/w/cubes", "dataset_id": "mokume", "layout": "cube_faces", "assets": assets, "shapes": shapes},
        {"root": "/w/more", "dataset_id": "wvtec_wood", "layout": "anomaly", "assets": more}])
    cache = catalog.select("image_path", "image_bytes", F.lit(64).alias("image_width"), F.lit(48).alias("image_height"))
    built = build_catalog(catalog, cache)
    return P.quality_profile(built.drop("needs_read")).join(
        built.groupBy("dataset_id").agg(F.count_if("needs_read").alias("to_read"), F.count_if(c("split") == "train").alias("train")), "dataset_id")


@query("integrity_report", """
    with ok as (select sample_id from fx_catalog where has_ring and image_width % 9 <> 0),
    a as (select n.*, i.width, i.height from fx_annotations n left join fx_images i on n.image_id = i.id),
    cr as (select i.file_name, i.split, i.group_id, n.category from fx_images i join fx_annotations n on n.image_id = i.id union all
      select file_name, split, group_id, 'normal' from fx_images where defect_label_state = 'verified_negative' and source_dataset in ('1-URGENT', '5-LOW') and id not in (select image_id from fx_annotations))
    select (select count(*) from fx_catalog) as manifest_images, (select count(*) from fx_catalog where has_ring and sample_id not in (select sample_id from ok)) as ring_missing,
      (select count(*) from fx_catalog where supervision_scope = 'primary' and defect_label_state <> 'missing') as expected_images,
      (select cast(sum(defect_instance_count) as bigint) from fx_catalog where supervision_scope = 'primary' and defect_label_state <> 'missing') as expected_annotations,
      (select count(*) from fx_images) as images, (select count(*) from fx_annotations) as annotations,
      (select count(*) from a where not (w > 0 and h > 0 and x >= -1 and y >= -1 and x + w <= width + 1 and y + h <= height + 1)) as bbox_errors,
      (select count(*) from fx_images where file_name not in (select path from fx_assets)) as reference_errors,
      (select count(*) from fx_images i join fx_catalog k using (sample_id) where i.split <> k.split or i.group_id <> k.group_id) as group_split_errors,
      (select count(*) from fx_images where ignored_instance_count > 0) as ignore_regions, (select count(*) from fx_images where ignored_instance_count > 0 and width < 60) as ignore_bbox_errors,
      (select count(*) from cr) as crop_rows, (select count(*) from cr join fx_catalog k on file_name = image_path where cr.split <> k.split) as crop_inheritance_errors,
      'error' as status""")
def _(spark, sf):
    catalog = fixture(spark, sf, "fx_catalog")
    ring = catalog.where("has_ring").select(
        "sample_id", F.when(c("image_width") % 9 != 0, "ok").otherwise("error").alias("status"), c("image_path").alias("model_image_path"),
        *[F.lit("").alias(n) for n in ("skeleton_path", "boundary_path", "distance_path", "instance_path", "valid_path")], F.lit(0).alias("non_nested_pairs"))
    region = F.struct(F.array(F.lit(1.0), F.lit(1.0), F.lit(60.0), F.lit(5.0)).alias("bbox"))
    images = fixture(spark, sf, "fx_images").withColumn("ignore_bboxes", F.when(c("ignored_instance_count") > 0, F.array(region)))
    rows = polygon_annotations(spark, sf).withColumn("bbox", F.array(*[c(f"bbox.{k}") for k in "xywh"])).withColumn(
        "rle", F.lit(None).cast("struct<size:array<int>,counts:array<int>>"))
    report = integrity_report(catalog, ring, images, rows, crops(spark, sf), fixture(spark, sf, "fx_assets"))
    return report.select("manifest_images", "ring_missing", "expected_images", "expected_annotations", "images", "annotations", "bbox_errors", "reference_errors",
                         "group_split_errors", "ignore_regions", "ignore_bbox_errors", "crop_rows", "crop_inheritance_errors", "status")
