"""Folder layouts to catalog rows (S13): each is an asset listing, path keys and joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolake import schema
from annolake.functions.geometry import has_point_label
from annolake.functions.labels import (
    attribute_flags, derive_key, label_state, qualified, stem, strip_suffix, variant_key,
)
from annolake.operators.catalog import attach_annotation, complete_sets, union_catalogs
from annolake.operators.profile import distinct_join
from annolake.operators.shapes import parsed_shapes
from annolake.operators.taxonomy import map_taxonomy
from annolake.presets import CATEGORY_IDS
from annolake.session import spread
from annolake.sources import files


def catalog_rows(df: DataFrame, **values: Column | str | bool | int) -> DataFrame:
    """The full catalog schema from the given columns, all others at their default."""
    columns = []
    for field in schema.CATALOG:
        if field.name in values:
            value = values[field.name]
            value = value if isinstance(value, Column) else F.lit(value)
        else:
            blank = {"string": "", "boolean": False}.get(field.dataType.simpleString(), 0)
            value = F.lit(schema.CATALOG_DEFAULTS.get(field.name, blank))
        if isinstance(field.dataType, T.StringType):
            value = F.coalesce(value, F.lit(""))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def _optional(load: Callable[[], DataFrame], spark: SparkSession, ddl: str) -> DataFrame:
    """The loaded table, or an empty one where no file matches."""
    try:
        return load()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


_SHAPE_DDL = (
    "file string, shape_index int, label string, shape_type string, points array<array<double>>, width int, height int"
)


def tree(spark: SparkSession, workspace: str, root: str, assets: DataFrame | None = None) -> DataFrame:
    """Files below ``root`` as rel (below root), path (below workspace), folder, name, stem, ext.

    ``assets`` (path, size) takes the place of walking the folders, e.g. a store's inventory.
    """
    listing = files.list_assets(spark, root) if assets is None else assets.where(F.col("path").startswith(root + "/"))
    rel = files.relative_to(F.col("path"), root)
    name = F.element_at(F.split("rel", "/"), -1)
    return listing.select(rel.alias("rel"), files.relative_to(F.col("path"), workspace).alias("path"), "size").select(
        "rel", "path", "size", F.regexp_replace("rel", "/?[^/]*$", "").alias("folder"), name.alias("name"),
        stem(F.col("rel")).alias("stem"), F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1)).alias("ext"),
    )


def _at(df: DataFrame, folder: str, ext: str) -> DataFrame:
    return df.where((F.col("folder") == folder) & (F.col("ext") == ext))


def _lookup(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return df.select(*(keys or ("stem",)), F.col("path").alias(column))


def _pith(names: DataFrame) -> DataFrame:
    """Image stems of a pith table, its only column, with a flag."""
    return names.select(F.col(names.columns[0]).alias("stem"), F.lit(True).alias("pith"))


def shape_summary(shapes: DataFrame) -> DataFrame:
    """Per file: target and ignored shapes, categories, subtypes and attributes."""
    valid = parsed_shapes(shapes).where(F.col("parsed").isNotNull() & (F.size("polygon") > 0))
    primary = F.col("parsed.category").isin(list(CATEGORY_IDS))
    counts = valid.groupBy("file").agg(
        F.count_if(primary).alias("targets"), F.count_if(~primary).alias("ignored")
    )
    chosen = valid.where(primary)
    parts = [
        distinct_join(chosen, ["file"], F.col("parsed.category"), "categories"),
        distinct_join(chosen.where(F.col("parsed.subtype") != "na"), ["file"], F.col("parsed.subtype"), "subtypes"),
        distinct_join(
            chosen.select("file", F.explode(attribute_flags(F.col("parsed"))).alias("flag")), ["file"], F.col("flag"), "flags"
        ),
    ]
    for part in parts:
        counts = counts.join(part, "file", "left")
    return counts.na.fill("", ["categories", "subtypes", "flags"])


def _defect_columns(annotation: str = "defect_path") -> dict[str, Column]:
    """Catalog columns that follow from a shape file and its summary."""
    has = F.col(annotation).isNotNull()
    targets, ignored = F.coalesce("targets", F.lit(0)), F.coalesce("ignored", F.lit(0))
    return {
        "defect_annotation_path": F.col(annotation), "has_defect_box": has, "has_defect_class": has,
        "defect_label_state": label_state(targets, ignored, has),
        "defect_instance_count": targets, "ignored_defect_instance_count": ignored,
        "raw_defect_classes": F.col("categories"),
        "unified_category": F.when(targets > 0, F.col("categories")).when(has, "normal"),
        "defect_subtype": F.col("subtypes"), "attributes": F.col("flags"),
    }


def _with_summary(rows: DataFrame, shapes: DataFrame, workspace: str, annotation: str = "defect_path") -> DataFrame:
    summary = shape_summary(shapes.withColumn("file", files.relative_to(F.col("file"), workspace)))
    # Rows without a file have a null key and would meet in one task; a number spreads them.
    spare = F.when(F.col(annotation).isNull(), F.pmod(F.xxhash64("path"), F.lit(1024)).cast("int")).otherwise(0)
    summary = summary.withColumnRenamed("file", annotation).withColumn("_spare", F.lit(0))
    return rows.withColumn("_spare", spare).join(summary, [annotation, "_spare"], "left").drop("_spare")


def scan_ring_and_defect_polygons(
    spark: SparkSession, workspace: str, root: str, dataset_id: str, assets: DataFrame | None = None,
    shapes: DataFrame | None = None, pith: DataFrame | None = None,
) -> DataFrame:
    """PNG discs with ring and defect polygon files and a pith table."""
    listing = tree(spark, workspace, root, assets)
    images = _at(listing, "images/images", "png")
    rings = _lookup(_at(listing, "ring_annotations/ring_annotations", "json"), "ring_path")
    defects = _lookup(_at(listing, "annotations/defects", "json"), "defect_path")
    pith = _pith(files.read_key_set(spark, f"{root}/pith_location.csv", "Image") if pith is None else pith)
    if shapes is None:
        shapes = _optional(lambda: files.read_labelme(spark, f"{root}/annotations/defects/*.json"), spark, _SHAPE_DDL)
    rows = images.join(rings, "stem", "left").join(defects, "stem", "left").join(pith, "stem", "left")
    rows = _with_summary(rows, shapes, workspace)
    physical = derive_key(F.col("stem"), r"^([A-Za-z]+\d+)")
    has_ring, has_defect, has_pith = F.col("ring_path").isNotNull(), F.col("defect_path").isNotNull(), F.coalesce("pith", F.lit(False))
    pith_file = files.relative_to(F.lit(f"{root}/pith_location.csv"), workspace)
    return catalog_rows(
        rows, image_path=F.col("path"), dataset_id=dataset_id, sample_id=qualified(F.lit(dataset_id), F.col("stem")),
        group_id=qualified(F.lit(dataset_id), physical), tree_id=physical, surface_type="transverse",
        has_ring=has_ring, has_pith=has_pith, ring_annotation_path=F.col("ring_path"),
        pith_annotation_path=F.when(has_pith, pith_file), dataset_role=F.when(has_defect, "bridge").otherwise("ring_main"),
        ring_label_state=F.when(has_ring, "complete_closed").otherwise("missing"), annotation_geometry="polygon",
        image_bytes=F.col("size"), **_defect_columns(),
    )


def scan_ring_polygons(
    spark: SparkSession, workspace: str, root: str, dataset_id: str, assets: DataFrame | None = None,
    documents: DataFrame | None = None, pith: DataFrame | None = None,
) -> DataFrame:
    """JPG discs whose pith is a point shape in the ring file or a row of a table."""
    listing = tree(spark, workspace, root, assets)
    images = _at(listing, "images", "jpg")
    rings = _lookup(_at(listing, "annotations/annual_rings", "json"), "ring_path")
    pith = _pith(files.read_key_set(spark, f"{root}/pith_location.txt", "Code") if pith is None else pith)
    if documents is None:
        documents = _optional(
            lambda: files.read_shape_files(spark, f"{root}/annotations/annual_rings/*.json").select("file", "shapes"),
            spark, "file string, shapes array<struct<label:string,shape_type:string,points:array<array<double>>>>",
        )
    points = documents.select(
        files.relative_to(F.col("file"), workspace).alias("ring_path"), has_point_label(F.col("shapes"), "pith").alias("point")
    )
    rows = images.join(rings, "stem", "left").join(pith, "stem", "left").join(points, "ring_path", "left")
    physical = strip_suffix(F.col("stem"), "-2|C")
    has_ring, point, listed = F.col("ring_path").isNotNull(), F.coalesce("point", F.lit(False)), F.coalesce("pith", F.lit(False))
    pith_file = files.relative_to(F.lit(f"{root}/pith_location.txt"), workspace)
    return catalog_rows(
        rows, image_path=F.col("path"), dataset_id=dataset_id, sample_id=qualified(F.lit(dataset_id), F.col("stem")),
        group_id=qualified(F.lit(dataset_id), physical), tree_id=physical, surface_type="transverse",
        has_ring=has_ring, has_pith=point | listed, ring_annotation_path=F.col("ring_path"),
        pith_annotation_path=F.when(point, F.col("ring_path")).when(listed, pith_file), dataset_role="ring_main",
        ring_label_state=F.when(has_ring, "complete_closed").otherwise("missing"), image_bytes=F.col("size"),
    )


def scan_named_discs(
    spark: SparkSession, workspace: str, root: str, dataset_id: str, assets: DataFrame | None = None,
    pith: DataFrame | None = None,
) -> DataFrame:
    """PNG discs named height_batch_number_view; all heights of a tree share its group."""
    listing = tree(spark, workspace, root, assets)
    images = _at(listing, "images", "png")
    rings = _lookup(_at(listing, "annotations/annual_rings", "json"), "ring_path")
    pith = _pith(files.read_key_set(spark, f"{root}/pith_location.txt", "Code") if pith is None else pith)
    rows = images.join(rings, "stem", "left").join(pith, "stem", "left")
    pattern = r"^(T[^_]+)_(B[^_]+)_(N[^_]+)_(.+)$"
    part = lambda i: F.regexp_extract("stem", pattern, i)
    named = part(1) != ""
    tree_id = F.when(named, F.concat_ws("_", part(2), part(3))).otherwise(F.col("stem"))
    has_ring, has_pith = F.col("ring_path").isNotNull(), F.coalesce("pith", F.lit(False))
    pith_file = files.relative_to(F.lit(f"{root}/pith_location.txt"), workspace)
    disc = F.when(named, F.concat_ws("_", part(1), tree_id)).otherwise(F.col("stem"))
    return catalog_rows(
        rows, image_path=F.col("path"), dataset_id=dataset_id, sample_id=qualified(F.lit(dataset_id), F.col("stem")),
        group_id=qualified(F.lit(dataset_id), tree_id), tree_id=tree_id, face_id=part(4), surface_type="transverse",
        has_ring=has_ring, has_pith=has_pith, ring_annotation_path=F.col("ring_path"),
        pith_annotation_path=F.when(has_pith, pith_file), dataset_role="ring_external_r1",
        ring_label_state=F.when(has_ring, "complete_closed").otherwise("missing"), image_bytes=F.col("size"),
        notes=F.concat(F.lit("disc_id="), disc, F.lit("; height="), part(1)),
    )


def scan_cube_faces(
    spark: SparkSession, workspace: str, root: str, dataset_id: str, assets: DataFrame | None = None,
    shapes: DataFrame | None = None,
) -> DataFrame:
    """Cube folders with six faces; defects count only when all six faces have a file."""
    listing = tree(spark, workspace, root, assets)
    face = F.regexp_extract("name", r"^([A-F])_col\.png$", 1)
    flat = F.regexp_extract("rel", r"^([^/]+)/[^/]+$", 1)
    images = listing.withColumn("face", face).withColumn("cube", flat).where((F.col("face") != "") & (F.col("cube") != ""))
    rings = listing.select(
        flat.alias("cube"), F.regexp_extract("name", r"^([A-F])_ann\.png$", 1).alias("face"), F.col("path").alias("ring_path")
    ).where((F.col("cube") != "") & (F.col("face") != ""))
    # Dealt by cube before a cube becomes six letters; sets of this size are joined by merging.
    defects = spread(listing.select(
        F.regexp_extract("rel", r"^([^/]+)/defects/[^/]+\.json$", 1).alias("cube"), "name", "path"
    ).where(F.col("cube") != ""), "cube")
    # Completeness is judged over the six letters, with or without an image of the face.
    letters = defects.select("cube").distinct().withColumn("face", F.explode(F.array(*[F.lit(c) for c in "ABCDEF"])))
    names = [F.concat("face", F.lit("_col.json")), F.concat("face", F.lit(".json"))]
    found = attach_annotation(letters, defects, ["cube"], names)
    whole = complete_sets(found, "cube", "face", 6).select("cube")
    chosen = found.join(whole.hint("merge"), "cube", "left_semi").select("cube", "face", F.col("annotation_path").alias("defect_path"))
    if shapes is None:
        shapes = _optional(lambda: files.read_labelme(spark, f"{root}/*/defects/*.json"), spark, _SHAPE_DDL)
    rows = images.join(rings.hint("merge"), ["cube", "face"], "left").join(chosen.hint("merge"), ["cube", "face"], "left")
    rows = _with_summary(rows, shapes, workspace)
    has_ring, has_defect = F.col("ring_path").isNotNull(), F.col("defect_path").isNotNull()
    return catalog_rows(
        rows, image_path=F.col("path"), dataset_id=dataset_id,
        sample_id=qualified(F.lit(dataset_id), F.col("cube"), F.col("face")), group_id=qualified(F.lit(dataset_id), F.col("cube")),
        cube_id=F.col("cube"), face_id=F.col("face"),
        surface_type=F.when(F.col("face").isin("B", "D"), "transverse").otherwise("side"),
        has_ring=has_ring, ring_annotation_path=F.col("ring_path"),
        dataset_role=F.when(has_defect, "bridge").otherwise("ring_multiface"),
        ring_label_state=F.when(has_ring, "local_1px").otherwise("missing"),
        annotation_geometry="axis_aligned_rectangle_from_polygon", image_bytes=F.col("size"), **_defect_columns(),
    )


_MANIFEST = T.StructType([
    T.StructField(name, kind) for name, kind in [
        ("image_path", T.StringType()), ("sample_id", T.StringType()), ("group_id", T.StringType()),
        ("split", T.StringType()), ("image_width", T.IntegerType()), ("image_height", T.IntegerType()),
        ("image_bytes", T.LongType()), ("defect_annotation_path", T.StringType()), ("defect_mask_path", T.StringType()),
        ("defect_label_state", T.StringType()), ("defect_instance_count", T.IntegerType()),
        ("raw_defect_classes", T.StringType()), ("unified_category", T.StringType()),
        ("selection_reason", T.StringType()), ("phash_hex", T.StringType()),
    ]
])
_INVENTORY = T.StructType([
    T.StructField("sample_id", T.StringType()), T.StructField("raw_classes", T.StringType()),
    T.StructField("excluded_instance_count", T.StringType()),
])


def scan_prebuilt(spark: SparkSession, workspace: str, root: str, dataset_id: str) -> DataFrame:
    """An outside manifest with a fixed split and an optional per-sample inventory."""
    manifest = files.read_table(spark, f"{root}/manifests/manifest.csv", _MANIFEST)
    inventory = _optional(
        lambda: files.read_table(spark, f"{root}/manifests/source_inventory.csv", _INVENTORY), spark,
        "sample_id string, raw_classes string, excluded_instance_count string",
    )
    rows = files.read_prebuilt_manifest(manifest, inventory)
    below = files.relative_to(F.lit(root), workspace)
    inside = lambda column: F.when(F.col(column) != "", F.concat_ws("/", below, F.col(column)))
    same = ["sample_id", "group_id", "split", "image_width", "image_height", "image_bytes", "defect_label_state",
            "defect_instance_count", "ignored_defect_instance_count", "raw_defect_classes", "unified_category"]
    return catalog_rows(
        rows, dataset_id=dataset_id, image_path=inside("image_path"), defect_annotation_path=inside("defect_annotation_path"),
        defect_mask_path=inside("defect_mask_path"), surface_type="board_surface", has_defect_box=True, has_defect_mask=True,
        has_defect_class=True, dataset_role="defect_main", annotation_geometry="bbox+semantic_instance_mask",
        source_variant=F.col("selection_reason"), base_sample_id=F.col("sample_id"), **{name: F.col(name) for name in same},
    )


def scan_split_class_folders(
    spark: SparkSession, workspace: str, root: str, dataset_id: str, taxonomy: DataFrame,
    assets: DataFrame | None = None, lines: DataFrame | None = None,
) -> DataFrame:
    """split/class/image.jpg folders with a centre-box file next to each image."""
    listing = tree(spark, workspace, root, assets)
    pattern = r"^(?:.*/)?(train|validation|test)/([^/]+)/[^/]+$"
    placed = listing.select(
        "*", F.regexp_extract("rel", pattern, 1).alias("source_split"), F.regexp_extract("rel", pattern, 2).alias("raw_label")
    ).where(F.col("source_split") != "")
    key = ["folder", "stem"]
    images = placed.where(F.col("ext") == "jpg").withColumn("dataset_id", F.lit(dataset_id))
    boxes = _lookup(placed.where(F.col("ext") == "txt"), "box_path", *key)
    if lines is None:
        lines = files.count_nonblank_lines(spark, root, "*.txt")
    lines = lines.select(files.relative_to(F.col("file"), workspace).alias("box_path"), "lines")
    rows = map_taxonomy(images, taxonomy, fallback="drop").join(boxes, key, "left").join(lines, "box_path", "left")
    has = F.col("box_path").isNotNull()
    name = F.lit(dataset_id)
    return catalog_rows(
        rows, image_path=F.col("path"), dataset_id=dataset_id,
        sample_id=qualified(name, F.col("source_split"), F.col("raw_label"), F.col("stem")),
        group_id=qualified(name, F.col("source_split"), F.lower("stem")), surface_type="board_surface",
        has_defect_box=has, has_defect_class=True, defect_annotation_path=F.col("box_path"),
        dataset_role="defect_external_then_joint", source_split=F.col("source_split"),
        defect_label_state=F.when(F.col("raw_label") == "0", "verified_negative").otherwise("positive"),
        defect_instance_count=F.coalesce("lines", F.lit(0)), raw_defect_classes=F.col("raw_label"),
        unified_category=F.col("category"), defect_subtype=F.col("subtype"), attributes=F.array_join("attributes", ";"),
        notes=F.concat(F.lit("source_class_id="), F.col("raw_label")), image_bytes=F.col("size"),
    )


# Folder and surface treatment.
SURFACE_FOLDERS = {"train-data": "cleaned", "train-data-dry": "dry", "train-data-rough": "rough"}


def scan_cvat_surfaces(
    spark: SparkSession, workspace: str, root: str, dataset_id: str, assets: DataFrame | None = None,
    polylines: DataFrame | None = None,
) -> DataFrame:
    """Board photos by surface, ring polylines in one XML file per surface, ignore masks."""
    listing = tree(spark, workspace, root, assets)
    top = F.substring_index("rel", "/", 1)
    surface = F.lit(None).cast("string")
    for folder, treatment in SURFACE_FOLDERS.items():
        surface = F.when(F.col("top") == folder, treatment).otherwise(surface)
    placed = listing.withColumn("top", top).withColumn("surface", surface).where(F.col("surface").isNotNull())
    images = placed.where(F.col("folder") == F.concat("top", F.lit("/image"))).where(F.col("ext") == "jpg")
    masks = placed.where(F.col("folder") == F.concat("top", F.lit("/ignore"))).select("top", "name", F.col("path").alias("mask_path"))
    if polylines is None:
        polylines = _optional(
            lambda: files.read_cvat_polylines(spark, f"{root}/*/label/annotations.xml", min_points=0).select("file", "image_name"),
            spark, "file string, image_name string",
        )
    lined = polylines.select("file", "image_name").distinct().select(
        F.regexp_extract("file", r"([^/]+)/label/annotations\.xml$", 1).alias("top"), F.col("image_name").alias("name"),
        files.relative_to(F.col("file"), workspace).alias("xml_path"),
    )
    rows = images.join(lined, ["top", "name"], "left").join(masks, ["top", "name"], "left")
    physical, has = F.substring_index("stem", "-", 1), F.col("xml_path").isNotNull()
    return catalog_rows(
        rows, image_path=F.col("path"), dataset_id=dataset_id, sample_id=qualified(F.lit(dataset_id), F.col("surface"), F.col("stem")),
        group_id=qualified(F.lit(dataset_id), physical), tree_id=physical,
        face_id=F.col("stem").substr(F.length(physical) + 2, F.length("stem")), surface_type=F.col("surface"),
        has_ring=has, ring_annotation_path=F.col("xml_path"), ignore_mask_path=F.col("mask_path"), dataset_role="ring_external",
        ring_label_state=F.when(has, "partial_with_ignore").otherwise("missing"), image_bytes=F.col("size"),
    )


def scan_voc(
    spark: SparkSession, workspace: str, root: str, dataset_id: str, taxonomy: DataFrame,
    assets: DataFrame | None = None, named: DataFrame | None = None,
) -> DataFrame:
    """JPEGImages with one XML box file each; labels outside the taxonomy are ignore regions."""
    listing = tree(spark, workspace, root, assets)
    images = _at(listing, "JPEGImages", "jpg")
    boxes = _lookup(_at(listing, "Annotations", "xml"), "xml_path")
    if named is None:
        named = _optional(lambda: files.read_voc_names(spark, f"{root}/Annotations/*.xml"), spark, "file string, raw_label string")
    labels = named.where(F.col("raw_label").isNotNull()).select(
        files.relative_to(F.col("file"), workspace).alias("xml_path"), "raw_label", F.lit(dataset_id).alias("dataset_id")
    )
    mapped = map_taxonomy(labels, taxonomy, fallback="unknown")
    exact = taxonomy.select("dataset_id", "raw_label", F.lit(True).alias("listed"))
    mapped = mapped.join(exact, ["dataset_id", "raw_label"], "left")
    keep = F.coalesce(F.col("listed"), F.lit(False)) & F.coalesce(F.col("train_action") == "keep", F.lit(False))
    mapped = mapped.withColumn("target", keep)
    key = ["xml_path"]
    counts = mapped.groupBy(*key).agg(F.count_if("target").alias("targets"), F.count_if(~F.col("target")).alias("ignored"))
    targets = mapped.where("target")
    for part in (
        distinct_join(mapped, key, F.col("raw_label"), "raw"), distinct_join(targets, key, F.col("category"), "categories"),
        distinct_join(targets, key, F.col("subtype"), "subtypes"),
        distinct_join(targets.select(*key, F.explode("attributes").alias("flag")), key, F.col("flag"), "flags"),
    ):
        counts = counts.join(part, key, "left")
    rows = images.join(boxes, "stem", "left").join(counts, key, "left")
    has, n = F.col("xml_path").isNotNull(), F.coalesce("targets", F.lit(0))
    ignored = F.coalesce("ignored", F.lit(0))
    state = label_state(n, ignored, has)
    name = qualified(F.lit(dataset_id), F.col("stem"))
    return catalog_rows(
        rows, image_path=F.col("path"), dataset_id=dataset_id, sample_id=name, group_id=name, surface_type="board_surface",
        has_defect_box=has, has_defect_class=has, defect_annotation_path=F.col("xml_path"), dataset_role="defect_external",
        defect_label_state=state, defect_instance_count=n, ignored_defect_instance_count=ignored, raw_defect_classes=F.col("raw"),
        unified_category=F.when(n > 0, F.col("categories")).when(state == "verified_negative", "normal"),
        defect_subtype=F.col("subtypes"), attributes=F.col("flags"), annotation_geometry="bbox", image_bytes=F.col("size"),
    )


def scan_anomaly(
    spark: SparkSession, workspace: str, root: str, dataset_id: str, assets: DataFrame | None = None,
    license_id: str = "CC-BY-NC-SA-4.0",
) -> DataFrame:
    """train/test category folders with masks under ground_truth; auxiliary only."""
    listing = tree(spark, workspace, root, assets)
    pattern = r"^(train|test)/([^/]+)/[^/]+\.png$"
    images = listing.select(
        "*", F.regexp_extract("rel", pattern, 1).alias("source_split"), F.regexp_extract("rel", pattern, 2).alias("category")
    ).where(F.col("source_split") != "")
    masks = listing.select(
        F.regexp_extract("rel", r"^ground_truth/([^/]+)/[^/]+_mask\.png$", 1).alias("category"),
        F.regexp_extract("rel", r"([^/]+)_mask\.png$", 1).alias("stem"), F.col("path").alias("mask_path"),
    ).where(F.col("category") != "")
    rows = images.join(masks, ["category", "stem"], "left")
    name = qualified(F.lit(dataset_id), F.col("source_split"), F.col("category"), F.col("stem"))
    return catalog_rows(
        rows, image_path=F.col("path"), dataset_id=dataset_id, sample_id=name, group_id=name, base_sample_id=name,
        split=F.when(F.col("source_split") == "train", "aux_train_reference").otherwise("external_anomaly_test"),
        surface_type="wood_texture", dataset_role="aux_anomaly_external", source_split=F.col("source_split"),
        supervision_scope="auxiliary_only", auxiliary_task="anomaly_segmentation", auxiliary_label=F.col("category"),
        auxiliary_annotation_path=F.col("mask_path"), source_variant=F.col("category"), license_id=license_id,
        image_bytes=F.col("size"),
    )


def scan_synthetic_variants(
    spark: SparkSession, workspace: str, root: str, dataset_id: str, assets: DataFrame | None = None,
) -> DataFrame:
    """variant/variant/Images derivatives; all derivatives of an image share its group."""
    listing = tree(spark, workspace, root, assets)
    pattern = r"^([^/]+)/\1/Images/[^/]+\.jpg$"
    images = listing.withColumn("variant", F.regexp_extract("rel", pattern, 1)).where(F.col("variant") != "")
    labels = listing.select(
        F.regexp_extract("rel", r"^([^/]+)/\1/Labels/[^/]+\.txt$", 1).alias("variant"), "stem", F.col("path").alias("label_path")
    ).where(F.col("variant") != "")
    rows = images.join(labels, ["variant", "stem"], "left").withColumn("key", variant_key(F.col("variant"), F.col("stem")))
    name = F.lit(dataset_id)
    base = qualified(name, F.col("key.base_id"))
    return catalog_rows(
        rows, image_path=F.col("path"), dataset_id=dataset_id, sample_id=qualified(name, F.col("variant"), F.col("stem")),
        group_id=base, base_sample_id=base, split="auxiliary_stress", surface_type="coated_wood_or_surface",
        dataset_role="aux_synthetic_stress", source_split="provided", supervision_scope="auxiliary_only",
        auxiliary_task="synthetic_detection_stress", auxiliary_label="source_classes_0_1_2_3_unmapped",
        auxiliary_annotation_path=F.col("label_path"), annotation_geometry="yolo_bbox",
        source_variant=F.concat_ws(":", "variant", "key.transform"), image_bytes=F.col("size"),
    )


LAYOUTS: dict[str, Callable[..., DataFrame]] = {
    "ring_and_defect_polygons": scan_ring_and_defect_polygons,
    "ring_polygons": scan_ring_polygons,
    "named_discs": scan_named_discs,
    "cube_faces": scan_cube_faces,
    "prebuilt": scan_prebuilt,
    "split_class_folders": scan_split_class_folders,
    "cvat_surfaces": scan_cvat_surfaces,
    "voc": scan_voc,
    "anomaly": scan_anomaly,
    "synthetic_variants": scan_synthetic_variants,
}


def scan_dataset(spark: SparkSession, workspace: str, root: str, dataset_id: str, layout: str, **options) -> DataFrame:
    """Catalog rows of one dataset in a named layout."""
    return LAYOUTS[layout](spark, workspace.rstrip("/"), root.rstrip("/"), dataset_id, **options)


def scan_all(spark: SparkSession, workspace: str, sources: list[dict]) -> DataFrame:
    """Union of all sources, each a dict of root, dataset_id, layout and layout options."""
    return union_catalogs([scan_dataset(spark, workspace, **source) for source in sources])
