"""Cleaning of polygon shape files: ids, truncation flags, invalid rings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolake.functions.geometry import polygon_area, rotated, shape_to_polygon, touches_frame
from annolake.functions.labels import format_pipe_label, parse_pipe_label
from annolake.presets import CATEGORY_IDS
from annolake.session import spread, stable

EDGE_CELL = 64.0


def parsed_shapes(shapes: DataFrame) -> DataFrame:
    """Shapes with their parsed label and polygon."""
    return shapes.withColumn("parsed", parse_pipe_label(F.col("label"))).withColumn(
        "polygon", shape_to_polygon(F.col("shape_type"), F.col("points"))
    )


def dedupe_instance_ids(shapes: DataFrame, keep_all: bool = False) -> DataFrame:
    """New ids for the second and later use of an id in a file and category.

    ``shapes``: file, shape_index, parsed, valid. Ids of every parsed label are taken,
    valid or not. Repeats are numbered in shape order with the lowest numbers that, written
    with two digits after the prefix, are free. Adds ``new_id``, null where nothing changes.
    """
    key = ["file", "_cat", "_id"]
    named = stable(shapes.where("parsed is not null").select(
        "file", "shape_index", F.col("parsed.category").alias("_cat"), F.col("parsed.instance_id").alias("_id"), "valid"
    ))
    usable = named.where("valid")
    first = usable.groupBy(*key).agg(F.min("shape_index").alias("_first"))
    repeats = usable.join(first, key).where(F.col("shape_index") > F.col("_first"))
    letters = F.regexp_extract("_id", "^([A-Za-z]+)", 1)
    fallback = F.when(F.col("_cat") == "knot", "K").otherwise("C")
    repeats = repeats.select(
        "file", "shape_index", "_cat", F.when(letters == "", fallback).otherwise(letters).alias("_prefix")
    )
    slot = ["file", "_cat", "_prefix"]
    # A window holds the repeats of one label file.
    repeats = repeats.withColumn("_k", F.row_number().over(Window.partitionBy(*slot).orderBy("shape_index")))

    # Numbers already used under a prefix: ids that read exactly prefix + two-digit number.
    taken = named.select("file", "_cat", "_id").distinct()
    number = F.regexp_extract("_id", r"^[A-Za-z]+(\d+)$", 1).try_cast("long")
    prefix = F.regexp_extract("_id", r"^([A-Za-z]+)\d+$", 1)
    padded = F.when(F.length(number.cast("string")) >= 2, number.cast("string")).otherwise(F.lpad(number.cast("string"), 2, "0"))
    used = (
        taken.withColumn("_n", number).withColumn("_prefix", prefix)
        .where((F.col("_n") >= 1) & (F.col("_id") == F.concat("_prefix", padded)))
        .select(*slot, "_n")
    )
    used = used.join(repeats.select(*slot).distinct(), slot, "left_semi").groupBy(*slot).agg(
        F.array_sort(F.collect_list("_n")).alias("_used")
    )
    # The k-th free number is k plus the used numbers that have fewer than k free ones below.
    below = F.filter(
        F.transform("_used", lambda n, i: n - i - 1), lambda free_before: free_before < F.col("_k")
    )
    fresh = repeats.join(used, slot, "left").withColumn(
        "_below", F.when(F.col("_used").isNull(), F.lit(0)).otherwise(F.size(below))
    )
    text = (F.col("_k") + F.col("_below")).cast("string")
    fresh = fresh.select(
        "file", "shape_index",
        F.concat("_prefix", F.when(F.length(text) >= 2, text).otherwise(F.lpad(text, 2, "0"))).alias("new_id"),
    )
    base = shapes if keep_all else shapes.where("valid and parsed is not null")
    return base.join(fresh, ["file", "shape_index"], "left")


def self_intersections(polygons: DataFrame, keys: list[str], cell: float = EDGE_CELL) -> DataFrame:
    """Polygons with crossing edges or without area.

    Edges are spread over the grid cells they pass, so only edges sharing a cell meet.
    """
    points, polygons = F.col("polygon"), spread(polygons, *keys)
    flat = polygons.where(polygon_area(points) == 0).select(*keys, F.lit("zero_area").alias("defect"))
    edges = polygons.select(
        *keys, F.size(points).alias("_n"),
        F.posexplode(F.zip_with(points, rotated(points), lambda a, b: F.struct(
            a.getItem(0).alias("x1"), a.getItem(1).alias("y1"), b.getItem(0).alias("x2"), b.getItem(1).alias("y2")
        ))).alias("_i", "_e"),
    )
    box = lambda lo, hi: F.sequence(F.floor(F.least(lo, hi) / cell), F.floor(F.greatest(lo, hi) / cell))
    e = F.col("_e")
    placed = edges.withColumn("_gx", F.explode(box(e["x1"], e["x2"]))).withColumn("_gy", F.explode(box(e["y1"], e["y2"])))
    left = placed.withColumnRenamed("_i", "_a").withColumnRenamed("_e", "_ea")
    # Edges are many more than the polygons Spark knows the size of: never sent whole to every task.
    right = placed.select(*keys, "_gx", "_gy", F.col("_i").alias("_b"), F.col("_e").alias("_eb")).hint("merge")
    turn = lambda s, x, y: F.signum((s["x2"] - s["x1"]) * (y - s["y1"]) - (s["y2"] - s["y1"]) * (x - s["x1"]))
    a, b = F.col("_ea"), F.col("_eb")
    crossing = (
        (turn(a, b["x1"], b["y1"]) * turn(a, b["x2"], b["y2"]) < 0)
        & (turn(b, a["x1"], a["y1"]) * turn(b, a["x2"], a["y2"]) < 0)
    )
    apart = (F.col("_b") - F.col("_a") > 1) & (F.col("_b") - F.col("_a") < F.col("_n") - 1)
    crossed = left.join(right, [*keys, "_gx", "_gy"]).where(apart & crossing)
    return flat.unionByName(
        crossed.select(*keys).distinct().select(*keys, F.lit("crossing_edges").alias("defect"))
    )


def exact(value: Column) -> Column:
    """A coordinate as a decimal of six places: differences and products of such are exact."""
    return value.cast("decimal(14,6)")


def turn_sign(x1: Column, y1: Column, x2: Column, y2: Column, x: Column, y: Column) -> Column:
    """Side of the point (x, y) seen along the line from 1 to 2: 1, -1, or 0 if it lies on the line. Exact on decimals."""
    value = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    return F.when(value > 0, 1).when(value < 0, -1).otherwise(0)


def outline_defects(polygons: DataFrame, keys: list[str], cell: float = EDGE_CELL) -> DataFrame:
    """Polygons whose outline meets itself, each kind once (R17): ``crossing`` edges, a point ``touching`` an edge or another vertex,
    edges ``overlapping`` along a stretch (also a spike that runs back on itself), and outlines that are ``flat`` (no area).

    Signs come from decimals, so there is no tolerance; coordinates count to six places. Repeated points in a row are one. Edges
    are spread over the grid cells they pass, so only edges sharing a cell meet.
    """
    whole = F.transform("polygon", lambda p: F.struct(exact(p.getItem(0)).alias("x"), exact(p.getItem(1)).alias("y")))
    shaped = spread(polygons, *keys).select(*keys, whole.alias("_all"))
    step = F.zip_with("_all", rotated(F.col("_all")), lambda a, b: F.when(a != b, a))
    shaped = shaped.select(*keys, F.array_compact(step).alias("_p"))
    ring = F.zip_with("_p", rotated(F.col("_p")), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    area = F.aggregate(ring, F.lit(0).cast("decimal(38,12)"), lambda s, e: (s + e["x1"] * e["y2"] - e["x2"] * e["y1"]).cast("decimal(38,12)"))
    flat = shaped.where(area == 0).select(*keys, F.lit("flat").alias("defect"))
    edges = shaped.where(F.size("_p") >= 2).select(*keys, F.size("_p").alias("_n"), F.posexplode(ring).alias("_i", "_e"))
    e = F.col("_e")
    box = lambda lo, hi: F.sequence(F.floor(F.least(lo, hi).cast("double") / cell), F.floor(F.greatest(lo, hi).cast("double") / cell))
    placed = edges.withColumn("_gx", F.explode(box(e["x1"], e["x2"]))).withColumn("_gy", F.explode(box(e["y1"], e["y2"])))
    left = placed.withColumnRenamed("_i", "_a").withColumnRenamed("_e", "_ea")
    # Edges are many more than the polygons Spark knows the size of: never sent whole to every task.
    right = placed.select(*keys, "_gx", "_gy", F.col("_i").alias("_b"), F.col("_e").alias("_eb")).hint("merge")
    pairs = left.join(right, [*keys, "_gx", "_gy"]).where("_a < _b").select(*keys, "_n", "_a", "_b", "_ea", "_eb").distinct()
    a, b = F.col("_ea"), F.col("_eb")
    side = lambda s, t, end: turn_sign(s["x1"], s["y1"], s["x2"], s["y2"], t[f"x{end}"], t[f"y{end}"])
    signed = pairs.select("*", side(a, b, 1).alias("_b1"), side(a, b, 2).alias("_b2"), side(b, a, 1).alias("_a1"), side(b, a, 2).alias("_a2"))

    def within(s: Column, t: Column, end: int) -> Column:
        x, y = t[f"x{end}"], t[f"y{end}"]
        return x.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"])) & y.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"]))

    def shared(axis: str) -> Column:
        return F.least(F.greatest(a[f"{axis}1"], a[f"{axis}2"]), F.greatest(b[f"{axis}1"], b[f"{axis}2"])) - F.greatest(
            F.least(a[f"{axis}1"], a[f"{axis}2"]), F.least(b[f"{axis}1"], b[f"{axis}2"]))

    in_line = (F.col("_b1") == 0) & (F.col("_b2") == 0)
    neighbours = (F.col("_b") - F.col("_a") == 1) | (F.col("_b") - F.col("_a") == F.col("_n") - 1)
    stretch = in_line & (shared("x") >= 0) & (shared("y") >= 0) & ((shared("x") > 0) | (shared("y") > 0))
    at_point = F.lit(False)
    for sign, s, t, end in (("_b1", a, b, 1), ("_b2", a, b, 2), ("_a1", b, a, 1), ("_a2", b, a, 2)):
        at_point = at_point | ((F.col(sign) == 0) & within(s, t, end))
    kind = F.when(stretch, "overlapping").when(neighbours, None).when(
        (F.col("_b1") * F.col("_b2") < 0) & (F.col("_a1") * F.col("_a2") < 0), "crossing").when(at_point, "touching")
    met = signed.select(*keys, kind.alias("defect")).where("defect is not null").distinct()
    return flat.unionByName(met)


def normalize_shapes(shapes: DataFrame) -> DataFrame:
    """Shape by shape: the outcome, the new label and the list of changes.

    ``shapes``: file, shape_index, label, shape_type, points, width, height. Polygons with
    crossing edges are flagged and kept, as no repair solver exists here; those without area
    and without crossings are beyond repair and dropped.
    """
    # Staged, as the steps below read the rows five times, and label files are many and small.
    shapes = stable(shapes.select("file", "shape_index", "label", "shape_type", "points", "width", "height"))
    rows = parsed_shapes(shapes).withColumn("valid", F.col("parsed").isNotNull() & (F.size("polygon") >= 3))
    drawn = rows.where("valid and shape_type = 'polygon'").select("file", "shape_index", "polygon")
    broken = self_intersections(drawn, ["file", "shape_index"]).groupBy("file", "shape_index").agg(F.min("defect").alias("_defect"))
    rows = dedupe_instance_ids(rows, keep_all=True).join(broken, ["file", "shape_index"], "left")
    label = F.col("parsed")
    touches = touches_frame(F.col("polygon"), F.col("width"), F.col("height"), label["truncated"])
    primary = label["category"].isin(list(CATEGORY_IDS))
    lost = F.coalesce(F.col("_defect") == "zero_area", F.lit(False))
    text = lambda value: F.lit(value) if isinstance(value, str) else value
    change = lambda action, old="", new="": F.struct(
        F.lit(action).alias("action"), text(old).alias("from"), text(new).alias("to")
    )
    flag = lambda value: F.when(value, "1").otherwise("0")
    changes = F.when(~F.col("valid"), F.array(change("drop_invalid_shape"))).otherwise(F.array_compact(F.array(
        F.when(~primary, change("retain_ignored_shape", label["category"])),
        F.when(F.col("new_id").isNotNull(), change("deduplicate_instance_id", label["instance_id"], F.col("new_id"))),
        F.when(touches != label["truncated"], change("normalize_truncated", flag(label["truncated"]), flag(touches))),
        F.when(lost, change("drop_unrepairable_polygon")),
        F.when(F.col("_defect") == "crossing_edges", change("flag_crossing_edges")),
    )))
    return rows.select(
        "file", "shape_index", "shape_type", "points", "width", "height",
        F.when(F.col("valid"), format_pipe_label(label, F.coalesce("new_id", label["instance_id"]), touches)).alias("label"),
        "valid", (F.col("valid") & ~lost).alias("kept"), (F.col("valid") & primary).alias("primary"), changes.alias("changes"),
    )


def normalization_audit(normalized: DataFrame) -> DataFrame:
    """Per file: shapes in and out, valid, primary and ignored instances.

    A polygon dropped for want of area lowers the valid count only, not primary or ignored.
    """
    return normalized.groupBy("file").agg(
        F.count(F.lit(1)).alias("input_shapes"), F.count_if("kept").alias("valid_instances"),
        F.count_if("primary").alias("primary_instances"),
        F.count_if(F.col("valid") & ~F.col("primary")).alias("ignored_instances"),
        F.count_if("kept").alias("output_shapes"),
    )


def normalization_actions(normalized: DataFrame) -> DataFrame:
    """How often each change was made over all files."""
    return (
        normalized.select(F.explode("changes").alias("c")).groupBy(F.col("c.action").alias("action"))
        .agg(F.count(F.lit(1)).alias("changes"))
    )
