"""Masks as rows of (image_id, y, x, ...): fills, outlines, dilation, distance, components, RLE.

Pixel (x, y) stands for the point with those coordinates. A fill takes the points inside by
the even-odd rule, half open at the right and lower side; outlines are traced apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolake.functions.geometry import box_pixel_span, rotated
from annolake.presets import IGNORE_VALUE
from annolake.session import spread, stable

DISTANCE_TAU = 16.0
TILE = 256


def rounded_points(points: Column) -> Column:
    """Vertices on whole pixels, halves to even."""
    return F.transform(points, lambda p: F.array(F.bround(p.getItem(0)), F.bround(p.getItem(1))))


def polygon_spans(df: DataFrame, keys: Sequence[str], points: str = "points", width: str = "width", height: str = "height") -> DataFrame:
    """Horizontal runs [x1, x2) of the even-odd fill, one row per run."""
    ys = F.transform(points, lambda p: p.getItem(1))
    first = F.greatest(F.lit(0), F.ceil(F.array_min(ys)).cast("int"))
    last = F.least(F.col(height) - 1, F.floor(F.array_max(ys)).cast("int"))
    shapes = df.where(F.size(points) >= 3).select(
        *keys, F.col(points).alias("_p"), F.col(width).alias("_w"), first.alias("_a"), last.alias("_b")
    ).where(F.col("_a") <= F.col("_b"))
    lines = spread(shapes, *keys[:1]).withColumn("y", F.explode(F.sequence("_a", "_b")))
    y = F.col("y")
    cuts = F.array_sort(F.array_compact(F.zip_with(
        "_p", rotated(F.col("_p")),
        lambda a, b: F.when(
            (a.getItem(1) > y) != (b.getItem(1) > y),
            (b.getItem(0) - a.getItem(0)) * (y - a.getItem(1)) / (b.getItem(1) - a.getItem(1)) + a.getItem(0),
        ),
    )))
    runs = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.size("_c"), F.lit(1)) - 1), lambda i: (i % 2 == 0) & (i + 1 < F.size("_c"))),
        lambda i: F.struct(
            F.greatest(F.lit(0), F.ceil(F.get("_c", i)).cast("int")).alias("x1"),
            F.least(F.col("_w"), F.ceil(F.get("_c", i + 1)).cast("int")).alias("x2"),
        ),
    )
    return (
        lines.withColumn("_c", cuts)
        .select(*keys, "y", F.explode(F.filter(runs, lambda r: r["x2"] > r["x1"])).alias("_r"))
        .select(*keys, "y", F.col("_r.x1").alias("x1"), F.col("_r.x2").alias("x2"))
    )


def spans_to_pixels(spans: DataFrame) -> DataFrame:
    keep = [c for c in spans.columns if c not in ("x1", "x2")]
    return spans.select(*keep, F.explode(F.sequence(F.col("x1"), F.col("x2") - 1)).alias("x"))


def rasterize(df: DataFrame, keys: Sequence[str], border: bool = False, **names: str) -> DataFrame:
    """Filled polygon pixels, with the outline of the rounded vertices if ``border``."""
    if not border:
        return spans_to_pixels(polygon_spans(df, keys, **names))
    points = names.get("points", "points")
    whole = df.withColumn(points, rounded_points(F.col(points)))
    fill = spans_to_pixels(polygon_spans(whole, keys, **names))
    edge = trace_lines(whole, keys, closed=True, **names)
    return fill.select(*keys, "y", "x").unionByName(edge.select(*keys, "y", "x")).distinct()


def trace_lines(df: DataFrame, keys: Sequence[str], closed: bool, points: str = "points", width: str = "width", height: str = "height") -> DataFrame:
    """Distinct one-pixel line pixels through the rounded vertices, inside the image (R2).

    Lines are dealt by their first key, the image, before they become pixels; no pixel is shuffled.
    """
    whole = rounded_points(F.col(points))
    ends = rotated(F.col("_p")) if closed else F.slice("_p", 2, F.size("_p"))
    edges = F.filter(
        F.zip_with("_p", ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda e: e["b"].isNotNull()
    )
    at = lambda end, axis: F.col(f"_e.{end}").getItem(axis)
    dx, dy = at("b", 0) - at("a", 0), at("b", 1) - at("a", 1)
    shapes = df.where(F.size(points) >= 2).select(*keys, F.col(width).alias("_w"), F.col(height).alias("_h"), whole.alias("_p"))
    lines = (
        spread(shapes, *keys[:1])
        .select(*keys, "_w", "_h", F.explode(edges).alias("_e"))
        .withColumn("_n", F.greatest(F.abs(dx), F.abs(dy)).cast("int"))
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    )
    step = F.when(F.col("_n") > 0, F.col("_i") / F.col("_n")).otherwise(0.0)
    pixel = lambda start, delta: F.floor(start + delta * step + 0.5).cast("int")
    return (
        lines.select(*keys, "_w", "_h", pixel(at("a", 1), dy).alias("y"), pixel(at("a", 0), dx).alias("x"))
        .where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("_w")) & (F.col("y") < F.col("_h")))
        .select(*keys, "y", "x").distinct()
    )


def image_grid(sizes: DataFrame) -> DataFrame:
    """Every pixel of every image. ``sizes``: image_id, width, height."""
    rows = sizes.where((F.col("width") > 0) & (F.col("height") > 0))
    rows = rows.select("image_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    return rows.select("image_id", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))


def dilate(pixels: DataFrame, radius: int, sizes: DataFrame | None = None, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Square dilation, one axis after the other: 2(2r+1) copies instead of (2r+1) squared."""
    result = pixels.select(*keys, "y", "x").distinct()
    if radius > 0:
        for axis in ("x", "y"):
            shifts = F.sequence(F.col(axis) - radius, F.col(axis) + radius)
            if sizes is None:
                shifts = F.filter(shifts, lambda v: v >= 0)
            result = result.withColumn(axis, F.explode(shifts)).distinct()
    if sizes is not None:
        inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") < F.col("height"))
        result = result.join(sizes.select("image_id", "width", "height"), "image_id").where(inside)
    return result.select(*keys, "y", "x")


#: A gap beyond every image.
FAR = 1 << 20
_GRID, _SKELETON, _VALID, _INSTANCE, _LABEL = range(5)


def _layer_kernel(kind: T.StructField, names: Sequence[str], tile: int, radius: int, tau: float, masked: bool):
    """Kernel over rows sorted by tile: the pixels of a tile with the layers ``names``, by array passes over rows and columns."""
    reach = int(np.ceil(tau))
    margin = max(reach, radius)
    types = {"distance": (pa.float64(), T.DoubleType()), "instance": (pa.int32(), T.IntegerType())}
    arrow, spark = zip(*[types.get(name, (pa.bool_(), T.BooleanType())) for name in names])
    schema = T.StructType([
        kind, T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), *map(T.StructField, names, spark)])

    def gap(marked: np.ndarray) -> np.ndarray:
        """Distance to the nearest marked pixel of the same row, for the columns inside the margin."""
        x = np.arange(marked.shape[1])
        left = np.maximum.accumulate(np.where(marked, x, -FAR), axis=1)
        right = np.minimum.accumulate(np.where(marked, x, FAR)[:, ::-1], axis=1)[:, ::-1]
        return np.minimum(x - left, right - x)[:, margin:marked.shape[1] - margin]

    def layers(top: int, left: int, of: np.ndarray, y: np.ndarray, x: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """y, x and layers for each size of the tile's image."""
        sizes = list(zip(y[of == _GRID].tolist(), x[of == _GRID].tolist()))
        if not sizes:
            return
        h, w = min(tile, max(s[0] for s in sizes) - top), min(tile, max(s[1] for s in sizes) - left)
        y, x = y - top, x - left

        def spots(kinds: tuple[int, ...], edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            hit = np.isin(of, kinds) & (y >= -edge) & (x >= -edge) & (y < h + edge) & (x < w + edge)
            return y[hit] + edge, x[hit] + edge, hit

        marked = np.zeros((h + 2 * margin, w + 2 * margin), bool)
        marked[spots((_SKELETON,), margin)[:2]] = True
        # Skeleton pixels outside the image thicken its rim, but no distance is measured to them.
        image = np.zeros_like(marked)
        for height, width in set(sizes):
            image[max(0, margin - top):max(0, height - top + margin), max(0, margin - left):max(0, width - left + margin)] = True
        inside = np.full((h, w), not masked)
        inside[spots((_VALID, _LABEL), 0)[:2]] = True
        made = {"skeleton": marked[margin:margin + h, margin:margin + w], "valid": inside}
        if "distance" in names:
            flat, square = gap(marked & image) ** 2, np.full((h, w), FAR * FAR)
            for dy in range(-reach, reach + 1):
                np.minimum(square, flat[margin + dy:margin + dy + h] + dy * dy, out=square)
            made["distance"] = np.where(inside, np.minimum(np.sqrt(square) / tau, 1.0), 1.0)
        if "boundary" in names:
            close, thick = gap(marked) <= radius, np.zeros((h, w), bool)
            for dy in range(-radius, radius + 1):
                thick |= close[margin + dy:margin + dy + h]
            made["boundary"] = thick & inside
        if "instance" in names:
            made["instance"] = np.zeros((h, w), np.int32)
            at_y, at_x, hit = spots((_INSTANCE, _LABEL), 0)
            made["instance"][at_y, at_x] = n[hit]
        for height, width in sizes:
            ys, xs = np.mgrid[0:max(0, min(h, height - top)), 0:max(0, min(w, width - left))]
            yield tuple(v.ravel() for v in (ys + top, xs + left, *[made[name][:ys.shape[0], :ys.shape[1]] for name in names]))

    def filled(block: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = [block.column(name).to_numpy() for name in ("_ty", "_tx", "kind", "y", "x")]
        n = block.column("n").fill_null(0).to_numpy()
        own, parts, size = [], [], 0

        def batch() -> pa.RecordBatch:
            at = np.repeat(own, [len(part[0]) for part in parts])
            values = [np.concatenate(column) for column in zip(*parts)]
            return pa.RecordBatch.from_arrays(
                [block.column("image_id").take(pa.array(at)).combine_chunks(),
                 *[pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), *arrow))]], names=schema.names)

        for a, b in zip(starts, [*starts[1:], block.num_rows]):
            ty, tx, of, y, x = (column[a:b] for column in columns)
            for part in layers(int(ty[0]) * tile, int(tx[0]) * tile, of, y, x, n[a:b]):
                own.append(a)
                parts.append(part)
                size += len(part[0])
                if size >= tile * tile:
                    yield batch()
                    own, parts, size = [], [], 0
        if parts:
            yield batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            block = more if held is None else pa.concat_tables([held, more]).combine_chunks()
            if not block.num_rows:
                continue
            image = block.column("image_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            place = np.stack([image, block.column("_ty").to_numpy(), block.column("_tx").to_numpy()])
            starts = np.concatenate(([0], np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1))
            # The last tile may go on in the next batch.
            held = block.slice(starts[-1])
            if len(starts) > 1:
                yield from filled(block.slice(0, starts[-1]).combine_chunks(), starts[:-1])
        if held is not None and held.num_rows:
            yield from filled(held.combine_chunks(), np.zeros(1, int))

    return run, schema


def grid_layers(
    skeleton: DataFrame, sizes: DataFrame, names: Sequence[str], valid: DataFrame | None = None, labels: DataFrame | None = None,
    radius: int = 0, tau: float = DISTANCE_TAU, tile: int = TILE,
) -> DataFrame:
    """Every pixel of every image with the layers ``names``: skeleton, boundary (within ``radius`` of it), distance (over ``tau``, 1 at most), instance, valid.

    Pixels that carry something are dealt to tiles once, skeleton pixels also to the tiles they reach; the grid is only made in the
    task of its tile, so nothing is joined to it. Valid pixels come from ``valid`` or, with numbers, from ``labels`` (instance,
    valid); without both every pixel is valid.
    """
    margin = max(int(np.ceil(tau)), radius)
    cell = lambda v: F.floor(v / tile).cast("int")
    span = lambda first, last: F.explode(F.sequence(F.greatest(F.lit(0), cell(first)), cell(last)))
    rows = lambda df, ty, tx, kind, y="y", x="x", n=F.lit(None): df.withColumn("_ty", ty).withColumn("_tx", tx).select(
        "image_id", "_ty", "_tx", kind.cast("int").alias("kind"), F.col(y).cast("int").alias("y"), F.col(x).cast("int").alias("x"), n.cast("int").alias("n"))
    known = lambda df: df.where("image_id is not null and y is not null and x is not null")
    own = lambda df, kind, n=F.lit(None): rows(known(df), cell(F.col("y")), cell(F.col("x")), kind, n=n)

    same = Window.partitionBy("image_id")
    grids = sizes.where((F.col("width") > 0) & (F.col("height") > 0)).select(
        "image_id", "width", "height", F.max("height").over(same).alias("_h"), F.max("width").over(same).alias("_w"))
    marked = known(skeleton).where((F.col("y") >= -margin) & (F.col("x") >= -margin))
    events = rows(grids, span(F.lit(0), F.col("_h") - 1), span(F.lit(0), F.col("_w") - 1), F.lit(_GRID), "height", "width").unionByName(
        rows(marked, span(F.col("y") - margin, F.col("y") + margin), span(F.col("x") - margin, F.col("x") + margin), F.lit(_SKELETON)))
    if labels is not None:
        events = events.unionByName(own(labels, F.when(F.col("valid"), _LABEL).otherwise(_INSTANCE), F.col("instance")))
    if valid is not None:
        events = events.unionByName(own(valid, F.lit(_VALID)))
    place = ["image_id", "_ty", "_tx"]
    kernel, schema = _layer_kernel(events.schema["image_id"], names, tile, radius, tau, valid is not None or labels is not None)
    made = spread(events, *place).sortWithinPartitions(*place).mapInArrow(kernel, schema)
    typed = image_grid(sizes).schema
    return made.select("image_id", *[F.col(v).cast(typed[v].dataType).alias(v) for v in ("y", "x")], *names)


def truncated_distance(skeleton: DataFrame, sizes: DataFrame, valid: DataFrame | None = None, tau: float = DISTANCE_TAU) -> DataFrame:
    """min(distance to the nearest skeleton pixel / tau, 1) per pixel, 1 outside ``valid``.

    Two passes in each tile: the nearest skeleton pixel along the row, then the best of the rows within tau.
    """
    return grid_layers(skeleton, sizes, ["distance"], valid, tau=tau)


def label_skeleton(pixels: DataFrame, background: int = IGNORE_VALUE) -> DataFrame:
    """Every pixel is valid; the skeleton is where the label is not background."""
    return pixels.select(
        "image_id", "y", "x", (F.col("value") != background).alias("skeleton"), F.lit(True).alias("valid")
    )


def apply_valid_mask(skeleton: DataFrame, mask: DataFrame, level: int = 128) -> DataFrame:
    """Skeleton pixels where the mask reaches ``level``."""
    # A mask has every pixel of its image: never sent whole to every task.
    valid = mask.where(F.col("value") >= level).select("image_id", "y", "x").hint("merge")
    return skeleton.join(valid, ["image_id", "y", "x"], "left_semi")


def box_rows(boxes: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """One row per pixel row a box covers, with its [x1, x2) extent."""
    span = box_pixel_span(F.col("box"), F.col("width"), F.col("height"))
    rows = boxes.withColumn("_s", span).where("_s.x2 > _s.x1 and _s.y2 > _s.y1")
    return rows.select(
        *keys, F.explode(F.sequence(F.col("_s.y1"), F.col("_s.y2") - 1)).alias("y"),
        F.col("_s.x1").alias("x1"), F.col("_s.x2").alias("x2"),
    )


def ignore_boxes(pixels: DataFrame, boxes: DataFrame, value: int = IGNORE_VALUE) -> DataFrame:
    """Paint boxes with the ignore value; the join is equal on image and row."""
    rows = box_rows(boxes).select(
        F.col("image_id").alias("_image"), F.col("y").alias("_y"), "x1", "x2"
    ).distinct()
    inside = (
        (F.col("image_id") == F.col("_image")) & (F.col("y") == F.col("_y"))
        & (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2"))
    )
    hit = pixels.join(rows, inside, "left_semi").withColumn("value", F.lit(value))
    return pixels.join(rows, inside, "left_anti").unionByName(hit)


def ring_order(polygons: DataFrame) -> DataFrame:
    """Rings numbered from 0 by area inside their image, as ``ring``."""
    from annolake.functions.geometry import polygon_area

    sized = spread(polygons.where(F.size("points") >= 3), "image_id").withColumn("_area", polygon_area(F.col("points")))
    # The rings of one image are few, so a window holds one image.
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("_area", "shape_index"))
    return sized.withColumn("ring", (place - 1).cast("int")).drop("_area")


def ring_cover(rings: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """For every pixel in a ring fill, the sorted numbers of the rings that cover it."""
    fill = rasterize(rings, [*keys, "ring"], border=True)
    return fill.groupBy(*keys, "y", "x").agg(F.array_sort(F.collect_set("ring")).alias("rings"))


def _cover_with_last(rings: DataFrame) -> DataFrame:
    """The cover of every pixel with the number of the image's last ring, which goes with the rings, so no pixel is joined."""
    known = rings.where("image_id is not null")
    return ring_cover(known.withColumn("_last", F.max("ring").over(Window.partitionBy("image_id"))), ["image_id", "_last"])


def ring_instances(rings: DataFrame) -> DataFrame:
    """Annulus number of every pixel and whether it lies in the outermost fill.

    A pixel in ring i but not in ring i-1 belongs to i; the largest such i wins.
    """
    own = F.filter("rings", lambda i: (i > 0) & ~F.array_contains("rings", i - 1))
    valid = F.array_contains("rings", F.col("_last"))
    return _cover_with_last(rings).select(
        "image_id", "y", "x",
        F.when(valid, F.coalesce(F.array_max(own), F.lit(0))).otherwise(0).alias("instance"), valid.alias("valid"),
    )


def non_nested_pairs(rings: DataFrame) -> DataFrame:
    """Adjacent ring pairs whose inner fill leaves the outer one, per image."""
    last = rings.groupBy("image_id").agg(F.max("ring").alias("_last"))
    loose = F.filter("rings", lambda i: (i < F.col("_last")) & ~F.array_contains("rings", i + 1))
    bad = (
        _cover_with_last(rings).select("image_id", F.explode(loose).alias("inner"))
        .distinct().groupBy("image_id").agg(F.count(F.lit(1)).alias("_bad"))
    )
    return last.join(bad, "image_id", "left").select(
        "image_id", (F.col("_last") + 1).alias("closed_rings"), F.coalesce("_bad", F.lit(0)).alias("non_nested_pairs")
    )


_LAYERS = ["skeleton", "boundary", "distance", "instance", "valid"]


def _targets(
    skeleton: DataFrame, sizes: DataFrame, valid: DataFrame | None, labels: DataFrame | None, boundary_width: int, tau: float,
) -> DataFrame:
    """The five target layers on the whole grid; without ``valid`` and ``labels`` every pixel is valid, without ``labels`` instances are 0."""
    return grid_layers(skeleton, sizes, _LAYERS, valid, labels, max(0, (boundary_width - 1) // 2), tau)


def ring_targets(polygons: DataFrame, sizes: DataFrame, boundary_width: int = 5, tau: float = DISTANCE_TAU) -> DataFrame:
    """Skeleton, boundary, distance, instance and valid of every pixel, from closed outlines."""
    rings = ring_order(polygons)
    labels = ring_instances(rings)
    skeleton = trace_lines(rings, ["image_id"], closed=True)
    return _targets(skeleton, sizes, None, labels, boundary_width, tau)


def ring_targets_raster(labels: DataFrame, sizes: DataFrame, boundary_width: int = 5, tau: float = DISTANCE_TAU) -> DataFrame:
    """The same layers from a raster of ring numbers, ``value`` per pixel; every pixel is valid."""
    return _targets(label_skeleton(labels).where("skeleton").select("image_id", "y", "x"), sizes, None, None, boundary_width, tau)


def ring_targets_lines(
    polylines: DataFrame, sizes: DataFrame, mask: DataFrame | None = None, boundary_width: int = 5, tau: float = DISTANCE_TAU, level: int = 128,
) -> DataFrame:
    """The same layers from open polylines; ``mask`` (image_id, y, x, value) leaves pixels of at least ``level`` valid."""
    skeleton = trace_lines(polylines, ["image_id"], closed=False)
    if mask is None:
        return _targets(skeleton, sizes, None, None, boundary_width, tau)
    return _targets(
        apply_valid_mask(skeleton, mask, level), sizes, mask.where(F.col("value") >= level).select("image_id", "y", "x"), None, boundary_width, tau)


def ring_index(samples: DataFrame, targets: DataFrame, nested: DataFrame | None = None) -> DataFrame:
    """One row per sample: pixel counts, rings and instances of its targets, or an error row.

    ``samples``: image_id and the descriptive index columns, width and height among them; ``nested`` is the result of
    ``non_nested_pairs``. A sample of unknown size, or without any outline, is an error row without counts.
    """
    counts = targets.groupBy("image_id").agg(
        F.count_if("skeleton").alias("skeleton_pixels"), F.count_if("valid").alias("valid_pixels"), F.max("instance").alias("instance_count"),
        (F.max("x") + 1).alias("target_width"), (F.max("y") + 1).alias("target_height"))
    rows = samples.join(counts, "image_id", "left")
    rings = F.lit(0), F.lit(0)
    if nested is not None:
        rows = rows.join(nested.select("image_id", "closed_rings", F.col("non_nested_pairs").alias("_loose")), "image_id", "left")
        rings = F.coalesce("closed_rings", F.lit(0)), F.coalesce("_loose", F.lit(0))
    error = F.when((F.coalesce("width", F.lit(0)) <= 0) | (F.coalesce("height", F.lit(0)) <= 0), "unknown image size").when(
        F.coalesce("skeleton_pixels", F.lit(0)) == 0, "no ring outline").otherwise("")
    good = lambda value: F.when(error == "", value)
    return rows.select(
        *samples.columns, *[good(F.col(name)).alias(name) for name in ("target_width", "target_height", "skeleton_pixels", "valid_pixels")],
        good(rings[0]).cast("int").alias("closed_ring_count"), good(F.col("instance_count")).alias("instance_count"),
        good(rings[1]).cast("int").alias("non_nested_pairs"), F.when(error == "", "ok").otherwise("error").alias("status"), error.alias("error"))


def _tile_components(keys: list[str], key_types: list[T.StructField], tile: int):
    """Kernel over rows sorted by tile: many whole tiles are labelled by one array pass."""
    places = [*keys, "_ty", "_tx"]
    schema = T.StructType([
        *key_types, T.StructField("_ty", T.IntegerType()), T.StructField("_tx", T.IntegerType()),
        T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("_root", T.LongType()),
    ])
    wide = tile + 2

    def label(block: pd.DataFrame) -> pd.DataFrame:
        """Smallest pixel code of each 8-connected part inside every tile of the block."""
        new_tile = (block[places] != block[places].shift()).any(axis=1).to_numpy()
        ys, xs = block["y"].to_numpy(), block["x"].to_numpy()
        spots = (np.cumsum(new_tile) - 1).astype(np.int64) * (wide * wide) + (ys % tile + 1) * wide + xs % tile + 1
        order = np.argsort(spots, kind="stable")
        spots = spots[order]
        starts, ends = [], []
        for step in (1, wide - 1, wide, wide + 1):
            at = np.minimum(np.searchsorted(spots, spots + step), len(spots) - 1)
            hit = spots[at] == spots + step
            starts.append(np.flatnonzero(hit))
            ends.append(at[hit])
        one, two = np.concatenate(starts), np.concatenate(ends)
        # Spots run in raster order inside a tile, so the least index is the first pixel.
        least = np.arange(len(spots))
        while True:
            low = np.minimum(least[one], least[two])
            better = least.copy()
            np.minimum.at(better, least[one], low)
            np.minimum.at(better, least[two], low)
            better = np.minimum(better, better[better])
            better = better[better]
            if np.array_equal(better, least):
                break
            least = better
        codes = (ys.astype(np.int64) * (1 << 31) + xs)[order]
        roots = np.empty(len(spots), dtype=np.int64)
        roots[order] = codes[least]
        return block.assign(_root=roots)[[*places, "y", "x", "_root"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            block = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if block.empty:
                continue
            # The last tile may go on in the next batch; no tile exceeds tile*tile rows.
            changed = np.flatnonzero((block[places] != block[places].shift()).any(axis=1).to_numpy())
            held = block.iloc[changed[-1] :].reset_index(drop=True)
            if changed[-1] > 0:
                yield label(block.iloc[: changed[-1]].reset_index(drop=True))
        if held is not None and not held.empty:
            yield label(held)

    return run, schema


def connected_components(pixels: DataFrame, keys: Sequence[str] = ("image_id", "class"), tile: int = TILE) -> DataFrame:
    """8-connected components as ``component``, the code of their first pixel.

    Masks are cut into tiles, so a grouped task sees at most tile*tile pixels. Parts touching
    over a tile edge are joined by label propagation over those contacts only.
    """
    keys = list(keys)
    tiled = pixels.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct()
    tiled = tiled.withColumn("_ty", F.floor(F.col("y") / tile).cast("int")).withColumn("_tx", F.floor(F.col("x") / tile).cast("int"))
    kernel, schema = _tile_components(keys, [tiled.schema[k] for k in keys], tile)
    places = [*keys, "_ty", "_tx"]
    ordered = tiled.select(*places, "y", "x").repartition(*places).sortWithinPartitions(*places)
    parts = stable(ordered.mapInPandas(kernel, schema))

    rim = (F.col("y") % tile).isin(0, tile - 1) | (F.col("x") % tile).isin(0, tile - 1)
    edge = parts.where(rim)
    moves = F.explode(F.array(*[
        F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))
    ])).alias("_m")
    # Contacts between different tiles, both directions, as pairs of part roots.
    ahead = edge.select(*keys, "_ty", "_tx", F.col("_root").alias("a"), "y", "x", moves).select(
        *keys, F.col("_ty").alias("_ay"), F.col("_tx").alias("_ax"), "a",
        (F.col("y") + F.col("_m.dy")).alias("y"), (F.col("x") + F.col("_m.dx")).alias("x"),
    )
    touch = ahead.join(edge.withColumnRenamed("_root", "b"), [*keys, "y", "x"]).where(
        (F.col("_ay") != F.col("_ty")) | (F.col("_ax") != F.col("_tx"))
    )
    links = stable(
        touch.select(*keys, "a", "b").union(touch.select(*keys, F.col("b"), F.col("a"))).distinct()
    )
    if links.isEmpty():
        return parts.select(*keys, "y", "x", F.col("_root").alias("component"))

    labels = stable(links.select(*keys, F.col("a").alias("part"), F.col("a").alias("label")).distinct())
    while True:
        # Least label among a part and its contacts, then one pointer jump.
        heard = links.join(labels.select(*keys, F.col("part").alias("b"), "label"), [*keys, "b"])
        offered = heard.select(*keys, F.col("a").alias("part"), "label").unionByName(labels)
        lower = offered.groupBy(*keys, "part").agg(F.min("label").alias("label"))
        jump = lower.select(*keys, F.col("part").alias("label"), F.col("label").alias("_far"))
        moved = lower.join(jump, [*keys, "label"], "left").select(
            *keys, "part", F.least("label", F.coalesce("_far", "label")).alias("label")
        )
        moved = stable(moved)
        changed = moved.join(labels, [*keys, "part", "label"], "left_anti")
        done = changed.isEmpty()
        labels = moved
        if done:
            break
    joined = parts.join(labels.withColumnRenamed("part", "_root"), [*keys, "_root"], "left")
    return joined.select(*keys, "y", "x", F.coalesce("label", "_root").alias("component"))


def component_stats(components: DataFrame, keys: Sequence[str] = ("image_id", "class")) -> DataFrame:
    """Area and box of each component, with a number from 1 in raster order."""
    stats = components.groupBy(*keys, "component").agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("x1"), F.min("y").alias("y1"),
        (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"),
    )
    # A window holds the components of one key group, an image and class.
    return stats.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("component")).cast("long"))


def column_runs(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vertical runs of set pixels as (x, y1, length); windows hold one image column."""
    lane = Window.partitionBy(*keys, "x").orderBy("y")
    points = pixels.select(*keys, "y", "x").distinct()
    island = points.withColumn("_g", F.col("y") - F.row_number().over(lane))
    return island.groupBy(*keys, "x", "_g").agg(F.min("y").alias("y1"), F.count(F.lit(1)).alias("length")).drop("_g")


def rle_encode(pixels: DataFrame, sizes: DataFrame, keys: Sequence[str], size_key: str = "image_id") -> DataFrame:
    """Column-major run lengths, zeros first, of each mask (R9). Empty masks have no row."""
    runs = column_runs(pixels, keys).join(sizes.select(size_key, "width", "height"), size_key)
    start = F.col("x").cast("long") * F.col("height") + F.col("y1")
    listed = runs.select(*keys, "width", "height", start.alias("s"), (start + F.col("length")).alias("e")).groupBy(
        *keys, "width", "height"
    ).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_runs"))
    size = F.size("_runs")
    spots = F.sequence(F.lit(0), size - 1)
    run = lambda i: F.get("_runs", i)
    starts = F.transform(
        F.filter(spots, lambda i: (i == 0) | (run(i)["s"] != run(i - 1)["e"])), lambda i: run(i)["s"]
    )
    ends = F.transform(
        F.filter(spots, lambda i: (i == size - 1) | (run(i + 1)["s"] != run(i)["e"])), lambda i: run(i)["e"]
    )
    merged = listed.select(*keys, "width", "height", starts.alias("_s"), ends.alias("_e"))
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("_e", 1, F.size("_e") - 1))
    pairs = F.flatten(F.transform(
        F.sequence(F.lit(0), F.size("_s") - 1),
        lambda i: F.array(F.get("_s", i) - F.get(before, i), F.get("_e", i) - F.get("_s", i)),
    ))
    total = F.col("width").cast("long") * F.col("height")
    tail = total - F.element_at("_e", -1)
    counts = F.when(tail > 0, F.concat(pairs, F.array(tail))).otherwise(pairs)
    return merged.select(
        *keys, F.struct(F.array("height", "width").alias("size"), counts.cast("array<int>").alias("counts")).alias("rle")
    )


def rle_valid(rle: Column) -> Column:
    """No negative run and no run beyond the image (R10, strict reading)."""
    total = F.aggregate(rle["counts"], F.lit(0).cast("long"), lambda s, v: s + v)
    cells = rle["size"].getItem(0).cast("long") * rle["size"].getItem(1)
    return F.coalesce(F.forall(rle["counts"], lambda v: v >= 0) & (total <= cells), F.lit(False))


def rle_decode(df: DataFrame, keys: Sequence[str], strict: bool = True) -> DataFrame:
    """Pixels of run-length masks.

    Strict drops invalid masks, which ``rle_valid`` tells apart; lenient reads negative runs
    as zero and stops at the image's end.
    """
    source = df.where(rle_valid(F.col("rle"))) if strict else df.where("rle is not null")
    rows = source.select(
        *keys, F.col("rle.size").getItem(0).alias("_h"), F.col("rle.size").getItem(1).alias("_w"),
        F.posexplode("rle.counts").alias("_i", "_n"),
    ).withColumn("_n", F.greatest(F.lit(0), F.col("_n")).cast("long"))
    order = Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_s", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    total = F.col("_h").cast("long") * F.col("_w")
    on = placed.where((F.col("_i") % 2 == 1) & (F.col("_n") > 0)).withColumn("_e", F.least(total, F.col("_s") + F.col("_n")))
    cells = on.where(F.col("_e") > F.col("_s")).select(
        *keys, "_h", F.explode(F.sequence(F.col("_s"), F.col("_e") - 1)).alias("_k")
    )
    return cells.select(*keys, (F.col("_k") % F.col("_h")).cast("int").alias("y"), F.floor(F.col("_k") / F.col("_h")).cast("int").alias("x"))


def paint_annotations(annotations: DataFrame) -> DataFrame:
    """Semantic mask: largest category over each pixel, from polygons, else boxes.

    ``annotations``: image_id, ann_id, category_id, polygons (array of point arrays), box,
    width, height.
    """
    known = annotations.where(F.col("category_id") > 0)
    usable = F.filter(F.coalesce("polygons", F.array().cast("array<array<array<double>>>")), lambda p: F.size(p) >= 3)
    listed = known.withColumn("_usable", usable)
    filled = rasterize(
        listed.select("image_id", "category_id", "width", "height", F.explode("_usable").alias("points")),
        ["image_id", "category_id"],
    )
    boxed = spans_to_pixels(box_rows(listed.where(F.size("_usable") == 0), ["image_id", "category_id"]))
    return filled.select("image_id", "category_id", "y", "x").unionByName(boxed.select("image_id", "category_id", "y", "x")).groupBy(
        "image_id", "y", "x"
    ).agg(F.max("category_id").alias("category_id"))


def near_far_regions(masks: DataFrame, sizes: DataFrame, radius: int) -> DataFrame:
    """Every pixel tagged near (within the dilated union of masks) or far."""
    return grid_layers(masks, sizes, ["boundary"], radius=radius, tau=0.0).select(
        "image_id", "y", "x", F.when(F.col("boundary"), "near").otherwise("far").alias("region")
    )


def instance_targets(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tight box and area of each mask; empty masks have no pixels and drop out."""
    return pixels.groupBy(*keys).agg(
        F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"),
        (F.max("y") + 1).alias("y2"), F.count(F.lit(1)).alias("area"),
    )
