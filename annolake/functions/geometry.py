"""Box and polygon expressions. Boxes are structs, polygons arrays of [x, y] arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME_TOLERANCE = 1.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def decimal_units(value: Column, digits: int) -> Column:
    """|value| in units of 10^-digits, rounded to the nearest, exact ties to even.

    Java rounds the shortest decimal form half up, which differs on exact binary ties. Here
    the value is split in halves whose products with 10^digits are exact, so the comparison
    with one half is exact too.
    """
    power = F.lit(10.0**digits)

    def halves(v: Column) -> Column:
        return let(v * F.lit(134217729.0), lambda scaled: let(
            scaled - (scaled - v), lambda high: F.struct((high * power).alias("a"), ((v - high) * power).alias("b"))))

    def nearest(p: Column) -> Column:
        whole = F.floor(p["a"])
        return let(F.struct(whole.alias("whole"), F.floor((p["a"] - whole) + p["b"]).alias("carry")), lambda q: let(
            ((p["a"] - q["whole"]) - q["carry"] - 0.5) + p["b"],
            lambda side: q["whole"] + q["carry"] + ((side > 0) | ((side == 0) & ((q["whole"] + q["carry"]) % 2 == 1))).cast("long")))

    return let(F.abs(value.cast("double")), lambda v: let(halves(v), nearest))


def round_half_even(value: Column, digits: int) -> Column:
    """The double nearest to the value rounded to ``digits`` decimals, exact ties to even."""
    rounded = decimal_units(value, digits) / F.lit(10.0**digits)
    return rounded * F.when(value < 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def fixed_text(value: Column, digits: int) -> Column:
    """Fixed-point text with ``digits`` decimals, exact ties to even."""
    base = F.lit(10**digits)
    number = let(decimal_units(value, digits), lambda units: F.concat(
        F.floor(units / base).cast("string"), F.lit("."), F.lpad((units % base).cast("string"), digits, "0")))
    return F.concat(F.when(value < 0, "-").otherwise(""), number)


def xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def xyxy(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def corners_to_xywh(x1, y1, x2, y2, width, height) -> Column:
    """Normalised corners to a pixel box (G1)."""
    return xywh(x1 * width, y1 * height, (x2 - x1) * width, (y2 - y1) * height)


def center_to_xywh(cx, cy, w, h, width, height) -> Column:
    """Normalised centre and size to a pixel box."""
    return xywh((cx - w / 2) * width, (cy - h / 2) * height, w * width, h * height)


def center_to_xyxy(cx, cy, w, h, width, height) -> Column:
    """Normalised centre and size to pixel corners."""
    return xyxy(
        (cx - w / 2.0) * width, (cy - h / 2.0) * height,
        (cx + w / 2.0) * width, (cy + h / 2.0) * height,
    )


def to_xyxy(box: Column) -> Column:
    return xyxy(box["x"], box["y"], box["x"] + box["w"], box["y"] + box["h"])


def box_array(box: Column) -> Column:
    """Box struct as the four-number array of the exchange format, 4 decimals."""
    return F.array(*[round_half_even(box[k], 4) for k in ("x", "y", "w", "h")])


def box_struct(values: Column) -> Column:
    return xywh(*[values.getItem(i) for i in range(4)])


def clip_box(x1, y1, x2, y2, width, height) -> Column:
    """Corners clamped to the image as an xywh box; null when nothing is left.

    A width or height of zero means the size is unknown and sets no upper bound.
    """
    left, top = F.greatest(F.lit(0.0), x1), F.greatest(F.lit(0.0), y1)
    right = F.when(width > 0, F.least(width, x2)).otherwise(x2)
    bottom = F.when(height > 0, F.least(height, y2)).otherwise(y2)
    return F.when(
        (right > left) & (bottom > top), xywh(left, top, right - left, bottom - top)
    )


def coordinates(points: Column, axis: int) -> Column:
    return F.transform(points, lambda p: p.getItem(axis))


def polygon_bbox(points: Column) -> Column:
    """Tight box of a polygon."""
    xs, ys = coordinates(points, 0), coordinates(points, 1)
    x1, y1 = F.array_min(xs), F.array_min(ys)
    return xywh(x1, y1, F.array_max(xs) - x1, F.array_max(ys) - y1)


def rotated(points: Column) -> Column:
    """The same ring, one vertex on: pairs with ``points`` to give the edges."""
    return F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))


def polygon_area(points: Column) -> Column:
    """Absolute shoelace area."""
    cross = F.zip_with(
        points, rotated(points),
        lambda a, b: a.getItem(0) * b.getItem(1) - b.getItem(0) * a.getItem(1),
    )
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda total, value: total + value) / 2.0)


def touches_frame(points, width, height, label_flag, tolerance: float = FRAME_TOLERANCE) -> Column:
    """Any vertex within tolerance of the frame; the label's own flag if the size is unknown."""
    near = F.exists(
        points,
        lambda p: (p.getItem(0) <= tolerance) | (p.getItem(1) <= tolerance)
        | (p.getItem(0) >= width - 1 - tolerance) | (p.getItem(1) >= height - 1 - tolerance),
    )
    return F.when((width > 0) & (height > 0), near).otherwise(label_flag)


def box_area(box: Column) -> Column:
    """Non-negative area to 4 decimals."""
    zero = F.lit(0.0)
    return round_half_even(F.greatest(zero, box["w"]) * F.greatest(zero, box["h"]), 4)


def scale_factor(target: Column, source: Column) -> Column:
    return target / F.greatest(F.lit(1), source)


def scale_box(box: Column, sx: Column, sy: Column) -> Column:
    """Box rescaled and rounded to 4 decimals."""
    r = lambda value: round_half_even(value, 4)
    return xywh(r(box["x"] * sx), r(box["y"] * sy), r(box["w"] * sx), r(box["h"] * sy))


def scale_polygons(polygons: Column, sx: Column, sy: Column) -> Column:
    """Flat polygons rescaled, even positions by x and odd ones by y."""
    return F.transform(
        polygons,
        lambda poly: F.transform(poly, lambda v, i: F.when(i % 2 == 0, v * sx).otherwise(v * sy)),
    )


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two xyxy boxes, 0 when the union is empty."""
    zero = F.lit(0.0)
    side = lambda low, high: F.greatest(zero, high - low)
    inter = side(F.greatest(a["x1"], b["x1"]), F.least(a["x2"], b["x2"])) * side(
        F.greatest(a["y1"], b["y1"]), F.least(a["y2"], b["y2"])
    )
    area = lambda box: side(box["x1"], box["x2"]) * side(box["y1"], box["y2"])
    union = area(a) + area(b) - inter
    return F.when(union <= 0, zero).otherwise(inter / union)


def box_in_bounds(box, width, height, low: float = -1.0, slack: float = 1.0) -> Column:
    """Positive size and inside the image; targets may start at -1, ignore boxes at 0."""
    return (
        (box["w"] > 0) & (box["h"] > 0) & (box["x"] >= low) & (box["y"] >= low)
        & (box["x"] + box["w"] <= width + slack) & (box["y"] + box["h"] <= height + slack)
    )


def polygons_wellformed(polygons: Column) -> Column:
    """Each flat polygon has at least three points and whole pairs."""
    return F.forall(polygons, lambda p: (F.size(p) >= 6) & (F.size(p) % 2 == 0))


def rle_wellformed(rle: Column, width: Column, height: Column) -> Column:
    """Run lengths exist and their size is the image's."""
    return (
        (rle["size"].getItem(0) == height) & (rle["size"].getItem(1) == width)
        & (F.size(rle["counts"]) > 0)
    )


def crop_window(box: Column, context: float = 0.20) -> Column:
    """Square window around a box with context on every side."""
    side = F.greatest(F.lit(2.0), F.greatest(box["w"], box["h"]) * (1.0 + 2.0 * context))
    cx, cy = box["x"] + box["w"] / 2.0, box["y"] + box["h"] / 2.0
    return xyxy(cx - side / 2, cy - side / 2, cx + side / 2, cy + side / 2)


def yolo_box_line(class_index, box, width, height) -> Column:
    """Class, centre and size relative to the image, 6 decimals."""
    numbers = [
        (box["x"] + box["w"] / 2.0) / width, (box["y"] + box["h"] / 2.0) / height,
        box["w"] / width, box["h"] / height,
    ]
    return F.concat_ws(" ", class_index.cast("int").cast("string"), *[fixed_text(n, 6) for n in numbers])


def yolo_polygon_line(class_index, polygon, width, height) -> Column:
    """Class and vertices relative to the image, 6 decimals."""
    numbers = F.transform(
        polygon,
        lambda v, i: fixed_text(v / F.when(i % 2 == 0, width).otherwise(height), 6),
    )
    return F.concat_ws(" ", class_index.cast("int").cast("string"), F.array_join(numbers, " "))


def box_pixel_span(box, width, height) -> Column:
    """Whole-pixel extent of a box, end exclusive, clamped to the image."""
    clamp = lambda value, top: F.greatest(F.lit(0), F.least(top, value)).cast("int")
    return xyxy(
        clamp(F.floor(box["x"]), width), clamp(F.floor(box["y"]), height),
        clamp(F.ceil(box["x"] + box["w"]), width), clamp(F.ceil(box["y"] + box["h"]), height),
    )


def point_in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd test, half open in y."""
    crossed = F.zip_with(
        points, rotated(points),
        lambda a, b: F.when(
            ((a.getItem(1) > y) != (b.getItem(1) > y))
            & (x < (b.getItem(0) - a.getItem(0)) * (y - a.getItem(1)) / (b.getItem(1) - a.getItem(1)) + a.getItem(0)),
            1,
        ).otherwise(0),
    )
    return F.aggregate(crossed, F.lit(0), lambda n, hit: n + hit) % 2 == 1


def shape_to_polygon(shape_type: Column, points: Column) -> Column:
    """Vertices of a polygon or of a two-point rectangle; empty when degenerate."""
    at = lambda i, axis: F.get(F.get(points, i), axis).cast("double")
    left, right = F.least(at(0, 0), at(1, 0)), F.greatest(at(0, 0), at(1, 0))
    top, bottom = F.least(at(0, 1), at(1, 1)), F.greatest(at(0, 1), at(1, 1))
    corner = lambda x, y: F.array(x, y)
    nothing = F.array().cast("array<array<double>>")
    return (
        F.when((shape_type == "polygon") & (F.size(points) >= 3), points.cast("array<array<double>>"))
        .when(
            (shape_type == "rectangle") & (F.size(points) == 2) & (left < right) & (top < bottom),
            F.array(corner(left, top), corner(right, top), corner(right, bottom), corner(left, bottom)),
        )
        .otherwise(nothing)
    )


def has_point_label(shapes: Column, label: str) -> Column:
    """Any point shape carrying the label."""
    return F.coalesce(
        F.exists(shapes, lambda s: (s["shape_type"] == "point") & (s["label"] == label)), F.lit(False)
    )


def shape_type_geometry(shape_type: Column) -> Column:
    """Geometry tag of a shape."""
    return F.when(shape_type == "polygon", "true_polygon").otherwise(
        "axis_aligned_rectangle_from_polygon"
    )


def flat_polygon(points: Column) -> Column:
    return F.flatten(points)


def unflatten(polygon: Column) -> Column:
    """Flat number list back to [x, y] pairs."""
    return F.transform(
        F.sequence(F.lit(0), F.floor(F.size(polygon) / 2).cast("int") - 1),
        lambda i: F.array(F.get(polygon, i * 2), F.get(polygon, i * 2 + 1)),
    )


def mask_source_priority(polygons: Column, rle: Column) -> Column:
    """Which source the mask of an annotation comes from: polygon, RLE, else its box."""
    usable = F.exists(polygons, lambda p: F.size(p) >= 6)
    return (
        F.when(F.coalesce(usable, F.lit(False)), "polygon")
        .when(rle.isNotNull() & (F.size(rle["size"]) == 2) & rle["counts"].isNotNull(), "rle")
        .otherwise("bbox")
    )
