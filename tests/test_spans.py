"""Run algebra against sets of pixels."""

import random

import pytest

from annolake.operators import raster, spans


def random_runs(seed, masks=6):
    rnd = random.Random(seed)
    rows = []
    for mask in range(masks):
        for _ in range(rnd.randrange(25)):
            start = rnd.randrange(30)
            rows.append((rnd.randrange(2), mask, rnd.randrange(4), start, start + rnd.randrange(0, 9)))
    return rows


def frame(spark, rows, name="mask"):
    return spark.createDataFrame(rows, f"image_id int, {name} int, y int, x1 int, x2 int").repartition(3)


def opened(rows):
    """{(image, mask): pixels}"""
    out = {}
    for image, mask, y, a, b in rows:
        out.setdefault((image, mask), set()).update((y, x) for x in range(a, b))
    return {k: v for k, v in out.items() if v}


def runs_of(df, *keys):
    rows = [tuple(r[k] for k in (*keys, "y", "x1", "x2")) for r in df.collect()]
    return rows


def as_pixels(rows, n):
    out = {}
    for r in rows:
        out.setdefault(r[:n], set()).update((r[n], x) for x in range(r[n + 1], r[n + 2]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_union_difference_maximum_and_overlap(spark, seed):
    left, right = random_runs(seed), random_runs(seed + 100)
    a, b = spans.merged(frame(spark, left), ["image_id", "mask"]), spans.merged(frame(spark, right), ["image_id", "mask"])
    got = runs_of(a, "image_id", "mask")
    assert as_pixels(got, 2) == opened(left)
    # Disjoint, with a gap between any two.
    ordered = sorted(got)
    assert all(p[:3] != q[:3] or p[4] < q[3] for p, q in zip(ordered, ordered[1:]))
    want = {k: v - opened(right).get(k, set()) for k, v in opened(left).items()}
    assert as_pixels(runs_of(spans.difference(a, b, ["image_id", "mask"]), "image_id", "mask"), 2) == {k: v for k, v in want.items() if v}
    top = {}
    for (image, mask), spots in opened(left).items():
        for spot in spots:
            top[image, spot] = max(mask, top.get((image, spot), -1))
    painted = as_pixels(runs_of(spans.painted(frame(spark, left), ["image_id"], "mask"), "image_id", "mask"), 2)
    assert {(image, spot): mask for (image, mask), spots in painted.items() for spot in spots} == top
    pairs = spans.mask_pairs_runs(a.withColumnRenamed("mask", "pred_id"), b.withColumnRenamed("mask", "gt_id"), ["image_id"]).collect()
    expected = {}
    for (image, p), x in opened(left).items():
        for (other, g), y in opened(right).items():
            if image == other and x & y:
                expected[image, p, g] = (len(x & y) / len(x | y), 2 * len(x & y) / (len(x) + len(y)))
    for at, name in enumerate(("iou", "dice")):
        assert {(r["image_id"], r["pred_id"], r["gt_id"]): r[name] for r in pairs} == pytest.approx({k: v[at] for k, v in expected.items()})


def test_rings_that_leave_the_next_one(spark):
    square = lambda low, high: [[low, low], [high, low], [high, high], [low, high]]
    rows = [(1, 0, square(8, 12)), (1, 1, square(4, 16)), (1, 2, square(1, 20)), (2, 0, square(8, 12)), (2, 1, square(9, 20)), (2, 2, square(0, 30)), (3, 0, square(2, 5))]
    rings = spark.createDataFrame([(i, r, [[float(v) for v in p] for p in points], 32, 32) for i, r, points in rows], "image_id int, ring int, points array<array<double>>, width int, height int")
    found = {r["image_id"]: (r["closed_rings"], r["non_nested_pairs"]) for r in spans.non_nested_runs(rings).collect()}
    assert found == {1: (3, 0), 2: (3, 1), 3: (1, 0)}
    assert found == {r["image_id"]: (r["closed_rings"], r["non_nested_pairs"]) for r in raster.non_nested_pairs(rings).collect()}


def test_no_runs(spark):
    none = frame(spark, [])
    assert spans.merged(none, ["image_id", "mask"]).count() == 0
    assert spans.segments(none, ["image_id"], none["mask"]).count() == 0
