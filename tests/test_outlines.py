"""Where outlines meet themselves, class by class."""

import random
from decimal import Decimal

from annolake.operators.shapes import outline_defects

CASES = {
    "square": ([(0, 0), (4, 0), (4, 4), (0, 4)], set()),
    "bow": ([(0, 0), (4, 4), (4, 0), (0, 4)], {"crossing", "flat"}),
    "uneven bow": ([(0, 0), (4, 4), (4, 0), (0, 6)], {"crossing"}),
    "vertex on edge": ([(0, 0), (8, 0), (8, 8), (4, 0), (0, 8)], {"touching"}),
    "two loops at one vertex": ([(0, 0), (4, 2), (8, 0), (8, 4), (4, 2), (0, 4)], {"touching"}),
    "spike": ([(0, 0), (4, 0), (4, 4), (4, 2), (0, 2)], {"overlapping", "touching"}),
    "edges on each other": ([(0, 0), (8, 0), (8, 4), (6, 4), (6, 0), (2, 0), (2, 4), (0, 4)], {"overlapping", "touching"}),
    "line there and back": ([(0, 0), (4, 4), (2, 2)], {"overlapping", "flat"}),
    "repeated points": ([(0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 4)], set()),
    "straight vertex": ([(0, 0), (2, 0), (4, 0), (4, 4), (0, 4)], set()),
    "one point": ([(1, 1), (1, 1), (1, 1)], {"flat"}),
    "small steps": ([(0.1, 0.1), (0.7, 0.3), (0.4, 0.2), (0.1, 0.9)], {"touching", "overlapping"}),
    "across cells": ([(0, 0), (300, 1), (300, 200), (150, 0.5), (0, 200)], {"touching"}),
}


def side(p, q, r):
    v = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return (v > 0) - (v < 0)

def on(p, q, r):
    return side(p, q, r) == 0 and min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])

def plain(points):
    ring = [p for p, q in zip(points, points[1:] + points[:1]) if p != q]
    n, out = len(ring), set()
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) == 0:
        out.add("flat")
    edges = [(ring[i], ring[(i + 1) % n]) for i in range(n)] if n > 1 else []
    for i in range(n):
        for j in range(i + 1, n):
            (p, q), (r, s) = edges[i], edges[j]
            ends = {x for x in (r, s) if on(p, q, x)} | {x for x in (p, q) if on(r, s, x)}
            if side(p, q, r) == 0 == side(p, q, s) and len(ends) > 1:
                out.add("overlapping")
            elif j - i in (1, n - 1):
                continue
            elif side(p, q, r) * side(p, q, s) < 0 and side(r, s, p) * side(r, s, q) < 0:
                out.add("crossing")
            elif ends:
                out.add("touching")
    return out


def found(spark, shapes, cell):
    df = spark.createDataFrame([(k, [[float(x), float(y)] for x, y in p]) for k, p in shapes.items()], "name string, polygon array<array<double>>")
    out = {k: set() for k in shapes}
    for r in outline_defects(df, ["name"], cell).collect():
        assert r["defect"] not in out[r["name"]]
        out[r["name"]].add(r["defect"])
    return out


def test_kinds(spark):
    got = found(spark, {k: p for k, (p, _) in CASES.items()}, 16.0)
    for name, (points, kinds) in CASES.items():
        assert plain([(Decimal(str(x)), Decimal(str(y))) for x, y in points]) == kinds, name
        assert got[name] == kinds, name


def test_like_a_plain_check_on_random_outlines(spark):
    rnd = random.Random(3)
    shapes = {str(i): [(rnd.randrange(7), rnd.randrange(7)) for _ in range(rnd.randrange(3, 7))] for i in range(150)}

    assert found(spark, shapes, 2.0) == {k: plain(p) for k, p in shapes.items()}
