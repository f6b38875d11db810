"""Queries over pixels: fills, lines, distances, components, run lengths."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolake.functions.geometry import shape_to_polygon, xywh
from annolake.operators import matching as M
from annolake.operators import raster as R
from annolake.operators import spans as I
from annolake.operators import taxonomy as X
from annolake.plans.fixtures import fixture
from annolake.plans.queries_geometry import shape_points
from annolake.plans.registry import query
from annolake.schema import INDEX_COLUMNS
from annolake.session import scratch_path
from annolake.sinks.tables import write_index
from annolake.sources.files import read_table
from annolake.presets import PALETTE
from annolake.presets import taxonomy as taxonomy_table

c = F.col
SPOT = ["image_id", "y", "x"]


def pixels(spark, sf):
    return fixture(spark, sf, "fx_pixels")


def frames(df):
    """Every image of the pixel fixture is 32 by 32."""
    return df.select("image_id").distinct().select("image_id", F.lit(32).alias("width"), F.lit(32).alias("height"))


_GRID = "gr as (select image_id, cast(r.range as int) as y, cast(s.range as int) as x from (select distinct image_id from fx_pixels), range(32) r, range(32) s)"


def polygons(spark, sf):
    """Polygons and rectangles alike, as closed outlines."""
    df = shape_points(fixture(spark, sf, "fx_shapes")).withColumn("points", shape_to_polygon(c("shape_type"), c("points"))).where("size(points) > 0")
    return df.select(c("shape_no").alias("image_id"), "points", F.lit(64).alias("width"), F.lit(60).alias("height"))


_POLY = """
    pts as (select shape_no as image_id, [[x, y], [x + w, y + 2], [x + w - 3, y + h], [x - 1, y + h + 1]] as p from fx_shapes where shape_type = 'polygon'
      union all select shape_no, [[x, y], [x + w, y], [x + w, y + h], [x, y + h]] from fx_shapes where shape_type = 'rectangle' and w > 0 and h > 0),
    ed as (select image_id, p[i] as a, p[i % 4 + 1] as b from (select *, unnest(range(1, 5)) as i from pts))"""


@query("rasterize", f"""
    with {_POLY}, cand as (select image_id, cast(r.range as int) as y, cast(s.range as int) as x from pts, range(60) r, range(64) s
      where r.range between p[1][2] and p[1][2] + 16 and s.range between p[1][1] - 4 and p[1][1] + 20),
    hit as (select image_id, y, x, count(*) filter (where (a[2] > y) <> (b[2] > y) and x < (b[1] - a[1]) * (y - a[2]) / (b[2] - a[2]) + a[1]) % 2 = 1 as inside from cand join ed using (image_id) group by 1, 2, 3)
    select image_id, y, x from hit where inside""")
def _(spark, sf):
    return R.rasterize(polygons(spark, sf), ["image_id"]).select(*SPOT)


@query("polygon_spans", f"""
    with {_POLY}, cut as (select image_id, cast(r.range as int) as y, (b[1] - a[1]) * (r.range - a[2]) / (b[2] - a[2]) + a[1] as cx from ed, range(60) r where (a[2] > r.range) <> (b[2] > r.range)),
    num as (select *, row_number() over (partition by image_id, y order by cx) - 1 as i from cut),
    runs as (select image_id, y, i // 2 as k, greatest(0, cast(ceil(min(cx)) as int)) as x1, least(64, cast(ceil(max(cx)) as int)) as x2 from num group by 1, 2, 3)
    select image_id, y, x1, x2 from runs where x2 > x1""")
def _(spark, sf):
    return R.polygon_spans(polygons(spark, sf), ["image_id"])


@query("trace_lines", f"""
    with {_POLY}, st as (select *, cast(greatest(abs(b[1] - a[1]), abs(b[2] - a[2])) as int) as n from ed)
    select distinct image_id, y, x from (select image_id, cast(floor(a[2] + (b[2] - a[2]) * (case when n > 0 then i.range / n else 0.0 end) + 0.5) as int) as y,
      cast(floor(a[1] + (b[1] - a[1]) * (case when n > 0 then i.range / n else 0.0 end) + 0.5) as int) as x from st, range(64) i where i.range <= n)
    where x >= 0 and y >= 0 and x < 64 and y < 60""")
def _(spark, sf):
    return R.trace_lines(polygons(spark, sf), ["image_id"], closed=True)


@query("dilate", f"""
    with {_GRID} select distinct gr.image_id, gr.y, gr.x from gr join (select * from fx_pixels where v > 100) p on gr.image_id = p.image_id and abs(gr.y - p.y) <= 2 and abs(gr.x - p.x) <= 2""")
def _(spark, sf):
    df = pixels(spark, sf)
    return R.dilate(df.where("v > 100"), 2, frames(df))


@query("truncated_distance", f"""
    with {_GRID}, sk as (select image_id, y, x from fx_pixels where v > 150),
    d as (select gr.image_id, gr.y, gr.x, min((gr.y - sk.y) * (gr.y - sk.y) + (gr.x - sk.x) * (gr.x - sk.x)) as q from gr left join sk on gr.image_id = sk.image_id group by 1, 2, 3)
    select d.image_id, d.y, d.x, round(case when p.v is null then 1 else least(sqrt(coalesce(q, 1000000)) / 6.0, 1.0) end, 6) as distance
    from d left join (select * from fx_pixels where v > 20) p on d.image_id = p.image_id and d.y = p.y and d.x = p.x""")
def _(spark, sf):
    df = pixels(spark, sf)
    return R.truncated_distance(df.where("v > 150"), frames(df), df.where("v > 20"), 6.0).withColumn("distance", F.round("distance", 6))


@query("label_skeleton", "select image_id, y, x, case when v > 60 then cast(floor(v) as int) else 255 end <> 255 as skeleton, true as valid from fx_pixels")
def _(spark, sf):
    return R.label_skeleton(pixels(spark, sf).withColumn("value", F.when(c("v") > 60, F.floor("v").cast("int")).otherwise(255)))


@query("apply_valid_mask", "select image_id, y, x from fx_pixels where v > 60 and x * 8 >= 128")
def _(spark, sf):
    df = pixels(spark, sf)
    return R.apply_valid_mask(df.where("v > 60").select(*SPOT), df.select(*SPOT, (c("x") * 8).alias("value")))


def user_boxes(spark, sf):
    """One box per customer on the pixel grid, ten to an image."""
    return fixture(spark, sf, "customer").select(
        F.floor(c("c_custkey") / 10).alias("image_id"), c("c_custkey").alias("ann_id"),
        xywh((c("c_custkey") % 23) + 0.5, (c("c_custkey") % 19) - 1.25, F.lit(7.0), (c("c_nationkey") % 9) + 1.0).alias("box"),
        F.lit(32).alias("width"), F.lit(32).alias("height"))


_UBOX = "ub as (select c_custkey // 10 as image_id, c_custkey as ann_id, (c_custkey % 23) + 0.5 as x, (c_custkey % 19) - 1.25 as y, 7.0 as w, (c_nationkey % 9) + 1.0 as h from customer)"


@query("ignore_boxes", f"""
    with {_UBOX} select p.image_id, p.y, p.x, case when exists (select 1 from ub where ub.image_id = p.image_id and p.x >= greatest(0, floor(ub.x)) and p.x < least(32, ceil(ub.x + w))
      and p.y >= greatest(0, floor(ub.y)) and p.y < least(32, ceil(ub.y + h))) then 255 else cast(floor(v / 100) as int) end as value from fx_pixels p""")
def _(spark, sf):
    df = pixels(spark, sf).select(*SPOT, F.floor(c("v") / 100).cast("int").alias("value"))
    return R.ignore_boxes(df, user_boxes(spark, sf))


# Nested squares: ring k of an image has half side 3k + (image % 3); one of five images has an odd ring out.
def ring_polygons(spark, sf):
    part = fixture(spark, sf, "supplier").select(c("s_suppkey").alias("image_id"))
    rows = part.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("shape_index"))
    half = 3.0 * (c("shape_index") + 1) + c("image_id") % 3
    shift = F.when((c("image_id") % 5 == 0) & (c("shape_index") == 1), 5.0).otherwise(0.0)
    corner = lambda sx, sy: F.array(F.lit(16.0) + shift + half * sx, F.lit(16.0) + half * sy)
    points = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))
    return rows.select("image_id", "shape_index", points.alias("points"), F.lit(32).alias("width"), F.lit(32).alias("height"))


# A filled square with its border is the closed box, clipped to the image.
_RINGS = """
    rg as (select s_suppkey as image_id, k, 3 * (k + 1) + s_suppkey % 3 as half, case when s_suppkey % 5 = 0 and k = 1 then 5 else 0 end as sh from supplier, range(3) t(k)),
    px as (select image_id, cast(a.range as int) as y, cast(b.range as int) as x, k from rg, range(32) a, range(32) b where abs(a.range - 16) <= half and abs(b.range - 16 - sh) <= half),
    cov as (select image_id, y, x, list(k) as ks from px group by 1, 2, 3)"""


@query("ring_instances", f"""
    with {_RINGS} select image_id, y, x, case when list_contains(ks, 2) then cast(coalesce(list_max(list_filter(ks, lambda i: i > 0 and not list_contains(ks, i - 1))), 0) as int) else 0 end as instance,
      list_contains(ks, 2) as valid from cov""")
def _(spark, sf):
    return R.ring_instances(R.ring_order(ring_polygons(spark, sf)))


@query("non_nested_pairs", f"""
    with {_RINGS}, bad as (select image_id, count(distinct i) as n from (select image_id, unnest(list_filter(ks, lambda i: i < 2 and not list_contains(ks, i + 1))) as i from cov) group by 1)
    select s_suppkey as image_id, 3 as closed_rings, coalesce(n, 0) as non_nested_pairs from supplier left join bad on image_id = s_suppkey""")
def _(spark, sf):
    return R.non_nested_pairs(R.ring_order(ring_polygons(spark, sf)))


@query("non_nested_runs", f"""
    with {_RINGS}, bad as (select image_id, count(distinct i) as n from (select image_id, unnest(list_filter(ks, lambda i: i < 2 and not list_contains(ks, i + 1))) as i from cov) group by 1)
    select s_suppkey as image_id, 3 as closed_rings, coalesce(n, 0) as non_nested_pairs from supplier left join bad on image_id = s_suppkey""")
def _(spark, sf):
    return I.non_nested_runs(R.ring_order(ring_polygons(spark, sf)))


@query("ring_targets", f"""
    with {_RINGS}, sk as (select distinct image_id, y, x from (select image_id, cast(a.range as int) as y, cast(b.range as int) as x, abs(a.range - 16) as dy, abs(b.range - 16 - sh) as dx, half from rg, range(32) a, range(32) b)
      where greatest(dx, dy) = half),
    vl as (select image_id, y, x, list_contains(ks, 2) as valid from cov),
    bo as (select count(*) as n from (select distinct vl.image_id, vl.y, vl.x from vl join sk on vl.image_id = sk.image_id and abs(vl.y - sk.y) <= 2 and abs(vl.x - sk.x) <= 2 where valid))
    select (select count(*) from sk) as skeleton_pixels, (select count(*) from vl where valid) as valid_pixels, (select n from bo) as boundary_pixels,
      (select count(*) * 1024 from supplier) as pixels, (select count(*) from sk join vl using (image_id, y, x) where valid) as zero_distance""")
def _(spark, sf):
    polys = ring_polygons(spark, sf)
    df = R.ring_targets(polys, polys.select("image_id", "width", "height").distinct())
    count = lambda flag, name: F.count_if(flag).alias(name)
    return df.agg(count(c("skeleton"), "skeleton_pixels"), count(c("valid"), "valid_pixels"), count(c("boundary"), "boundary_pixels"),
                  F.count(F.lit(1)).alias("pixels"), count(c("distance") == 0, "zero_distance"))


_RING_INDEX = f"""
    with {_RINGS}, sk as (select image_id, count(*) as n from (select distinct image_id, y, x from (
        select image_id, cast(a.range as int) as y, cast(b.range as int) as x, abs(a.range - 16) as dy, abs(b.range - 16 - sh) as dx, half from rg, range(32) a, range(32) b)
      where greatest(dx, dy) = half) group by 1),
    vl as (select image_id, count(*) filter (where list_contains(ks, 2)) as n, max(case when list_contains(ks, 2) then
      coalesce(list_max(list_filter(ks, lambda i: i > 0 and not list_contains(ks, i - 1))), 0) else 0 end) as top from cov group by 1),
    bad as (select image_id, count(distinct i) as n from (select image_id, unnest(list_filter(ks, lambda i: i < 2 and not list_contains(ks, i + 1))) as i from cov) group by 1),
    ok as (select s_suppkey, case when s_suppkey % 7 = 1 then 'unknown image size' when s_suppkey % 7 = 0 then 'no ring outline' else '' end as error from supplier)
    select concat('s', s_suppkey) as sample_id, case when error = '' then sk.n end as skeleton_pixels, case when error = '' then vl.n end as valid_pixels,
      case when error = '' then 3 end as closed_ring_count, case when error = '' then cast(top as int) end as instance_count,
      case when error = '' then cast(coalesce(bad.n, 0) as int) end as non_nested_pairs, case when error = '' then 'ok' else 'error' end as status, error
    from ok join sk on sk.image_id = s_suppkey join vl on vl.image_id = s_suppkey left join bad on bad.image_id = s_suppkey"""


def ring_samples(spark, sf):
    """The index of the nested squares; a seventh of the samples has no outline, a seventh no size."""
    kind = c("image_id") % 7
    samples = fixture(spark, sf, "supplier").select(c("s_suppkey").alias("image_id")).select(
        "image_id", F.concat(F.lit("s"), c("image_id").cast("string")).alias("sample_id"), F.lit("mokume").alias("dataset_id"),
        F.when(kind == 1, 0).otherwise(32).alias("width"), F.when(kind == 1, 0).otherwise(32).alias("height"))
    polys = ring_polygons(spark, sf).where(kind > 1)
    targets = R.ring_targets(polys, samples.where("width > 0").select("image_id", "width", "height"))
    return R.ring_index(samples, targets, R.non_nested_pairs(R.ring_order(polys)))


_INDEX_COLUMNS = ["sample_id", "skeleton_pixels", "valid_pixels", "closed_ring_count", "instance_count", "non_nested_pairs", "status", "error"]


@query("ring_index", _RING_INDEX)
def _(spark, sf):
    return ring_samples(spark, sf).select(*_INDEX_COLUMNS)


@query("ring_index_roundtrip", f"select sample_id, coalesce(skeleton_pixels, 0) as skeleton_pixels, status, error from ({_RING_INDEX})")
def _(spark, sf):
    path = scratch_path(spark, "rings")
    write_index(ring_samples(spark, sf), path, "ring")
    kind = T.StructType([T.StructField(n, T.LongType() if n == "skeleton_pixels" else T.StringType()) for n in INDEX_COLUMNS["ring"]])
    return read_table(spark, path, kind).select("sample_id", "skeleton_pixels", "status", "error")


@query("ring_targets_raster", """
    with lb as (select user_id as image_id, cast(floor((event_id % 1024) / 32) as int) as y, cast(event_id % 32 as int) as x from events group by 1, 2, 3 having max(value) > 150),
    gr as (select image_id, cast(a.range as int) as y, cast(b.range as int) as x from (select distinct user_id as image_id from events), range(32) a, range(32) b)
    select gr.image_id, gr.y, gr.x, lb.image_id is not null as skeleton, exists (select 1 from lb q where q.image_id = gr.image_id and abs(q.y - gr.y) <= 1 and abs(q.x - gr.x) <= 1) as boundary,
      0 as instance, true as valid from gr left join lb using (image_id, y, x)""")
def _(spark, sf):
    df = pixels(spark, sf)
    grid = R.image_grid(frames(df)).join(df.where("v > 150").select(*SPOT, F.lit(1).alias("one")).hint("merge"), SPOT, "left")
    labels = grid.select(*SPOT, F.when(c("one").isNull(), 255).otherwise(7).alias("value"))
    return R.ring_targets_raster(labels, frames(df), boundary_width=3).drop("distance")


@query("ring_targets_polylines", """
    with ln as (select s_suppkey as image_id, cast(s_suppkey % 32 as int) as y, cast(b.range as int) as x from supplier, range(32) b where b.range between 2 and 20),
    gr as (select s_suppkey as image_id, cast(a.range as int) as y, cast(b.range as int) as x from supplier, range(32) a, range(32) b)
    select gr.image_id, gr.y, gr.x, ln.image_id is not null and gr.x >= 10 as skeleton, gr.x >= 10 and gr.x <= 22 and abs(gr.y - gr.image_id % 32) <= 2 as boundary, 0 as instance, gr.x >= 10 as valid
    from gr left join ln using (image_id, y, x)""")
def _(spark, sf):
    rows = fixture(spark, sf, "supplier").select(c("s_suppkey").alias("image_id"), F.lit(32).alias("width"), F.lit(32).alias("height"))
    height = (c("image_id") % 32).cast("double")
    lines = rows.withColumn("points", F.array(F.array(F.lit(2.0), height), F.array(F.lit(20.0), height)))
    mask = R.image_grid(rows).withColumn("value", F.when(c("x") >= 10, 255).otherwise(0))
    return R.ring_targets_lines(lines, rows, mask).drop("distance")


# Components: parts are the classes of the transitive closure of touching pixels.
_COMP = """
    cp as (select image_id, class, y, x, cast(y as bigint) * 2147483648 + x as code from fx_pixels where v > 120),
    tc(image_id, class, root, code) as (select image_id, class, code, code from cp union
      select t.image_id, t.class, t.root, q.code from tc t join cp p on p.image_id = t.image_id and p.class = t.class and p.code = t.code
        join cp q on q.image_id = p.image_id and q.class = p.class and abs(q.y - p.y) <= 1 and abs(q.x - p.x) <= 1),
    lb as (select image_id, class, code, min(root) as component from tc group by 1, 2, 3)"""


def components(spark, sf, tile=R.TILE):
    return R.connected_components(pixels(spark, sf).where("v > 120"), tile=tile)


@query("connected_components", f"with recursive {_COMP} select image_id, class, y, x, component from lb join cp using (image_id, class, code)")
def _(spark, sf):
    return components(spark, sf)


@query("connected_components_tiled", f"with recursive {_COMP} select image_id, class, y, x, component from lb join cp using (image_id, class, code)")
def _(spark, sf):
    return components(spark, sf, tile=8)


@query("component_stats", f"""
    with recursive {_COMP}, st as (select image_id, class, component, count(*) as area, min(x) as x1, min(y) as y1, max(x) + 1 as x2, max(y) + 1 as y2 from lb join cp using (image_id, class, code) group by 1, 2, 3)
    select *, row_number() over (partition by image_id, class order by component) as number from st""")
def _(spark, sf):
    return R.component_stats(components(spark, sf))


def component_boxes(spark, sf):
    df = user_boxes(spark, sf)
    kinds = fixture(spark, sf, "fx_pixels").select("image_id", "class").distinct()
    return df.join(kinds, "image_id").select("image_id", "class", "ann_id", "box", "width", "height")


@query("match_boxes_to_components", f"""
    with recursive {_COMP}, {_UBOX}, kb as (select ub.*, k.class from ub join (select distinct image_id, class from fx_pixels) k using (image_id)),
    ov as (select kb.image_id, kb.class, ann_id, component, count(*) as n from kb join (select * from lb join cp using (image_id, class, code)) p on p.image_id = kb.image_id and p.class = kb.class
        and p.x >= greatest(0, trunc(kb.x)) and p.x < least(32, ceil(kb.x + w)) and p.y >= greatest(0, trunc(kb.y)) and p.y < least(32, ceil(kb.y + h)) group by 1, 2, 3, 4),
    sq as (select *, row_number() over (partition by image_id, class order by ann_id, n desc, component) as k from ov),
    walk as (select image_id, class, k, ann_id, component, n, true as hit, [ann_id] as bs, [component] as cs from sq where k = 1
      union all select s.image_id, s.class, s.k, s.ann_id, s.component, s.n, not list_contains(bs, s.ann_id) and not list_contains(cs, s.component),
        case when not list_contains(bs, s.ann_id) and not list_contains(cs, s.component) then list_append(bs, s.ann_id) else bs end,
        case when not list_contains(bs, s.ann_id) and not list_contains(cs, s.component) then list_append(cs, s.component) else cs end
      from walk w join sq s on s.image_id = w.image_id and s.class = w.class and s.k = w.k + 1)
    select kb.image_id, kb.class, kb.ann_id, component, n as overlap from kb left join (select * from walk where hit) b on b.image_id = kb.image_id and b.class = kb.class and b.ann_id = kb.ann_id""")
def _(spark, sf):
    return M.match_boxes_to_components(component_boxes(spark, sf), components(spark, sf))


@query("match_boxes_reuse", f"""
    with recursive {_COMP}, {_UBOX}, kb as (select ub.*, k.class from ub join (select distinct image_id, class from fx_pixels) k using (image_id)),
    ov as (select kb.image_id, kb.class, ann_id, component, count(*) as n from kb join (select * from lb join cp using (image_id, class, code)) p on p.image_id = kb.image_id and p.class = kb.class
        and p.x >= greatest(0, trunc(kb.x)) and p.x < least(32, ceil(kb.x + w)) and p.y >= greatest(0, trunc(kb.y)) and p.y < least(32, ceil(kb.y + h)) group by 1, 2, 3, 4),
    bs as (select *, row_number() over (partition by image_id, class, ann_id order by n desc, component) as r from ov)
    select kb.image_id, kb.class, kb.ann_id, component, n as overlap from kb left join (select * from bs where r = 1) b on b.image_id = kb.image_id and b.class = kb.class and b.ann_id = kb.ann_id""")
def _(spark, sf):
    return M.match_boxes_to_components(component_boxes(spark, sf), components(spark, sf), reuse=True)


_RUNS = """
    ix as (select image_id, x * 32 + y as i from fx_pixels where v > 90),
    rn as (select image_id, min(i) as s, max(i) + 1 as e from (select *, i - row_number() over (partition by image_id order by i) as g from ix) group by image_id, g),
    cn as (select image_id, s, s - coalesce(lag(e) over (partition by image_id order by s), 0) as z, e - s as o, e from rn),
    rl as (select image_id, concat(string_agg(concat(z, ',', o), ',' order by s), case when max(e) < 1024 then concat(',', 1024 - max(e)) else '' end) as counts from cn group by 1)"""


@query("rle_encode", f"with {_RUNS} select image_id, '32,32' as size, counts from rl")
def _(spark, sf):
    df = pixels(spark, sf)
    rle = R.rle_encode(df.where("v > 90"), frames(df), ["image_id"])
    text = lambda field: F.array_join(c(f"rle.{field}").cast("array<string>"), ",")
    return rle.select("image_id", text("size").alias("size"), text("counts").alias("counts"))


@query("rle_decode", "select image_id, y, x from fx_pixels where v > 90")
def _(spark, sf):
    df = pixels(spark, sf)
    return R.rle_decode(R.rle_encode(df.where("v > 90"), frames(df), ["image_id"]), ["image_id"])


_PAINTED = f"""
    with {_POLY}, bx as (select image_id, 1 as category_id, cast(r.range as int) as y, cast(s.range as int) as x from pts, range(60) r, range(64) s where image_id % 3 = 0
        and r.range >= floor(p[1][2]) and r.range < p[1][2] + 6 and s.range >= floor(p[1][1]) and s.range < p[1][1] + 6),
    cand as (select image_id, cast(r.range as int) as y, cast(s.range as int) as x from pts, range(60) r, range(64) s where image_id % 3 <> 0
      and r.range between p[1][2] and p[1][2] + 16 and s.range between p[1][1] - 4 and p[1][1] + 20),
    hit as (select image_id, y, x from cand join ed using (image_id) group by 1, 2, 3 having count(*) filter (where (a[2] > y) <> (b[2] > y) and x < (b[1] - a[1]) * (y - a[2]) / (b[2] - a[2]) + a[1]) % 2 = 1)
    select image_id // 20 as image_id, y, x, max(category_id) as category_id from (select image_id, y, x, 2 as category_id from hit union all select image_id, y, x, 1 from bx) group by 1, 2, 3"""


def painted_annotations(spark, sf):
    df = polygons(spark, sf)
    first = F.get(c("points"), 0)
    boxed = c("image_id") % 3 == 0
    return df.select(
        F.floor(c("image_id") / 20).alias("image_id"), c("image_id").alias("ann_id"), F.when(boxed, 1).otherwise(2).alias("category_id"),
        F.when(~boxed, F.array("points")).alias("polygons"), xywh(F.get(first, 0), F.get(first, 1), F.lit(6.0), F.lit(6.0)).alias("box"), "width", "height")


@query("paint_annotations", _PAINTED)
def _(spark, sf):
    return R.paint_annotations(painted_annotations(spark, sf))


@query("paint_runs", f"""
    with px as ({_PAINTED}), isles as (select *, x - row_number() over (partition by image_id, y, category_id order by x) as isle from px)
    select image_id, y, category_id, min(x) as x1, max(x) + 1 as x2 from isles group by image_id, y, category_id, isle""")
def _(spark, sf):
    return I.paint_annotation_runs(painted_annotations(spark, sf))


@query("near_far_regions", f"""
    with {_GRID} select gr.image_id, gr.y, gr.x, case when exists (select 1 from fx_pixels p where v > 200 and p.image_id = gr.image_id and abs(gr.y - p.y) <= 3 and abs(gr.x - p.x) <= 3) then 'near' else 'far' end as region from gr""")
def _(spark, sf):
    df = pixels(spark, sf)
    return R.near_far_regions(df.where("v > 200"), frames(df), 3)


@query("instance_targets", "select image_id, class, min(x) as x1, min(y) as y1, max(x) + 1 as x2, max(y) + 1 as y2, count(*) as area from fx_pixels group by 1, 2")
def _(spark, sf):
    return R.instance_targets(pixels(spark, sf), ["image_id", "class"])


# Colours: the palette entry picked by the cell, or an odd colour for every seventh event.
_COLORS = [(r << 16) | (g << 8) | b for _, r, g, b in PALETTE]
_COLOR_SQL = f"case when x % 7 = 3 then 1118481 + y when x % 5 = 0 then 0 else ([{', '.join(map(str, _COLORS))}])[y % 10 + 1] end"
_IDS = {0x00FF00: 1, 0xFF0000: 1, 0xFF6400: 1, 0xFFAF00: 1, 0xFF0064: 2}
_ID_SQL = "case color " + " ".join(f"when {k} then {v}" for k, v in _IDS.items()) + " else 0 end"


def colored(spark, sf):
    pick = F.get(F.array(*[F.lit(v) for v in _COLORS]), c("y") % 10)
    color = F.when(c("x") % 7 == 3, F.lit(1118481) + c("y")).when(c("x") % 5 == 0, 0).otherwise(pick)
    r, g, b = F.call_function("shiftright", color, F.lit(16)), F.call_function("shiftright", color, F.lit(8)) % 256, color % 256
    df = pixels(spark, sf).select(*SPOT, X.encode_rgb(r, g, b).alias("color"))
    return X.decode_palette(df, X.palette(spark, taxonomy_table(spark)))


@query("decode_palette", f"select *, {_ID_SQL} as category_id from (select image_id, y, x, cast({_COLOR_SQL} as int) as color from fx_pixels)")
def _(spark, sf):
    return colored(spark, sf)


@query("unknown_colors", f"""
    select lpad(to_hex(color), 6, '0') as color_hex, count(*) as pixels from (select cast({_COLOR_SQL} as int) as color from fx_pixels) where color <> 0 and {_ID_SQL} = 0 group by 1""")
def _(spark, sf):
    return X.unknown_colors(colored(spark, sf))
