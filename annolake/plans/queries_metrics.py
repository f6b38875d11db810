"""Queries over predictions, hashes, history and sampling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from annolake.functions.geometry import to_xyxy, xywh
from annolake.functions.labels import hex_hash
from annolake.operators import duplicates as D
from annolake.operators import matching as M
from annolake.operators import metrics as E
from annolake.operators import sampling as N
from annolake.operators import spans as I
from annolake.plans.fixtures import fixture
from annolake.plans.registry import query
from annolake.presets import IOU_THRESHOLDS
from annolake.session import stable

c = F.col
_ROW = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


# Confusion and class scores ----------------------------------------------------------------

# No row has truth N, no prediction is N: a class without support.
_FLAGS = """select t as truth, case when l_linenumber % 4 = 0 then 'R' when l_partkey % 5 = 0 then 'Z' else t end as pred
  from (select *, case l_returnflag when 'N' then 'A' else l_returnflag end as t from lineitem)"""
_CLASSES = ["A", "N", "R", "Z"]
_CM = f"""
    f as ({_FLAGS}), k(cls) as (values ('A'), ('N'), ('R'), ('Z')),
    s as (select cls, (select count(*) from f where truth = cls and pred = cls) as tp, (select count(*) from f where truth = cls) as support,
      (select count(*) from f where pred = cls) as predicted from k),
    r as (select *, case when predicted > 0 then tp / predicted else 0 end as p, case when support > 0 then tp / support else 0 end as r from s),
    z as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1, case when support + predicted - tp > 0 then tp / (support + predicted - tp) else 0 end as iou from r)"""


def flags(spark, sf):
    truth = F.when(c("l_returnflag") == "N", "A").otherwise(c("l_returnflag"))
    other = F.when(c("l_linenumber") % 4 == 0, "R").when(c("l_partkey") % 5 == 0, "Z").otherwise(truth)
    return fixture(spark, sf, "lineitem").select(truth.alias("truth"), other.alias("pred"))


@query("confusion_matrix", f"""
    with f as ({_FLAGS}), k(cls) as (values ('A'), ('N'), ('R'), ('Z'))
    select a.cls as truth, b.cls as pred, (select count(*) from f where truth = a.cls and pred = b.cls) as cell_count from k a, k b""")
def _(spark, sf):
    return E.confusion_matrix(flags(spark, sf), _CLASSES)


@query("per_class_scores", f"""
    with {_CM} select cls as class, support, predicted, tp, round(p, 6) as "precision", round(r, 6) as recall, round(f1, 6) as f1, round(iou, 6) as iou from z""")
def _(spark, sf):
    df = E.per_class_scores(flags(spark, sf), _CLASSES)
    return df.select("class", "support", "predicted", "tp", *[F.round(k, 6).alias(k) for k in ("precision", "recall", "f1", "iou")])


@query("classification_report", f"""
    with {_CM} select round(sum(tp) / sum(support), 6) as accuracy, round(avg(r), 6) as balanced_accuracy, round(avg(f1), 6) as macro_f1, cast(sum(support) as bigint) as samples from z""")
def _(spark, sf):
    df = E.classification_report(flags(spark, sf), _CLASSES)
    return df.select(*[F.round(k, 6).alias(k) for k in ("accuracy", "balanced_accuracy", "macro_f1")], "samples")


@query("binary_report", """
    with k(cls) as (values (0), (1)), s as (select cls, (select count(*) from fx_pred where truth = cls and pred = cls) as tp, (select count(*) from fx_pred where truth = cls) as sup,
      (select count(*) from fx_pred where pred = cls) as pr from k), r as (select *, tp / pr as p, tp / sup as r from s)
    select round(sum(tp) / sum(sup), 6) as accuracy, round(avg(r), 6) as balanced_accuracy, round(avg(2 * p * r / (p + r)), 6) as macro_f1, cast(sum(sup) as bigint) as samples from r""")
def _(spark, sf):
    df = E.classification_report(fixture(spark, sf, "fx_pred"), [0, 1])
    return df.select(*[F.round(k, 6).alias(k) for k in ("accuracy", "balanced_accuracy", "macro_f1")], "samples")


@query("semantic_iou", """
    with p as (select case when event_id % 11 = 0 then 255 else event_id % 3 end as truth, case when user_id % 4 = 0 then 0 else event_id % 3 end as pred from events),
    v as (select * from p where truth in (0, 1, 2)), k(cls) as (values (0), (1), (2)),
    s as (select cls, (select count(*) from v where truth = cls and pred = cls) as tp, (select count(*) from v where truth = cls) as sup, (select count(*) from v where pred = cls) as pr from k)
    select round(avg(tp / (sup + pr - tp)) filter (where cls > 0), 6) as mean_iou, round(sum(tp) / sum(sup), 6) as pixel_accuracy, cast(sum(sup) as bigint) as pixels from s""")
def _(spark, sf):
    kind = (c("event_id") % 3).cast("int")
    df = fixture(spark, sf, "events").select(
        F.when(c("event_id") % 11 == 0, 255).otherwise(kind).alias("truth"), F.when(c("user_id") % 4 == 0, 0).otherwise(kind).alias("pred"))
    return E.semantic_iou(df, [0, 1, 2]).select(F.round("mean_iou", 6).alias("mean_iou"), F.round("pixel_accuracy", 6).alias("pixel_accuracy"), "pixels")


_RING = """
    g as (select image_id, v > 20 as valid, class in ('click', 'error') as pred, v > 200 as target, y / 32.0::double as pd, x / 32.0::double as td,
      case when x < 16 then 'near' else 'far' end as region from fx_pixels)"""


def ring_pixels(spark, sf):
    return fixture(spark, sf, "fx_pixels").select(
        "image_id", (c("v") > 20).alias("valid"), c("class").isin("click", "error").alias("pred"), (c("v") > 200).alias("target"),
        (c("y") / 32.0).alias("pred_distance"), (c("x") / 32.0).alias("target_distance"), F.when(c("x") < 16, "near").otherwise("far").alias("region"))


@query("ring_scores", f"""
    with {_RING}, i as (select image_id, count(*) filter (where valid and pred and target) as h, count(*) filter (where valid and pred) + count(*) filter (where valid and target) as t,
      avg(abs(pd - td)) filter (where valid) as e from g group by 1)
    select round(avg(case when t > 0 then 2.0 * h / t else 0 end), 6) as boundary_dice, round(avg(e), 6) as distance_mae, count(*) as images from i""")
def _(spark, sf):
    df = E.ring_scores(ring_pixels(spark, sf))
    return df.select(F.round("boundary_dice", 6).alias("boundary_dice"), F.round("distance_mae", 6).alias("distance_mae"), "images")


@query("regional_ring_scores", f"""
    with {_RING}, i as (select region, image_id, count(*) filter (where valid and pred and target) as h, count(*) filter (where valid and pred) + count(*) filter (where valid and target) as t,
      count(*) filter (where valid and target) as tp, count(*) filter (where valid) as n, sum(abs(pd - td)) filter (where valid) as e from g group by 1, 2)
    select region, round(avg(2.0 * h / t) filter (where t > 0), 6) as boundary_dice_macro, round(2.0 * sum(h) / sum(t), 6) as boundary_dice_micro, round(sum(e) / sum(n), 6) as distance_mae,
      count(*) as evaluated_images, count(*) filter (where t > 0) as informative_images, cast(sum(n) as bigint) as valid_pixels, cast(sum(tp) as bigint) as target_boundary_pixels
    from i where n > 0 group by 1""")
def _(spark, sf):
    df = E.regional_ring_scores(ring_pixels(spark, sf))
    rounded = {k: F.round(k, 6) for k in ("boundary_dice_macro", "boundary_dice_micro", "distance_mae")}
    return df.withColumns(rounded)


# Detection ---------------------------------------------------------------------------------


def predictions(spark, sf):
    boxes = fixture(spark, sf, "fx_boxes").select("image_id", "class", "is_pred", "box_id", "x", "y", "w", "h", "score")
    # Staged: each side is read once or twice, and grouping the items again would shuffle all of them.
    df = stable(boxes).withColumn("box", to_xyxy(xywh(c("x"), c("y"), c("w"), c("h"))))
    preds = df.where("is_pred").select("image_id", "class", c("box_id").alias("pred_id"), "score", "box")
    return preds, df.where("not is_pred").select("image_id", "class", c("box_id").alias("gt_id"), "box")


_PAIRS = """
    j as (select p.image_id, p.class, p.box_id as pred_id, g.box_id as gt_id, p.score, greatest(0.0, least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x)) * greatest(0.0, least(p.y + p.h, g.y + g.h) - greatest(p.y, g.y)) as i,
        p.w * p.h + g.w * g.h as a from fx_boxes p join fx_boxes g on p.image_id = g.image_id and p.class = g.class and p.is_pred and not g.is_pred
        and p.x < g.x + g.w and g.x < p.x + p.w and p.y < g.y + g.h and g.y < p.y + p.h),
    pr as (select image_id, class, pred_id, gt_id, score, i / (a - i) as iou from j where i / (a - i) >= 0.5)"""


@query("iou_pairs", f"with {_PAIRS} select image_id, class, pred_id, gt_id, iou from pr")
def _(spark, sf):
    return M.iou_pairs(*predictions(spark, sf), 0.5).select("image_id", "class", "pred_id", "gt_id", "iou")


# The greedy rule step by step: pairs of a group in preference order, with the ids taken so far.
_GREEDY = f"""
    {_PAIRS}, sq as (select image_id, class, t, pred_id, gt_id, score, iou, row_number() over (partition by image_id, class, t order by score desc, pred_id, iou desc, gt_id) as n
      from pr, (select unnest([{', '.join(map(repr, IOU_THRESHOLDS))}])::double as t) where iou >= t),
    walk as (select image_id, class, t, n, pred_id, gt_id, score, iou, true as hit, [pred_id] as ps, [gt_id] as gs from sq where n = 1
      union all select s.image_id, s.class, s.t, s.n, s.pred_id, s.gt_id, s.score, s.iou, not list_contains(ps, s.pred_id) and not list_contains(gs, s.gt_id),
        case when not list_contains(ps, s.pred_id) and not list_contains(gs, s.gt_id) then list_append(ps, s.pred_id) else ps end,
        case when not list_contains(ps, s.pred_id) and not list_contains(gs, s.gt_id) then list_append(gs, s.gt_id) else gs end
      from walk w join sq s on s.image_id = w.image_id and s.class = w.class and s.t = w.t and s.n = w.n + 1)"""


@query("match_detections", f"with recursive {_GREEDY} select image_id, class, t as threshold, pred_id, gt_id, iou from walk where hit")
def match_detections(spark, sf):
    return M.match_detections(M.iou_pairs(*predictions(spark, sf), 0.5)).select("image_id", "class", "threshold", "pred_id", "gt_id", "iou")


@query("match_bounds", f"""
    with {_PAIRS} select class, count(distinct pred_id) as preds_in_reach, count(distinct gt_id) as gts_in_reach, 0 as repeated_preds, 0 as repeated_gts, 0 as blocked_pairs
    from pr group by 1""")
def _(spark, sf):
    """What any greedy match must satisfy: one-to-one, and no pair left with both sides free."""
    pairs = stable(M.iou_pairs(*predictions(spark, sf), 0.5))
    matches = stable(M.match_detections(pairs, [0.5]))
    repeated = lambda side: matches.groupBy("class", side).agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("class").agg(F.count(F.lit(1)).alias(f"r_{side}"))
    loose = (
        pairs.join(matches.select("class", "pred_id", F.lit(1).alias("mp")), ["class", "pred_id"], "left")
        .join(matches.select("class", "gt_id", F.lit(1).alias("mg")), ["class", "gt_id"], "left")
        .where("mp is null and mg is null").groupBy("class").agg(F.count(F.lit(1)).alias("loose")))
    base = pairs.groupBy("class").agg(F.count_distinct("pred_id").alias("preds_in_reach"), F.count_distinct("gt_id").alias("gts_in_reach"))
    joined = base.join(repeated("pred_id"), "class", "left").join(repeated("gt_id"), "class", "left").join(loose, "class", "left")
    zero = lambda name, alias: F.coalesce(name, F.lit(0)).cast("int").alias(alias)
    return joined.select("class", "preds_in_reach", "gts_in_reach", zero("r_pred_id", "repeated_preds"), zero("r_gt_id", "repeated_gts"), zero("loose", "blocked_pairs"))


def _report(walk: str, preds: str, truths: str) -> str:
    """CTEs that end in curve rows ``cu`` and (class, threshold) grid ``gr``, from greedy steps, predictions and truths."""
    return f"""
    pl as (select image_id, class, pred_id, row_number() over (partition by class order by score desc, pred_id) as seen from ({preds})),
    hc as (select class, t, seen, row_number() over (partition by class, t order by seen) as tp from {walk} w join pl using (image_id, class, pred_id) where hit),
    np as (select class, count(*) as npos from ({truths}) group by 1), gr as (select class, npos, unnest([{', '.join(map(repr, IOU_THRESHOLDS))}])::double as t from np),
    cu as (select hc.*, tp / seen as p, tp / npos as r from hc join np using (class)),
    lv as (select class, t, npos, (select coalesce(max(p), 0) from cu where cu.class = gr.class and cu.t = gr.t and r >= k * 0.01::double) as b from gr, range(101) q(k)),
    ap as (select class, t, npos, avg(b) as ap, (select coalesce(max(r), 0) from cu where cu.class = lv.class and cu.t = lv.t) as rec from lv group by 1, 2, 3)"""


_PER_CLASS = """class, max(npos) as support, round(avg(ap), 6) as ap50_95, round(max(ap) filter (where t = 0.5), 6) as ap50,
      round(max(rec) filter (where t = 0.5), 6) as recall50 from ap group by class"""
_BOX_REPORT = _report("walk", "select image_id, class, box_id as pred_id, score from fx_boxes where is_pred", "select class from fx_boxes where not is_pred")


@query("detection_report", f"with recursive {_GREEDY}, {_BOX_REPORT} select 'box' as kind, {_PER_CLASS}")
def detection_report(spark, sf):
    preds, gts = predictions(spark, sf)
    df = E.detection_report(preds, gts, M.iou_pairs(preds, gts, 0.5))
    return df.select("kind", "class", "support", *[F.round(k, 6).alias(k) for k in ("ap50_95", "ap50", "recall50")])


@query("detection_means", f"""
    with recursive {_GREEDY}, {_BOX_REPORT}, ev as (select class, t, max(p) over (partition by class, t order by tp desc rows unbounded preceding) as e from cu),
    ar as (select class, t, npos, coalesce((select sum(e) from ev where ev.class = gr.class and ev.t = gr.t), 0) / npos as ap,
      coalesce((select max(r) from cu where cu.class = gr.class and cu.t = gr.t), 0) as rec from gr)
    select round(avg(ap), 6) as map50_95, round(avg(ap) filter (where t = 0.5), 6) as map50, round(avg(rec) filter (where t = 0.5), 6) as macro_recall50 from ar""")
def _(spark, sf):
    preds, gts = predictions(spark, sf)
    df = E.detection_means(E.detection_report(preds, gts, M.iou_pairs(preds, gts, 0.5), area=True))
    return df.select(*[F.round(k, 6).alias(k) for k in ("map50_95", "map50", "macro_recall50")])


# Precision-recall of a record table: a hit is a truth of class A with an even part key.
_CURVE = f"""
    rec as (select l_returnflag as class, box_id as pred_id, l_extendedprice as score, case when l_partkey % 3 = 0 then 1 else 0 end as tp
      from (select *, concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string)) as box_id from lineitem)),
    np as (select class, sum(tp) + 10 as npos from rec group by 1),
    cur as (select rec.class, pred_id, tp, row_number() over w as seen, sum(tp) over (partition by rec.class order by score desc, pred_id rows unbounded preceding) as tpr, npos
      from rec join np on rec.class = np.class window w as (partition by rec.class order by score desc, pred_id)),
    pr as (select *, tpr / seen as p, tpr / npos as r from cur)"""


def pr_records(spark, sf):
    df = fixture(spark, sf, "lineitem").select(
        c("l_returnflag").alias("class"), F.concat_ws("-", *[c(k).cast("string") for k in _ROW.split(", ")]).alias("pred_id"),
        c("l_extendedprice").alias("score"), F.when(c("l_partkey") % 3 == 0, 1).otherwise(0).alias("tp"))
    return df, df.groupBy("class").agg((F.sum("tp") + 10).alias("npos"))


@query("cumulative_pr", f"""
    with {_CURVE} select class, pred_id, cast(tpr as bigint) as tp_run, cast(seen - tpr as bigint) as fp_run, round(p, 6) as "precision", round(r, 6) as recall from pr""")
def _(spark, sf):
    df = E.cumulative_pr(*pr_records(spark, sf), ["class"])
    return df.select("class", "pred_id", "tp_run", "fp_run", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("average_precision_101", f"""
    with {_CURVE}, l as (select class, k, (select coalesce(max(p), 0) from pr where pr.class = np.class and r >= k * 0.01::double) as b from np, range(101) t(k))
    select class, round(avg(b), 6) as ap from l group by 1""")
def _(spark, sf):
    records, npos = pr_records(spark, sf)
    return E.average_precision_101(E.cumulative_pr(records, npos, ["class"]), npos, ["class"]).select("class", F.round("ap", 6).alias("ap"))


@query("average_precision_area", f"""
    with {_CURVE}, e as (select class, npos, max(p) over (partition by class order by tpr desc rows unbounded preceding) as env from pr where tp = 1)
    select class, round(sum(env) / min(npos), 6) as ap from e group by 1""")
def _(spark, sf):
    records, npos = pr_records(spark, sf)
    return E.average_precision_area(E.cumulative_pr(records, npos, ["class"]), npos, ["class"]).select("class", F.round("ap", 6).alias("ap"))


# Masks of one user's events: prediction and truth are two overlapping selections of cells.
def mask_rows(spark, sf):
    df = fixture(spark, sf, "fx_pixels")
    preds = df.where("v < 300").select("image_id", F.lit("a").alias("class"), c("class").alias("pred_id"), "y", "x")
    gts = df.where("v > 60").select("image_id", F.lit("a").alias("class"), F.concat(F.lit("g"), (c("x") % 3).cast("string")).alias("gt_id"), "y", "x")
    return preds, gts


_MASKS = """
    pm as (select image_id, class as pred_id, y, x from fx_pixels where v < 300), gm as (select image_id, concat('g', cast(x % 3 as string)) as gt_id, y, x from fx_pixels where v > 60),
    it as (select image_id, pred_id, gt_id, count(*) as n from pm join gm using (image_id, y, x) group by 1, 2, 3),
    mp as (select image_id, pred_id, gt_id, n / (pa + ga - n) as iou, 2.0 * n / (pa + ga) as dice from it join (select image_id, pred_id, count(*) as pa from pm group by 1, 2) using (image_id, pred_id)
      join (select image_id, gt_id, count(*) as ga from gm group by 1, 2) using (image_id, gt_id))"""


@query("mask_pairs", f"with {_MASKS} select image_id, pred_id, gt_id, round(iou, 6) as iou, round(dice, 6) as dice from mp")
def _(spark, sf):
    return E.mask_pairs(*mask_rows(spark, sf)).select("image_id", "pred_id", "gt_id", F.round("iou", 6).alias("iou"), F.round("dice", 6).alias("dice"))


@query("mask_pairs_runs", f"with {_MASKS} select image_id, pred_id, gt_id, round(iou, 6) as iou, round(dice, 6) as dice from mp")
def _(spark, sf):
    preds, gts = mask_rows(spark, sf)
    pairs = I.mask_pairs_runs(I.pixel_runs(preds, ["image_id", "class", "pred_id"]), I.pixel_runs(gts, ["image_id", "class", "gt_id"]))
    return pairs.select("image_id", "pred_id", "gt_id", F.round("iou", 6).alias("iou"), F.round("dice", 6).alias("dice"))


@query("mask_quality", f"""
    with {_MASKS}, b as (select image_id, gt_id, iou, dice, row_number() over (partition by image_id, gt_id order by iou desc, length(pred_id) desc, pred_id desc) as r from mp where length(pred_id) / 10.0 >= 0.5),
    g as (select distinct image_id, gt_id from gm)
    select 'a' as class, count(*) as support, round(avg(coalesce(iou, 0)), 6) as gt_best_mask_iou, round(avg(coalesce(dice, 0)), 6) as gt_best_mask_dice
    from g left join (select * from b where r = 1) using (image_id, gt_id)""")
def _(spark, sf):
    pred_pixels, gt_pixels = mask_rows(spark, sf)
    preds = pred_pixels.select("image_id", "class", "pred_id").distinct().withColumn("score", F.length("pred_id") / 10.0)
    gts = gt_pixels.select("image_id", "class", "gt_id").distinct()
    df = E.mask_quality(E.mask_pairs(pred_pixels, gt_pixels), preds, gts, 0.5)
    return df.select("class", "support", F.round("gt_best_mask_iou", 6).alias("gt_best_mask_iou"), F.round("gt_best_mask_dice", 6).alias("gt_best_mask_dice"))


def mask_sides(pred_pixels, gt_pixels):
    preds = pred_pixels.select("image_id", "class", "pred_id").distinct().withColumn("score", F.length("pred_id") / 10.0)
    return preds, gt_pixels.select("image_id", "class", "gt_id").distinct()


@query("mask_quality_means", f"""
    with {_MASKS}, b as (select image_id, gt_id, iou, dice, row_number() over (partition by image_id, gt_id order by iou desc, length(pred_id) desc, pred_id desc) as r from mp where length(pred_id) / 10.0 >= 0.5),
    g as (select distinct image_id, gt_id from gm), k as (select gt_id = 'g0' as class, avg(coalesce(iou, 0)) as i, avg(coalesce(dice, 0)) as d
      from g left join (select * from b where r = 1) using (image_id, gt_id) group by 1)
    select round(avg(i), 6) as gt_best_mask_iou, round(avg(d), 6) as gt_best_mask_dice from k""")
def _(spark, sf):
    """Truth g0 is a class of its own here; every prediction is offered to both classes."""
    pred_pixels, gt_pixels = mask_rows(spark, sf)
    gt_pixels = gt_pixels.withColumn("class", F.when(c("gt_id") == "g0", "b").otherwise("a"))
    pred_pixels = pred_pixels.withColumn("class", F.explode(F.array(F.lit("a"), F.lit("b"))))
    preds, gts = mask_sides(pred_pixels, gt_pixels)
    df = E.mask_quality_means(E.mask_quality(E.mask_pairs(pred_pixels, gt_pixels), preds, gts, 0.5))
    return df.select(*[F.round(k, 6).alias(k) for k in df.columns])


_MASK_GREEDY = f"""
    {_MASKS}, sq as (select image_id, 'a' as class, t, pred_id, gt_id, row_number() over (partition by image_id, t order by length(pred_id) desc, pred_id, iou desc, gt_id) as n
      from mp, (select unnest([{', '.join(map(repr, IOU_THRESHOLDS))}])::double as t) where iou >= t),
    walk as (select image_id, class, t, n, pred_id, gt_id, true as hit, [pred_id] as ps, [gt_id] as gs from sq where n = 1
      union all select s.image_id, s.class, s.t, s.n, s.pred_id, s.gt_id, not list_contains(ps, s.pred_id) and not list_contains(gs, s.gt_id),
        case when not list_contains(ps, s.pred_id) and not list_contains(gs, s.gt_id) then list_append(ps, s.pred_id) else ps end,
        case when not list_contains(ps, s.pred_id) and not list_contains(gs, s.gt_id) then list_append(gs, s.gt_id) else gs end
      from walk w join sq s on s.image_id = w.image_id and s.t = w.t and s.n = w.n + 1)"""
_MASK_REPORT = _report("walk", "select distinct image_id, 'a' as class, pred_id, length(pred_id) as score from pm", "select distinct image_id, 'a' as class, gt_id from gm")


@query("detection_report_mask", f"with recursive {_MASK_GREEDY}, {_MASK_REPORT} select 'mask' as kind, {_PER_CLASS}")
def _(spark, sf):
    pixels = mask_rows(spark, sf)
    df = E.detection_report(*mask_sides(*pixels), E.mask_pairs(*pixels), kind="mask")
    return df.select("kind", "class", "support", *[F.round(k, 6).alias(k) for k in ("ap50_95", "ap50", "recall50")])


@query("weighted_score", """
    select run, epoch, round(score * case metric when 'click' then 1.0 when 'error' then 0.5 else 0 end, 6) as score from fx_history""")
def _(spark, sf):
    df = fixture(spark, sf, "fx_history").withColumnRenamed("score", "value")
    out = E.weighted_score(df, {"click": 1.0, "error": 0.5}, ["run", "epoch"], known=["click", "error", "view"])
    return out.select("run", "epoch", F.round("score", 6).alias("score"))


@query("best_epoch", """
    select run, epoch, score from (select *, row_number() over (partition by run order by score desc, epoch desc) as r from fx_history) where r = 1""")
def _(spark, sf):
    return E.best_epoch(fixture(spark, sf, "fx_history"), ["run"])


# Hashes ------------------------------------------------------------------------------------

_HASH = """
    h as (select *, xor(('0x' || substr(sha256(cast(o_custkey as varchar)), 1, 15))::bigint, 1::bigint << cast(o_orderkey % 60 as int)) as phash from fx_hash)"""


def hashed(spark, sf):
    base = F.conv(F.substring(F.sha2(c("o_custkey").cast("string"), 256), 1, 15), 16, 10).cast("long")
    return fixture(spark, sf, "fx_hash").withColumn(
        "phash", base.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (c("o_orderkey") % 60).cast("int"))))


@query("hash_hex", f"with {_HASH} select sample_id, lpad(lower(to_hex(phash)), 16, '0') as phash_hex from h")
def _(spark, sf):
    return hashed(spark, sf).select("sample_id", hex_hash(c("phash")).alias("phash_hex"))


@query("near_duplicates", f"""
    with {_HASH} select a.sample_id as left_sample_id, b.sample_id as right_sample_id, a.split as left_split, b.split as right_split, a.group_id as left_group_id, b.group_id as right_group_id,
      a.image_path as left_path, b.image_path as right_path, cast(bit_count(xor(a.phash, b.phash)) as int) as hamming_distance
    from h a join h b on a.sample_id < b.sample_id and a.split <> b.split and bit_count(xor(a.phash, b.phash)) <= 4""")
def near_duplicates(spark, sf):
    df = D.near_duplicates(hashed(spark, sf), 4)
    return df.withColumnsRenamed({"left_image_path": "left_path", "right_image_path": "right_path"})


@query("duplicate_summary", f"""
    with {_HASH}, p as (select a.phash = b.phash as same from h a join h b on a.sample_id < b.sample_id and a.split <> b.split and bit_count(xor(a.phash, b.phash)) <= 4)
    select (select count(*) from h) as images_hashed, count(*) as cross_split_candidates, count(*) filter (where same) as exact_hash_candidates from p""")
def _(spark, sf):
    return D.duplicate_summary(hashed(spark, sf), 4)


@query("resolve_hash", f"""
    with {_HASH} select sample_id, case when sample_id % 3 = 0 then phash when sample_id % 5 = 0 then phash + 1 when sample_id % 7 = 0 then phash + 2 end as phash,
      case when sample_id % 3 = 0 then 'precomputed' when sample_id % 5 = 0 or sample_id % 7 = 0 then 'local_cache' else 'computed' end as hash_source from h""")
def _(spark, sf):
    df = hashed(spark, sf)
    given = df.where("sample_id % 3 = 0").select("sample_id", "phash")
    by_path = df.where("sample_id % 5 = 0").select((c("sample_id") + 10_000_000).alias("sample_id"), "image_path", (c("phash") + 1).alias("phash"))
    by_sample = df.where("sample_id % 7 = 0").select("sample_id", F.lit("elsewhere").alias("image_path"), (c("phash") + 2).alias("phash"))
    out = D.resolve_hash(df.drop("phash"), given, by_path.unionByName(by_sample))
    return out.select("sample_id", "phash", "hash_source")


def _basis_sql(side: int) -> str:
    rows = [[math.sqrt((1.0 if u == 0 else 2.0) / side) * math.cos(math.pi * (2 * i + 1) * u / (2 * side)) for i in range(side)] for u in range(8)]
    return "[" + ", ".join("[" + ", ".join(repr(v) + "::double" for v in row) + "]" for row in rows) + "]"


@query("perceptual_hash", f"""
    with b as (select {_basis_sql(8)} as m), e as (select vec_id, u, v, (select sum(embedding[y * 8 + x + 1]::double * m[v + 1][x + 1] * m[u + 1][y + 1]) from range(8) t(y), range(8) s(x)) as k
      from embeddings, b, range(8) p(u), range(8) q(v)),
    d as (select vec_id, median(k) filter (where u + v > 0) as mid from e group by 1)
    select e.vec_id, string_agg(case when k > mid then '1' else '0' end, '' order by u, v) as bits from e join d using (vec_id) group by 1""")
def _(spark, sf):
    gray = F.transform("embedding", lambda e: e.cast("double"))
    df = fixture(spark, sf, "embeddings").select("vec_id", D.perceptual_hash(gray, 8).alias("h"))
    return df.select("vec_id", F.lpad(F.bin("h"), 64, "0").alias("bits"))


@query("gray_grid", """
    with p as (select user_id as image_id, cast(floor((event_id % 1024) / 32) as int) as y, cast(event_id % 32 as int) as x, max(event_id % 256) as b, max(event_id % 199) as g, max(event_id % 101) as r from events group by 1, 2, 3),
    s as (select cast(round_even(i * 31 / 7.0, 0) as int) as at, i from range(8) t(i))
    select image_id, count(*) as cells, round(sum(cast(b * 0.114::double + g * 0.587::double + r * 0.299::double as float)::double * (v.i * 8 + u.i + 1)), 2) as weighted
    from p join s u on u.at = x join s v on v.at = y group by 1""")
def _(spark, sf):
    pixels = fixture(spark, sf, "events").groupBy(
        c("user_id").alias("image_id"), F.floor((c("event_id") % 1024) / 32).cast("int").alias("y"), (c("event_id") % 32).cast("int").alias("x")
    ).agg(F.max(c("event_id") % 256).alias("b"), F.max(c("event_id") % 199).alias("g"), F.max(c("event_id") % 101).alias("r"))
    sizes = pixels.select("image_id").distinct().select("image_id", F.lit(32).alias("width"), F.lit(32).alias("height"))
    cells = D.gray_cells(pixels, sizes, 8)
    return cells.groupBy("image_id").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum(c("v").cast("double") * (c("i") + 1)), 2).alias("weighted"))


# A whole 32 x 32 grey picture from every vector; the same arithmetic in both engines.
_SHADE = "(abs(cast(floor(embedding[{at}] * 1000) as bigint)) * (y + 3) + x * x * 17 + y * 29) % 256"


@query("perceptual_hash_32", f"""
    with basis as (select u, i, sqrt(case when u = 0 then 1.0 else 2.0 end / 32.0) * cos(pi() * (2 * i + 1) * u / 64.0) as w from range(8) t(u), range(32) r(i)),
    px as (select vec_id, y, x, {_SHADE.format(at='(y * 32 + x) % 64 + 1')} as v from embeddings, range(32) a(y), range(32) b(x)),
    gr as (select vec_id, y, x, cast(v * 0.114::double + v * 0.587::double + v * 0.299::double as float)::double as g from px),
    half as (select vec_id, y, u as v, sum(g * w) as k from gr join basis on i = x group by 1, 2, 3),
    e as (select vec_id, u, v, sum(k * w) as k from half join basis on i = y group by 1, 2, 3),
    d as (select vec_id, median(k) filter (where u + v > 0) as mid from e group by 1)
    select e.vec_id, string_agg(case when k > mid then '1' else '0' end, '' order by u, v) as bits from e join d using (vec_id) group by 1""")
def _(spark, sf):
    """From pixels to the 32 x 32 grid (P13) and its hash."""
    cells = fixture(spark, sf, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("y")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("x"))
    shade = F.expr(_SHADE.format(at="(y * 32 + x) % 64"))
    pixels = cells.select(c("vec_id").alias("image_id"), "y", "x", *[shade.alias(k) for k in "bgr"])
    sizes = pixels.select("image_id").distinct().select("image_id", F.lit(32).alias("width"), F.lit(32).alias("height"))
    grids = D.gray_grid(pixels, sizes, 32)
    return grids.select(c("image_id").alias("vec_id"), F.lpad(F.bin(D.perceptual_hash(c("gray"), 32)), 64, "0").alias("bits"))


# Sampling ----------------------------------------------------------------------------------


@query("inverse_frequency_weights", """
    select doc_id, truth, 1.0::double / count(*) over (partition by truth) as weight from fx_pred""")
def _(spark, sf):
    return N.inverse_frequency_weights(fixture(spark, sf, "fx_pred"), "truth").select("doc_id", "truth", "weight")


@query("multilabel_weights", """
    with l as (select image_id, category_id as label from fx_annotations), n as (select label, 1.0::double / count(*) as w from l group by 1),
    b as (select image_id, max(w) as w from l join n using (label) group by 1), e as (select count(*) as k from fx_images where id not in (select image_id from l))
    select id as sample_id, coalesce(w, 0.25::double / greatest(1, k)) as weight from fx_images left join b on image_id = id, e""")
def _(spark, sf):
    labels = fixture(spark, sf, "fx_annotations").select(c("image_id").alias("sample_id"), c("category_id").alias("label"))
    return N.multilabel_weights(fixture(spark, sf, "fx_images").select(c("id").alias("sample_id")), labels)


@query("positive_fraction_weights", """
    select doc_id, case when truth = 1 then 0.3::double / count(*) filter (where truth = 1) over () else 0.7::double / count(*) filter (where truth <> 1) over () end as weight from fx_pred""")
def _(spark, sf):
    return N.positive_fraction_weights(fixture(spark, sf, "fx_pred"), c("truth") == 1, 0.3).select("doc_id", "weight")


@query("weighted_sample", """
    with w as (select o_orderkey, cast(round(o_totalprice * (o_orderkey % 3) * 1000000) as bigint) as u from orders),
    e as (select o_orderkey, u, cast(sum(u) over (order by o_orderkey rows unbounded preceding) as bigint) as e from w where u > 0),
    d as (select range as draw, ('0x' || substr(sha256('11:' || range), 1, 15))::bigint % (select max(e) from e) as p from range((select count(*) from orders)))
    select draw, o_orderkey from d asof join (select o_orderkey, e - u as b from e) on p >= b""")
def _(spark, sf):
    df = fixture(spark, sf, "orders").select("o_orderkey", (c("o_totalprice") * (c("o_orderkey") % 3)).alias("weight"))
    return N.weighted_sample(df, df.count(), 11, "o_orderkey").select("draw", "o_orderkey")


@query("weighted_sample_contract", """
    select count(*) as draws, 0 as weightless from events""")
def _(spark, sf):
    """As many draws as events, none of a row without weight."""
    df = fixture(spark, sf, "orders").select("o_orderkey", (c("o_totalprice") * (c("o_orderkey") % 3)).alias("weight"))
    drawn = N.weighted_sample(df, fixture(spark, sf, "events").count(), 5, "o_orderkey")
    return drawn.agg(F.count(F.lit(1)).alias("draws"), F.count_if(c("o_orderkey") % 3 == 0).cast("int").alias("weightless"))


_MIX = {"ring": 2, "defect": 1, "bridge": 1}


@query("mix_tasks", """
    with s(pos, task, turn, share) as (values (0, 'ring', 0, 2), (1, 'defect', 0, 1), (2, 'bridge', 0, 1), (3, 'ring', 1, 2)),
    t as (select c_custkey as id, 'ring' as task from customer union all select s_suppkey, 'defect' from supplier union all select p_partkey, 'bridge' from part),
    n as (select *, row_number() over (partition by task order by id) - 1 as r, count(*) over (partition by task) as k from t),
    e as (select event_id as step, s.task, (event_id // 4) * share + turn as u from events join s on pos = event_id % 4)
    select step, e.task, id from e join n on n.task = e.task and n.r = e.u % n.k""")
def _(spark, sf):
    frames = {
        "ring": fixture(spark, sf, "customer").select(c("c_custkey").alias("id")), "defect": fixture(spark, sf, "supplier").select(c("s_suppkey").alias("id")),
        "bridge": fixture(spark, sf, "part").select(c("p_partkey").alias("id"))}
    return N.mix_tasks(frames, _MIX, fixture(spark, sf, "events").count(), "id").select("step", "task", "id")


@query("class_index", "select p_type, cast(row_number() over (order by p_type) - 1 as int) as class_index from (select distinct p_type from part)")
def _(spark, sf):
    return N.class_index(fixture(spark, sf, "part"), "p_type")


@query("build_task_tables", """
    with t as (select * from fx_catalog where split = 'train'), ri as (select sample_id from fx_catalog where has_ring and image_width % 9 <> 0),
    im as (select sample_id from fx_images where ignored_instance_count = 0), sel as (
      select sample_id, 'ring' as mode from t where has_ring and sample_id in (select sample_id from ri)
      union all select sample_id, 'defect' from t where defect_label_state <> 'missing' and sample_id in (select sample_id from im)
      union all select sample_id, 'bridge' from t where dataset_role = 'bridge' and defect_label_state <> 'missing' and sample_id in (select sample_id from im) and sample_id in (select sample_id from ri)
      union all select concat('crop/', sample_id), 'classification' from fx_images where split = 'train')
    select mode, sample_id from sel""")
def _(spark, sf):
    catalog = fixture(spark, sf, "fx_catalog")
    ring = catalog.where("has_ring").select("sample_id", F.when(c("image_width") % 9 != 0, "ok").otherwise("error").alias("status"))
    images = fixture(spark, sf, "fx_images")
    crops = images.select(F.concat(F.lit("crop/"), "sample_id").alias("crop_path"), c("file_name").alias("source_image"), "split", "group_id", F.lit("knot").alias("category"))
    flagged = images.withColumn("ignore_bboxes", F.when(c("ignored_instance_count") > 0, F.array(F.lit(1))))
    return N.build_task_tables(catalog, "train", ring, flagged, crops).select("mode", "sample_id")
