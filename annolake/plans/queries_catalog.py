"""Queries over catalogs: keys, labels, splits, audits, set operations, provenance."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from annolake.functions import labels as L
from annolake.operators import catalog as C
from annolake.operators import order as O
from annolake.operators import profile as P
from annolake.operators import provenance as V
from annolake.operators import splits as S
from annolake.operators import taxonomy as X
from annolake.operators.integrity import quality_report
from annolake.plans.fixtures import fixture
from annolake.plans.registry import query
from annolake.session import literal_table
from annolake.sinks.tables import group_splits, mask_contract, report_table

RATIOS = {"train": 0.7, "val": 0.15, "test": 0.15}


def _allocation(group_sql: str, seed: str, ratios: dict[str, float], by: str = "") -> str:
    """Oracle text of the group allocation: CTEs ending in ``alloc``."""
    names = list(ratios)
    part = f"partition by {by}" if by else ""
    lead = f"{by}, " if by else ""
    exact = ", ".join(f"n * {ratios[k]!r}::double as e_{i}" for i, k in enumerate(names))
    floors = " + ".join(f"floor(e_{i})" for i in range(len(names)))
    places = []
    for i, name in enumerate(names):
        terms = []
        for j, other in enumerate(names):
            if i != j:
                tie = ">=" if other < name else ">"
                terms.append(f"case when e_{j} - floor(e_{j}) {tie} e_{i} - floor(e_{i}) then 1 else 0 end")
        places.append(
            f"floor(e_{i}) + case when 1 + {' + '.join(terms)} <= n - ({floors}) then 1 else 0 end as c_{i}"
        )
    cases = " ".join(
        f"when rk <= {' + '.join(f'c_{j}' for j in range(i + 1))} then '{name}'" for i, name in enumerate(names)
    )
    return f"""
      grp as (select distinct {lead} group_id from ({group_sql}) s0),
      rnk as (select *, row_number() over ({part} order by sha256({seed} || ':' || group_id), group_id) as rk,
                     count(*) over ({part}) as n from grp),
      exa as (select *, {exact} from rnk),
      siz as (select *, {', '.join(places)} from exa),
      alloc as (select {lead} group_id, case {cases} end as split from siz)"""


@query("derive_keys", """
    select c_custkey, case when regexp_extract(c_name, '^Customer#0*([0-9]*)[02468]$', 1) = '' then c_name
        else regexp_extract(c_name, '^Customer#0*([0-9]*)[02468]$', 1) end as tree_id,
      regexp_replace(c_name, '(?:1|C)$', '') as physical_id, concat_ws(':', c_mktsegment, c_name) as sample_id
    from customer""")
def _(spark, sf):
    df, name = fixture(spark, sf, "customer"), F.col("c_name")
    return df.select(
        "c_custkey", L.derive_key(name, r"^Customer#0*([0-9]*)[02468]$").alias("tree_id"),
        L.strip_suffix(name, "1|C").alias("physical_id"), L.qualified(F.col("c_mktsegment"), name).alias("sample_id"),
    )


@query("variant_key", """
    with v as (select o_orderkey, case when o_orderkey % 2 = 0 then 'DirectionChange' else 'Blur' end as variant,
      case when o_orderkey % 2 = 0 then cast(o_orderkey + 1 as string)
           else concat(cast(o_orderkey as string), case when o_custkey % 3 = 0 then '' else concat('_', lower(o_orderstatus)) end) end as name
      from orders)
    select o_orderkey, case when variant = 'DirectionChange' then lpad(cast((o_orderkey // 8) + 1 as string), 6, '0')
             else lpad(split_part(name, '_', 1), 6, '0') end as base_id,
           case when variant = 'DirectionChange' then concat('direction_', cast(o_orderkey % 8 as string))
             when strpos(name, '_') = 0 then 'original' else split_part(name, '_', 2) end as transform
    from v""")
def _(spark, sf):
    odd = F.col("o_orderkey") % 2 == 1
    tail = F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("_"), F.lower("o_orderstatus")))
    df = fixture(spark, sf, "orders").select(
        "o_orderkey", F.when(odd, "Blur").otherwise("DirectionChange").alias("variant"),
        F.when(odd, F.concat(F.col("o_orderkey").cast("string"), tail)).otherwise((F.col("o_orderkey") + 1).cast("string")).alias("name"),
    )
    return df.select("o_orderkey", L.variant_key(F.col("variant"), F.col("name")).alias("k")).select("o_orderkey", "k.*")


@query("label_state", """
    select sample_id, case when o = 0 then 'missing' when defect_instance_count > 0 then 'positive'
      when ignored_defect_instance_count > 0 then 'ignore_only' else 'verified_negative' end as state
    from (select *, case when has_defect_box or defect_instance_count > 0 then 1 else 0 end as o from fx_catalog)""")
def _(spark, sf):
    df = fixture(spark, sf, "fx_catalog")
    annotated = F.col("has_defect_box") | (F.col("defect_instance_count") > 0)
    return df.select("sample_id", L.label_state(
        F.col("defect_instance_count"), F.col("ignored_defect_instance_count"), annotated).alias("state"))


@query("select_samples", """
    select sample_id, dataset_id, split from fx_catalog
    where dataset_id in ('1-URGENT', '5-LOW') and split in ('train', 'val') and dataset_role in ('bridge')""")
def _(spark, sf):
    df = L.select_samples(fixture(spark, sf, "fx_catalog"), {"1-URGENT", "5-LOW"}, {"train", "val"}, {"bridge"})
    return df.select("sample_id", "dataset_id", "split")


@query("safe_name", "select page_id, regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g') as name from pages")
def _(spark, sf):
    return fixture(spark, sf, "pages").select("page_id", L.safe_name(F.col("url")).alias("name"))


@query("parse_pipe_label", """
    with f as (select *, list_transform(string_split(label, '|'), lambda p: trim(p)) as p from fx_labels),
    ok as (select *, len(p) = 6 and p[1] in ('knot','crack','discoloration','resin','other') and p[2] <> '' and p[3] <> ''
      and p[4] in ('clear','partial') and p[5] in ('0','1') and p[6] in ('0','1') as good from f)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when good then p[1] end as category, case when good then p[2] end as subtype,
      case when good then p[3] end as instance_id, case when good then p[4] end as visibility,
      case when good then p[5] = '1' end as truncated, case when good then p[6] = '1' end as affects_rings from ok""")
def _(spark, sf):
    df = fixture(spark, sf, "fx_labels").withColumn("p", L.parse_pipe_label(F.col("label")))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p.*")


@query("resolve_reference", """
    select page_id, case when page_id % 5 = 0 then null else url end as file from pages""")
def _(spark, sf):
    df = fixture(spark, sf, "pages")
    ref = (F.when(F.col("page_id") % 5 == 0, "").when(F.col("page_id") % 3 == 0, F.concat(F.lit("zip://"), "url", F.lit("::a/b.png")))
           .otherwise(F.col("url")))
    return df.select("page_id", L.resolve_reference(ref).alias("file"))


@query("split_attributes", """
    select p_partkey, array_to_string(list_filter(list_transform(string_split(concat(p_brand, '; ;', p_type, ' ;'), ';'),
      lambda p: trim(p)), lambda p: p <> ''), '|') as attributes from part""")
def _(spark, sf):
    text = F.concat("p_brand", F.lit("; ;"), "p_type", F.lit(" ;"))
    return fixture(spark, sf, "part").select("p_partkey", F.array_join(L.split_attributes(text), "|").alias("attributes"))


@query("attribute_flags", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(';', case when l_partkey % 2 = 1 then 'truncated' end,
      case when l_linestatus <> 'F' then 'visibility_partial' end, case when l_suppkey % 2 = 1 then 'affects_rings' end) as flags
    from lineitem where l_returnflag in ('A', 'R')""")
def _(spark, sf):
    df = fixture(spark, sf, "fx_labels").withColumn("p", L.parse_pipe_label(F.col("label"))).where("p is not null")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.array_join(L.attribute_flags(F.col("p")), ";").alias("flags"))


@query("distinct_join", """
    select l_orderkey, string_agg(v, ';' order by v) as categories from (
      select distinct l_orderkey, case l_returnflag when 'A' then 'knot' else 'crack' end as v from lineitem where l_returnflag in ('A', 'R')
    ) group by 1""")
def _(spark, sf):
    df = fixture(spark, sf, "fx_labels").withColumn("p", L.parse_pipe_label(F.col("label")))
    return P.distinct_join(df, ["l_orderkey"], F.col("p.category"), "categories")


# Splits ------------------------------------------------------------------------------------


@query("allocate_groups", f"""
    with {_allocation("select group_id from fx_groups", "'42'", RATIOS)} select group_id, split from alloc""")
def _(spark, sf):
    return S.allocate_groups(fixture(spark, sf, "fx_groups"), RATIOS, 42)


@query("allocate_groups_by_dataset", f"""
    with {_allocation("select dataset_id, group_id from fx_groups", "cast(1042 + length(dataset_id) as string)", RATIOS, "dataset_id")}
    select dataset_id, group_id, split from alloc""")
def _(spark, sf):
    return S.allocate_groups(fixture(spark, sf, "fx_groups"), RATIOS, F.lit(1042) + F.length("dataset_id"), by=["dataset_id"])


FOLDS = {str(i): 1.0 / 5 for i in range(5)}


@query("assign_folds", f"""
    with {_allocation("select group_id from fx_groups", "'411'", FOLDS)} select group_id, split as fold from alloc""")
def _(spark, sf):
    return S.assign_folds(fixture(spark, sf, "fx_groups"), 5, 7)


_POLICY = {
    "bridge": {"train": 0.6, "val": 0.2, "test": 0.2},
    "pooled": {"datasets": ["1-URGENT", "2-HIGH"], "ratios": {"train": 0.8, "val": 0.2}},
    "single": {"3-MEDIUM": RATIOS},
    "external": {"datasets": ["5-LOW"], "split": "external_test"},
    "folds": {"dataset": "5-LOW", "k": 5},
}
_LADDER_SQL = f"""
    with base as (select sample_id, dataset_id, group_id, dataset_role from fx_catalog),
    b as (with {_allocation("select dataset_id, group_id from base where dataset_role = 'bridge'", "cast(1042 + length(dataset_id) as string)", _POLICY["bridge"], "dataset_id")}
          select * from alloc),
    s1 as (select base.*, coalesce(b.split, '') as split from base left join b using (dataset_id, group_id)),
    p as (with {_allocation("select group_id from s1 where dataset_id in ('1-URGENT', '2-HIGH') and split = ''", "'43'", _POLICY["pooled"]["ratios"])}
          select * from alloc),
    s2 as (select s1.* exclude (split), case when dataset_id in ('1-URGENT', '2-HIGH') and s1.split = '' then p.split else s1.split end as split
           from s1 left join p using (group_id)),
    m as (with {_allocation("select group_id from s2 where dataset_id = '3-MEDIUM' and split = ''", "'50'", RATIOS)} select * from alloc),
    s3 as (select s2.* exclude (split), case when dataset_id = '3-MEDIUM' and s2.split = '' then m.split else s2.split end as split
           from s2 left join m using (group_id)),
    s4 as (select * exclude (split), case when dataset_id = '5-LOW' then 'external_test' else split end as split from s3),
    f as (with {_allocation("select group_id from s4 where dataset_id = '5-LOW'", "'446'", FOLDS)} select group_id, split as fold from alloc),
    s5 as (select s4.*, case when dataset_id = '5-LOW' then fold else '' end as ring_r2_fold from s4 left join f using (group_id))"""


def ladder(spark, sf):
    df = fixture(spark, sf, "fx_catalog").withColumn("split", F.lit("")).withColumn("ring_r2_fold", F.lit(""))
    return S.assign_splits(df, _POLICY, 42)


@query("assign_splits", _LADDER_SQL + " select sample_id, split, ring_r2_fold from s5")
def _(spark, sf):
    return ladder(spark, sf).select("sample_id", "split", "ring_r2_fold")


@query("split_then_profile", _LADDER_SQL + """
    select dataset_id, split, count(*) as images, count(distinct group_id) as groups from s5 group by 1, 2""")
def split_then_profile(spark, sf):
    """Leak-free splits over a catalog, then images and groups per dataset and split."""
    return ladder(spark, sf).groupBy("dataset_id", "split").agg(
        F.count(F.lit(1)).alias("images"), F.count_distinct("group_id").alias("groups"))


@query("split_leaks", """
    select group_id, string_agg(split, ',' order by split) as splits from (select distinct group_id, split from fx_catalog)
    group by 1 having count(*) > 1""")
def _(spark, sf):
    return S.split_leaks(fixture(spark, sf, "fx_catalog")).withColumn("splits", F.array_join("splits", ","))


@query("group_overlap", """
    with g as (select distinct group_id, split from fx_catalog)
    select a.group_id, a.split as split_l, b.split as split_r from g a join g b on a.group_id = b.group_id and a.split < b.split""")
def _(spark, sf):
    return S.group_overlap(fixture(spark, sf, "fx_catalog"))


@query("intersect_groups", """
    select group_id from fx_catalog where split = 'val' intersect select group_id from fx_catalog where split = 'test'""")
def _(spark, sf):
    df = fixture(spark, sf, "fx_catalog")
    return S.intersect_groups(df.where("split = 'val'"), df.where("split = 'test'"))


@query("split_audit", """
    with m as (select split, string_agg(concat(dataset_id, '=', cast(n as string)), ', ' order by dataset_id) as dataset_records
      from (select split, dataset_id, count(*) as n from fx_catalog group by 1, 2) group by 1)
    select c.split, count(*) as records, count(distinct group_id) as groups, m.dataset_records,
      count(*) filter (where defect_label_state = 'positive') as positive_records, count(*) filter (where defect_label_state <> 'positive') as verified_negative_records
    from fx_catalog c join m on c.split = m.split group by c.split, m.dataset_records""")
def _(spark, sf):
    df = S.split_audit(fixture(spark, sf, "fx_catalog"), F.col("defect_label_state") == "positive")
    return df.withColumn("dataset_records", S.map_text("dataset_records"))


# Profiles and reports ----------------------------------------------------------------------

_PROFILE = """
    select dataset_id, count(*) as images, count(distinct group_id) as groups, count(*) filter (where has_ring) as ring_labels,
      count(*) filter (where has_pith) as pith_labels, count(*) filter (where has_defect_box) as defect_box_labels, count(*) filter (where has_defect_mask) as defect_mask_labels,
      count(*) filter (where has_defect_class) as defect_class_labels, count(*) filter (where defect_label_state = 'verified_negative') as verified_negative,
      cast(sum(ignored_defect_instance_count) as bigint) as ignored_defect_instances,
      count(*) filter (where ring_label_state = 'missing') as missing_ring_labels, count(*) filter (where defect_label_state = 'missing') as missing_defect_labels
    from fx_catalog group by 1"""
_SPLIT_MAP = """
    select dataset_id, string_agg(concat(split, '=', cast(n as string)), ', ' order by split) as splits
    from (select dataset_id, split, count(*) as n from fx_catalog group by 1, 2) group by 1"""


@query("quality_profile", _PROFILE)
def _(spark, sf):
    return P.quality_profile(fixture(spark, sf, "fx_catalog"))


@query("count_map", _SPLIT_MAP)
def _(spark, sf):
    df = S.count_map(fixture(spark, sf, "fx_catalog"), ["dataset_id"], "split")
    return df.select("dataset_id", S.map_text("counts").alias("splits"))


@query("report_table", f"""
    with p as ({_PROFILE}), m as ({_SPLIT_MAP})
    select dataset_id, concat('| ', concat_ws(' | ', dataset_id, images, groups, splits, ring_labels, pith_labels, defect_box_labels,
      defect_mask_labels, defect_class_labels, ignored_defect_instances), ' |') as line from p join m using (dataset_id)""")
def _(spark, sf):
    df = fixture(spark, sf, "fx_catalog")
    return report_table(P.quality_profile(df), S.count_map(df, ["dataset_id"], "split"))


@query("duplicate_keys", "select ring_annotation_path, count(*) as copies from fx_catalog group by 1 having count(*) > 1")
def _(spark, sf):
    return P.duplicate_keys(fixture(spark, sf, "fx_catalog"), "ring_annotation_path")


@query("invalid_images", """
    select sample_id, image_path, image_width, image_height, image_bytes from fx_catalog
    where image_width <= 0 or image_height <= 0 or image_bytes <= 0""")
def _(spark, sf):
    return P.invalid_images(fixture(spark, sf, "fx_catalog"))


@query("fold_group_counts", "select ring_r2_fold, count(distinct group_id) as groups from fx_catalog group by 1")
def _(spark, sf):
    return P.fold_group_counts(fixture(spark, sf, "fx_catalog"))


@query("category_totals", """
    select source_dataset as dataset_id, category, count(*) as instances, grouping(source_dataset, category) as level
    from fx_annotations a join fx_images i on a.image_id = i.id group by cube(source_dataset, category)""")
def _(spark, sf):
    pairs = C.attach_children(fixture(spark, sf, "fx_images"), fixture(spark, sf, "fx_annotations"))
    return P.category_totals(pairs.withColumnRenamed("image_source_dataset", "dataset_id"))


@query("category_pivot", """
    select split, count(*) filter (where category = 'knot') as knot, count(*) filter (where category = 'crack') as crack, count(*) as total
    from fx_annotations a join fx_images i on a.image_id = i.id group by 1""")
def _(spark, sf):
    pairs = C.attach_children(fixture(spark, sf, "fx_images"), fixture(spark, sf, "fx_annotations"))
    return P.category_pivot(pairs.withColumnRenamed("image_split", "split"), "split", ["knot", "crack"])


@query("variants_per_group", """
    select variants, count(*) as groups from (select group_id, count(*) as variants from fx_groups group by 1) group by 1""")
def _(spark, sf):
    return P.variants_per_group(fixture(spark, sf, "fx_groups"))


@query("storage_profile", "select count(*) as files, cast(sum(size) as bigint) as bytes from fx_assets")
def _(spark, sf):
    return P.storage_profile(fixture(spark, sf, "fx_assets"))


@query("target_summary", """
    select dataset_id, count(*) as requested, count(*) filter (where o) as generated, count(*) filter (where not o) as errors,
      cast(sum(defect_instance_count) as bigint) as closed_rings, cast(sum(ignored_defect_instance_count) as bigint) as non_nested_pairs
    from (select *, image_width % 9 <> 0 as o from fx_catalog) group by rollup(dataset_id)""")
def _(spark, sf):
    df = fixture(spark, sf, "fx_catalog").select(
        "dataset_id", F.when(F.col("image_width") % 9 != 0, "ok").otherwise("error").alias("status"),
        F.col("defect_instance_count").alias("closed_ring_count"), F.col("ignored_defect_instance_count").alias("non_nested_pairs"))
    return P.target_summary(df)


@query("nonfinite_audit", """
    with v as (select vec_id, list_transform(embedding, lambda e: case when e > 0.35 then 'inf'::double else e end) as e from embeddings)
    select count(*) as vectors, cast(sum(len(e)) as bigint) as vector_values,
      cast(sum(len(list_filter(e, lambda x: not isfinite(x)))) as bigint) as nonfinite_values,
      count(*) filter (where len(list_filter(e, lambda x: not isfinite(x))) > 0) as nonfinite_vectors from v""")
def _(spark, sf):
    df = fixture(spark, sf, "embeddings").withColumn(
        "embedding", F.transform("embedding", lambda e: F.when(e > 0.35, float("inf")).otherwise(e.cast("double"))))
    return P.nonfinite_audit(df, "embedding", "vec_id")


def tree(name: str, keys: str, source: str) -> str:
    """CTEs that end in ``name`` (keys, d, lines): the tree digest of ``source`` (keys, line, r from 0)."""
    lead = keys + ", " if keys else ""
    by = f"group by {lead}" if keys else "group by "
    return f"""
    {name}_1 as (select {lead}r // 4096 as a, sha256(string_agg(line, '' order by r)) as d, count(*) as n from ({source}) {by}a),
    {name}_2 as (select {lead}a // 4096 as b, sha256(string_agg(d, '' order by a)) as d, sum(n) as n from {name}_1 {by}b),
    {name} as (select {lead}sha256(string_agg(d, '' order by b)) as d, cast(sum(n) as bigint) as lines from {name}_2 {'group by ' + keys if keys else ''})"""


_INVENTORY = tree("inv", "", """select concat(image_path, chr(9), image_width, chr(9), image_height, chr(9), image_bytes, chr(10)) as line,
      row_number() over (order by image_path) - 1 as r from fx_catalog""")


@query("quality_report", f"""
    with d as (select count(*) as n from (select image_path from fx_catalog group by 1 having count(*) > 1)),
    r as (select sample_id, image_path as p from fx_catalog union all select sample_id, ring_annotation_path from fx_catalog where ring_annotation_path <> ''
      union all select sample_id, split_part(substr(defect_mask_path, 7), '::', 1) from fx_catalog where defect_mask_path <> ''),
    m as (select count(*) as n from r where p not in (select path from fx_assets)),
    i as (select count(*) as n from fx_catalog where image_width <= 0 or image_height <= 0 or image_bytes <= 0),
    l as (select count(*) as n from (select group_id from fx_catalog group by 1 having count(distinct split) > 1)),
    {_INVENTORY}
    select inv.lines as total_images, d.n as duplicate_image_paths, m.n as missing_files, i.n as invalid_images, l.n as split_leaks,
      inv.d as inventory_sha256, case when d.n + m.n + i.n + l.n = 0 then 'ok' else 'error' end as status from d, m, i, l, inv""")
def _(spark, sf):
    fields = ["image_path", "ring_annotation_path", "defect_mask_path"]
    return quality_report(fixture(spark, sf, "fx_catalog"), fixture(spark, sf, "fx_assets"), fields)


# Provenance --------------------------------------------------------------------------------


@query("inventory_fingerprint", f"with {_INVENTORY} select d as inventory_sha256, lines from inv")
def _(spark, sf):
    return V.inventory_fingerprint(fixture(spark, sf, "fx_catalog"))


_REFS = """
    refs as (select distinct dataset_id, p from (select dataset_id, image_path as p from fx_catalog
      union all select dataset_id, ring_annotation_path from fx_catalog where ring_annotation_path <> ''
      union all select dataset_id, split_part(substr(defect_mask_path, 7), '::', 1) from fx_catalog where defect_mask_path <> '')),
    seen as (select dataset_id, p as path, size, mtime, case when size is null then concat(p, chr(9), 'MISSING', chr(10))
      else concat(p, chr(9), size, chr(9), mtime, chr(10)) end as line from refs left join fx_assets on p = path)"""
_FIELDS = ["image_path", "ring_annotation_path", "defect_mask_path"]


_SEEN = tree("t", "dataset_id", "select dataset_id, line, row_number() over (partition by dataset_id order by path) - 1 as r from seen")


@query("metadata_fingerprint", f"""
    with {_REFS}, {_SEEN} select dataset_id, lines as files, bytes, missing, d as metadata_sha256 from t join (
      select dataset_id, cast(coalesce(sum(size), 0) as bigint) as bytes, count(*) filter (where size is null) as missing from seen group by 1) using (dataset_id)""")
def _(spark, sf):
    return V.metadata_fingerprint(fixture(spark, sf, "fx_catalog"), fixture(spark, sf, "fx_assets"), _FIELDS)


_OVERALL = tree("t", "", "select concat(dataset_id, chr(9), line) as line, row_number() over (order by dataset_id, path) - 1 as r from seen")


@query("overall_fingerprint", f"with {_REFS}, {_OVERALL} select d as metadata_sha256, lines as file_count from t")
def _(spark, sf):
    return V.overall_fingerprint(fixture(spark, sf, "fx_catalog"), fixture(spark, sf, "fx_assets"), _FIELDS)


_CONTENT = tree("t", "dataset_id", """select dataset_id, concat(path, chr(9), size, chr(9), coalesce(h, 'MISSING'), chr(10)) as line,
      row_number() over (partition by dataset_id order by path) - 1 as r from l""")


@query("content_fingerprint", f"""
    with c as (select url as path, length(html) as size, sha256(html) as h, 'd' || cast(page_id % 3 as string) as dataset_id, page_id from pages),
    l as (select dataset_id, path, page_id, case when page_id % 10 = 0 then 0 else size end as size, case when page_id % 10 = 0 then null else h end as h from c),
    {_CONTENT} select dataset_id, lines as files, bytes, missing, d as aggregate_content_sha256 from t join (
      select dataset_id, cast(sum(size) as bigint) as bytes, count(*) filter (where h is null) as missing from l group by 1) using (dataset_id)""")
def _(spark, sf):
    pages = fixture(spark, sf, "pages")
    df = pages.select(F.concat(F.lit("d"), (F.col("page_id") % 3).cast("string")).alias("dataset_id"), F.col("url").alias("image_path"))
    contents = pages.where(F.col("page_id") % 10 != 0).select(
        F.col("url").alias("path"), F.length("html").cast("long").alias("size"), F.sha2("html", 256).alias("sha256"))
    return V.content_fingerprint(df, contents, ["image_path"])


@query("hash_mismatches", """
    select url as path, sha256(case when page_id % 4 = 0 then 'x' else html end) as expected_sha256,
      case when page_id % 6 = 0 then 'MISSING' else sha256(html) end as actual_sha256
    from pages where page_id % 4 = 0 or page_id % 6 = 0""")
def _(spark, sf):
    pages = fixture(spark, sf, "pages")
    wanted = pages.select(F.col("url").alias("path"), F.sha2(F.when(F.col("page_id") % 4 == 0, "x").otherwise(F.col("html")), 256).alias("expected_sha256"))
    contents = pages.where(F.col("page_id") % 6 != 0).select(F.col("url").alias("path"), F.sha2("html", 256).alias("sha256"))
    return V.hash_mismatches(wanted, contents)


def _snapshot(df, broken):
    size = F.when(F.col("c_custkey") == 1, F.col("c_custkey") + 1000).otherwise(F.col("c_custkey")) if broken else F.col("c_custkey")
    rows = df.select(F.col("c_mktsegment").alias("dataset_id"), F.col("c_name").alias("path"), size.alias("size"))
    return O.ordered_digest(rows, [F.col("path")], V.tab_line(F.col("path"), F.col("size")), ["dataset_id"], "metadata_sha256")


_SNAPSHOT = tree("b", "dataset_id", """select c_mktsegment as dataset_id, concat(c_name, chr(9), c_custkey, chr(10)) as line,
      row_number() over (partition by c_mktsegment order by c_name) - 1 as r from customer""") + "," + tree("n", "dataset_id", """select
      c_mktsegment as dataset_id, concat(c_name, chr(9), case when c_custkey = 1 then c_custkey + 1000 else c_custkey end, chr(10)) as line,
      row_number() over (partition by c_mktsegment order by c_name) - 1 as r from customer where c_mktsegment <> 'MACHINERY'""")


@query("compare_snapshots", f"""
    with {_SNAPSHOT} select b.dataset_id, b.d as baseline_digest, n.d as current_digest, b.d is distinct from n.d as changed
    from b left join n using (dataset_id)""")
def _(spark, sf):
    df = fixture(spark, sf, "customer")
    return V.compare_snapshots(_snapshot(df, False), _snapshot(df.where("c_mktsegment <> 'MACHINERY'"), True))


@query("provenance_status", f"""
    with {_SNAPSHOT}, c as (select b.dataset_id, b.d is distinct from n.d as changed from b left join n using (dataset_id)),
    m as (select count(*) as k from customer where c_mktsegment = 'MACHINERY')
    select count(*) filter (where changed) as changed_datasets, string_agg(case when changed then dataset_id end, ',' order by dataset_id) as changed_ids,
      min(m.k) as missing_files, false as source_unchanged, 'error' as status from c, m""")
def _(spark, sf):
    df = fixture(spark, sf, "customer")
    gone = df.where("c_mktsegment = 'MACHINERY'")
    compared = V.compare_snapshots(_snapshot(df, False), _snapshot(df.where("c_mktsegment <> 'MACHINERY'"), True))
    return V.provenance_status(compared, F.lit(False), gone)


# Joins and set operations ------------------------------------------------------------------

_TAX_ROWS = [
    ("tax", "ECONOMY", "knot", "sound_or_live", ["a"], "keep"),
    ("tax", "Large Plated", None, "", ["b"], "ignore"),
    ("tax", "PROMO", "crack", "standalone", [], "keep"),
    ("tax", "UNKNOWN", None, "", ["unknown_source_class"], "ignore"),
]
_TAX_SQL = """
    tax(raw_label, category, subtype, attributes, train_action) as (values ('ECONOMY', 'knot', 'sound_or_live', 'a', 'keep'),
      ('Large Plated', null, '', 'b', 'ignore'), ('PROMO', 'crack', 'standalone', '', 'keep'), ('UNKNOWN', null, '', 'unknown_source_class', 'ignore')),
    raw as (select p_partkey, case p_partkey % 3 when 0 then p_type when 1 then concat(' ', lower(p_type), ' ') else 'large_plated' end as raw_label from part)"""


def _raw_labels(spark, sf):
    key, kind = F.col("p_partkey") % 3, F.col("p_type")
    text = F.when(key == 0, kind).when(key == 1, F.concat(F.lit(" "), F.lower(kind), F.lit(" "))).otherwise("large_plated")
    return fixture(spark, sf, "part").select("p_partkey", F.lit("tax").alias("dataset_id"), text.alias("raw_label"))


def _tax(spark):
    schema = pa.schema([("dataset_id", pa.string()), ("raw_label", pa.string()), ("category", pa.string()), ("subtype", pa.string()),
                        ("attributes", pa.list_(pa.string())), ("train_action", pa.string())])
    return literal_table(spark, _TAX_ROWS, schema)


def _flat(df):
    return df.withColumn("attributes", F.array_join("attributes", ";")).drop("dataset_id")


@query("map_taxonomy_canonical", f"""
    with {_TAX_SQL}, canon as (select *, replace(lower(trim(raw_label)), ' ', '_') as k from tax)
    select r.p_partkey, r.raw_label, case when c.k is null then 'other' else c.category end as category,
      case when c.k is null then '' else c.subtype end as subtype, case when c.k is null then 'unmapped_source_class' else c.attributes end as attributes,
      c.train_action from raw r left join canon c on replace(lower(trim(r.raw_label)), ' ', '_') = c.k""")
def _(spark, sf):
    return _flat(X.map_taxonomy(_raw_labels(spark, sf), _tax(spark)))


@query("map_taxonomy_strict", f"""
    with {_TAX_SQL} select r.p_partkey, r.raw_label, t.category, t.subtype, t.attributes, t.train_action from raw r join tax t using (raw_label)""")
def _(spark, sf):
    return _flat(X.map_taxonomy(_raw_labels(spark, sf), _tax(spark), fallback="drop"))


@query("map_taxonomy_unknown", f"""
    with {_TAX_SQL} select r.p_partkey, r.raw_label, t.category, t.subtype, t.attributes, t.train_action
    from raw r join tax t on t.raw_label = case when r.raw_label in (select raw_label from tax) then r.raw_label else 'UNKNOWN' end""")
def _(spark, sf):
    return _flat(X.map_taxonomy(_raw_labels(spark, sf), _tax(spark), fallback="unknown"))


@query("partition_targets", f"""
    with {_TAX_SQL}, canon as (select *, replace(lower(trim(raw_label)), ' ', '_') as k from tax)
    select case when coalesce(c.category in ('knot', 'crack') and c.train_action = 'keep', false) then 'target' else 'ignore' end as part, count(*) as n
    from raw r left join canon c on replace(lower(trim(r.raw_label)), ' ', '_') = c.k group by 1""")
def _(spark, sf):
    target, ignore = X.partition_targets(X.map_taxonomy(_raw_labels(spark, sf), _tax(spark)))
    tagged = target.select(F.lit("target").alias("part")).unionByName(ignore.select(F.lit("ignore").alias("part")))
    return tagged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("attach_children", """
    select a.id, a.image_id, category, i.split as image_split, i.group_id as image_group_id
    from fx_annotations a join fx_images i on a.image_id = i.id where i.width > 100""")
def _(spark, sf):
    images = fixture(spark, sf, "fx_images").where("width > 100")
    return C.attach_children(images, fixture(spark, sf, "fx_annotations")).select("id", "image_id", "category", "image_split", "image_group_id")


@query("reuse_metadata", """
    with c as (select image_path, case when image_height % 2 = 0 then image_bytes else image_bytes + 1 end as image_bytes, 640 as w, 480 as h
      from fx_catalog where image_width % 3 = 0)
    select sample_id, case when w is not null and image_width = 0 then w else image_width end as image_width, image_height,
      not (image_width > 0 and image_height > 0 and image_bytes > 0) and w is null as needs_read
    from fx_catalog k left join c using (image_path, image_bytes)""")
def _(spark, sf):
    df = fixture(spark, sf, "fx_catalog")
    cache = df.where("image_width % 3 = 0").select(
        "image_path", F.when(F.col("image_height") % 2 == 0, F.col("image_bytes")).otherwise(F.col("image_bytes") + 1).alias("image_bytes"),
        F.lit(640).alias("image_width"), F.lit(480).alias("image_height"))
    fresh = df.select("sample_id", "image_path", "image_bytes", "image_width", "image_height")
    out = C.reuse_metadata(fresh, cache)
    return out.select("sample_id", "image_width", "image_height", "needs_read")


def _ring_index(df):
    return df.where("has_ring and image_width % 5 <> 0").select(
        "sample_id", F.when(F.col("image_width") % 9 != 0, "ok").otherwise("error").alias("status"),
        F.lit(320).alias("target_width"), (F.col("image_height") * 2).alias("target_height"))


_TASKS = """
    ri as (select sample_id, image_width % 9 <> 0 as okay from fx_catalog where has_ring and image_width % 5 <> 0),
    im as (select sample_id from fx_images where width > 60)"""


@query("task_samples", f"""
    with {_TASKS}
    select sample_id, image_path as source_image, split, group_id, 'ring' as mode, 1 as ring, 0 as defect, 0 as classification
      from fx_catalog where has_ring and sample_id in (select sample_id from ri where okay)
    union all select sample_id, image_path, split, group_id, 'defect', 0, 1, 0 from fx_catalog
      where defect_label_state <> 'missing' and sample_id in (select sample_id from im)
    union all select sample_id, image_path, split, group_id, 'bridge', 1, 1, 0 from fx_catalog where dataset_role = 'bridge'
      and defect_label_state <> 'missing' and sample_id in (select sample_id from im) and sample_id in (select sample_id from ri where okay)""")
def _(spark, sf):
    df = fixture(spark, sf, "fx_catalog")
    images = fixture(spark, sf, "fx_images").where("width > 60")
    parts = [C.task_samples(df, task, ring_index=_ring_index(df), images=images) for task in ("ring", "defect", "bridge")]
    return C.union_catalogs(parts).select("sample_id", "source_image", "split", "group_id", "mode", "task_mask.*")


@query("key_set_diff", """
    select group_id, 'missing' as side from (select group_id from fx_catalog where split = 'train' except select group_id from fx_catalog where split = 'val')
    union all select group_id, 'extra' from (select group_id from fx_catalog where split = 'val' except select group_id from fx_catalog where split = 'train')""")
def _(spark, sf):
    df = fixture(spark, sf, "fx_catalog")
    return C.key_set_diff(df.where("split = 'train'"), df.where("split = 'val'"), "group_id")


@query("set_difference", """
    select p_type, 'unexpected' as side from (select distinct p_type from part where p_type <> 'PROMO')
    union all select 'normal', 'absent'""")
def _(spark, sf):
    part = fixture(spark, sf, "part").select("p_type").distinct()
    wanted = part.where("p_type = 'PROMO'").unionByName(spark.range(1).select(F.lit("normal").alias("p_type")))
    return C.set_difference(part, wanted)


@query("missing_references", """
    select sample_id, field, p as path from (select sample_id, 'image_path' as field, image_path as p from fx_catalog
      union all select sample_id, 'ring_annotation_path', ring_annotation_path from fx_catalog where ring_annotation_path <> ''
      union all select sample_id, 'defect_mask_path', split_part(substr(defect_mask_path, 7), '::', 1) from fx_catalog where defect_mask_path <> '')
    where p not in (select path from fx_assets)""")
def _(spark, sf):
    return C.missing_references(fixture(spark, sf, "fx_catalog"), _FIELDS, fixture(spark, sf, "fx_assets"))


@query("inheritance_violations", """
    select i.sample_id, i.split, i.group_id from fx_images i left join (select * from fx_catalog where image_width % 10 <> 1) c on i.sample_id = c.sample_id
    where c.sample_id is null or c.split <> i.split or c.group_id <> i.group_id""")
def _(spark, sf):
    parent = fixture(spark, sf, "fx_catalog").where("image_width % 10 <> 1")
    child = fixture(spark, sf, "fx_images").select("sample_id", "split", "group_id")
    return C.inheritance_violations(child, parent, "sample_id")


@query("attach_annotation", """
    select o_orderkey, case when o_orderkey % 2 = 0 then concat('p/', o_orderkey, '_col.json') when o_orderkey % 3 = 0 then concat('q/', o_orderkey, '.json') end as annotation_path
    from orders""")
def _(spark, sf):
    orders = fixture(spark, sf, "orders")
    stem = F.col("o_orderkey").cast("string")
    first = orders.where("o_orderkey % 2 = 0").select(F.concat(stem, F.lit("_col.json")).alias("name"), F.concat(F.lit("p/"), stem, F.lit("_col.json")).alias("path"))
    second = orders.where("o_orderkey % 3 = 0").select(F.concat(stem, F.lit(".json")).alias("name"), F.concat(F.lit("q/"), stem, F.lit(".json")).alias("path"))
    names = [F.concat(stem, F.lit("_col.json")), F.concat(stem, F.lit(".json"))]
    return C.attach_annotation(orders.select("o_orderkey"), first.unionByName(second), [], names)


@query("complete_sets", """
    select o_custkey, count(distinct o_orderpriority) as members from orders where o_orderkey % 9 <> 0 group by 1 having count(distinct o_orderpriority) = 5""")
def _(spark, sf):
    df = fixture(spark, sf, "orders").withColumn("annotation_path", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")))
    return C.complete_sets(df, "o_custkey", "o_orderpriority", 5)


@query("apply_override", """
    select sample_id, defect_mask_path as defect_annotation_path, case when defect_mask_path <> '' and image_height % 2 = 0 then concat('norm/', sample_id) else defect_mask_path end as annotation_source
    from fx_catalog""")
def _(spark, sf):
    df = fixture(spark, sf, "fx_catalog").select("sample_id", "image_height", F.col("defect_mask_path").alias("defect_annotation_path"))
    overrides = df.where("defect_annotation_path <> '' and image_height % 2 = 0").select(
        F.col("defect_annotation_path").alias("source_relative"), F.concat(F.lit("norm/"), "sample_id").alias("normalized_relative"))
    return C.apply_override(df.select("sample_id", "defect_annotation_path"), overrides)


@query("enrich_registry", """
    with reg as (select distinct c_mktsegment as dataset_id, 'available' as status from customer union all select distinct o_orderpriority, 'listed' from orders),
    m as (select dataset_id, string_agg(concat(split, '=', cast(n as string)), ', ' order by split) as splits
      from (select dataset_id, split, count(*) as n from fx_catalog group by 1, 2) group by 1)
    select r.dataset_id, r.status, count(c.sample_id) as manifest_images, count(distinct c.group_id) as physical_groups, count(*) filter (where coalesce(c.has_ring, false)) as ring_images,
      count(*) filter (where coalesce(c.defect_label_state <> 'missing', false)) as defect_labeled_images, cast(coalesce(sum(c.defect_instance_count), 0) as bigint) as target_instances_manifest,
      cast(coalesce(sum(c.ignored_defect_instance_count), 0) as bigint) as ignored_instances_manifest, coalesce(any_value(m.splits), '') as splits
    from reg r left join fx_catalog c on r.dataset_id = c.dataset_id left join m on r.dataset_id = m.dataset_id group by 1, 2""")
def _(spark, sf):
    catalog = fixture(spark, sf, "fx_catalog")
    registry = fixture(spark, sf, "customer").select(F.col("c_mktsegment").alias("dataset_id"), F.lit("available").alias("status")).distinct().unionByName(
        fixture(spark, sf, "orders").select(F.col("o_orderpriority").alias("dataset_id"), F.lit("listed").alias("status")).distinct())
    return C.enrich_registry(registry, catalog).withColumn("splits", S.map_text("splits"))


@query("combine_bridge_sample", """
    with ri as (select sample_id, 320 as tw, image_height * 2 as th from fx_catalog where has_ring and image_width % 5 <> 0 and image_width % 9 <> 0),
    s as (select i.id, i.sample_id, tw / greatest(1, i.width) as sx, th / greatest(1, i.height) as sy from fx_images i join ri using (sample_id))
    select a.id, s.sample_id, round_even(x * sx, 4) as x, round_even(y * sy, 4) as y, round_even(w * sx, 4) as w, round_even(h * sy, 4) as h, round(w * h * sx * sy, 4) as area
    from fx_annotations a join s on a.image_id = s.id""")
def _(spark, sf):
    from annolake.functions.geometry import xywh

    c = F.col
    annotations = fixture(spark, sf, "fx_annotations").select("id", "image_id", xywh(c("x"), c("y"), c("w"), c("h")).alias("bbox"), (c("w") * c("h")).alias("area"))
    out = C.combine_bridge_sample(_ring_index(fixture(spark, sf, "fx_catalog")), fixture(spark, sf, "fx_images"), annotations)
    return out.select("id", "sample_id", *[F.col(f"bbox.{k}").alias(k) for k in "xywh"], F.round("area", 4).alias("area"))


@query("union_catalogs", """
    select doc_id as id, dataset_id from fx_samples union all select sample_id, dataset_id from fx_groups""")
def _(spark, sf):
    return C.union_catalogs([
        fixture(spark, sf, "fx_samples").select(F.col("doc_id").alias("id"), "dataset_id"),
        fixture(spark, sf, "fx_groups").select(F.col("sample_id").alias("id"), "dataset_id")])


@query("append_precomputed", """
    select sample_id, dataset_id, 'old' as origin from fx_catalog where dataset_id = '5-LOW'
    union all select sample_id, dataset_id, 'new' from fx_catalog where dataset_id <> '5-LOW'""")
def _(spark, sf):
    df = fixture(spark, sf, "fx_catalog").select("sample_id", "dataset_id")
    return C.append_precomputed(df.withColumn("origin", F.lit("new")), df.where("dataset_id = '5-LOW'").withColumn("origin", F.lit("old")), "dataset_id")


@query("resume_pending", """
    with d as (select sample_id from fx_catalog where image_width % 9 <> 0 and ring_annotation_path <> ''
      and ring_annotation_path in (select path from fx_assets) and image_path in (select path from fx_assets))
    select sample_id, case when sample_id in (select sample_id from d) then 'carried' else 'pending' end as work from fx_catalog where has_ring""")
def _(spark, sf):
    df = fixture(spark, sf, "fx_catalog")
    done = df.select("sample_id", F.when(F.col("image_width") % 9 != 0, "ok").otherwise("error").alias("status"), "ring_annotation_path", "image_path")
    pending, carried = C.resume_pending(df.where("has_ring"), done, "sample_id", ["ring_annotation_path", "image_path"], fixture(spark, sf, "fx_assets"))
    tag = lambda frame, name: frame.select("sample_id", F.lit(name).alias("work"))
    return tag(pending, "pending").unionByName(tag(carried, "carried"))


# Order -------------------------------------------------------------------------------------


@query("global_rank", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over (order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey) as place from lineitem""")
def _(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    df = fixture(spark, sf, "lineitem").select(*keys, "l_extendedprice")
    return O.ranked(df, [F.col("l_extendedprice").desc(), *[F.col(k) for k in keys]], name="place").drop("l_extendedprice")


@query("running_totals", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over w as place, cast(sum(l_linenumber) over w as bigint) as total, max(l_quantity) over w as peak
    from lineitem window w as (partition by l_returnflag order by l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey rows unbounded preceding)""")
def _(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    df = fixture(spark, sf, "lineitem").select(*keys, "l_returnflag", "l_extendedprice", "l_quantity")
    out = O.running(df, [F.col("l_extendedprice"), *[F.col(k) for k in keys]], ["l_returnflag"], rank="place",
                    sums={"total": F.col("l_linenumber").cast("long")}, maxima={"peak": F.col("l_quantity")})
    return out.select(*keys, "place", "total", "peak")


@query("first_per_key", """
    select ring_annotation_path, sample_id, image_path from (select *, row_number() over (partition by ring_annotation_path order by dataset_id, sample_id) as r
      from fx_catalog where ring_annotation_path <> '') where r = 1""")
def _(spark, sf):
    df = fixture(spark, sf, "fx_catalog").where("ring_annotation_path <> ''").select("ring_annotation_path", "dataset_id", "sample_id", "image_path")
    return O.first_per_key(df, ["ring_annotation_path"], ["dataset_id", "sample_id"]).drop("dataset_id")


@query("even_sample", """
    with n as (select event_id, row_number() over (order by event_id) - 1 as r, count(*) over () as c from events)
    select event_id from n where r in (select case when i = 136 then c - 1 else cast(floor(i * ((c - 1) / 136.0::double)) as bigint) end
      from range(137) t(i), (select count(*) as c from events))""")
def _(spark, sf):
    return O.even_sample(fixture(spark, sf, "events").select("event_id"), 137, "event_id")


@query("head_rows", "select event_id, value from events order by value desc, event_id limit 25")
def _(spark, sf):
    df = fixture(spark, sf, "events").select("event_id", "value", (-F.col("value")).alias("_v"))
    return O.head(df, 25, "_v", "event_id").drop("_v")


@query("preview", """
    select (select count(*) from fx_catalog where image_width = 0) as total,
      (select string_agg(sample_id, ', ' order by sample_id) from (select sample_id from fx_catalog where image_width = 0 order by 1 limit 5)) as preview""")
def _(spark, sf):
    return O.preview(fixture(spark, sf, "fx_catalog").where("image_width = 0"), "sample_id")


@query("first_match", """
    select sample_id, image_width from fx_catalog where dataset_role = 'bridge' and defect_instance_count > 2 order by sample_id limit 1""")
def _(spark, sf):
    match = (F.col("dataset_role") == "bridge") & (F.col("defect_instance_count") > 2)
    return O.first_match(fixture(spark, sf, "fx_catalog"), match, "sample_id").select("sample_id", "image_width")


@query("group_splits", """
    select arg_min(dataset_id, dataset_id || chr(1) || sample_id) as dataset_id, group_id, arg_min(split, dataset_id || chr(1) || sample_id) as split,
      arg_min(ring_r2_fold, dataset_id || chr(1) || sample_id) as ring_r2_fold, count(*) as sample_count from fx_catalog group by group_id""")
def _(spark, sf):
    return group_splits(fixture(spark, sf, "fx_catalog"))


@query("mask_contract", """
    select sample_id, split, defect_mask_path as source_semantic_mask, 'prebuilt_two_class_id_mask' as decoder,
      '0=background;1=knot;2=crack' as unified_category_ids from fx_catalog where dataset_id = '2-HIGH'""")
def _(spark, sf):
    return mask_contract(fixture(spark, sf, "fx_catalog"), "2-HIGH")
