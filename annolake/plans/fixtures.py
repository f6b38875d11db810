"""Views over the given tables that play the role of annotation data, in SQL both engines read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

FIXTURES: dict[str, str] = {
    "fx_samples": """
        select d.doc_id, concat(d.lang, ':', cast(d.doc_id as string)) as sample_id, d.lang as dataset_id,
               concat(d.lang, ':', d.source) as group_id, d.n_chars as image_bytes,
               coalesce(l.quality, 0) = 1 as has_ring,
               case when l.doc_id is null then 'missing' when l.toxic = 1 then 'positive'
                    else 'verified_negative' end as label_state
        from {documents} d left join {labels} l on d.doc_id = l.doc_id""",
    "fx_groups": """
        select o_orderkey as sample_id, o_orderpriority as dataset_id,
               concat('c', cast(o_custkey as string)) as group_id
        from {orders}""",
    "fx_catalog": """
        select concat('img/', cast(o_orderkey as string), '.png') as image_path, o_orderpriority as dataset_id,
               concat(o_orderpriority, ':', cast(o_orderkey as string)) as sample_id,
               concat('c', cast(o_custkey as string)) as group_id,
               cast(o_orderkey % 641 as int) as image_width, cast(o_custkey % 480 + 1 as int) as image_height,
               cast(floor(o_totalprice) as bigint) as image_bytes,
               case when o_custkey % 50 = 0 and o_orderkey % 2 = 0 then 'val' when o_custkey % 5 = 0 then 'test'
                    else 'train' end as split,
               o_orderkey % 2 = 0 as has_ring, o_orderkey % 3 = 0 as has_pith, o_orderkey % 4 = 0 as has_defect_box,
               o_orderkey % 5 = 0 as has_defect_mask, o_orderkey % 6 = 0 as has_defect_class,
               case when o_orderkey % 10 = 0 then 'bridge' else 'defect_main' end as dataset_role,
               case when o_orderkey % 2 = 0 then 'complete_closed' else 'missing' end as ring_label_state,
               case o_orderstatus when 'O' then 'missing' when 'P' then 'positive'
                    else case when o_orderkey % 3 = 0 then 'ignore_only' else 'verified_negative' end end as defect_label_state,
               case when o_orderstatus = 'P' then cast(o_orderkey % 4 + 1 as int) else 0 end as defect_instance_count,
               case when o_orderstatus = 'F' and o_orderkey % 3 = 0 then cast(o_orderkey % 2 + 1 as int) else 0 end
                   as ignored_defect_instance_count,
               case when o_orderkey % 2 = 0 then concat('ann/', cast(o_orderkey % 5000 as string), '.json') else '' end
                   as ring_annotation_path,
               case when o_orderkey % 3 = 0 then concat('zip://arc/', cast(o_custkey % 100 as string), '.zip::',
                    cast(o_orderkey as string)) else '' end as defect_mask_path,
               case when o_custkey % 4 = 0 then 'auxiliary_only' else 'primary' end as supervision_scope,
               cast(o_custkey % 5 as string) as ring_r2_fold
        from {orders}""",
    "fx_assets": """
        select concat('img/', cast(o_orderkey as string), '.png') as path, cast(floor(o_totalprice) as bigint) as size,
               o_orderkey * 1000 as mtime from {orders} where o_orderkey % 7 <> 0
        union all select distinct concat('ann/', cast(o_orderkey % 5000 as string), '.json'),
               o_orderkey % 5000, o_orderkey % 5000 + 7 from {orders} where o_orderkey % 11 <> 0
        union all select distinct concat('arc/', cast(o_custkey % 100 as string), '.zip'), o_custkey % 100 + 5, 3
               from {orders} where o_custkey % 100 <> 42""",
    # lineitem with one row per key, so that ids made of the key are unique.
    "fx_items": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_quantity) as l_quantity, min(l_extendedprice) as l_extendedprice,
               min(l_returnflag) as l_returnflag, min(l_linestatus) as l_linestatus, min(l_shipdate) as l_shipdate
        from {lineitem} group by l_orderkey, l_linenumber, l_partkey, l_suppkey""",
    "fx_boxes": """
        select cast(floor(l_orderkey / 20) as bigint) as image_id, l_returnflag as class, l_linestatus = 'F' as is_pred, l_orderkey,
               l_linenumber, l_partkey, l_suppkey,
               concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string),
                         cast(l_suppkey as string)) as box_id,
               cast(l_partkey % 40 as double) as x, cast(l_suppkey % 30 as double) as y, l_quantity as w,
               cast(5 + l_linenumber * 3 as double) as h, l_extendedprice as score
        from {fx_items}""",
    "fx_pixels": """
        select user_id as image_id, cast(floor((event_id % 1024) / 32) as int) as y, cast(event_id % 32 as int) as x,
               max(event_type) as class, max(value) as v
        from {events} group by 1, 2, 3""",
    "fx_labels": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey,
               concat(case when l_returnflag = 'A' then 'knot' when l_returnflag = 'R' then 'crack' else 'bogus' end,
                      ' | na |', case l_returnflag when 'A' then 'K' else 'C' end, lpad(cast(l_linenumber as string), 2, '0'),
                      '|', case when l_linestatus = 'F' then 'clear' else 'partial' end, '|',
                      cast(l_partkey % 2 as string), '|', cast(l_suppkey % 2 as string)) as label
        from {lineitem}""",
    "fx_pred": """
        select d.doc_id, l.quality as truth, case when d.n_chars > 1000 then 1 else 0 end as pred, d.source
        from {documents} d join {labels} l on d.doc_id = l.doc_id""",
    "fx_history": """
        select user_id as run, event_id as epoch, round(value, 0) as score, event_type as metric from {events}""",
    "fx_hash": """
        select o_orderkey as sample_id, o_orderstatus as split, concat('c', cast(o_custkey as string)) as group_id,
               concat('img/', cast(o_orderkey as string)) as image_path, o_custkey, o_orderkey from {orders}""",
    "fx_images": """
        select o_orderkey as id, concat('img/', cast(o_orderkey as string), '.png') as file_name,
               cast(o_custkey % 200 + 40 as int) as width, cast(o_custkey % 90 + 30 as int) as height,
               o_orderpriority as source_dataset, concat('c', cast(o_custkey as string)) as group_id,
               concat(o_orderpriority, ':', cast(o_orderkey as string)) as sample_id,
               case when o_custkey % 5 = 0 then 'test' else 'train' end as split,
               case when o_orderstatus = 'O' then 'verified_negative' when o_orderstatus = 'P' then 'positive'
                    else 'ignore_only' end as defect_label_state,
               case when o_orderstatus = 'F' and o_orderkey % 2 = 0 then 1 else 0 end as ignored_instance_count
        from {orders}""",
    "fx_annotations": """
        select ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey as id, l_orderkey as image_id,
               case when l_returnflag = 'A' then 1 else 2 end as category_id,
               case when l_returnflag = 'A' then 'knot' else 'crack' end as category,
               cast(l_partkey % 60 as double) - 1.5 as x, cast(l_suppkey % 50 as double) as y,
               l_quantity as w, cast(l_linenumber * 4 as double) as h, l_shipdate, l_partkey
        from {fx_items}""",
    "fx_shapes": """
        select cast(floor(p_partkey / 5) as bigint) as file_no, p_partkey as shape_no,
               concat(case when p_size % 5 = 4 then 'bogus' when p_size % 5 = 3 then 'resin' when p_size % 5 = 2 then 'crack'
                      else 'knot' end, '|na|', case when p_size % 2 = 0 then 'K' else 'X' end,
                      lpad(cast(p_size % 3 + 1 as string), 2, '0'), '|', case when p_size % 4 = 0 then 'partial' else 'clear' end,
                      '|', cast(p_partkey % 2 as string), '|0') as label,
               case when p_partkey % 4 = 3 then 'rectangle' else 'polygon' end as shape_type,
               cast(p_partkey % 53 as double) as x, cast(p_size as double) as y, cast(p_partkey % 17 as double) as w,
               cast(p_size % 13 as double) as h
        from {part}""",
}

_DEPENDENCY = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a fixture view as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = FIXTURES[name]
    needed = sorted(set(_DEPENDENCY.findall(sql)))
    return spark.sql(sql, **{dep: fixture(spark, sf_dir, dep) for dep in needed})


def with_fixtures(sql: str) -> str:
    """The SQL with every fixture view it names in front as a common table expression."""
    ordered: list[str] = []

    def visit(text: str, pattern: re.Pattern) -> None:
        for name in pattern.findall(text):
            if name in FIXTURES and name not in ordered:
                visit(FIXTURES[name], _DEPENDENCY)
                ordered.append(name)

    visit(sql, re.compile(r"\bfx_\w+"))
    parts = [f"{name} as ({_DEPENDENCY.sub(r'\1', FIXTURES[name])})" for name in ordered]
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return "with recursive " + ", ".join([*parts, body[15:]])
    if body.lower().startswith("with "):
        return "with " + ", ".join([*parts, body[5:]])
    return ("with " + ", ".join(parts) + " " if parts else "") + body
