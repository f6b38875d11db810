"""Queries over stored snapshots: what changed, and which record held when."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolake.operators import snapshots as S
from annolake.plans.fixtures import fixture
from annolake.plans.registry import query
from annolake.session import scratch_path

c = F.col


def inventories(spark, sf):
    """The files of two days: some go, some come, of one dataset some change; others keep all their leaves."""
    files = fixture(spark, sf, "customer").select(
        c("c_mktsegment").alias("dataset_id"), F.concat(F.lit("img/"), c("c_custkey").cast("string"), F.lit(".png")).alias("path"), "c_custkey", "c_mktsegment")
    moving = c("c_mktsegment").isin("BUILDING", "MACHINERY")
    size = c("c_custkey") % 1000
    old = files.where(~(moving & (c("c_custkey") % 17 == 0))).select("dataset_id", "path", S.file_line(F.when(c("c_custkey") % 23 != 0, size), c("c_custkey") * 7).alias("line"))
    grown = F.when((c("c_mktsegment") == "BUILDING") & (c("c_custkey") % 13 == 0), size + 1).otherwise(size)
    new = files.where(~(moving & (c("c_custkey") % 19 == 0))).select("dataset_id", "path", S.file_line(F.when(c("c_custkey") % 23 != 0, grown), c("c_custkey") * 7).alias("line"))
    return old, new


def stored(spark, sf):
    path = scratch_path(spark, "snapshots")
    for name, files in zip(("day1", "day2"), inventories(spark, sf)):
        S.write_snapshot(files, path, name)
    return path


_LINES = """
    files as (select c_mktsegment as dataset_id, 'img/' || c_custkey || '.png' as path, c_custkey as k, c_mktsegment in ('BUILDING', 'MACHINERY') as moving from customer),
    o as (select dataset_id, path, case when k % 23 = 0 then 'MISSING' || chr(10) else (k % 1000) || chr(9) || (k * 7) || chr(10) end as line from files where not (moving and k % 17 = 0)),
    n as (select dataset_id, path, case when k % 23 = 0 then 'MISSING' || chr(10) else (k % 1000 + case when dataset_id = 'BUILDING' and k % 13 = 0 then 1 else 0 end) || chr(9) || (k * 7) || chr(10) end as line
        from files where not (moving and k % 19 = 0))"""


@query("snapshot_diff", f"""
    with {_LINES} select dataset_id, path, case when o.line is null then 'added' when n.line is null then 'gone' else 'changed' end as change, o.line as old_line, n.line as new_line
    from o full join n using (dataset_id, path) where o.line is distinct from n.line""")
def _(spark, sf):
    return S.snapshot_diff(spark, stored(spark, sf), "day1", "day2")


@query("snapshot_roots", f"""
    with {_LINES}, leaves as (select dataset_id, cast('0x' || substr(sha256(path), 1, 4) as bigint) as leaf, count(*) as files, sha256(string_agg(path || chr(9) || line, '' order by path, line)) as digest from o group by 1, 2),
    branches as (select dataset_id, leaf // 1024 as branch, cast(sum(files) as bigint) as files, sha256(string_agg(leaf || ' ' || digest || chr(10), '' order by leaf)) as digest from leaves group by 1, 2)
    select dataset_id, sha256(string_agg(branch || ' ' || digest || chr(10), '' order by branch)) as digest, cast(sum(files) as bigint) as files from branches group by 1""")
def _(spark, sf):
    return S.read_nodes(spark, stored(spark, sf), "day1", 0).select("dataset_id", "digest", "files")


@query("snapshot_as_of", """
    with ledger as (select o_orderpriority as dataset_id, cast(o_orderdate as timestamp) as taken_at, lpad(cast(o_orderkey as varchar), 12, '0') as snapshot_id, o_custkey as files from orders),
    asked as (select distinct o_orderpriority as dataset_id, cast(l_shipdate as timestamp) as asked_at from lineitem join orders on l_orderkey = o_orderkey),
    days as (select dataset_id, taken_at, max(snapshot_id) as snapshot_id, arg_max(files, snapshot_id) as files from ledger group by 1, 2)
    select strftime(asked_at, '%Y-%m-%dT%H:%M:%SZ') as asked_at, d.dataset_id, snapshot_id, strftime(taken_at, '%Y-%m-%dT%H:%M:%SZ') as taken_at, files
    from asked q asof join days d on q.dataset_id = d.dataset_id and q.asked_at >= d.taken_at""")
def _(spark, sf):
    """A ledger with a record per order, asked for every shipping date of the dataset's orders."""
    path = scratch_path(spark, "ledger")
    orders = fixture(spark, sf, "orders")
    S.append_snapshot_record(
        orders.select(c("o_orderpriority").alias("dataset_id"), F.sha2("o_orderstatus", 256).alias("digest"), c("o_custkey").alias("files"), "o_orderkey", "o_orderdate"),
        path, F.lpad(c("o_orderkey").cast("string"), 12, "0"), c("o_orderdate"))
    asked = fixture(spark, sf, "lineitem").join(orders, c("l_orderkey") == c("o_orderkey")).select(c("o_orderpriority").alias("dataset_id"), c("l_shipdate").alias("asked_at"))
    held = S.snapshot_as_of(spark.read.schema(S.LEDGER_DDL).parquet(path), asked)
    return held.select(S.utc_stamp(c("asked_at")).alias("asked_at"), "dataset_id", "snapshot_id", S.utc_stamp(c("taken_at")).alias("taken_at"), "files")
