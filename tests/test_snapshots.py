"""Stored digest trees and the dated ledger."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from annolake.operators import snapshots as S


def files(spark, rows):
    return spark.createDataFrame(rows, "dataset_id string, path string, line string")


def test_changes_are_named_and_other_folders_stay_closed(spark, tmp_path):
    rows = [("d", f"p/{i}", f"{i}\n") for i in range(500)] + [("e", "only", "1\n")]
    changed = [r for r in rows if r[1] != "p/7"] + [("d", "p/new", "x\n")]
    changed = [(d, p, "other\n" if p == "p/9" else line) for d, p, line in changed if d == "d"] + [("f", "fresh", "1\n")]
    path = str(tmp_path)
    S.write_snapshot(files(spark, rows), path, "a")
    S.write_snapshot(files(spark, changed).repartition(5), path, "b")
    got = {(r["dataset_id"], r["path"]): (r["change"], r["old_line"], r["new_line"]) for r in S.snapshot_diff(spark, path, "a", "b").collect()}
    assert got == {
        ("d", "p/7"): ("gone", "7\n", None), ("d", "p/new"): ("added", None, "x\n"), ("d", "p/9"): ("changed", "9\n", "other\n"),
        ("e", "only"): ("gone", "1\n", None), ("f", "fresh"): ("added", None, "1\n")}
    # An inserted file changes one leaf and one branch of its dataset, wherever it sorts.
    leaves = S.differing(spark, path, "a", "b", 2).where("dataset_id = 'd'").count()
    assert leaves == 3
    diff = S.snapshot_diff(spark, path, "a", "b")
    read = {name.split("branch=")[1].split("/")[0] for name in diff.inputFiles() if "branch=" in name}
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(branch" in plan or "branch#" in plan
    assert len(read) > 5 and plan.count("INSET") + plan.count(" IN (") >= 2


def test_order_and_partitioning_do_not_change_the_tree(spark):
    rows = [("d", f"p/{i}", f"{i}\n") for i in range(300)]
    trees = [sorted(map(tuple, S.tree_nodes(files(spark, some).repartition(n)).collect()), key=repr) for some, n in ((rows, 1), (rows[::-1], 7))]
    assert trees[0] == trees[1] and S.tree_nodes(files(spark, [])).count() == 0


def test_same_snapshot_has_no_changes(spark, tmp_path):
    for name in "ab":
        S.write_snapshot(files(spark, [("d", "p", "1\n")]), str(tmp_path), name)
    assert S.snapshot_diff(spark, str(tmp_path), "a", "b").count() == 0
    with pytest.raises(Exception, match="(?i)already exists"):
        S.write_snapshot(files(spark, []), str(tmp_path), "a")


def test_ledger_tells_the_last_record_at_or_before(spark, tmp_path):
    path, day = str(tmp_path / "ledger"), lambda n: dt.datetime(2024, 1, n, 12)
    for name, at, digest in (("s1", day(2), "A"), ("s2", day(5), "B"), ("s3", day(5), "C")):
        S.append_snapshot_record(spark.createDataFrame([("d", digest, 3)], "dataset_id string, digest string, files long"), path, name, F.lit(at))
    S.append_snapshot_record(spark.createDataFrame([("now", "N", 1)], "dataset_id string, digest string, files long"), path, "s4")
    ledger = spark.read.schema(S.LEDGER_DDL).parquet(path)
    asked = spark.createDataFrame([("d", day(n)) for n in (1, 2, 4, 5, 30)] + [("void", day(5)), ("now", dt.datetime(2100, 1, 1))], "dataset_id string, asked_at timestamp")
    got = {(r["dataset_id"], r["asked_at"].day): r["snapshot_id"] for r in S.snapshot_as_of(ledger, asked).collect()}
    assert got == {("d", 2): "s1", ("d", 4): "s1", ("d", 5): "s3", ("d", 30): "s3", ("now", 1): "s4"}
    assert ledger.where("snapshot_id = 's1'").select(S.utc_stamp(F.col("taken_at"))).first()[0] == "2024-01-02T12:00:00Z"
