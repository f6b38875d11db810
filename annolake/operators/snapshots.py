"""Snapshots of file inventories: stored digest trees, what changed between two of them, and a dated ledger.

A tree has leaves bounded by key: a file belongs to one of 65,536 leaves of its dataset by the first 16 bits of its path's SHA-256. An
inserted file changes its own leaf and nothing else, unlike leaves that count lines. Above are 64 branches and the root. A
comparison opens branches whose digests differ, then leaves, then only the rows of such leaves: rows lie in one folder per
branch, in leaf order, so other folders are never listed and other row groups are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.operators.order import running
from annolake.operators.provenance import tab_line

LEAVES_PER_BRANCH = 1024
STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"
LEDGER_DDL = "snapshot_id string, taken_at timestamp, dataset_id string, digest string, files long"


def leaf_of(path: Column) -> Column:
    return F.conv(F.substring(F.sha2(path, 256), 1, 4), 16, 10).cast("int")


def file_line(size: Column, mtime: Column) -> Column:
    """What a snapshot remembers of a file; a file that was not there says so."""
    return F.when(size.isNull(), F.lit("MISSING\n")).otherwise(tab_line(size, mtime))


def tree_nodes(files: DataFrame) -> DataFrame:
    """level (2 leaf, 1 branch, 0 root), dataset_id, branch, leaf, digest and files of each node; ``files``: dataset_id, path, line.

    A leaf digests its lines ``path<tab>line`` in path order, a node above the numbers and digests of its children.
    """
    def above(children: DataFrame, *keys: str) -> DataFrame:
        text = "listagg(concat(at, ' ', digest, '\\n'), '') within group (order by at)"
        return children.groupBy("dataset_id", *keys).agg(F.expr(f"sha2({text}, 256)").alias("digest"), F.sum("files").alias("files"))

    none = F.lit(None).cast("int")
    leaves = files.withColumn("leaf", leaf_of(F.col("path"))).groupBy("dataset_id", "leaf").agg(
        F.expr("sha2(listagg(concat(path, '\\t', line), '') within group (order by path, line), 256)").alias("digest"), F.count(F.lit(1)).alias("files"),
    ).withColumn("branch", F.floor(F.col("leaf") / LEAVES_PER_BRANCH).cast("int"))
    branches = above(leaves.withColumn("at", F.col("leaf")), "branch")
    roots = above(branches.withColumn("at", F.col("branch")))
    names = ["level", "dataset_id", "branch", "leaf", "digest", "files"]
    return leaves.withColumn("level", F.lit(2)).select(*names).unionByName(
        branches.withColumn("level", F.lit(1)).withColumn("leaf", none).select(*names)).unionByName(
        roots.withColumn("level", F.lit(0)).withColumn("branch", none).withColumn("leaf", none).select(*names))


def write_snapshot(files: DataFrame, path: str, snapshot_id: str) -> None:
    """Store ``files`` (dataset_id, path, line) and their tree below ``path``."""
    rows = files.select("dataset_id", "path", "line", leaf_of(F.col("path")).alias("leaf")).withColumn("branch", F.floor(F.col("leaf") / LEAVES_PER_BRANCH).cast("int"))
    # Few large files per branch folder, salted so that no task holds a whole branch.
    salt = F.pmod(F.xxhash64("leaf"), F.lit(8))
    rows.repartition("branch", salt).sortWithinPartitions("branch", "leaf").write.mode("errorifexists").partitionBy("branch").parquet(f"{path}/{snapshot_id}/rows")
    # The tree comes from what was stored, so that both agree also if the source changes meanwhile.
    stored = read_rows(files.sparkSession, path, snapshot_id)
    tree_nodes(stored).repartition("level").write.mode("errorifexists").partitionBy("level").parquet(f"{path}/{snapshot_id}/nodes")


def read_rows(spark: SparkSession, path: str, snapshot_id: str) -> DataFrame:
    return spark.read.schema("dataset_id string, path string, line string, leaf int, branch int").parquet(f"{path}/{snapshot_id}/rows")


def read_nodes(spark: SparkSession, path: str, snapshot_id: str, level: int) -> DataFrame:
    kind = "dataset_id string, branch int, leaf int, digest string, files long, level int"
    return spark.read.schema(kind).parquet(f"{path}/{snapshot_id}/nodes").where(F.col("level") == level)


def differing(spark: SparkSession, path: str, old: str, new: str, level: int, within: DataFrame | None = None) -> DataFrame:
    """dataset_id, branch and leaf of the nodes of a level that are not alike in both snapshots; ``within``: the parents to open."""
    keys = ["dataset_id", "branch", "leaf"]
    sides = [read_nodes(spark, path, name, level) for name in (old, new)]
    if within is not None:
        sides = [side.join(within, [k for k in within.columns], "left_semi") for side in sides]
    both = sides[0].select(*keys, "digest", F.lit(1).alias("side")).unionByName(sides[1].select(*keys, "digest", F.lit(2).alias("side")))
    return both.groupBy(*keys, "digest").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(*keys).distinct()


def snapshot_diff(spark: SparkSession, path: str, old: str, new: str) -> DataFrame:
    """dataset_id, path, change (added, gone or changed), old_line and new_line of every file that differs."""
    roots = differing(spark, path, old, new, 0).select("dataset_id")
    branches = differing(spark, path, old, new, 1, roots).select("dataset_id", "branch")
    leaves = differing(spark, path, old, new, 2, branches).select("dataset_id", "branch", "leaf")
    # At most 64 numbers: they select the folders to be read.
    opened = sorted(row["branch"] for row in branches.select("branch").distinct().collect())

    def rows(name: str, line: str) -> DataFrame:
        stored = read_rows(spark, path, name).where(F.col("branch").isin(opened))
        return stored.join(leaves, ["dataset_id", "branch", "leaf"], "left_semi").select("dataset_id", "path", F.col("line").alias(line))

    both = rows(old, "old_line").join(rows(new, "new_line"), ["dataset_id", "path"], "full").where(~F.col("old_line").eqNullSafe(F.col("new_line")))
    change = F.when(F.col("old_line").isNull(), "added").when(F.col("new_line").isNull(), "gone").otherwise("changed")
    return both.select("dataset_id", "path", change.alias("change"), "old_line", "new_line")


def append_snapshot_record(roots: DataFrame, path: str, snapshot_id: str | Column, taken_at: Column | None = None) -> None:
    """Add one record per dataset to the ledger: its root digest and file count (``roots``: dataset_id, digest, files), stamped
    ``taken_at`` or now. Records are only ever added."""
    name = F.lit(snapshot_id) if isinstance(snapshot_id, str) else snapshot_id
    roots.select(
        name.alias("snapshot_id"), (F.current_timestamp() if taken_at is None else taken_at).cast("timestamp").alias("taken_at"),
        "dataset_id", "digest", F.col("files").cast("long").alias("files")).write.mode("append").parquet(path)


def utc_stamp(at: Column) -> Column:
    """An instant as UTC text, to the second."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), STAMP)


def snapshot_as_of(ledger: DataFrame, asked: DataFrame) -> DataFrame:
    """For every question (``asked``: dataset_id, asked_at) the dataset's last record at or before that instant; of records at one
    instant the greatest snapshot_id. Questions before a dataset's first record give no row.

    Records and questions are sorted together and the last record is carried on over all tasks (``order.running``), so no pair
    of a record and a question is built and no dataset has to fit one task.
    """
    kind = "struct<taken_at:timestamp,snapshot_id:string,digest:string,files:bigint>"
    told = ledger.select(
        "dataset_id", F.col("taken_at").alias("_at"), F.lit(0).alias("_asks"), F.struct("taken_at", "snapshot_id", "digest", "files").cast(kind).alias("_record"))
    questions = asked.select("dataset_id", F.col("asked_at").cast("timestamp").alias("_at"), F.lit(1).alias("_asks"), F.lit(None).cast(kind).alias("_record")).distinct()
    lines = told.unionByName(questions)
    carried = running(lines, [F.col("_at"), F.col("_asks"), F.col("_record")], ["dataset_id"], maxima={"_last": F.col("_record")})
    return carried.where("_asks = 1 and _last is not null").select(F.col("_at").alias("asked_at"), "dataset_id", "_last.*")
