"""Session helpers: reliable materialisation, scratch folders."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Least number of tasks for rows that are about to grow.
SPREAD = 64


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only a session on one machine may do without the setting."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/annolake-shared"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, readable by every executor, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/annolake-{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that every later branch sees the
    same rows and a lost executor costs a re-read only.

    A table rather than a checkpoint: later branches read only the columns they need, and the
    planner knows the size.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.stage_path = path
    return staged


def remove(df: DataFrame) -> None:
    """Delete the table that ``stable`` wrote for ``df``, once nothing reads it any more. Other frames are left alone."""
    path = getattr(df, "stage_path", None)
    if path is not None:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def separate_session(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session of the same application with the settings of ``spark`` and some of its own, which ``spark`` keeps no trace of."""
    own = spark.newSession()
    for name, value in {**spark.conf.getAll, **settings}.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    return own


def literal_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A driver-side constant table. Spark knows its exact size and plans the join by it."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [pa.array(list(values), type=field.type) for values, field in zip(columns, schema)]
    return spark.createDataFrame(pa.table(arrays, schema=schema))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key to at least ``SPREAD`` tasks, for steps that make many rows of one.

    Spark deals rows by their size before such a step, so a small file would grow to millions of rows in one task. Steps
    that group by the same keys afterwards need no further shuffle.
    """
    return df.repartition(max(SPREAD, shuffle_partitions(df)), *keys)
