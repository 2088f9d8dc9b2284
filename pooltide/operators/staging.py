"""Cutting lineage through a written table, for results that several passes read."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pooltide-ckpt-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back (runs a job, whose shuffle files go with its end).

    The table outlives lost executors, and later passes read only the columns
    they need.
    """
    spark = df.sparkSession
    path = os.path.join(staging_dir(spark), "pooltide", f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        # The mode of clean-up is that of the session when a DataFrame is made.
        df.select("*").write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task gets where the work of a stored table is split by its length.
ROWS_PER_TASK = 100_000
_TASKS: dict[tuple[str, str], int] = {}


def tasks_for(table: DataFrame, name: str) -> int:
    """How many tasks suit the rows of a stored table (runs a job once per application and ``name``, on Parquet footers alone).

    The number grows with the table, so what one task holds does not.
    """
    context = table.sparkSession.sparkContext
    key = (context.applicationId, name)
    if key not in _TASKS:
        _TASKS[key] = max(context.defaultParallelism, -(-table.count() // ROWS_PER_TASK))
    return _TASKS[key]


def spread(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """Partition by ``keys`` into a fixed number of tasks.

    For few bytes that mean much work (rows about to multiply, or to be solved
    one by one): adaptive execution would merge them into a handful of tasks by
    size alone.
    """
    spark = df.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(max(least, tasks or 0), *keys)
