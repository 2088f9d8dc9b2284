"""Written intermediate tables, connected components and small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pooltide.operators.staging import staged


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and outlives lost executors. Runs a job, whose shuffle files go with its end."""
    return staged(df, name)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    Labels spread to neighbours and jump to their label's label, so a component of
    n nodes takes about log n rounds. Each round is joins and minima over edges;
    no node's neighbours and no component is ever gathered in one place. Null ends
    are ignored; loops and repeated edges do no harm; no edges give no rows.
    """
    ends = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node IS NOT NULL AND other IS NOT NULL")
    both = written(ends.unionByName(ends.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.min("other").alias("least"))
                     .select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("other"), "component"), "other")
                .groupBy("node").agg(F.min("component").alias("near")))
        moved = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = moved.select(F.col("node").alias("next"), F.col("next").alias("jumped"))
        fresh = written(moved.join(jump, "next", "left").select(
            "node", F.coalesce(F.least("next", "jumped"), "next").alias("component"),
            (F.coalesce(F.least("next", "jumped"), "next") != F.col("component")).alias("changed")), "labels")
        discard(labels)
        labels = fresh.select("node", "component")
        if fresh.where("changed").isEmpty():
            discard(both)
            return labels
