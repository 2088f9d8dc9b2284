"""Session helper for tests and the benchmark. A cluster brings its own session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "pooltide", partitions: int | None = None) -> SparkSession:
    """A local session with the settings the library is tested under."""
    width = partitions or (os.cpu_count() if cpus == "*" else int(cpus)) or 8
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(width))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("POOLTIDE_DRIVER_MEMORY", "16g"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        # Tests only: a cluster names its shared checkpoint folder itself.
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pooltide-ckpt-"))
    return spark
