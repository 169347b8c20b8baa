"""Session construction and the shared-folder helper used to cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(app_name: str = "annolytics", *, cpus: int | None = None, driver_memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine is tuned for; on a cluster the caller's session is used as it is."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where none is set (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="annolytics-")
        spark.sparkContext.setCheckpointDir(found)
    return found
