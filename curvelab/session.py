"""Session settings the library relies on.

``build`` makes a session for tests and scripts.  ``tune`` only sets runtime SQL
options, so it is safe on a session somebody else built (a cluster, a notebook).
"""

from __future__ import annotations

import os
import posixpath

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # One wall clock for batch, stream and file output.
    "spark.sql.session.timeZone": "UTC",
    # Re-plan at run time: merge small shuffle partitions, split hot join keys.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A join may use a partitioning on some of its keys (bars stay placed by time).
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build(master: str | None = None, app: str = "curvelab", partitions: int = 8, shared: str | None = None) -> SparkSession:
    """A local session.  ``shared`` is the folder for stage tables and checkpoints."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("CURVELAB_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shared is not None:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stage tables: the one the cluster names in
    ``spark.checkpoint.dir``, or a folder of the warehouse, which all executors see as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or posixpath.join(spark.conf.get("spark.sql.warehouse.dir").rstrip("/"), "curvelab-shared")
