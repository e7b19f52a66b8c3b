"""Stage tables: intermediate results written once as Parquet in the shared folder.

A pipeline stage that several later steps read (row counts, running totals, the rows
themselves) is written instead of recomputed per reader.  Readers then scan only the
columns they need, lineage ends at the files, and the loss of executors costs nothing
that was finished.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curvelab.session import checkpoint_dir

_WRITTEN: dict[tuple[str, str], str] = {}


def fingerprint(spark: SparkSession, folder: str) -> str:
    """State of the tables in a folder: each one's bytes, files and time of change."""
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    seen = []
    for status in store.listStatus(path):
        held = store.getContentSummary(status.getPath())
        seen.append((status.getPath().getName(), held.getLength(), held.getFileCount(), status.getModificationTime()))
    return hashlib.sha1(repr(sorted(seen)).encode()).hexdigest()


def write_stage_path(df: DataFrame, label: str) -> str:
    """Write a stage table and give its folder."""
    spark = df.sparkSession
    name = f"{label}-{uuid.uuid4().hex[:12]}"
    path = posixpath.join(checkpoint_dir(spark), "curvelab-stages", spark.sparkContext.applicationId, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def write_stage(df: DataFrame, label: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(write_stage_path(df, label))


def stage(spark: SparkSession, label: str, folder: str, build: Callable[[], DataFrame], settings: str = "") -> DataFrame:
    """The stage table of this application for the inputs in ``folder`` as they are now.

    Written on first use, and again when a table in the folder or the settings changed.
    """
    key = f"{folder}|{settings}|{fingerprint(spark, folder)}"
    slot = (spark.sparkContext.applicationId, f"{label}-{hashlib.sha1(key.encode()).hexdigest()[:10]}")
    if slot not in _WRITTEN:
        _WRITTEN[slot] = write_stage_path(build(), slot[1])
    return spark.read.parquet(_WRITTEN[slot])
