"""File sources and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvelab.edge import clean

BAR_SCHEMA = (
    "timestamp_utc timestamp, bar_start_local timestamp_ntz, bar_end_local timestamp_ntz, session_date date, bar_slot int,"
    " event_type string, root string, security string, delivery_month date, open double, high double, low double,"
    " close double, volume_contracts double, num_events double, value double, source string, pulled_at_utc timestamp"
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """A stored table in Parquet, ORC, CSV or JSON; a missing one is an empty typed frame."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    if not location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true").option("enforceSchema", "false")
    return reader.format(fmt).load(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Zstandard Parquet; with partitions only the partitions present are replaced."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def flat_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for text formats."""
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str, compressed: bool = False) -> None:
    writer = flat_columns(df).write.mode("overwrite").option("header", "true")
    (writer.option("compression", "gzip") if compressed else writer).csv(path)


def json_records(df: DataFrame, limit: int | None = None) -> DataFrame:
    """One JSON text per row; numbers that are not finite become null."""
    cells = [
        clean(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ]
    rows = df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("record"))
    return rows if limit is None else rows.limit(limit)
