"""A table of results kept by content: what is known of a content is never computed again.

Shared by the secret scan (blob and rule version to spans) and the token counts
(content and tokenizer digest to count).  Entries lie as Parquet in batch folders below
one path; a batch is committed by Spark's writer as a whole and never changed.  A batch
that is lost costs work, not results, and readers accept a content that two writers added.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvelab.llm.common import session


def content_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.encode(text, "UTF-8"), F.lit(b"")), 256))


def distinct_contents(docs: DataFrame, text: Column) -> DataFrame:
    """(digest, text), one row per content.

    Copies are combined before the shuffle, so a content that holds a third of the rows
    crosses it once per task.
    """
    return docs.select(content_digest(text).alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))


class Ledger:
    """Append-only entries of one schema."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark = session(spark)
        self.path = path.rstrip("/")
        self.schema = T._parse_datatype_string(schema)

    def read(self) -> DataFrame:
        """All entries; none before the first batch."""
        try:
            return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.option("compression", "zstd").parquet(f"{self.path}/batch={uuid.uuid4().hex}")
