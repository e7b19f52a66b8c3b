import zlib

import duckdb
import pytest
from pyspark.sql import types as T

from tests.conftest import SMALL

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def rows(name):
    return duckdb.sql(f"SELECT * FROM '{SMALL}/{name}.parquet'").fetchall()


@pytest.fixture(scope="session")
def small():
    """Documents of the smallest data as (doc_id, text, lang, source, n_chars)."""
    return rows("documents")


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows and ids."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
    texts = [None, "", " \t\n", "a", "one two", "One  TWO", "x y z x y z x y z", "é è ü — «»", "123 456", "<|endoftext|> end", long, long, "solo\x00null"]
    out = [(i, t, None, None, None) for i, t in enumerate(texts)]
    out += [(3, "a", "en", "s", 1), (3, "a", "en", "s", 1), (None, "a", None, None, None), (None, None, None, None, None), (7, "another text", "fr", None, 5)]
    return out


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    """The edge rows with extra columns whose names clash with what the operators add."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(edge_rows, DOCS)
    extra = ["_digest", "_found", "_lead", "_text", "digest", "n_tokens", "ids", "size", "shard", "score", "node", "bands", "findings", "x", "label", "n_words", "kept", "id", "row1"]
    return frame.withColumns({name: F.lit(f"extra {name}") for name in extra})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
