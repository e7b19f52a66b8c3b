"""The corpus pipeline: stages over documents, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and gives a table that is written as Parquet and
read again as the next one's docs.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curvelab.llm import bpe, decontaminate, language, ngram_join, secrets
from curvelab.llm.common import table, written
from curvelab.llm.queries import remainder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Share of a text's words that its language must have.
LANGUAGE_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a language, or with none that has half of the words, go."""
    return language.identified(docs, language.train(docs, remainder(4) != 2), LANGUAGE_SHARE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest id."""
    return ngram_join.representatives(docs)


def drop_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), inside=True)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; secrets in their texts are replaced."""
    return secrets.redacted(docs, length_col="n_chars")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and digests of them and of their decoding."""
    return bpe.encode(docs, ids=True, digests=True)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_texts),
    ("secret scans", redact_secrets),
    ("BPE encoding and decoding", encode_tokens),
]

#: The first stage is a learned model, which SQL cannot express; tests/llm has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each result written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return docs
