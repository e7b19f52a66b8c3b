"""Token counts from a digest cache.

The cache holds (content digest, tokenizer digest) -> count.  Counting joins the
documents' digests to it; only distinct contents without an entry are encoded, and their
counts are appended.  The tokenizer digest is that of the vocabulary file, so another
file never reads this one's counts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelab.llm.common import file_digest, shared_path, tokenizer_path, utf8_bytes
from curvelab.llm.ledger import Ledger, content_digest, distinct_contents
from curvelab.scale import salted_join

#: Words whose count a worker remembers at most.
WORDS = 200_000

_SEGMENT = re.compile(r" *[^ ]+| +$")


class PieceCounter:
    """Counts of a sentencepiece BPE model with identity normaliser.

    Where no piece has a space mark after another character, no merge crosses the border
    between a character and the space after it.  The text then falls into segments of
    spaces and the word behind them whose counts add up, and equal segments are counted
    once.  A model without that property is asked for whole texts.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.splits = not any(re.search("[^\u2581]\u2581", p) for p in pieces) and self._plain()
        self.known: dict[str, int] = {}

    def _plain(self) -> bool:
        """True if spaces are kept, a leading one is added, and nothing is normalised."""
        probe = "  \ufb01 x\u00a0\u3000y  "
        return self.model.decode(self.model.encode(probe)) == probe and self.model.encode("x", out_type=str)[0].startswith("\u2581")

    def _first(self, segment: str) -> int:
        """Count of a segment that begins the text: the model adds the leading space itself."""
        return len(self.model.encode(segment))

    def _later(self, segment: str) -> int:
        """Count of a segment inside the text: its first space is the one the model adds.

        A single space at the end of the text is the space mark alone.
        """
        return len(self.model.encode(segment[1:])) if len(segment) > 1 else 1

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits or "\u2581" in text:
            return len(self.model.encode(text))
        segments = _SEGMENT.findall(text)
        known = self.known
        total = self._first(segments[0])
        for segment in segments[1:]:
            n = known.get(segment)
            if n is None:
                n = self._later(segment)
                if len(known) >= WORDS:
                    known.clear()
                known[segment] = n
            total += n
        return total


class FileCounter:
    """Counts of a ``tokenizers`` file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, text: str) -> int:
        return len(self.model.encode(text, add_special_tokens=False))


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter | FileCounter:
    return PieceCounter(path) if path.endswith(".model") else FileCounter(path)


ENTRY = "digest binary, tokenizer string, n_tokens bigint"


def _counting(name: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        count = counter(tokenizer_path(name)).count
        for batch in batches:
            counts = [count(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest").cast(pa.binary()), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                names=["digest", "tokenizer", "n_tokens"],
            )

    return run


def as_is(text: Column) -> Column:
    """The normalisation under which counts are shared: null counts as empty, nothing else changes.

    The vocabulary files have identity normalisers, so texts that differ in any byte may
    differ in their count.  A normalisation given instead must not change counts.
    """
    return F.coalesce(text, F.lit(""))


def count_tokens(
    docs: DataFrame,
    tokenizer: str = "piece_bpe_32k.model",
    cache_path: str | None = None,
    limit: int = 4096,
    normalise: Callable[[Column], Column] = as_is,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    Whole texts, no begin, end or added tokens, no truncation.  Without ``cache_path`` the
    run uses a cache of its own in the shared folder.  A null or empty text has 0 bytes and
    0 tokens.  Rows with null or equal ids are all kept.  An empty table gives an empty
    result.  Other columns are not read.
    """
    spark = docs.sparkSession
    cache = Ledger(spark, cache_path or shared_path(spark, "token-cache"), ENTRY)
    version = file_digest(tokenizer_path(tokenizer))
    text = normalise(F.col(f"`{text_col}`"))
    known = cache.read().filter(F.col("tokenizer") == version)
    contents = distinct_contents(docs, text)
    if not known.isEmpty():
        contents = contents.join(known.select("digest"), "digest", "left_anti")
    cache.append(contents.mapInArrow(_counting(tokenizer, version), cache.schema))
    counts = (
        cache.read()
        .filter(F.col("tokenizer") == version)
        .groupBy("digest")
        .agg(F.max("n_tokens").alias("n_tokens"))
        .withColumnRenamed("digest", "_digest")
    )
    rows = docs.select(
        F.col(f"`{id_col}`").alias(id_col), utf8_bytes(F.col(f"`{text_col}`")).alias("n_bytes"), content_digest(text).alias("_digest")
    )
    return salted_join(rows, counts, "_digest", salts=4).select(
        id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
