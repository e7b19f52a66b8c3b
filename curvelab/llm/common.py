"""Helpers shared by the operators: reading, Arrow batches, byte-level words and shingles.

Texts reach Python as Arrow buffers and stay bytes.  Words and shingles are found with
numpy over the UTF-8 bytes of many documents at once, so the cost per word is a few
array operations and no Python string is made.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelab.session import checkpoint_dir, tune

#: Rows and bytes of one Arrow batch: bounds a Python worker's memory whatever the texts' length.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20
#: Bytes of text worked on at once inside a batch.
SLICE_BYTES = 1 << 19

#: Words per shingle and least similarity of the near-duplicate operators.
SHINGLE = 5
THRESHOLD = 0.8


def session(spark: SparkSession) -> SparkSession:
    """Runtime settings of the library, and Arrow batches bounded in rows and bytes."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name in the folder that driver and executors share."""
    return posixpath.join(checkpoint_dir(spark), "llm", spark.sparkContext.applicationId, f"{label}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it: lineage ends there."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def file_digest(path: str) -> str:
    """Version of a vocabulary file."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; ``LLM_TOKENIZERS`` names another folder."""
    folder = os.environ.get("LLM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- texts as bytes


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows with about ``most`` bytes.

    Yields (first row, row after the last, bytes, offsets of the rows in them).  A row
    longer than ``most`` is a run of its own and stays whole.  Null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (finaliser of a public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x = x * _M2
    x ^= x >> np.uint64(33)
    return x


def _inverse_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for i, step in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            powers = np.empty(size, dtype=np.uint64)
            powers[0] = 1
            filled = 1
            while filled < size:
                factor = np.uint64(pow(step, filled, 1 << 64))
                powers[filled : 2 * filled] = powers[:filled] * factor
                filled *= 2
            _POWERS[i : i + 1] = [powers]
    return _POWERS[0], _POWERS[1]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every span of bytes: a polynomial modulo 2**64, mixed with the length."""
    powers, inverse = _inverse_powers(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inverse[: len(data)], out=total[1:])
        value = (total[end] - total[start]) * powers[start]
        return mix(value ^ ((end - start).astype(np.uint64) * _M1))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space, A-Z lower-cased, of rows that lie back to back.

    Returns (hash, row, first byte, byte after the last) per word.
    """
    n = len(data)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    begins[cuts] = inside[cuts]  # a row's first byte starts a word even after a word's last byte
    start = np.flatnonzero(begins)
    if not len(start):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    before = cuts - 1
    before = before[before >= 0]
    ends[before] = inside[before]
    end = np.flatnonzero(ends) + 1
    value = span_hashes(_LOWER[data], start, end)
    row = np.searchsorted(offsets, start, side="right") - 1
    return value, row, start, end


def shingle_hashes(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hash of every run of ``width`` words, in order."""
    n = max(len(hashes) - width + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _M2 + mix(hashes[k : k + n] + np.uint64(k + 1))
        return mix(out)


def row_shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of every row in text order, back to back, and how many each row has.

    A row with fewer words than ``width`` has its whole word sequence as one shingle;
    a row without words has none.
    """
    rows = len(offsets) - 1
    hashes, row, _, _ = word_hashes(data, offsets)
    words = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    firsts = np.concatenate(([0], np.cumsum(words)))
    grams = shingle_hashes(hashes, width)
    grams = grams[row[: len(grams)] == row[width - 1 :]] if len(grams) else grams
    sizes = np.maximum(words - width + 1, 0)
    short = np.flatnonzero((words > 0) & (words < width))
    if len(short):
        sizes[short] = 1
        at = np.concatenate(([0], np.cumsum(sizes)))[short] - np.arange(len(short))
        grams = np.insert(grams, at, [_whole(hashes[firsts[r] : firsts[r + 1]]) for r in short])
    return grams, sizes


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, back to back, and their offsets."""
    grams, sizes = row_shingles(data, offsets, width)
    bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        grams[first:last].sort()
    fresh = np.ones(len(grams), dtype=bool)
    fresh[1:] = grams[1:] != grams[:-1]
    fresh[bounds[:-1][sizes > 0]] = True
    kept = np.concatenate(([0], np.cumsum(fresh)))
    return grams[fresh], kept[bounds].astype(np.int64)


def _whole(words: np.ndarray) -> np.uint64:
    """One hash for a sequence shorter than a shingle."""
    value = np.array([len(words)], dtype=np.uint64)
    with np.errstate(over="ignore"):
        for h in words:
            value = value * _M2 + h
        return mix(value)[0]
