"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a global number 0..n-1, the permutation maps the number to a place in
the shuffled order, and shard and slot follow by division: place p lies in shard
``p % shards`` at slot ``p // shards``.  Nothing is sorted by a random key and no order
is stored; ``locate`` and ``row_at`` compute the way there and back for any number.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvelab.llm.common import mix, utf8_bytes

#: Buckets of the two-level row numbering: the table of their counts is this long at most.
BUCKETS = 4096
ROUNDS = 6


@dataclass(frozen=True)
class Feistel:
    """A keyed bijection of 0..n-1.

    The network permutes the 2k-bit numbers, the smallest such domain that holds n; a
    result of n or more is sent through again until it falls below n (cycle walking),
    which takes fewer than four turns on average.
    """

    n: int
    seed: int = 0

    @property
    def half(self) -> int:
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _keys(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + mix(np.array([self.seed % (1 << 64)], np.uint64)))

    def _turn(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        for key in keys:
            if back:
                left, right = right ^ (mix(left ^ key) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ key) & mask)
        return (left << bits) | right

    def _walk(self, numbers: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(numbers).astype(np.uint64)
        keys = self._keys()[::-1] if back else self._keys()
        out = self._turn(x, keys, back)
        while (far := out >= np.uint64(self.n)).any():
            out[far] = self._turn(out[far], keys, back)
        return out.astype(np.int64)

    def place(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, back=False)

    def number(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, back=True)


def locate(n: int, shards: int, numbers: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers, without any table."""
    place = Feistel(n, seed).place(numbers)
    return place % shards, place // shards


def row_at(n: int, shards: int, shard: np.ndarray, slot: np.ndarray, seed: int = 0) -> np.ndarray:
    """Row number that lies at (shard, slot)."""
    return Feistel(n, seed).number(np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64))


def numbered(df: DataFrame, identity: Sequence[str], name: str, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """Number all rows 0..n-1, independent of files, partitions and earlier attempts.

    Rows are counted per value of ``identity`` first, so any number of equal rows is one
    count.  The order is (bucket of a hash of the identity, identity): counts per
    bucket, at most ``buckets`` of them, give each bucket's first number, and a window
    inside the bucket the rest.  Rows with one identity are interchangeable.  Returns one
    row per identity with its first number and its count, and n.
    """
    bucket = F.pmod(F.xxhash64(*identity), F.lit(buckets)).cast("int")
    counts = df.groupBy(*identity).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_bucket", bucket)
    sizes = {r["_bucket"]: r["n"] for r in counts.groupBy("_bucket").agg(F.sum("_copies").alias("n")).collect()}
    total, firsts = 0, [0] * buckets
    for b in range(buckets):
        firsts[b], total = total, total + sizes.get(b, 0)
    before = Window.partitionBy("_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in identity]).rowsBetween(Window.unboundedPreceding, -1)
    listed = F.split(F.lit(",".join(map(str, firsts))), ",").cast("array<bigint>")  # one constant
    first = F.element_at(listed, F.col("_bucket") + 1)
    out = counts.withColumn(name, first + F.coalesce(F.sum("_copies").over(before), F.lit(0)))
    return out.drop("_bucket"), total


def shard(
    docs: DataFrame, shards: int = 8, seed: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Put every row into one of ``shards`` shards; counts differ by one at most (law ``rows``).

    Columns: the id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot
    (gapless from 0 in each shard), row_number and grown_shard (null: this law moves rows
    between shards when their number changes).

    A null text has size 1 and the checksum of no bytes, 0.  Null ids, equal ids and fully
    equal rows each get a place of their own.  An empty table gives an empty result.
    Other columns are not read.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias(id_col),
        (utf8_bytes(text) + 1).alias("size"),
        F.crc32(F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))).alias("text_crc32"),
    )
    identity = [id_col, "size", "text_crc32"]
    counts, n = numbered(rows, identity, "_first")
    copies = counts.withColumn(
        "row_number", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_copies") - 1))
    )

    @F.pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(Feistel(n, seed).place(number.to_numpy()))

    return (
        copies.withColumn("_place", place("row_number"))
        .select(
            *identity,
            F.lit("rows").alias("law"),
            F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
            F.floor(F.col("_place") / F.lit(shards)).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "row_number",
        )
    )
