"""Vector codes by product quantisation, trained with active-entry Lloyd rounds.

Vectors become whole numbers and are cut into consecutive parts; every part position has a
codebook.  A round keeps each part's entry and its exact squared distance beside the vector.
In the next round a part whose entry stayed where it was compares only the entries that moved
with the stored distance, as no other distance changed; a part whose entry moved is searched
completely.  All numbers are whole, so the result is that of full searches, ties included.

The rows never leave their task: what moves is one sum per part position, entry and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelab.llm.common import session, written
from curvelab.scale import salted_join

STATE = "id {id}, label {label}, n int, v array<int>, code array<int>, dist array<bigint>"
#: Sums below this are exact in double precision, where products of matrices are fast.
_EXACT = 1 << 53


@dataclass(frozen=True)
class Codebooks:
    """``entries[p]`` is (entries, width) of part position p, whole numbers."""

    entries: tuple[np.ndarray, ...]

    @property
    def digest(self) -> str:
        """SHA-256 of all components in order of part, entry and position, joined by commas."""
        flat = ",".join(str(x) for part in self.entries for x in part.ravel().tolist())
        return hashlib.sha256(flat.encode()).hexdigest()

    def decode(self, codes: list[int]) -> list[int]:
        """The vector of whole numbers that the entries of a code make."""
        return [x for part, code in zip(self.entries, codes) for x in part[code].tolist()]


def cuts(length: int, parts: int) -> list[int]:
    """Borders of the parts: equal where the length allows, otherwise one apart."""
    return [p * length // parts for p in range(parts + 1)]


def largest(length: int) -> int:
    """Largest component for which every sum of squared differences fits 64 bits."""
    return int((2**62 / max(length, 1)) ** 0.5) // 2 - 1 if length > 1 << 8 else 1 << 26


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    top = max(int(np.abs(rows).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if rows.shape[1] * (2 * top) ** 2 < _EXACT:
        x, c = rows.astype(np.float64), entries.astype(np.float64)
        out = x @ (-2.0 * c.T)
        out += np.einsum("ij,ij->i", x, x)[:, None]
        out += np.einsum("ij,ij->i", c, c)[None, :]
        return out
    out = np.zeros((len(rows), len(entries)), dtype=np.int64)
    for k in range(rows.shape[1]):
        out += (rows[:, k, None] - entries[None, :, k]) ** 2
    return out


def full_search(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every row, the lower of equals, and its squared distance."""
    found = distances(rows, entries)
    code = found.argmin(axis=1)
    return code, found[np.arange(len(rows)), code].astype(np.int64)


def active_search(
    rows: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, dist: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The same from the last round's entry and distance and the entries moved since (ascending)."""
    code, dist = code.copy(), dist.copy()
    hit = np.isin(code, moved)
    lost = np.flatnonzero(hit)
    if len(lost):
        code[lost], dist[lost] = full_search(rows[lost], entries)
    held = np.flatnonzero(~hit)
    if len(held) and len(moved):
        at, near = full_search(rows[held], entries[moved])
        at = moved[at]
        better = (near < dist[held]) | ((near == dist[held]) & (at < code[held]))
        code[held[better]], dist[held[better]] = at[better], near[better]
    return code, dist


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width) if width else np.zeros((len(column), 0), np.int64)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * width, pa.array(matrix.ravel(), kind))


def _whole(scale: int):
    """Vectors as whole numbers: floor(scale * x).  Rows without a usable vector go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            v = v.cast(pa.large_list(pa.float64())) if pa.types.is_large_list(v.type) else v
            offsets = v.offsets.to_numpy()
            start, end = offsets[:-1], offsets[1:]
            values = v.values.to_numpy(zero_copy_only=False)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            keep = v.is_valid().to_numpy(zero_copy_only=False) & (bad[end] == bad[start])
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(values * scale)
            n = end - start
            rows = np.flatnonzero(keep)
            # largest() by each row's length, never past what an int holds
            sizes, which = np.unique(n, return_inverse=True)
            bound = np.repeat(np.array([largest(int(x)) for x in sizes], dtype=np.float64)[which], n)
            scaled = scaled[offsets[0] : offsets[-1]]
            np.nan_to_num(scaled, copy=False, nan=0.0, posinf=2.0**62, neginf=-(2.0**62))
            whole = np.clip(scaled, -bound, bound).astype(np.int32)
            lists = pa.ListArray.from_arrays((offsets - offsets[0]).astype(np.int32), pa.array(whole, pa.int32()))
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(taken), batch.column("label").take(taken), pa.array(n[rows], pa.int32()), lists.take(taken)],
                names=["id", "label", "n", "v"],
            )

    return run


def _assign(books: Codebooks, moved: list[np.ndarray] | None, borders: list[int]):
    """Entry and distance of every part; ``moved`` is None in the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("v"), borders[-1]).astype(np.int64)
            parts = len(borders) - 1
            codes, dists = np.empty((len(rows), parts), np.int64), np.empty((len(rows), parts), np.int64)
            if moved is not None:
                before, was = _matrix(batch.column("code"), parts), _matrix(batch.column("dist"), parts)
            for p in range(parts):
                x = rows[:, borders[p] : borders[p + 1]]
                if moved is None:
                    codes[:, p], dists[:, p] = full_search(x, books.entries[p])
                else:
                    codes[:, p], dists[:, p] = active_search(x, books.entries[p], moved[p], before[:, p], was[:, p])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "label", "n", "v")), _lists(codes, pa.int32()), _lists(dists, pa.int64())],
                names=["id", "label", "n", "v", "code", "dist"],
            )

    return run


def _sums(borders: list[int], entries: int):
    """One row per part position and entry that a task's rows use: how many, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = len(borders) - 1
        counts = np.zeros((parts, entries), np.int64)
        sums = [np.zeros((entries, borders[p + 1] - borders[p]), np.int64) for p in range(parts)]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, codes = _matrix(batch.column("v"), borders[-1]).astype(np.int64), _matrix(batch.column("code"), parts)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                used, first, n = np.unique(codes[order, p], return_index=True, return_counts=True)
                counts[p, used] += n
                if sums[p].shape[1]:
                    sums[p][used] += np.add.reduceat(rows[order, borders[p] : borders[p + 1]], first, axis=0)
        for p in range(parts):
            used = np.flatnonzero(counts[p])
            width = sums[p].shape[1]
            at = np.tile(np.arange(width, dtype=np.int32), len(used))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(at), p, np.int32)), pa.array(np.repeat(used, width).astype(np.int32)), pa.array(at),
                    pa.array(np.repeat(counts[p, used], width)), pa.array(sums[p][used].ravel()),
                ],
                names=["part", "entry", "at", "n", "total"],
            )

    return run


def _start(vectors: DataFrame, borders: list[int], entries: int) -> Codebooks:
    """The parts of the ``entries`` rows with the smallest ids."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    seed = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), borders[-1])
    return Codebooks(tuple(np.ascontiguousarray(seed[:, a:b]) for a, b in zip(borders, borders[1:])))


def _moved(state: DataFrame, books: Codebooks, borders: list[int]) -> tuple[Codebooks, list[np.ndarray]]:
    """Codebooks of the means, rounded down, and the entries that changed in each."""
    size = len(books.entries[0])
    schema = "part int, entry int, at int, n bigint, total bigint"
    partial = state.select("v", "code").mapInArrow(_sums(borders, size), schema)
    summed = partial.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    after = [part.copy() for part in books.entries]
    for part, entry, at, n, total in summed.collect():  # parts x entries x width numbers, whatever the table
        after[part][entry, at] = total // n
    changed = [np.flatnonzero((a != b).any(axis=1)) for a, b in zip(after, books.entries)]
    return Codebooks(tuple(after)), changed


def compress(
    vectors: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, Codebooks]:
    """(id, label, code, dist) of every usable row, and the codebooks.

    ``code`` has the entry of every part, ``dist`` its squared distance.  Rows go whose vector
    is null or has a null, NaN or infinite component, and rows whose vector is not as long as
    most rows' (of equally many, the longer).  Rows with null or repeated ids are coded like
    all others; the codebooks start from the rows with the smallest ids, nulls last, equal ids
    in order of their vectors, so with fewer rows than ``entries`` there are fewer entries.  A
    length that ``parts`` does not divide gives parts of lengths one apart.  Components whose
    scaled size passes ``largest`` (2**26 up to 256 components) count as that bound, so that
    distances fit 64 bits.  An empty table gives an empty result and empty codebooks.
    Columns other than the three are not read.
    """
    spark = session(vectors.sparkSession)
    fields = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    schema = STATE.format(id=fields[id_col], label=fields[label_col])
    source = vectors.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")
    )
    whole = written(source.mapInArrow(_whole(scale), schema.split(", code")[0]), "vectors")
    lengths = whole.groupBy("n").count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema).select("id", "label", "code", "dist"), Codebooks(tuple(np.zeros((0, 0), np.int64) for _ in range(parts)))
    borders = cuts(lengths[0]["n"], parts)
    rows = whole.filter(F.col("n") == borders[-1])
    books, moved = _start(rows, borders, entries), None
    for _ in range(rounds):
        rows = written(rows.mapInArrow(_assign(books, moved, borders), schema), "codes")
        books, moved = _moved(rows, books, borders)
    return rows.mapInArrow(_assign(books, moved, borders), schema).select("id", "label", "code", "dist"), books


def with_errors(coded: DataFrame, books: Codebooks, id_col: str = "vec_id") -> DataFrame:
    """id, code in hexadecimal, error, error of the label's rows together, digest of the codebooks.

    Null labels are one label.  A label may hold any share of the rows: its error is summed
    before the shuffle, and its rows are dealt to several tasks.  A sum beyond 64 bits is null.
    """
    digits = F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    rows = written(
        coded.select(
            F.col("id").alias(id_col), F.struct("label").alias("_label"), F.array_join(digits, "").alias("code"),
            F.aggregate("dist", F.lit(0).cast("long"), lambda a, d: a + d).alias("error"),
        ), "coded",
    )
    sums = rows.groupBy("_label").agg(F.try_sum("error").alias("label_error"))
    return salted_join(rows, sums, "_label").select(id_col, "code", "error", "label_error", F.lit(books.digest).alias("codebooks_sha256"))
