"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class is a Gaussian over transformed statistics of the text.  Its covariance is shrunk
towards the pooled one and towards a multiple of the identity (oracle approximating
shrinkage, in closed form), so a class of few rows stays invertible.  A score is the
difference of the two log densities: Mahalanobis distances by the classes' Cholesky
factors, which are computed once per model and travel with it.

Means and covariances come from sums that tasks combine over all labelled rows; neither
rows nor texts reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelab.llm.common import session, shingle_hashes, span_hashes, text_slices, word_hashes, written

#: Added to every variance, in units of the pooled one.
FLOOR = 1e-3
#: Log density differences are limited to this before the logistic function.
STEEP = 30.0

STATISTICS = (
    "log_words", "word_length", "word_spread", "distinct_share", "repeated_share", "dup_line_share", "symbol_share", "upper_share",
    "digit_share", "mark_share", "letter_share", "other_share", "line_length", "byte_entropy",
)

_KINDS = np.full(256, 6, dtype=np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0
_KINDS[97:123] = 1
_KINDS[65:91] = 2
_KINDS[48:58] = 3
_KINDS[list(b".,;:!?'\"()-")] = 4
_KINDS[128:] = 1
_KINDS[list(b"#*$%&|<>")] = 5


def _share(x: np.ndarray, floor: float = 1e-3) -> np.ndarray:
    """Logit of a share, finite at 0 and 1."""
    x = np.clip(x, 0, 1)
    return np.log((x + floor) / (1 - x + floor))


def _sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, values, rows) if len(row) else np.zeros(rows)


def _again(value: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, distinct values) per row."""
    if not len(row):
        return np.zeros(rows), np.zeros(rows)
    order = np.lexsort((value, row))
    v, r = value[order], row[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r, minlength=rows).astype(float), np.bincount(r, new, rows)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics of rows that lie back to back; a row without text has zeros."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets).astype(float)
    at = np.repeat(np.arange(rows), np.diff(offsets))
    histogram = np.bincount(at * 256 + data, minlength=rows * 256).reshape(rows, 256)
    kinds = np.stack([histogram[:, _KINDS == k].sum(axis=1) for k in range(7)])
    solid = np.maximum(sizes - kinds[0], 1)
    words, row, start, end = word_hashes(data, offsets)
    n, distinct = _again(words, row, rows)
    length = (end - start).astype(float)
    many = np.maximum(n, 1)
    mean = _sums(length, row, rows) / many
    spread = np.sqrt(np.maximum(_sums(length**2, row, rows) / many - mean**2, 0))
    grams = shingle_hashes(words, 3)
    whole = row[: len(grams)] == row[2:] if len(grams) else np.empty(0, bool)
    g, different = _again(grams[whole], row[: len(grams)][whole], rows)
    lines, unlike = _lines(data, offsets)
    p = histogram / np.maximum(sizes, 1)[:, None]
    entropy = -(p * np.log2(np.maximum(p, 1e-12))).sum(axis=1)
    out = np.stack([
        np.log1p(n), np.log1p(mean), np.log1p(spread), _share(distinct / many), _share((g - different) / np.maximum(g, 1)),
        _share((lines - unlike) / np.maximum(lines, 1)), _share(kinds[5] / solid), _share(kinds[2] / solid), _share(kinds[3] / solid),
        _share(kinds[4] / solid), _share(kinds[1] / solid), _share(kinds[6] / solid), np.log1p(n / np.maximum(lines, 1)), entropy,
    ], axis=1)
    out[n == 0] = 0.0
    return out


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a character other than a line break, and distinct ones, per row."""
    inside = data != 0x0A
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    begin[cuts] = inside[cuts]
    start = np.flatnonzero(begin)
    stops = np.union1d(np.flatnonzero(~inside), offsets)
    end = stops[np.searchsorted(stops, start, "right")]
    row = np.searchsorted(offsets, start, side="right") - 1
    return _again(span_hashes(data, start, end), row, len(offsets) - 1)


# ---------------------------------------------------------------- the model


@dataclass
class Discriminant:
    """Means, Cholesky factors and log priors of the classes 0 and 1."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    priors: list[float]
    constants: list[float] = field(init=False)

    def __post_init__(self) -> None:
        self.constants = [math.log(p) - float(np.log(np.diag(f)).sum()) for p, f in zip(self.priors, self.factors)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of every row."""
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants):
            z = np.linalg.solve(factor, (x - mean).T)  # triangular
            logs.append(constant - 0.5 * (z * z).sum(axis=0))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -STEEP, STEEP)))


def shrunk(cov: np.ndarray, n: float) -> np.ndarray:
    """Oracle approximating shrinkage of a covariance towards a multiple of the identity."""
    d = len(cov)
    trace, square = float(np.trace(cov)), float((cov * cov).sum())
    below = (n + 1 - 2 / d) * (square - trace**2 / d)
    weight = 1.0 if below <= 0 else min(1.0, ((1 - 2 / d) * square + trace**2) / below)
    return (1 - weight) * cov + weight * trace / d * np.eye(d)


def solve(counts: list[float], sums: list[np.ndarray], squares: list[np.ndarray]) -> Discriminant | None:
    """The model from per-class counts, sums and sums of outer products; None without both classes."""
    if min(counts) < 2:
        return None
    d, n = len(sums[0]), sum(counts)
    means = [s / c for s, c in zip(sums, counts)]
    covs = [q / c - np.outer(m, m) for q, c, m in zip(squares, counts, means)]
    pooled = sum(c * v for c, v in zip(counts, covs)) / n
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
    unit = np.outer(scale, scale)
    factors = []
    for c, cov in zip(counts, covs):
        lean = d / (d + c)  # a class with few rows leans on the pooled covariance
        mixed = shrunk(((1 - lean) * cov + lean * pooled) / unit, c) + FLOOR * np.eye(d)
        factors.append(np.linalg.cholesky(mixed * unit))
    return Discriminant(means, factors, [c / n for c in counts])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [statistics(data, offsets) for _, _, data, offsets in text_slices(batch.column("_text"))]
        if parts:
            x = np.concatenate(parts)
            flat = pa.array(x.ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "x"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) of every row: its statistics in the order of ``STATISTICS``."""
    session(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(_measure, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, x array<double>")


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one task: rows (label, place, value), place 0 the count, then sums, then products."""
    d = len(STATISTICS)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            for label in (0, 1):
                own = x[y == label]
                total[label, 0] += len(own)
                total[label, 1 : 1 + d] += own.sum(axis=0)
                total[label, 1 + d :] += (own.T @ own).ravel()
    label, place = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(label, pa.int64()), pa.array(place, pa.int64()), pa.array(total[label, place])], names=["label", "place", "value"])


def train(labelled: DataFrame) -> Discriminant | None:
    """Fit on all rows (x, label) with labels 0 and 1."""
    d = len(STATISTICS)
    sums = labelled.select("x", F.col("label").cast("long").alias("label")).mapInArrow(_partial, "label long, place long, value double")
    total = np.zeros((2, 1 + d + d * d))
    for r in sums.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        total[r["label"], r["place"]] = r["value"]
    return solve(total[:, 0].tolist(), list(total[:, 1 : 1 + d]), [q.reshape(d, d) for q in total[:, 1 + d :]])


def predict(stats: DataFrame, model: Discriminant | None) -> DataFrame:
    """The rows with ``x`` replaced by score and predicted; 0.5 and 1 where nothing was learned."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                score = np.round(shared.value.scores(x), 12) if shared.value is not None else np.full(len(x), 0.5)
                kept = [i for i, n in enumerate(batch.schema.names) if n != "x"]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i) for i in kept], pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=[*[batch.schema.names[i] for i in kept], "score", "predicted"],
                )

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields if f.name != "x"]
    return stats.mapInArrow(run, ", ".join([*kinds, "score double", "predicted int"]))


def classify(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score, predicted) of every row; the model learns from labels whose id is ``usable``.

    Labels of one id are taken together (the smallest); null labels, null ids and labels
    without a document are not used.  Null and empty texts have all statistics zero and are
    scored like others.  Rows with null or equal ids are all kept; an empty table gives an
    empty result; other columns are not read.
    """
    stats = written(measured(docs, id_col, text_col), "statistics")
    known = labels.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{label_col}`").alias("label")).filter(usable)
    known = known.groupBy(id_col).agg(F.min("label").alias("label")).filter(F.col(id_col).isNotNull() & F.col("label").isin(0, 1))
    return predict(stats, train(stats.join(known, id_col)))
