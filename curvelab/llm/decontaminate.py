"""Short benchmark items inside long documents: size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set (powers of two).  Every partition
has its own sketch length: an item is represented by its k smallest shingle hashes under
a random permutation, a bottom-k MinHash.  An item of n shingles that a document contains
to the degree t lacks at most ``n - ceil(t * n)`` of them there, so at least
``k - (n - ceil(t * n))`` of its sketch stand in the document; k is chosen so that this
is a handful.  The search therefore misses nothing: sketch hits below that number prove
that the containment is smaller.  Documents are partitioned by size as well, as one with
fewer than ``t * n`` shingles cannot contain an item of n.  What remains is verified by
the exact containment of the items' word shingles.

Items are worked through in blocks of a bounded number of shingles; each block is
broadcast, and every document meets every block.  Documents are never shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from curvelab.llm.common import SHINGLE, THRESHOLD, mix, row_shingles, session, shingle_sets, text_slices

#: Bytes of item texts in one block: bounds what is collected and broadcast at once.
BLOCK_BYTES = 8 << 20
#: Sketch hits asked of a document, where the item is long enough.
HITS = 4
_FILTER_BITS = 20

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text: str) -> set[tuple[str, ...]]:
    """Distinct word shingles, A-Z lower-cased; fewer words than a shingle count as one."""
    words = _WORD.findall(text.translate(_FOLD))
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(SHINGLE))))


def missing(n: int, threshold: float) -> int:
    """Shingles that an item of n may lack in a document that contains it."""
    return n - math.ceil(threshold * n - 1e-9)


def sketch_size(n: int, threshold: float) -> int:
    """Sketch length of the size partition that n lies in."""
    upper = (2 << (n.bit_length() - 1)) - 1
    return min(n, missing(upper, threshold) + HITS)


@dataclass
class Block:
    """The sketches of some items, sorted by hash, and what verification needs."""

    ids: list
    texts: list[str]
    threshold: float
    inside: bool = False

    def __post_init__(self) -> None:
        self.brief = self._brief() if self.inside else {}
        apart = {i for _, items in self.brief.values() for i in items.tolist()}
        grams, offsets = np.empty(0, np.uint64), np.zeros(1, np.int64)
        for _, _, data, starts in text_slices(pa.array(self.texts, pa.large_string()), 1 << 62):
            grams, offsets = shingle_sets(data, starts)
        self.sizes = np.diff(offsets)
        hashes, items, self.need = [], [], np.zeros(len(self.ids), np.int64)
        for i, n in enumerate(self.sizes.tolist()):
            if n and i not in apart:
                own = grams[offsets[i] : offsets[i + 1]]
                k = sketch_size(n, self.threshold)
                hashes.append(own[np.argsort(mix(own ^ np.uint64(0x5851F42D4C957F2D)))[:k]])
                items.append(np.full(k, i))
                self.need[i] = k - missing(n, self.threshold)
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        owner = np.concatenate(items) if items else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.items = flat[order], owner[order]
        self.least = np.array([n - missing(n, self.threshold) for n in self.sizes.tolist()], np.int64)
        self.present = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.present[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.exact: dict[int, set] = {}

    def _brief(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By number of words, the items of fewer words than a shingle: sorted hashes, and whose they are."""
        words = [len(_WORD.findall(t)) for t in self.texts]
        out = {}
        for width in range(1, SHINGLE):
            which = [i for i, n in enumerate(words) if n == width]
            for _, _, data, starts in text_slices(pa.array([self.texts[i] for i in which], pa.large_string()), 1 << 62):
                grams, _ = row_shingles(data, starts, width)
                order = np.argsort(grams, kind="stable")
                out[width] = grams[order], np.array(which)[order]
        return out

    def _within(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, item) of the short items whose words stand side by side in a row."""
        for width, (hashes, items) in self.brief.items():
            grams, sizes = row_shingles(data, offsets, width)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            low, high = np.searchsorted(hashes, grams, "left"), np.searchsorted(hashes, grams, "right")
            many = high - low
            if not many.sum():
                continue
            entry = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            rows, found = np.unique(np.stack((np.repeat(owner, many), items[entry])), axis=1).tolist()
            before, own = -1, set()
            for row, i in zip(rows, found):
                if row != before:
                    words = _WORD.findall(data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace").translate(_FOLD))
                    before, own = row, set(zip(*(words[k:] for k in range(width))))
                if tuple(_WORD.findall(self.texts[i].translate(_FOLD))) in own:
                    yield row, i

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of rows with enough of an item's sketch, and large enough to hold it."""
        grams, sizes = row_shingles(data, offsets)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        some = self.present[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
        grams, owner = grams[some], owner[some]
        low, high = np.searchsorted(self.hashes, grams, "left"), np.searchsorted(self.hashes, grams, "right")
        many = high - low
        entry = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        row = np.repeat(owner, many)
        hits = np.unique(np.stack((row, entry)), axis=1)  # a shingle that a row repeats counts once
        pairs, count = np.unique(np.stack((hits[0], self.items[hits[1]])), axis=1, return_counts=True)
        good = (count >= self.need[pairs[1]]) & (sizes[pairs[0]] >= self.least[pairs[1]])
        return pairs[0][good], pairs[1][good]

    def found(self, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, shared shingles, the item's shingles) of all verified pairs."""
        for first, _, data, offsets in text_slices(column):
            for r, i in self._within(data, offsets):
                yield first + r, i, 1, 1
            rows, items = self.candidates(data, offsets)
            before, own = -1, set()
            for r, i in zip(rows.tolist(), items.tolist()):
                if r != before:
                    own = shingles(data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace"))
                    before = r
                if i not in self.exact:
                    self.exact[i] = shingles(self.texts[i])
                asked = self.exact[i]
                shared = len(asked & own)
                if shared >= len(asked) - missing(len(asked), self.threshold):
                    yield first + r, i, shared, len(asked)


def _blocks(items: DataFrame, threshold: float, id_col: str, text_col: str, most: int, inside: bool) -> Iterator[Block]:
    """The items in blocks of about ``most`` bytes of text, one block in memory at a time."""
    rows = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter(F.length("text") > 0)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(total / most))
    place = F.pmod(F.xxhash64("id", "text"), F.lit(count))
    for b in range(count):
        part = rows.filter(place == b).collect() if count > 1 else rows.collect()
        yield Block([r["id"] for r in part], [r["text"] for r in part], threshold, inside)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    inside: bool = False,
) -> DataFrame:
    """All pairs (document, item) where the document holds ``threshold`` of the item's shingles.

    Columns: the two ids, shared, n_shingles (the item's), containment.  Shingles are five
    words with A-Z lower-cased; an item of fewer words is one shingle, and only a document
    that consists of just these words has it; with ``inside`` any document has it where these
    words stand side by side.

    Null or empty texts, on either side, are in no pair.  Rows with null or equal ids are
    searched like others and give a pair each.  Empty tables give an empty result.  Other
    columns are not read.
    """
    spark = session(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    item_type = items.select(F.col(f"`{item_id_col}`")).schema[0].dataType
    kinds = rows.schema[0].dataType.simpleString(), item_type.simpleString()
    schema = f"`{id_col}` {kinds[0]}, `{item_id_col}` {kinds[1]}, shared long, n_shingles long, containment double"
    out = None
    for block in _blocks(items, threshold, item_id_col, item_text_col, block_bytes, inside):
        part = rows.mapInArrow(_pairs(spark.sparkContext.broadcast(block), id_col, item_id_col, to_arrow_type(item_type)), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _pairs(block, id_col: str, item_id_col: str, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work: Block = block.value
        for batch in batches:
            hits = list(work.found(batch.column("_text")))
            if hits:
                row, item, shared, n = zip(*hits)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row)),
                        pa.array([work.ids[i] for i in item], item_type),
                        pa.array(shared, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([x / y for x, y in zip(shared, n)], pa.float64()),
                    ],
                    names=[id_col, item_id_col, "shared", "n_shingles", "containment"],
                )

    return run


def decontaminated(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, inside: bool = False,
) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item; nothing is shuffled.

    ``inside`` as for ``contained_items``.  Rows with a null or empty text stay.
    """
    spark, schema = session(docs.sparkSession), docs.schema
    for block in _blocks(items, threshold, item_id_col, item_text_col, block_bytes, inside):
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(block), text_col), schema)
    return docs


def _clean(block, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work: Block = block.value
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for row, *_ in work.found(batch.column(batch.schema.get_field_index(text_col))):
                keep[row] = False
            yield batch.filter(pa.array(keep))

    return run
