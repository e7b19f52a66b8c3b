"""Join of texts by the Jaccard similarity of their word shingles: T-occurrence search.

A text that shares at least T of a query's shingles occurs at least T times on the query's
inverted lists.  DivideSkip splits these lists: the L longest are set apart, the short ones
are merged with a heap, and what occurs T - L times there is probed in the long ones by
binary search.

Around the search:

1. Texts with one shingle set become one node (digest of the set).
2. Nodes meet in blocks: bands of a MinHash signature of the set.  ``ROWS`` and ``BANDS``
   are chosen so that two sets at exactly 0.8 share no block with probability 3e-8.  With
   ``exact`` the blocks are prefixes, and no pair is missed: every text deals its smallest shingle
   hashes, all below ``SAMPLED`` of their range and at least the ``n - ceil(0.8 n) + 1`` smallest, of
   which two linked sets share one.  Of the shingles below the sample's border a partner
   lacks ``n - ceil(0.8 n)`` at most; a node that shares fewer of them leaves.
3. A node with more than ``n - ceil(0.8 n)`` shingles that no other node in any block has
   cannot reach T with anyone and leaves.
4. First every block's most central node is searched against the block, which joins most
   copies with work in proportion to the block.
5. In blocks whose nodes are not all joined by then, the nodes outside the largest
   component are searched against all others, in cells of bounded slices.

Links are verified on whole sets; pairs inside one component are not compared further,
as they change nothing.  A block that holds a third of all rows is cut into slices, so no
task gets it whole.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelab.llm.common import THRESHOLD, fresh, mix, session, shingle_sets, text_slices, written
from curvelab.llm.components import components

#: Minimum hashes per band, and bands.
ROWS, BANDS = 3, 24
#: Share of all shingles that is compared before whole sets are, where no pair may be missed.
SAMPLED = 0.3
#: Nodes on one side of a cell.
SLICE = 256
#: Shingles that one task counts at once.
BUCKET_TOKENS = 1 << 20


# ---------------------------------------------------------------- T-occurrence search


class InvertedLists:
    """Shingle -> sorted positions of the sets that have it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.tokens, self.owners = flat[order], owner[order]

    def search(self, query: np.ndarray, threshold: float) -> list[int]:
        """Positions of all sets whose Jaccard similarity with ``query`` reaches the threshold."""
        n = len(query)
        least = math.ceil(threshold * n - 1e-9)  # the overlap is at least this share of the union
        low = np.searchsorted(self.tokens, query, "left")
        high = np.searchsorted(self.tokens, query, "right")
        there = high > low
        low, high = low[there], high[there]
        if not n or len(low) < least:
            return []
        by_length = np.argsort(high - low, kind="stable")
        low, high = low[by_length], high[by_length]
        longest = int(high[-1] - low[-1])
        apart = min(least - 1, int(least / (0.01 * math.log2(longest + 1) + 1)))
        cut = len(low) - apart
        merged = heapq.merge(*(self.owners[a:b].tolist() for a, b in zip(low[:cut].tolist(), high[:cut].tolist())))
        found, current, seen = [], -1, 0
        for owner in merged:
            if owner != current:
                if seen >= least - apart:
                    found.append((current, seen))
                current, seen = owner, 0
            seen += 1
        if seen >= least - apart:
            found.append((current, seen))
        out = []
        for owner, seen in found:
            needed = self._needed(n, int(self.sizes[owner]), threshold)
            if needed > min(n, self.sizes[owner]) or seen + apart < needed:
                continue
            if seen + self._probe(low[cut:], high[cut:], owner) >= needed:
                out.append(owner)
        return out

    @staticmethod
    def _needed(n: int, m: int, threshold: float) -> int:
        """Smallest overlap of sets of n and m with the Jaccard similarity asked for."""
        return math.ceil(threshold * (n + m) / (1 + threshold) - 1e-9)

    def _probe(self, low: np.ndarray, high: np.ndarray, owner: int) -> int:
        """Lists that hold ``owner``: one binary search in each, all steps side by side."""
        low, stop = low.copy(), high
        high = high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            less = open_ & (self.owners[np.minimum(middle, len(self.owners) - 1)] < owner)
            low = np.where(less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        inside = low < stop
        return int(np.count_nonzero(self.owners[low[inside]] == owner))


# ---------------------------------------------------------------- passes over the texts


_BORDER = np.uint64(int(SAMPLED * (1 << 64)))
_PREFIX, _SAMPLE = 1 << 30, 1 << 29
#: Owner of a hash that several nodes of a batch have.
_MANY = _SAMPLE - 1
SALTS = 16


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * ROWS * BANDS + 1, dtype=np.uint64))
    return base[: ROWS * BANDS] | np.uint64(1), base[ROWS * BANDS :]


def _bands(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Band keys of every non-empty set."""
    factors, shifts = _permutations()
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.zeros((len(starts), BANDS), dtype=np.uint64)
    if not len(starts):
        return out
    with np.errstate(over="ignore"):
        for i, (factor, shift) in enumerate(zip(factors, shifts)):
            lowest = np.minimum.reduceat(grams * factor + shift, starts)
            out[:, i // ROWS] = mix(out[:, i // ROWS] * np.uint64(31) + mix(lowest + np.uint64(i)))
    return out


def _node(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _short(node: bytes) -> int:
    """The first half of a digest, which stands for the node where blocks are found."""
    return int.from_bytes(node[:8], "little", signed=True)


def _sign(exact: bool):
    """(id, row keys, text) to (id, row keys, n, shingles in the sample, node, its short form, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sampled, nodes, keys = [], [], [], []
            for first, last, data, offsets in text_slices(batch.column("text")):
                grams, bounds = shingle_sets(data, offsets)
                bands = None if exact else iter(_bands(grams, bounds).astype(np.int64))
                for i in range(last - first):
                    own = grams[bounds[i] : bounds[i + 1]]
                    n.append(len(own))
                    sampled.append(int(np.searchsorted(own, _BORDER)))
                    nodes.append(_node(own) if len(own) else None)
                    keys.append(next(bands) if bands is not None and len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], pa.array(n, pa.int64()), pa.array(sampled, pa.int64()), pa.array(nodes, pa.binary()),
                    pa.array([None if x is None else _short(x) for x in nodes], pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["id", "row1", "row2", "n", "sampled", "node", "short", "bands"],
            )

    return run


def _prefixes(buckets: int, threshold: float):
    """Texts to rows (bucket, nodes, keys, owners): the smallest shingle hashes dealt out by another hash.

    ``nodes`` are short forms, ``keys`` 32 bits of the other hash beside its bucket, ``owners`` places
    in ``nodes`` with a mark for hashes of the prefix and one for those of the sample.  Equal
    sets of a batch are dealt once.  A hash that several nodes of the batch have is dealt once and
    owned by ``_MANY``; its owners go to one of ``SALTS`` buckets beside, so that a frequent hash
    costs its bucket one entry a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, parts, marks = [], [], []
            seen: set[int] = set()
            for first, last, data, offsets in text_slices(batch.column("text")):
                grams, bounds = shingle_sets(data, offsets)
                for i in range(last - first):
                    own = grams[bounds[i] : bounds[i + 1]]
                    if not len(own) or (short := _short(_node(own))) in seen:
                        continue
                    seen.add(short)
                    prefix, sampled = len(own) - math.ceil(threshold * len(own) - 1e-9) + 1, int(np.searchsorted(own, _BORDER))
                    size = max(prefix, sampled)
                    mark = np.zeros(size, np.int32)
                    mark[:prefix] |= _PREFIX
                    mark[:sampled] |= _SAMPLE
                    marks.append(mark | len(nodes))
                    parts.append(own[:size])
                    nodes.append(short)
            if not nodes:
                continue
            mixed, owners = mix(np.concatenate(parts) ^ np.uint64(0xA5A5)), np.concatenate(marks)
            keys = ((mixed % np.uint64(buckets)) << np.uint64(32)) | (mixed >> np.uint64(32))
            order = np.argsort(keys, kind="stable")
            keys, owners = keys[order], owners[order]
            begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            size = np.diff(np.append(begins, len(keys)))
            common = np.repeat(size, size) > 1
            names, out = np.array(nodes, np.int64), []
            salt = 1 + nodes[0] % SALTS
            own = np.where(size > 1, (np.bitwise_or.reduceat(owners, begins) & ~_MANY) | _MANY, owners[begins]).astype(np.int32)
            for base, k, o in ((0, keys[begins], own), (salt * buckets, keys[common], owners[common])):
                cuts = np.searchsorted(k >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    out.append((base + b, *_entry(names, k[cuts[b] : cuts[b + 1]], o[cuts[b] : cuts[b + 1]])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                names=["bucket", "nodes", "keys", "owners"],
            )

    return run


def _entry(names: np.ndarray, keys: np.ndarray, owners: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Keys and owners with the names that these use, as bytes."""
    place = owners & _MANY
    used = np.unique(place[place != _MANY])
    renamed = np.where(place == _MANY, _MANY, np.searchsorted(used, place))
    return names[used].tobytes(), keys.astype(np.uint32).tobytes(), ((owners & ~_MANY) | renamed).astype(np.int32).tobytes()


def _meet(buckets: int):
    """(short, shared): sampled hashes that a node has in common with others; (short, key): prefix hashes that other prefixes have."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        names = [np.frombuffer(x, np.int64) for x in group.column("nodes").to_pylist()]
        marks = [np.frombuffer(x, np.int32) for x in group.column("owners").to_pylist()]
        keys = np.concatenate([np.frombuffer(x, np.uint32) for x in group.column("keys").to_pylist()]).astype(np.uint64)
        shorts, number = np.unique(np.concatenate(names), return_inverse=True)
        bases = np.concatenate(([0], np.cumsum([len(x) for x in names])))
        number = np.append(number, len(shorts))
        place = np.concatenate([np.where((m & _MANY) == _MANY, bases[-1], (m & _MANY) + base) for m, base in zip(marks, bases)])
        node, mark = number[place].astype(np.uint64), np.concatenate(marks) & ~_MANY
        # A node that came from several batches counts once.
        both = (keys << np.uint64(32)) | node
        order = np.argsort(both, kind="stable")
        both, mark = both[order], mark[order]
        once = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        mark, keys, node = np.bitwise_or.reduceat(mark, once), both[once] >> np.uint64(32), (both[once] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        many = node == len(shorts)
        begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(begins, len(keys)))
        owned = lambda flags: np.repeat(np.add.reduceat(np.where(flags, 1 + many, 0), begins), size)
        first, whole = (mark & _PREFIX) > 0, np.ones(len(keys), dtype=bool)
        if bucket >= buckets:  # hashes that several nodes of one batch have
            shared = block = whole
        else:
            shared, block = owned(whole) > 1, owned(first) > 1
        counts = np.bincount(node[shared & ~many & ((mark & _SAMPLE) > 0)], minlength=len(shorts))
        some = np.flatnonzero(counts)
        # Hashes of the same owners are one block: its key is made of the owners where all are known here.
        with np.errstate(over="ignore"):
            named = np.where(first, mix(np.append(shorts, 0)[node].astype(np.uint64)), np.uint64(0))
            owners = mix(np.bitwise_xor.reduceat(named, begins) ^ mix(np.add.reduceat(named * np.uint64(0x9E3779B97F4A7C15), begins)))
        own = (np.uint64(bucket % buckets) << np.uint64(32)) | keys
        apart = np.repeat(np.bitwise_or.reduceat(many, begins), size) if bucket < buckets else whole
        key = np.where(apart, own, np.repeat(owners, size))
        met = np.flatnonzero(first & block & ~many)
        pairs = np.unique(np.stack((node[met].astype(np.uint64), key[met]), 1), axis=0)
        return pa.table({
            "short": pa.array(np.concatenate((shorts[some], shorts[pairs[:, 0].astype(np.int64)])), pa.int64()),
            "shared": pa.array([*counts[some].tolist(), *[None] * len(pairs)], pa.int64()),
            "key": pa.array([*[None] * len(some), *pairs[:, 1].astype(np.int64).tolist()], pa.int64()),
        })

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, n, tokens): the sorted shingle hashes as bytes."""
    for batch in batches:
        n, tokens = [], []
        for first, last, data, offsets in text_slices(batch.column("text")):
            grams, bounds = shingle_sets(data, offsets)
            for i in range(last - first):
                tokens.append(grams[bounds[i] : bounds[i + 1]].tobytes())
                n.append(int(bounds[i + 1] - bounds[i]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("node").cast(pa.binary()), pa.array(n, pa.int64()), pa.array(tokens, pa.binary())], names=["node", "n", "tokens"]
        )


def _deal(buckets: int):
    """(node, n, tokens) to rows (bucket, nodes, tokens, owners): tokens dealt out by hash.

    A token that several nodes of the batch have is sent once and owned by none, so a
    frequent token costs one entry per batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column("node").to_pylist()
            sets = [np.frombuffer(t, np.uint64) for t in batch.column("tokens").to_pylist()]
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
            token, first, count = np.unique(flat, return_index=True, return_counts=True)
            owner = np.where(count > 1, -1, owner[first]).astype(np.int32)
            # sorted tokens: buckets are ranges of the hash
            edges = np.arange(1, buckets, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // buckets)
            cuts = np.concatenate(([0], np.searchsorted(token, edges), [len(token)]))
            where = np.flatnonzero(np.diff(cuts)).tolist()
            named = b"".join(nodes)
            out = []
            for b in where:
                own = owner[cuts[b] : cuts[b + 1]]
                used, renamed = np.unique(own[own >= 0], return_inverse=True)
                own = own.copy()
                own[own >= 0] = renamed
                out.append((b, b"".join(named[16 * u : 16 * u + 16] for u in used.tolist()), token[cuts[b] : cuts[b + 1]].tobytes(), own.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                names=["bucket", "nodes", "tokens", "owners"],
            )

    return run


def _private(group: pa.Table) -> pa.Table:
    """One bucket: how many of its tokens each node has alone."""
    tokens = [np.frombuffer(t, np.uint64) for t in group.column("tokens").to_pylist()]
    owners = [np.frombuffer(o, np.int32) for o in group.column("owners").to_pylist()]
    names = group.column("nodes").to_pylist()
    bases = np.concatenate(([0], np.cumsum([len(x) // 16 for x in names])))
    owner = np.concatenate([np.where(o >= 0, o + base, -1) for o, base in zip(owners, bases)])
    _, first, count = np.unique(np.concatenate(tokens), return_index=True, return_counts=True)
    single = owner[first[count == 1]]
    per_node = np.bincount(single[single >= 0], minlength=bases[-1])
    joined = b"".join(names)
    some = np.flatnonzero(per_node)
    return pa.table({
        "node": pa.array([joined[16 * i : 16 * i + 16] for i in some.tolist()], pa.binary()),
        "private": pa.array(per_node[some], pa.int64()),
    })


def _cell(threshold: float):
    """Search the queries of one cell in the inverted lists of its other sets."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.select(["asks", "node", "part", "tokens"]).to_pydict()
        sets = [np.frombuffer(t, np.uint64) for t in rows["tokens"]]
        index = [i for i, asks in enumerate(rows["asks"]) if not asks]
        lists = InvertedLists([sets[i] for i in index])
        a, b = [], []
        for q, asks in enumerate(rows["asks"]):
            if asks:
                for hit in lists.search(sets[q], threshold):
                    i = index[hit]
                    if rows["part"][i] != rows["part"][q]:
                        a.append(rows["node"][q])
                        b.append(rows["node"][i])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


# ---------------------------------------------------------------- the join


def link(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """Component of every row under the links: id, n_shingles, component_id.

    Words are what stands between ASCII white space, A-Z lower-cased; a text's set are its
    distinct five-word shingles, or its whole word sequence where it has fewer words.  Two
    rows are linked when the Jaccard similarity of their sets is at least ``threshold``;
    component_id is the smallest id reachable by links.  ``exact`` takes prefixes for blocks,
    which miss no pair and move several times as much.

    A null or empty text, or one without words, has no shingles and is its own component.
    Rows with a null id take part, and have a null component_id only if no row of the
    component has an id.  Equal ids and equal rows are all kept.  An empty table gives an
    empty result.  Other columns are not read.
    """
    found = _components(docs, threshold, id_col, text_col, exact)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _components(docs: DataFrame, threshold: float, id_col: str, text_col: str, exact: bool = False) -> DataFrame:
    """(id, row2, n, part, component_id) of every row; part is null where there are no shingles."""
    session(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("row1"), F.xxhash64(text).alias("row2"), text.alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()
    signed = written(rows.mapInArrow(_sign(exact), f"id {kind}, row1 long, row2 long, n long, sampled long, node binary, short long, bands array<long>"), "signed")
    nodes = written(
        signed.filter("n > 0").groupBy("node").agg(
            F.min(F.struct("row1", "row2")).alias("r"), F.first("n").alias("n"), F.first("sampled").alias("sampled"), F.first("short").alias("short"), F.first("bands").alias("bands"),
        ),
        "nodes",
    )
    blocks = _shared(_blocks(rows, nodes, threshold) if exact else nodes.select("node", "n", F.explode("bands").alias("key")))
    sets = _fetch_sets(rows, nodes, blocks)
    blocks = _shared(blocks.drop("size").join(_linkable(sets, threshold), "node", "left_semi"))
    near = written(_search(_central(blocks, threshold), sets, threshold), "near")
    labels = components(near)
    far = written(_search(_unjoined(blocks, labels), sets, threshold), "far")
    if not far.isEmpty():
        labels = components(near.unionByName(far))
    labelled = signed.select("id", "row2", "n", "node").join(labels, "node", "left").select("id", "row2", "n", F.coalesce("label", "node").alias("part"))
    worded = labelled.filter(F.col("part").isNotNull())
    out = worded.join(worded.groupBy("part").agg(F.min("id").alias("component_id")), "part")
    empty = signed.filter("n = 0").select("id", "row2", "n", F.col("node").alias("part"), F.col("id").alias("component_id"))
    return out.select(*empty.columns).unionByName(empty)


def _blocks(rows: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, n, key) of the nodes that may have a partner, and their prefix hashes that other nodes have in theirs."""
    lacking = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9)
    total = nodes.agg(F.sum(F.greatest("sampled", lacking + 1))).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_TOKENS))
    dealt = rows.select("text").mapInArrow(_prefixes(buckets, threshold), "bucket long, nodes binary, keys binary, owners binary")
    met = written(dealt.groupBy("bucket").applyInArrow(_meet(buckets), "short long, shared long, key long"), "met")
    shared = met.filter("key IS NULL").groupBy("short").agg(F.sum("shared").alias("shared"))
    able = nodes.join(shared, "short", "left").filter(F.coalesce("shared", F.lit(0)) >= F.col("sampled") - lacking)
    return met.filter("key IS NOT NULL").select("short", "key").distinct().join(able.select("short", "node", "n"), "short").select("node", "n", "key")


def _shared(blocks: DataFrame) -> DataFrame:
    """Blocks of two nodes or more, with their size; written."""
    sizes = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return written(blocks.join(sizes, "key"), "blocks")


def _fetch_sets(rows: DataFrame, nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(node, n, tokens) of the nodes in blocks, from one text each; written."""
    wanted = nodes.join(blocks.select("node").distinct(), "node", "left_semi").select("r.row1", "r.row2", "node")
    texts = rows.select("row1", "row2", "text").groupBy("row1", "row2").agg(F.first("text").alias("text"))
    return written(texts.join(wanted, ["row1", "row2"]).select("node", "text").mapInArrow(_sets, "node binary, n long, tokens binary"), "sets")


def _linkable(sets: DataFrame, threshold: float) -> DataFrame:
    """Nodes that share enough shingles with others to reach the threshold with anyone."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_TOKENS))
    dealt = sets.mapInArrow(_deal(buckets), "bucket long, nodes binary, tokens binary, owners binary")
    private = dealt.groupBy("bucket").applyInArrow(_private, "node binary, private long").groupBy("node").agg(F.sum("private").alias("private"))
    shares = F.col("n") - F.coalesce("private", F.lit(0))
    return sets.select("node", "n").join(private, "node", "left").filter(shares >= F.ceil(F.lit(threshold) * F.col("n") - 1e-9)).select("node")


def _central(blocks: DataFrame, threshold: float) -> DataFrame:
    """Cells of each block's most central node against the block: (cell, asks, part, node).

    Central is the node whose blocks are the largest: the text the others are copies of.
    """
    weight = blocks.groupBy("node").agg(F.sum(F.log2("size")).alias("weight"))
    weighed = blocks.join(weight, "node")
    centre = weighed.groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("c"))
    pairs = (
        weighed.join(centre, "key")
        .filter((F.col("node") != F.col("c.node")) & (F.least("n", "c.n") >= F.lit(threshold) * F.greatest("n", "c.n") - 1e-9))
        .select(F.col("c.node").alias("centre"), "node")
        .distinct()
    )
    slices = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / F.lit(SLICE)).alias("slices"))
    dealt = pairs.join(slices, "centre").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")))
    asked = dealt.select(F.struct("centre", "slice").alias("cell"), F.lit(False).alias("asks"), F.col("node").alias("part"), "node")
    asking = dealt.select("centre", "slice").distinct().select(F.struct("centre", "slice").alias("cell"), F.lit(True).alias("asks"), F.col("centre").alias("part"), F.col("centre").alias("node"))
    return asked.unionByName(asking)


def _unjoined(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells that compare what the first search left apart within a block.

    Blocks of the same nodes are taken once.  The queries are the nodes outside the
    block's largest component.
    """
    parted = blocks.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("part"))
    told = parted.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.min("part").alias("p1"), F.max("part").alias("p2"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.min("node").alias("low"), F.max("node").alias("high"),
    )
    once = told.filter("p1 <> p2").groupBy("members", "s", "low", "high").agg(F.min("key").alias("key")).select("key", "members")
    parted = written(parted.join(once, "key"), "parted")
    largest = (
        parted.groupBy("key", "part").agg(F.count(F.lit(1)).alias("many"))
        .groupBy("key").agg(F.max(F.struct("many", "part")).alias("m"), F.sum("many").alias("all"))
        .select("key", F.col("m.part").alias("main"), F.ceil((F.col("all") - F.col("m.many")) / F.lit(SLICE)).alias("ways"), F.ceil(F.col("all") / F.lit(SLICE)).alias("slices"))
    )
    dealt = parted.join(largest, "key")
    place = lambda n: F.pmod(F.xxhash64("node"), n)
    whole = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    asking = dealt.filter(F.col("part") != F.col("main")).select("key", place(F.col("ways")).alias("way"), F.explode(whole("slices")).alias("slice"), "part", "node")
    asked = dealt.select("key", F.explode(whole("ways")).alias("way"), place(F.col("slices")).alias("slice"), "part", "node")
    cell = F.struct("key", "way", "slice").alias("cell")
    return asked.select(cell, F.lit(False).alias("asks"), "part", "node").unionByName(asking.select(cell, F.lit(True).alias("asks"), "part", "node"))


def _search(cells: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) found in the cells."""
    return cells.join(sets.select("node", "tokens"), "node").groupBy("cell").applyInArrow(_cell(threshold), "a binary, b binary")


def representatives(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that lead their component; repeats of one row stay once.

    Of each component one text stays under the smallest id, whatever other rows have that id;
    of several texts under it, that of the smallest hash; where no row has an id, one text.
    Rows without shingles are components of their own and stay, repeats once.
    """
    found = written(_components(docs, threshold, id_col, text_col), "components")
    text, lead, digest = F.col(f"`{text_col}`"), fresh(docs, "_lead"), fresh(docs, "_digest")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row2")).alias("r")
    chosen = found.filter("part IS NOT NULL").groupBy("part").agg(first).select("r.id", "r.row2")
    chosen = written(chosen.unionByName(found.filter("part IS NULL").select("id", "row2").distinct()), "chosen")
    told = docs.withColumn(digest, F.xxhash64(text))
    leads = chosen.filter("id IS NOT NULL").select(F.col("id").alias(lead), F.col("row2").alias(fresh(docs, "_row2")))
    named = told.join(leads, (told[id_col] == leads[lead]) & (told[digest] == leads[leads.columns[1]]), "left_semi")  # placed by id and digest, and so are its repeats
    nameless = chosen.filter("id IS NULL").select(F.col("row2").alias(lead))
    kept = told.filter(F.col(f"`{id_col}`").isNull()).join(nameless, F.col(digest) == F.col(lead), "left_semi")
    return named.dropDuplicates([id_col, digest, text_col]).unionByName(kept.dropDuplicates([digest, text_col])).drop(digest)
