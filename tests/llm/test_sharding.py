import zlib
from collections import Counter

import numpy as np
import pytest

from curvelab.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection_with_an_inverse(n):
    f = sharding.Feistel(n, seed=9)
    place = f.place(np.arange(n))
    assert sorted(place.tolist()) == list(range(n))
    assert (f.number(place) == np.arange(n)).all()


def test_seeds_give_other_orders():
    assert (sharding.Feistel(1000, 1).place(np.arange(1000)) != sharding.Feistel(1000, 2).place(np.arange(1000))).any()


def test_locate_and_row_at_agree():
    shard, slot = sharding.locate(1003, 8, np.arange(1003), seed=4)
    assert (sharding.row_at(1003, 8, shard, slot, seed=4) == np.arange(1003)).all()


def check(rows, shards):
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts.get(s, 0)))
    assert sorted(r["row_number"] for r in rows) == list(range(len(rows)))


def test_every_row_has_a_place(spark, small):
    docs = spark.createDataFrame([r[:2] for r in small], "doc_id long, text string")
    rows = sharding.shard(docs, 8, seed=17).collect()
    again = sharding.shard(docs.repartition(7), 8, seed=17).collect()
    check(rows, 8)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    text = {r[0]: r[1].encode() for r in small}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in rows)


def test_edges(edges, edge_rows, nothing):
    rows = sharding.shard(edges, 4).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in edge_rows)
    check(rows, 4)
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (0, 1)} == {(1, 0)}
    assert sharding.shard(nothing).count() == 0
