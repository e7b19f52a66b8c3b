import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelab.llm import lloyd
from tests.llm.conftest import rows as table_rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """Full searches over Python integers: (id, code, error, label) and the codebooks."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], [[] for _ in range(parts)]
    width = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * width : (p + 1) * width] for r in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for turn in range(rounds + 1):
        found = [[nearest(v[p * width : (p + 1) * width], books[p]) for p in range(parts)] for _, v, _ in kept]
        if turn == rounds:
            break
        for p in range(parts):
            members = defaultdict(list)
            for (_, v, _), f in zip(kept, found):
                members[f[p][1]].append(v[p * width : (p + 1) * width])
            for k, vs in members.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs)]
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), label) for (i, _, label), f in zip(kept, found)], books


def check(spark, rows, **how):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = lloyd.with_errors(*lloyd.compress(frame, **how)).collect()
    want, books = brute(rows, **how)
    per_label = Counter()
    for _, _, error, label in want:
        per_label[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    assert Counter(map(tuple, out)) == Counter((i, code, error, per_label[label], digest) for i, code, error, label in want)


@pytest.fixture(scope="module")
def vectors():
    return [(i, v, label) for i, v, label in table_rows("embeddings")]


def test_equal_to_full_searches(spark, vectors):
    check(spark, [(i, v[:16], label) for i, v, label in vectors], entries=16)


def test_more_vectors_than_entries_and_whole_width(spark, vectors):
    check(spark, vectors, entries=256)


def test_ties_repeated_rows_nulls_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    grid = [(i, (rng.integers(-2, 3, 8) / 1024).tolist(), [None, 1, 2][i % 3]) for i in range(300)]
    odd = [(5, None, 1), (6, [None] + [0.0] * 7, 1), (7, [math.nan] * 8, 1), (8, [math.inf] + [0.0] * 7, None), (None, [0.001] * 8, None)]
    check(spark, grid + grid[:50] + odd, entries=8)
    check(spark, grid[:5] + odd, entries=8)
    check(spark, odd[:4], entries=8)


def test_rows_of_another_length_go(spark):
    rows = [(0, [1.0] * 4, 1), (1, [0.0] * 8, 1), (2, [0.5] * 8, 1), (3, [], 1)]
    out = lloyd.with_errors(*lloyd.compress(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted(r["vec_id"] for r in out) == [1, 2] and all(r["error"] == 0 for r in out)


def test_huge_components_count_as_the_bound(spark):
    rows = [(i, [x] * 64, 1) for i, x in enumerate([3e38, -3e38, 0.25, 65536.0])]
    out = {r["vec_id"]: r for r in lloyd.with_errors(*lloyd.compress(spark.createDataFrame(rows, SCHEMA), entries=1)).collect()}
    assert len(out) == 4 and all(r["error"] >= 0 for r in out.values())


def test_empty_table_and_clashing_columns(spark, vectors):
    frame = spark.createDataFrame(vectors[:40], SCHEMA)
    clash = frame.withColumns({n: F.lit("x") for n in ("id", "v", "n", "code", "dist", "_label", "error")})
    plain = lloyd.with_errors(*lloyd.compress(frame, entries=4)).collect()
    assert Counter(lloyd.with_errors(*lloyd.compress(clash, entries=4)).collect()) == Counter(plain)
    coded, books = lloyd.compress(frame.limit(0))
    assert lloyd.with_errors(coded, books).count() == 0 and books.digest == hashlib.sha256(b"").hexdigest()


def test_active_search_is_a_full_search():
    rng = np.random.default_rng(11)
    for trial in range(50):
        rows, before = rng.integers(-3, 4, (60, 3)), rng.integers(-3, 4, (9, 3))
        after = before.copy()
        moved = np.sort(rng.choice(9, trial % 10, replace=False))
        after[moved] = rng.integers(-3, 4, (len(moved), 3))
        got = lloyd.active_search(rows, after, moved, *lloyd.full_search(rows, before))
        assert all((a == b).all() for a, b in zip(got, lloyd.full_search(rows, after)))


def test_distances_are_exact_for_large_numbers():
    rows, entries = np.array([[2**26, -(2**26)] * 8]), np.array([[-(2**26) + 1, 2**26] * 8])
    assert int(lloyd.distances(rows, entries)[0, 0]) == 8 * ((2**27 - 1) ** 2 + 2**54)


def test_decode():
    books = lloyd.Codebooks((np.array([[1, 2], [3, 4]]), np.array([[5], [6]])))
    assert books.decode([1, 0]) == [3, 4, 5]
