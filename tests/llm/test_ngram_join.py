import random

import numpy as np
import pytest

from curvelab.llm import ngram_join
from curvelab.llm.components import components
from tests.llm.brute import components as brute


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_search_equals_pairwise_comparison():
    gen = np.random.default_rng(3)
    base = [np.unique(gen.integers(0, 1 << 60, int(n)).astype(np.uint64)) for n in gen.integers(1, 60, 12)]
    sets = []
    for s in base:
        for _ in range(8):
            own = s[gen.random(len(s)) > gen.choice([0, 0.02, 0.1, 0.3])]
            sets.append(np.union1d(own, gen.integers(0, 1 << 60, int(gen.integers(0, 4))).astype(np.uint64)))
    lists = ngram_join.InvertedLists(sets)
    for q in sets:
        want = []
        for i, s in enumerate(sets):
            shared = len(np.intersect1d(q, s))
            if len(q) and shared and 100 * shared >= 80 * (len(q) + len(s) - shared):
                want.append(i)
        assert lists.search(q, 0.8) == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[201] == 200


def test_given_documents(spark, small):
    rows = [r[:2] for r in small]
    assert rows_of(ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(brute(rows), key=str)


@pytest.fixture(scope="module")
def crowd():
    """Large groups: copies of copies at all distances, and texts that share a passage only."""
    gen = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "mnopqrst"]
    say = lambda n: [gen.choice(vocabulary) + gen.choice(vocabulary) for _ in range(n)]
    rows, base, passage = [], say(150), say(45)
    for i in range(500):
        text = base[:]
        for _ in range(gen.choice([0, 1, 2, 3, 4, 6, 8, 12])):
            text[gen.randrange(len(text))] = say(1)[0]
        rows.append((i, " ".join(text)))
    for i in range(500, 700):
        rows.append((i, " ".join(say(gen.randrange(5, 60)) + passage)))
    for i in range(700, 760):
        rows.append((i, " ".join(base)))
    chain = say(120)
    for i in range(760, 790):  # each near its neighbour, far from the first
        chain = chain[6:] + say(6)
        rows.append((i, " ".join(chain)))
    return rows


def test_large_groups_and_small_slices(spark, crowd, monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE", 32)
    monkeypatch.setattr(ngram_join, "BUCKET_TOKENS", 4096)
    docs = spark.createDataFrame(crowd, "doc_id long, text string").repartition(5)
    assert rows_of(ngram_join.link(docs)) == sorted(brute(crowd), key=str)


def test_representatives(spark, small):
    rows = [r[:2] for r in small]
    leads = {c for _, _, c in brute(rows)}
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in ngram_join.representatives(docs).collect()) == sorted(leads)


def test_representatives_without_ids(spark, small):
    base = max((r[1] for r in small), key=len)
    words = base.split(" ")
    near = " ".join([*words[:-2], "other", "end"])
    rows = [(None, base), (None, base), (None, near), (5, "one two three"), (None, "one two three"), (None, "alone"), (None, ""), (None, None), (None, ""), (7, None)]
    kept = ngram_join.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept if r["text"] not in (base, near)), key=str) == sorted([(5, "one two three"), (None, "alone"), (None, ""), (None, None), (7, None)], key=str)
    assert sum(r["text"] in (base, near) for r in kept) == 1


def test_representatives_of_shared_ids(spark):
    """One id over many rows: near copies under it go, and so does a copy led by another id."""
    say = lambda k: " ".join(f"{k}{i}" for i in range(60))
    a, near_a, c, near_c = say("a"), say("a") + " end", say("c"), say("c") + " end"
    rows = [(5, a), (5, near_a), (5, near_a), (5, c), (3, near_c), (None, c), (5, say("d")), (5, ""), (5, None), (5, None), (4, "")]
    kept = [tuple(r) for r in ngram_join.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum(r in ((5, a), (5, near_a)) for r in kept) == 1
    rest = [r for r in kept if r not in ((5, a), (5, near_a))]
    assert sorted(rest, key=str) == sorted([(3, near_c), (5, say("d")), (5, ""), (5, None), (4, "")], key=str)


def test_edges(spark, edges, edge_rows, nothing):
    got = rows_of(ngram_join.link(edges))
    want = []
    for i, n, c in brute([r[:2] for r in edge_rows]):
        want.append((i, n, c if n else i))
    assert got == sorted(want, key=str)
    assert ngram_join.link(nothing).count() == 0
    assert ngram_join.representatives(nothing).count() == 0
    assert ngram_join.representatives(edges).columns == edges.columns


@pytest.mark.parametrize("exact", [False, True])
def test_pairs_at_the_threshold(spark, crowd, monkeypatch, exact):
    """Pairs at exactly 0.8 (80 shingles shared of 100), some just below, and the large groups."""
    monkeypatch.setattr(ngram_join, "SLICE", 16)
    gen = random.Random(21)
    say = lambda n: [f"{gen.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(200):
        words = say(94)
        kept = 84 if i % 2 else 83
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:kept] + say(94 - kept)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link(docs, exact=exact).collect()}
    assert all(got[2 * i + 1] == (2 * i if i % 2 else 2 * i + 1) for i in range(200))
    docs = spark.createDataFrame(crowd, "doc_id long, text string").repartition(7)
    assert rows_of(ngram_join.link(docs, exact=exact)) == sorted(brute(crowd), key=str)
