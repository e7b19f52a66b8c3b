import random

from curvelab.llm import decontaminate
from tests.conftest import SMALL
from tests.llm.brute import contained, shingles
from tests.llm.conftest import rows


def found(df):
    return sorted((r["doc_id"], r["item_id"], r["shared"], r["n_shingles"]) for r in df.collect())


def test_query_equals_brute_force(spark, small):
    from curvelab.llm.queries import op4_benchmark_containment

    assert found(op4_benchmark_containment(spark, SMALL)) == sorted(contained([r[:2] for r in small], rows("benchmark")))


def test_partial_items_in_long_documents_and_several_blocks(spark):
    gen = random.Random(4)
    say = lambda n: [gen.choice("abcdefghij") + gen.choice("klmnopqrst") + str(gen.randrange(30)) for _ in range(n)]
    items = [(i, " ".join(say(gen.choice([1, 3, 5, 6, 9, 20, 45, 150])))) for i in range(60)]
    docs = []
    for d in range(200):
        text = say(gen.randrange(0, 300))
        for _ in range(gen.randrange(3)):
            own = items[gen.randrange(60)][1].split()
            cut = gen.choice([0, 0, 1, 2, 5])
            own = [w.upper() for w in own[cut : len(own) - gen.choice([0, 0, 1, 3])]]
            if own and gen.random() < 0.5:
                own[gen.randrange(len(own))] = "changed"
            at = gen.randrange(len(text) + 1)
            text[at:at] = own
        docs.append((d, "\n ".join(text)))
    docs += [(900 + i, t) for i, t in items if len(t.split()) < 5]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(contained(docs, items))
    assert len(want) > 40
    assert found(decontaminate.contained_items(*frames)) == want
    assert found(decontaminate.contained_items(*frames, block_bytes=600)) == want
    hit = {d for d, *_ in want}
    kept = decontaminate.decontaminated(*frames, block_bytes=600).collect()
    assert sorted(map(tuple, kept)) == sorted(r for r in docs if r[0] not in hit)


def test_sketches_cannot_miss():
    for n in range(1, 400):
        k = decontaminate.sketch_size(n, 0.8)
        assert 1 <= k <= n and k - decontaminate.missing(n, 0.8) >= 1


def test_both_ways_to_shingles_agree(edge_rows):
    for r in edge_rows:
        assert decontaminate.shingles(r[1] or "") == shingles(r[1])


def test_edges(spark, edges, nothing):
    items = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (None, "a"), (1, "one two")], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contained_items(edges, items).select("doc_id", "item_id").collect()), key=str)
    assert got == sorted([(4, 1), (5, 1), (4, 1), (5, 1), (3, None), (3, None), (3, None), (None, None)], key=str)
    assert decontaminate.contained_items(nothing, items).count() == 0
    assert decontaminate.contained_items(edges, items.limit(0)).count() == 0
    kept = decontaminate.decontaminated(edges, items)
    assert kept.columns == edges.columns and kept.count() == edges.count() - 6


def test_short_items_inside_long_documents(spark):
    items = [(1, "Alpha"), (2, "beta gamma"), (3, "one two three four"), (4, "one two three four five"), (5, "beta gamma")]
    docs = [(1, "x y z alpha w v u"), (2, "a beta  GAMMA b c d e"), (3, "beta a gamma b c d"), (4, "0 one two three four five 6"), (5, "beta gamma"), (6, "alphabet x y z w"), (7, None), (8, "")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = found(decontaminate.contained_items(*frames, inside=True))
    assert got == [(1, 1, 1, 1), (2, 2, 1, 1), (2, 5, 1, 1), (4, 3, 1, 1), (4, 4, 1, 1), (5, 2, 1, 1), (5, 5, 1, 1)]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(*frames, inside=True).collect()) == [3, 6, 7, 8]
