from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from curvelab.llm import discriminant
from curvelab.llm.common import table
from tests.conftest import SMALL
from tests.llm.conftest import remainder

LARGER = SMALL.replace("0.001", "0.01")


def test_fit_over_tasks_equals_one_array(spark):
    gen = np.random.default_rng(1)
    d = len(discriminant.STATISTICS)
    x = gen.normal(size=(300, d)) @ gen.normal(size=(d, d))
    y = (gen.random(300) < 0.7).astype(int)
    rows = spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(x, y)], "x array<double>, label int").repartition(7)
    model = discriminant.train(rows)
    whole = discriminant.solve([float((y == k).sum()) for k in (0, 1)], [x[y == k].sum(0) for k in (0, 1)], [x[y == k].T @ x[y == k] for k in (0, 1)])
    assert np.allclose(model.scores(x), whole.scores(x))
    # scores are the log density difference of the two Gaussians
    logs = [np.log(p) - 0.5 * np.linalg.slogdet(f @ f.T)[1] - 0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(f @ f.T), x - m) for p, f, m in zip(whole.priors, whole.factors, whole.means)]
    assert np.allclose(whole.scores(x), 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -30, 30))))


def test_query_held_out_accuracy(spark):
    from curvelab.llm.queries import op9_quadratic_discriminant

    labels = dict(map(tuple, table(spark, LARGER, "labels").select("doc_id", "quality").collect()))
    rows = op9_quadratic_discriminant(spark, LARGER).collect()
    assert all(r["held_out"] == (remainder(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.93


def test_edges(spark, edges, edge_rows, nothing):
    labels = spark.createDataFrame([(0, 0), (1, 1), (3, 1), (4, 0), (4, 0), (None, 1), (99, 0), (5, None), (7, 1)], "doc_id long, quality int")
    rows = discriminant.classify(edges, labels, F.lit(True)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in edge_rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in discriminant.classify(edges, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert discriminant.classify(nothing, labels, F.lit(True)).count() == 0


def _plain(text):
    """The fourteen statistics of one text, character by character."""
    import math

    share = lambda x, floor=1e-3: math.log((min(max(x, 0), 1) + floor) / (1 - min(max(x, 0), 1) + floor))
    data = text.encode()
    words = data.split()
    if not words:
        return [0.0] * len(discriminant.STATISTICS)
    low = [w.lower() for w in words]
    kind = Counter()
    for b in data:
        c = chr(b)
        if b in (0x20, *range(0x09, 0x0E)):
            kind["space"] += 1
        elif "a" <= c <= "z" or b >= 128:
            kind["letter"] += 1
        elif "A" <= c <= "Z":
            kind["upper"] += 1
        elif "0" <= c <= "9":
            kind["digit"] += 1
        elif c in ".,;:!?'\"()-":
            kind["mark"] += 1
        elif c in "#*$%&|<>":
            kind["symbol"] += 1
        else:
            kind["other"] += 1
    solid = max(len(data) - kind["space"], 1)
    sizes = [len(w) for w in words]
    mean = sum(sizes) / len(sizes)
    spread = math.sqrt(max(sum(s * s for s in sizes) / len(sizes) - mean**2, 0))
    grams = list(zip(low, low[1:], low[2:]))
    lines = [x for x in data.split(b"\n") if x]
    counts = Counter(data)
    entropy = -sum(c / len(data) * math.log2(c / len(data)) for c in counts.values())
    return [
        math.log1p(len(words)), math.log1p(mean), math.log1p(spread), share(len(set(low)) / len(words)), share((len(grams) - len(set(grams))) / max(len(grams), 1)),
        share((len(lines) - len(set(lines))) / max(len(lines), 1)), share(kind["symbol"] / solid), share(kind["upper"] / solid), share(kind["digit"] / solid), share(kind["mark"] / solid),
        share(kind["letter"] / solid), share(kind["other"] / solid), math.log1p(len(words) / max(len(lines), 1)), entropy,
    ]


def test_statistics_equal_the_plain_ones(small, edge_rows):
    texts = [r[1] or "" for r in (*small, *edge_rows)] + ["a\n\nb\n", "\n", "A a A a", "x", "é\x0bÉ #*$ 12", "one\ntwo\none\ntwo three"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    got = discriminant.statistics(data, offsets)
    np.testing.assert_allclose(got, [_plain(t) for t in texts], rtol=1e-9, atol=1e-9)
