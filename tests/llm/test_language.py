import numpy as np
import pyarrow as pa

from curvelab.llm import language
from tests.llm.conftest import remainder


def test_two_level_chain_equals_the_plain_recursion():
    rng = np.random.default_rng(0)
    scores, firsts, moves = rng.normal(size=(400, 3)), np.array([0, 1, 70, 71, 333]), rng.normal(size=(3, 3))
    got = language.marginals(scores, firsts, moves)
    for a, b in zip(firsts, [*firsts[1:], 400]):
        forward = [np.exp(scores[a])]
        for t in range(a + 1, b):
            forward.append((forward[-1] @ np.exp(moves)) * np.exp(scores[t]))
            forward[-1] /= forward[-1].sum()
        backward = [np.ones(3)]
        for t in range(b - 1, a, -1):
            x = np.exp(moves) @ (np.exp(scores[t]) * backward[-1])
            backward.append(x / x.sum())
        want = np.array(forward) * np.array(backward[::-1])
        assert np.allclose(want / want.sum(axis=1, keepdims=True), got[a:b])


def test_held_out_accuracy_and_switches(small):
    usable = [r for r in small if remainder(r[0], 4) != 2]
    model = language.fit([r[1] for r in usable], [r[2] for r in usable])
    held = [r for r in small if remainder(r[0], 4) == 2]
    judged = list(language._judged(model, pa.array([r[1] for r in held])))
    assert np.mean([j[0] == r[2] for j, r in zip(judged, held)]) > 0.95
    en, fr = (next(r[1] for r in held if r[2] == lang and len(r[1]) > 800)[:400] for lang in ("en", "fr"))
    _, _, runs = next(language._judged(model, pa.array([en + " " + fr])))
    assert [r["lang"] for r in sorted(runs, key=lambda r: -r["words"])[:2]] in (["en", "fr"], ["fr", "en"])


def test_query_learns_nothing_from_held_out_rows(spark, small, tmp_path):
    from curvelab.llm.queries import op2_language_crf
    from tests.llm.conftest import DOCS

    answers = []
    for turn in (0, 1):
        docs = [(r[0], r[1], "xx" if turn and remainder(r[0], 4) == 2 else r[2], r[3], r[4]) for r in small]
        path = tmp_path / str(turn)
        spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
        answers.append(sorted(map(tuple, op2_language_crf(spark, str(path)).collect())))
    assert answers[0] == answers[1]
    assert all(held == (remainder(i, 4) == 2) for i, held, _, _ in answers[0])


def test_edges(spark, edges, nothing, small):
    model = language.fit([r[1] for r in small], [r[2] for r in small])
    got = {(r["doc_id"], r["lang_pred"] == "und") for r in language.predict(edges, model).collect()}
    assert {i for i, und in got if und} >= {0, 1, 2, 8} and (3, False) in got
    assert language.predict(nothing, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(edges, None).collect()} == {"und"}
    from pyspark.sql import functions as F

    assert language.train(nothing, F.lit(True)) is None
    assert language.train(edges, F.lit(True)).labels == ["en", "fr"]
    kept = language.identified(edges, model)
    assert kept.columns == edges.columns and {0, 1, 2, 8}.isdisjoint(r["doc_id"] for r in kept.select("doc_id").collect())
    assert language.identified(nothing, model).count() == 0


def test_more_labels_than_a_model_can_have(spark):
    """200 labels, most of them on one row each: the frequent ones are learned, and every row has a result."""
    from pyspark.sql import functions as F

    words = {"aa": "der die das und nicht", "bb": "the and not with from"}
    rows = [(i, f"{words['aa' if i % 2 else 'bb']} {i % 7}", "aa" if i % 2 else "bb") for i in range(60)]
    rows += [(100 + i, f"xq{i} zz{i}", f"dirty {i:03d}") for i in range(200)] + [(400, "der die das", "und"), (401, "the and", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True))
    assert len(model.labels) == language.LANGUAGES and {"aa", "bb"} <= set(model.labels)
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()}
    assert len(got) == len(rows) and got[1] == "aa" and got[2] == "bb" and set(got.values()) <= set(model.labels)
