import corpus_pipeline
from curvelab.llm import secrets
from curvelab.llm.common import table, written
from tests.conftest import SMALL
from tests.llm.brute import components, contained
from tests.llm.conftest import DOCS, rows
from tests.llm.test_secrets import brute


def test_stages_against_brute_force(spark, small):
    docs, seen = table(spark, SMALL, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SMALL), "stage")
        seen.append((before, docs))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == before.columns
    told = [[tuple(r) for r in after.collect()] for _, after in seen]
    first = {r[0] for r in told[0]}
    assert first <= {r[0] for r in small} and len(first) > 0.95 * len(small)
    leads = {c for _, _, c in components([r[:2] for r in told[0]])}
    assert {r[0] for r in told[1]} == leads
    hit = {d for d, *_ in contained([r[:2] for r in told[1]], rows("benchmark"))}
    assert hit and sorted(told[2]) == sorted(r for r in told[1] if r[0] not in hit)
    text = {r[0]: r[1] for r in told[2]}
    assert {r[0] for r in told[3]} == set(text)
    for r in told[3]:
        if brute(text[r[0]]):
            assert "<secret>" in r[1] and r[4] == len(r[1])
        else:
            assert r[1] == text[r[0]]
    assert {r[0] for r in told[4]} == {r[0] for r in told[3]}
    ran = corpus_pipeline.run(spark, SMALL)
    key = lambda r: (r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
    assert sorted(map(key, ran.collect())) == sorted(map(key, seen[-1][1].collect()))


def test_stages_take_edges_and_nothing(spark, edges, nothing):
    for docs in (edges, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert out.count() <= docs.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
    assert DOCS.names == nothing.columns and secrets.RULES
