import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from curvelab.llm import token_counts
from curvelab.llm.common import shared_path, tokenizer_path
from curvelab.llm.ledger import Ledger
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def test_segments_add_up(model):
    gen = random.Random(1)
    parts = [" ", "  ", "\n", " \n", "a", "the", "ing", "1", "é", "中文", "😀", ".", "▁", "▁▁", "<s>", "</s>", "<unk>", "<0x0A>", "\xa0", "\u3000", "ﬁ", "\x00"]
    count = token_counts.counter(tokenizer_path("piece_bpe_32k.model")).count
    for _ in range(5000):
        text = "".join(gen.choice(parts) for _ in range(gen.randrange(13)))
        assert count(text) == len(model.encode(text)), repr(text)


def test_query_equals_the_library(spark, small, model):
    from curvelab.llm.queries import op7_token_counts

    got = {tuple(r) for r in op7_token_counts(spark, SMALL).collect()}
    assert got == {(r[0], len(r[1].encode()), n := len(model.encode(r[1])), n > 4096) for r in small}


def test_only_misses_are_encoded(spark, monkeypatch):
    path = shared_path(spark, "cache")
    docs = spark.createDataFrame([(1, "some text"), (2, "some text"), (3, "other")], "doc_id long, text string")
    cache = Ledger(spark, path, token_counts.ENTRY)
    first = sorted(map(tuple, token_counts.count_tokens(docs, cache_path=path).collect()))
    assert cache.read().count() == 2
    more = docs.union(spark.createDataFrame([(4, "new")], docs.schema))
    assert sorted(map(tuple, token_counts.count_tokens(more, cache_path=path).collect()))[:3] == first
    assert cache.read().count() == 3
    # another vocabulary has counts of its own
    own = token_counts.count_tokens(more, "word_bpe_49k.json", path).collect()
    assert cache.read().count() == 6
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    assert {r["doc_id"]: r["n_tokens"] for r in own}[1] == len(library.encode("some text", add_special_tokens=False).ids)


def test_edges(edges, edge_rows, nothing, model):
    rows = token_counts.count_tokens(edges, limit=10).collect()
    want = Counter((r[0], len((r[1] or "").encode()), n := len(model.encode(r[1] or "")), n > 10) for r in edge_rows)
    assert Counter(map(tuple, rows)) == want
    assert token_counts.count_tokens(nothing).count() == 0
