import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from curvelab.llm import bpe
from curvelab.llm.common import tokenizer_path
from tests.conftest import SMALL

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(tokenizer_path(NAME))
    out.no_truncation()
    out.no_padding()
    return out


def check(library, texts):
    codec = bpe.codec(tokenizer_path(NAME))
    encoded = library.encode_batch(texts, add_special_tokens=False)
    for text, want, (ids, joined, decoded) in zip(texts, encoded, codec.batch(pa.array(texts, pa.string())), strict=True):
        assert ids.tolist() == want.ids, text
        assert joined.decode() == ",".join(map(str, want.ids))
        assert decoded == library.decode(want.ids, skip_special_tokens=False) == text
        assert codec.decode(want.ids) == text


def test_strange_texts(library):
    gen = random.Random(2)
    parts = [" ", "  ", "\n", " \n", "\t", "a", "the", "ing", "S", "'s", "'ll", "'", "'re", "re", "1", "23", "é", "ñ", "中文", "😀", ".", "!!", "\x1c", "\x85", "\u3000", "\u200b", "<|endoftext|>", "\x00", "\u0558", "\U000323b0", "aaaa", "====", "ſ", "K", "\xa0", " a"]
    check(library, ["".join(gen.choice(parts) for _ in range(gen.randrange(13))) for _ in range(4000)])
    check(library, ["".join(chr(gen.choice([gen.randrange(0x250), gen.randrange(0x250, 0xD800), gen.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(500)])
    check(library, [c * gen.randrange(1, 500) for c in ("a", "=", " ", "ab", "-", "\n", "0") for _ in range(8)])
    check(library, ["".join(gen.choice("abcdefghij") for _ in range(50_000)), "", " "])


def test_small_automaton_by_hand():
    """Merges of a, aa and ab: every string of a and b against merging in order."""
    labels = {0: b"a", 1: b"b", 2: b"aa", 3: b"ab", 4: b"aab", 5: b"bb", 6: b"abb"}
    merges = [(0, 0, 2), (0, 1, 3), (2, 1, 4), (1, 1, 5), (3, 1, 6)]
    rank = {(u, v): (i, t) for i, (u, v, t) in enumerate(merges)}
    automaton = bpe.Automaton(labels, merges)
    for n in range(1, 11):
        for bits in range(1 << n):
            word = [bits >> k & 1 for k in range(n)]
            merged = word[:]
            while True:
                best = min(((rank[p], k) for k, p in enumerate(zip(merged, merged[1:])) if p in rank), default=None)
                if best is None:
                    break
                merged[best[1] : best[1] + 2] = [best[0][1]]
            assert automaton.encode(bytes(b"ab"[x] for x in word)).tolist() == merged


def test_query_equals_the_library(spark, small, library):
    from curvelab.llm.queries import op5_bpe_automaton

    text = {r[0]: r[1] for r in small}
    for r in op5_bpe_automaton(spark, SMALL).collect():
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edges(edges, edge_rows, nothing, library):
    got = bpe.encode(edges, ids=True, decoded=True).collect()
    assert len(got) == len(edge_rows)
    want = {(r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids), r[1] or "") for r in edge_rows}
    assert {(r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got} == want
    assert bpe.encode(nothing).count() == 0


def test_a_very_long_word_takes_time_in_proportion(library):
    """Words without a break: equal to the library, and ten megabytes of one."""
    import time

    codec = bpe.codec(bpe.tokenizer_path("byte_bpe_50k.json"))
    gen = np.random.default_rng(4)
    letters = "".join(chr(97 + x) for x in gen.integers(0, 26, 10_000_000))
    for text in (letters[:100_000], "ab" * 30_000, "a" * 20_001, "é" * 999):
        assert codec.ids(text) == library.encode(text, add_special_tokens=False).ids
    took = []
    for n in (1_000_000, 10_000_000):
        started = time.process_time()
        tokens = codec.automaton.encode(letters[:n].encode())
        took.append(time.process_time() - started)
        assert b"".join(codec.labels[t] for t in tokens.tolist()) == letters[:n].encode()
    assert took[1] < 20 * took[0]
