"""Byte-level BPE by a tokenization automaton.

The automaton reads tokens.  It starts as one state with a loop for every byte, which
accepts every spelling of a text, and each merge is applied to it by a gadget: where an
arc u leads to a state p that has an arc v, the new token uv gets an arc past p, and the
arcs u are led to a copy of p without v.  After the last merge exactly one path spells
each byte string, and it is the one that applying the merges in order gives.

All arcs of a token lead to one state, so a merge copies one state.  Copies are not
written out: a state is a list of runs (left token, merges before), and a table of what
each left token lost at which merge says whether an arc exists.  Arcs that were looked up
once are rows of a plain transition table.

Every prefix of a byte string is spelled by one path, hence one pass from left to right
keeps one state per position and needs no search.  Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelab.llm.common import session, span_hashes, text_slices, tokenizer_path

#: Looked-up arcs that a worker remembers at most.
ARCS = 1_000_000
#: Bytes of the longest word that goes through the arrays; longer ones are spelled alone.
LONG = 64
#: Distinct words spelled at once.
WORDS = 40_000
#: Bytes of text worked on at once.
TEXT_BYTES = 2 << 20

def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


class IntTable:
    """Hash table from non-negative 62-bit integers to small integers, read by arrays."""

    def __init__(self, bits: int) -> None:
        self.bits, self.size = bits, 0
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << bits, dtype=np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        out = np.full(len(keys), -1, dtype=np.int32)
        at, slot, mask = np.arange(len(keys)), self._slots(keys), (1 << self.bits) - 1
        while len(at):
            there = self.keys[slot]
            hit = there == keys[at]
            out[at[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            at, slot = at[on], (slot[on] + 1) & mask
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are distinct and not in the table."""
        while 2 * (self.size + len(keys)) > len(self.keys):
            kept = self.keys >= 0
            old, self.bits = (self.keys[kept], self.values[kept]), self.bits + 1
            self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32)
            self._place(*old)
        self._place(keys, values)
        self.size += len(keys)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        at, slot, mask = np.arange(len(keys)), self._slots(keys), (1 << self.bits) - 1
        while len(at):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[at[free]]
            won = self.keys[slot] == keys[at]
            self.values[slot[won]] = values[at[won]]
            at, slot = at[~won], (slot[~won] + 1) & mask


class Ragged:
    """Arrays of different lengths, back to back."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray) -> None:
        self.flat, self.offsets = flat, offsets

    @classmethod
    def of(cls, parts: list, kind: type) -> Ragged:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        return cls(np.array([x for p in parts for x in p], dtype=kind), np.concatenate(([0], np.cumsum(lengths))))

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def take(self, which: np.ndarray) -> Ragged:
        lengths = self.lengths[which]
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        at = np.repeat(self.offsets[which] - offsets[:-1], lengths)
        at += np.arange(offsets[-1])
        return Ragged(self.flat[at], offsets)

    def merged(self, outer: np.ndarray) -> Ragged:
        """Neighbours joined: ``outer`` are offsets into the arrays."""
        return Ragged(self.flat, self.offsets[outer])


class Automaton:
    """Deterministic automaton over tokens, compiled merge by merge."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]) -> None:
        """``labels``: bytes of each token; ``merges``: (left, right, token) in order."""
        self.labels = labels
        self.first: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.lost: dict[tuple[int, int], int] = {}
        self.runs: dict[int, tuple[tuple[int, int], ...]] = {}
        self.arcs = IntTable(16)
        end = len(merges)
        made = {t for _, _, t in merges}
        self.runs = {t: ((t, end),) for t in labels if t not in made}
        for step, (u, v, t) in enumerate(merges):
            self._gadget(step, u, v, t, end)
        self._trie()

    def _gadget(self, step: int, u: int, v: int, t: int, end: int) -> None:
        """Apply one merge: an arc t past the state after u, and u to a copy without v."""
        if u not in self.runs or v not in self.runs or t in self.born or not self._arc(u, v):
            return
        after_v = tuple((x, min(limit, step)) for x, limit in self.runs[v])
        self.first[t], self.born[t] = u, step
        self.runs[t] = ((t, end), *after_v)
        self.lost[u, v] = step

    def _arc(self, last: int, token: int) -> bool:
        """True if the state after ``last`` has an arc ``token``.

        A state loses the arc z at merge ``lost``.  An arc that begins with z is there
        only if it was added before, i.e. if its token was born earlier.
        """
        runs, lost, born = self.runs[last], self.lost, self.born
        z, bound = token, 1 << 60
        while True:
            for x, limit in runs:
                step = lost.get((x, z))
                if step is not None and step < limit and step <= bound:
                    return False
            if z not in self.first:
                return True
            bound = born[z]
            z = self.first[z]

    def _trie(self) -> None:
        """Labels as a byte trie: node * 256 + byte -> node, and the token that ends there."""
        self.step: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        nodes = 1
        for t in self.runs:
            node = 0
            for b in self.labels[t]:
                key = (node << 8) | b
                to = self.step.get(key)
                if to is None:
                    to = self.step[key] = nodes
                    nodes += 1
                node = to
            self.ends[node] = t

        self.trie = IntTable(16)
        self.trie.put(np.fromiter(self.step, np.int64, len(self.step)), np.fromiter(self.step.values(), np.int32, len(self.step)))
        self.token_at = np.full(nodes, -1, dtype=np.int32)
        self.token_at[list(self.ends)] = list(self.ends.values())
        self.sizes = np.array([len(self.labels.get(t, b"")) for t in range(max(self.labels) + 1)], dtype=np.int64)

    def allowed(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """For many pairs at once: does the state after ``last`` have an arc ``token``?"""
        keys = (last.astype(np.int64) << 32) | token
        known = self.arcs.get(keys)
        if (known < 0).any():
            new = np.unique(keys[known < 0])
            if self.arcs.size + len(new) > ARCS:
                self.arcs = IntTable(16)
            found = [self._arc(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()]
            self.arcs.put(new, np.array(found, dtype=np.int32))
            known[known < 0] = self.arcs.get(keys[known < 0])
            if (known < 0).any():  # the table was begun anew
                return self.allowed(last, token)
        return known > 0

    def encode_all(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Ragged:
        """Tokens of many non-empty words, given as places in ``data``."""
        parts = []
        for first in range(0, len(start), WORDS):
            parts.append(self._encode_some(data, start[first : first + WORDS], end[first : first + WORDS]))
        if not parts:
            return Ragged(np.empty(0, np.int32), np.zeros(1, np.int64))
        lengths = np.concatenate([p.lengths for p in parts])
        return Ragged(np.concatenate([p.flat for p in parts]), np.concatenate(([0], np.cumsum(lengths))))

    def _encode_some(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Ragged:
        """All words at once: every arc of every position first, then states from left to right.

        ``last`` holds, for each position of each word, the last token of the one path that
        spells the bytes before it.
        """
        alone = np.flatnonzero(end - start > LONG)
        spelled = [self.encode(data[start[w] : end[w]].tobytes()) for w in alone]
        lengths = np.where(end - start > LONG, 0, end - start)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        owner = np.repeat(np.arange(len(start), dtype=np.int32), lengths)
        inside = np.arange(offsets[-1], dtype=np.int32) - offsets[owner].astype(np.int32)
        flat, stop = data[start[owner] + inside], offsets[1:][owner]
        who, token, size = self._arcs_of(flat, stop)
        order = np.argsort(inside[who].astype(np.int8), kind="stable")
        who, token, size = who[order], token[order], size[order]
        slot = who + owner[who]
        last = np.full(len(flat) + len(start), -1, dtype=np.int32)
        cuts = np.concatenate(([0], np.cumsum(np.bincount(inside[who], minlength=1))))
        for i in range(len(cuts) - 1):
            here = slice(cuts[i], cuts[i + 1])
            at, new, far = slot[here], token[here], slot[here] + size[here]
            if i:
                before = last[at]
                fits = self.allowed(before, new)
                new, far = new[fits], far[fits]
            last[far] = new
        return self._paths(last, offsets, lengths, alone, spelled)

    def _arcs_of(self, flat: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, token, its bytes) of every token that stands at a position."""
        out = []
        who = here = np.arange(len(flat), dtype=np.int32)
        node, depth = np.zeros(len(flat), np.int64), 0
        while len(who):
            depth += 1
            node = self.trie.get((node << 8) | flat[here])
            deeper = node >= 0
            who, node = who[deeper], node[deeper].astype(np.int64)
            token = self.token_at[node]
            there = token >= 0
            out.append((who[there], token[there], np.full(np.count_nonzero(there), depth, np.int32)))
            here = who + depth
            on = here < stop[who]
            who, node, here = who[on], node[on], here[on]
        if not out:
            return np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*out))

    def _paths(self, last: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, alone: np.ndarray, spelled: list[np.ndarray]) -> Ragged:
        """Follow the last tokens back from each word's end."""
        words = np.flatnonzero(lengths)
        at, left = offsets[words] + lengths[words] + words, lengths[words]
        owners, tokens = [np.repeat(alone, [len(x) for x in spelled])], [np.concatenate([x[::-1] for x in spelled]) if spelled else np.empty(0, np.int32)]
        while len(words):
            token = last[at]
            owners.append(words)
            tokens.append(token)
            size = self.sizes[token]
            on = left > size
            words, at, left = words[on], (at - size)[on], (left - size)[on]
        owner, token = np.concatenate(owners), np.concatenate(tokens)
        order = np.lexsort((-np.arange(len(owner)), owner))
        return Ragged(token[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(lengths))))))

    def _walk(self, word: bytes, at: int) -> list[tuple[int, int]]:
        """(end, token) of all tokens that stand at a position, shorter ones first."""
        out, node = [], 0
        step, ends = self.step.get, self.ends.get
        for end in range(at, len(word)):
            node = step((node << 8) | word[end])
            if node is None:
                break
            token = ends(node)
            if token is not None:
                out.append((end + 1, token))
        return out

    def encode(self, word: bytes) -> np.ndarray:
        """The one path that spells ``word``, in time and memory proportional to its length.

        Longer tokens are tried first.  A position is reached by one path only, so one
        from which the end was not reached is never entered again; the tokens that stand at
        a position are looked up anew when the path comes back to it.
        """
        n = len(word)
        dead, path = bytearray(n + 1), array("i")
        last, at, below = -1, 0, n + 1
        while at < n:
            for end, token in reversed(self._walk(word, at)):
                if end < below and not dead[end] and (last < 0 or self._arc(last, token)):
                    path.append(token)
                    last, at, below = token, end, n + 1
                    break
            else:
                dead[at] = 1
                below = at
                at -= len(self.labels[path.pop()])
                last = path[-1] if path else -1
        return np.frombuffer(path, np.int32) if path else np.empty(0, np.int32)


#: Classes of characters: white space, letters, numbers, others.
_SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = range(5)


class Codec:
    """Whole texts: added tokens, pre-split words, the automaton, and back."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        vocab, symbols = said["model"]["vocab"], byte_symbols()
        labels = {i: bytes(symbols[c] for c in token) for token, i in vocab.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"])
        self.automaton = Automaton(labels, [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs])
        self.added = {t["content"]: t["id"] for t in said.get("added_tokens") or ()}
        self.labels = labels | {i: t.encode() for t, i in self.added.items()}
        top = range(max(self.labels) + 1)
        self.label_bytes = Ragged.of([self.labels.get(i, b"") for i in top], np.uint8)
        self.digits = Ragged.of([b"%d," % i for i in top], np.uint8)
        listed = sorted(self.added, key=len, reverse=True)
        self.around = re.compile("(" + "|".join(map(re.escape, listed)) + ")") if listed else None
        self.classes = np.full(0x110000, _UNKNOWN, dtype=np.uint8)

    def _classes(self, points: np.ndarray) -> np.ndarray:
        """Class of each code point.

        The vocabulary's library knows an older standard: characters that were assigned
        lately, which ``unicodedata`` does not know either, are others there.
        """
        out = self.classes[points]
        if (out == _UNKNOWN).any():
            for p in np.unique(points[out == _UNKNOWN]).tolist():
                kind = unicodedata.category(chr(p))
                space = chr(p).isspace() and not 0x1C <= p <= 0x1F
                self.classes[p] = _SPACE if space else _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _OTHER
            out = self.classes[points]
        return out

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pre-split words of rows that lie back to back: (first byte, byte after the last, words before each row).

        The rule, a fixed value: a contraction (the sign ' and s, t, re, ve, m, ll or d);
        else a run of letters, of numbers or of others, with one space before it if there is
        one; else white space, of which the last character before another one stands alone.
        """
        chars = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
        points = data[chars].astype(np.int32)
        wide = np.flatnonzero(points >= 0x80)
        if len(wide):
            lead, at = points[wide], chars[wide]
            size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
            value = lead & (0x7F >> size)
            for k in (1, 2, 3):
                more = size > k
                value[more] = (value[more] << 6) | (data[at[more] + k] & 0x3F)
            points[wide] = value
        n = len(chars)
        first = np.zeros(n + 1, dtype=bool)
        row_at = np.searchsorted(chars, offsets)
        first[row_at] = True
        first = first[:n]
        kind = self._classes(points)
        space, blank = kind == _SPACE, points == 0x20
        same, after_space, after_blank, before_other = (np.zeros(n, dtype=bool) for _ in range(4))
        same[1:] = (kind[1:] == kind[:-1]) & ~first[1:]
        after_space[1:] = space[:-1] & ~first[1:]
        after_blank[1:] = blank[:-1] & ~first[1:]
        before_other[:-1] = ~space[1:] & ~first[1:]
        begin = first | np.where(space, ~after_space | before_other, ~same & ~after_blank)
        for i in np.flatnonzero(begin & (points == 0x27)).tolist():
            for tail in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"):
                stop = i + 1 + len(tail)
                if stop <= n and not first[i + 1 : stop].any() and np.array_equal(points[i + 1 : stop], np.frombuffer(tail, np.uint8)):
                    begin[i + 1 : stop] = False
                    if stop < n:
                        begin[stop] |= kind[stop] == _LETTER
        where = np.flatnonzero(begin)
        start = chars[where]
        end = np.append(start[1:], len(data))
        return start, end, np.searchsorted(where, row_at)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Ragged, Ragged, Ragged]:
        """(token ids, decimal ids each followed by a comma, decoded bytes) of every row.

        Equal words are spelled once per call.
        """
        start, end, before = self._words(data, offsets)
        _, index, which = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        tokens = self.automaton.encode_all(data, start[index], end[index])
        digits = self.digits.take(tokens.flat).merged(tokens.offsets)
        label = self.label_bytes.take(tokens.flat).merged(tokens.offsets)
        return tuple(part.take(which).merged(before) for part in (tokens, digits, label))

    def ids(self, text: str) -> list[int]:
        """Token ids of one text, with the added tokens that stand in it."""
        out: list[int] = []
        for piece in self.around.split(text) if self.around else [text]:
            if piece in self.added:
                out.append(self.added[piece])
            elif piece:
                data = np.frombuffer(piece.encode(), np.uint8)
                out += self.rows(data, np.array([0, len(data)]))[0].flat.tolist()
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.labels[i] for i in ids]).decode("utf-8", "replace")

    def batch(self, column: pa.Array) -> Iterator[tuple[np.ndarray, bytes, str]]:
        """(ids, ids joined by commas, decoded text) of every row of a string column."""
        for first, last, data, offsets in text_slices(column, TEXT_BYTES):
            ids, digits, label = (
                (part.flat, part.offsets.tolist()) for part in self.rows(data, offsets)
            )
            for i in range(last - first):
                a, b = offsets[i], offsets[i + 1]
                text = data[a:b].tobytes()
                if any(t.encode() in text for t in self.added):
                    own = self.ids(text.decode("utf-8", "replace"))
                    yield np.array(own, np.int32), ",".join(map(str, own)).encode(), self.decode(own)
                    continue
                joined = digits[0][digits[1][i] : max(digits[1][i + 1] - 1, digits[1][i])].tobytes()
                decoded = label[0][label[1][i] : label[1][i + 1]].tobytes().decode("utf-8", "replace")
                yield ids[0][ids[1][i] : ids[1][i + 1]], joined, decoded


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _mapper(tokenizer: str, parts: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(tokenizer_path(tokenizer))
        for batch in batches:
            columns = {name: [] for name in ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")}
            for own, joined, decoded in work.batch(batch.column("text")):
                columns["n_tokens"].append(len(own))
                if "ids" in parts:
                    columns["ids"].append(own.astype(np.int32))
                if "decoded" in parts:
                    columns["decoded"].append(decoded)
                if "ids_sha256" in parts:
                    columns["ids_sha256"].append(hashlib.sha256(joined).hexdigest())
                    columns["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            made = [pa.array(columns[p], kinds.get(p, pa.string())) for p in parts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *parts])

    return run


def encode(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    ids: bool = False,
    decoded: bool = False,
    digests: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokens of every row: id and n_tokens, and as asked for ids, decoded and digests.

    ``digests`` are ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of
    the decoded text in UTF-8), made where the ids are.  No special tokens are added; added
    tokens that stand in a text are found as the vocabulary's library finds them.

    A null or empty text has no tokens and decodes to the empty text.  Rows with null or
    equal ids are all kept; other columns are not read.  No shuffle.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))
    session(docs.sparkSession)
    kinds = {"n_tokens": "long", "ids": "array<int>"}
    parts = ("n_tokens", *["ids"] * ids, *["decoded"] * decoded, *["ids_sha256", "decoded_sha256"] * digests)
    schema = ", ".join([f"`{id_col}` {rows.schema[0].dataType.simpleString()}", *[f"{p} {kinds.get(p, 'string')}" for p in parts]])
    return rows.mapInArrow(_mapper(tokenizer, parts), schema)
