"""Language identification by a linear-chain conditional random field over words.

Each word of a text is labelled with a language; the score of a label is a sum of learned
weights of the word's features (first and last letters, letter n-grams, the lexicon that
knows it), and learned transition weights tie neighbours, so that a text may switch
languages and a doubtful word follows its context.  Forward-backward over the whole text
gives every word's label probabilities; the document takes the language with the largest
sum.

Words are runs of letters: ASCII letters, A-Z lower-cased, and the bytes of other
characters.  Features are computed over the bytes of many documents at once.  The chain is
run exactly in two levels: chunks of words side by side, then over the chunks of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelab.llm.common import mix, session, span_hashes, text_slices

#: Rows per language that the model is fitted on: a sample bounded whatever the table's size.
ROWS_PER_LANGUAGE = 80
#: Languages a model can have: bounds its tables, which are sent to every task.  Of more labels
#: the most frequent ones are learned.
LANGUAGES = 64
EPOCHS, STEP, PENALTY = 6, 0.5, 1e-4
#: Words of a training sequence, and of the pieces of one text it is made of.
SEQUENCE, PIECE = 32, 8
CHUNK = 64

_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)

_TWO, _THREE, _AFFIX = 1 << 16, 1 << 17, 1 << 15
_AFFIX_AT = _TWO + _THREE
_LEXICON_AT = _AFFIX_AT + 8 * _AFFIX
UNKNOWN = "und"


def _hashed(x: np.ndarray, size: int) -> np.ndarray:
    return (mix(x.astype(np.uint64)) >> np.uint64(40)).astype(np.int64) & (size - 1)


@dataclass
class Words:
    """Feature numbers of words: per letter two n-grams, per word eight affixes."""

    row: np.ndarray
    first: np.ndarray
    letters: np.ndarray
    affixes: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words | None:
        clean = np.zeros(len(data) + 8, dtype=np.uint8)
        clean[4:-4] = _LETTER[data]
        inside = clean[4:-4] > 0
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[cuts < len(data)]
        begin[cuts] = inside[cuts]
        start = np.flatnonzero(begin)
        if not len(start):
            return None
        places = np.flatnonzero(inside)
        first = np.searchsorted(places, start)
        size = np.diff(np.append(first, len(places)))
        end = start + size
        at = places + 4
        before, here, after = (clean[at + k].astype(np.int64) for k in (-1, 0, 1))
        before[first] = 0
        after[np.append(first[1:], len(places)) - 1] = 0
        two = (before << 8) | here
        three = _TWO + _hashed((before << 16) | (here << 8) | after, _THREE)
        affixes = np.empty((len(start), 8), dtype=np.int64)
        head = tail = np.zeros(len(start), dtype=np.int64)
        for k in range(4):
            there = k < size
            head = (head << 8) | np.where(there, clean[start + 4 + k], 0)
            tail = (tail << 8) | np.where(there, clean[end + 3 - k], 0)
            affixes[:, 2 * k] = _AFFIX_AT + 2 * k * _AFFIX + _hashed(head, _AFFIX)
            affixes[:, 2 * k + 1] = _AFFIX_AT + (2 * k + 1) * _AFFIX + _hashed(tail, _AFFIX)
        row = np.searchsorted(offsets, start, side="right") - 1
        return cls(row, first, np.stack((two, three), 1), affixes, span_hashes(clean[4:-4], start, end))


@dataclass
class Model:
    """Labels, feature weights, transitions and the lexicon (word hash -> label)."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray
    meaning: np.ndarray

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Lexicon feature of every word."""
        if not len(self.lexicon):
            return np.full(len(hashes), _LEXICON_AT + len(self.labels))
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return _LEXICON_AT + np.where(self.lexicon[at] == hashes, self.meaning[at], len(self.labels))

    def scores(self, words: Words, known: np.ndarray) -> np.ndarray:
        """Label scores of every word from its features."""
        w = self.weights
        grams = w[words.letters[:, 0]] + w[words.letters[:, 1]]
        out = np.add.reduceat(grams, words.first, axis=0) + w[known]
        for k in range(8):
            out += w[words.affixes[:, k]]
        return out

    def marginals(self, words: Words) -> np.ndarray:
        """Label probabilities of every word, each row of texts being one chain."""
        scores = self.scores(words, self.known(words.hashes)).astype(np.float64)
        return marginals(scores, np.flatnonzero(np.diff(words.row, prepend=-1)), self.transitions)


def marginals(scores: np.ndarray, firsts: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of every place of chains that lie back to back."""
    forward, backward, _, _ = messages(scores, firsts, transitions)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True)


def messages(scores: np.ndarray, firsts: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: forward (with the place's own evidence), backward, emissions, steps.

    Level one multiplies the step matrices inside chunks of all chains side by side, level
    two runs over the chunks of each chain, level three fills the chunks in.
    """
    n, k = scores.shape
    emission = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(transitions - transitions.max())
    lengths = np.diff(np.append(firsts, n))
    chunks = -(-lengths // CHUNK)
    chain = np.repeat(np.arange(len(firsts)), chunks)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    at = (firsts[chain] + number * CHUNK)[:, None] + np.arange(CHUNK)
    real = at < (firsts + lengths)[chain][:, None]
    e = emission[np.minimum(at, n - 1)]
    # a chain's first word has no step before it
    opens = number == 0
    product = np.broadcast_to(np.eye(k), (len(chain), k, k)).copy()
    for t in range(CHUNK):
        now = real[:, t]
        if not now.any():
            break
        move = np.broadcast_to(step, (len(chain), k, k)) if t else np.where(opens[:, None, None], np.eye(k), step)
        after = (product @ move) * e[:, t, None, :]
        after /= after.sum(axis=(1, 2), keepdims=True)
        product = np.where(now[:, None, None], after, product)
    first_chunk = np.cumsum(chunks) - chunks
    left, right = np.empty((len(chain), k)), np.empty((len(chain), k))
    state = np.full((len(firsts), k), 1.0 / k)
    for c in range(int(chunks.max())):
        who = np.flatnonzero(chunks > c)
        left[first_chunk[who] + c] = state[who]
        state[who] = np.einsum("ni,nij->nj", state[who], product[first_chunk[who] + c])
        state[who] /= state[who].sum(axis=1, keepdims=True)
    state = np.full((len(firsts), k), 1.0 / k)
    for c in range(int(chunks.max())):
        who = np.flatnonzero(chunks > c)
        chunk = first_chunk[who] + chunks[who] - 1 - c
        right[chunk] = state[who]
        state[who] = np.einsum("nij,nj->ni", product[chunk], state[who])
        state[who] /= state[who].sum(axis=1, keepdims=True)
    forward, backward = np.empty((CHUNK, len(chain), k)), np.empty((CHUNK, len(chain), k))
    state = left
    for t in range(CHUNK):
        now = real[:, t, None]
        moved = state @ step
        if t == 0:
            moved = np.where(opens[:, None], state, moved)
        after = moved * e[:, t]
        after /= after.sum(axis=1, keepdims=True)
        state = np.where(now, after, state)
        forward[t] = state
    state = right
    for t in range(CHUNK - 1, -1, -1):
        backward[t] = state
        before = (state * e[:, t]) @ step.T
        before /= before.sum(axis=1, keepdims=True)
        state = np.where(real[:, t, None], before, state)
    return forward.transpose(1, 0, 2)[real], backward.transpose(1, 0, 2)[real], emission, step


# ---------------------------------------------------------------- fitting


def fit(texts: list[str], langs: list[str], seed: int = 5) -> Model | None:
    """Learn weights, transitions and the lexicon from labelled texts.

    One half of the texts gives the lexicon, the other half trains the field, so that the
    lexicon features are as reliable in training as on new texts.  Training sequences put
    pieces of different texts behind each other: that is where switches are learned from.
    """
    labels = sorted(set(langs))
    if not labels:
        return None
    index = {lang: i for i, lang in enumerate(labels)}
    half = [i for j, lang in enumerate(labels) for i in [k for k, x in enumerate(langs) if x == lang][::2]]
    rest = sorted(set(range(len(texts))) - set(half)) or half
    gen = np.random.default_rng(seed)
    model = Model(labels, np.zeros((_LEXICON_AT + len(labels) + 1, len(labels)), np.float32), np.zeros((len(labels),) * 2), *_lexicon(texts, langs, half, index))
    words, owner = _all_words([texts[i] for i in rest])
    if words is None:
        return model
    truth = np.array([index[langs[i]] for i in rest])[owner]
    known = model.known(words.hashes)
    order = _sequences(owner, gen)
    squares_w, squares_t = np.full(model.weights.shape, 1e-6, np.float32), np.full(model.transitions.shape, 1e-6)
    batch = SEQUENCE * 128
    for _ in range(EPOCHS):
        starts = gen.permutation(np.arange(0, len(order), batch))
        for s in starts:
            chosen = order[s : s + batch]
            chosen = chosen[: max(len(chosen) // SEQUENCE * SEQUENCE, min(len(chosen), SEQUENCE))]
            _learn(model, _pick(words, chosen), known[chosen], truth[chosen], squares_w, squares_t)
    return model


def _all_words(texts: list[str]) -> tuple[Words | None, np.ndarray]:
    for _, _, data, offsets in text_slices(pa.array(texts, pa.large_string()), 1 << 62):
        words = Words.of(data, offsets)
        return words, words.row if words is not None else np.empty(0, np.int64)
    return None, np.empty(0, np.int64)


def _lexicon(texts: list[str], langs: list[str], which: list[int], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Words that occur twice or more, nine times in ten under one label."""
    words, owner = _all_words([texts[i] for i in which])
    if words is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    label = np.array([index[langs[i]] for i in which])[owner]
    hashes, place = np.unique(words.hashes, return_inverse=True)
    counts = np.zeros((len(hashes), len(index)))
    np.add.at(counts, (place, label), 1)
    total = counts.sum(axis=1)
    good = (total >= 2) & (counts.max(axis=1) >= 0.9 * total)
    return hashes[good], counts.argmax(axis=1)[good]


def _sequences(owner: np.ndarray, gen: np.random.Generator) -> np.ndarray:
    """Word numbers in training order: runs of one to four pieces of a text, shuffled."""
    runs, n = [], len(owner)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], n)):
        while a < b:
            size = int(gen.integers(1, 5)) * PIECE
            runs.append(np.arange(a, min(a + size, b)))
            a += size
    return np.concatenate([runs[i] for i in gen.permutation(len(runs))])


def _pick(words: Words, which: np.ndarray) -> Words:
    size = np.diff(np.append(words.first, len(words.letters)))[which]
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    at = np.repeat(words.first[which] - first, size) + np.arange(size.sum())
    return Words(np.arange(len(which)) // SEQUENCE, first, words.letters[at], words.affixes[which], words.hashes[which])


def _learn(model: Model, words: Words, known: np.ndarray, truth: np.ndarray, squares_w: np.ndarray, squares_t: np.ndarray) -> None:
    """One adaptive gradient step on the log-likelihood of a batch of sequences."""
    n, k = len(truth), len(model.labels)
    scores = model.scores(words, known).astype(np.float64)
    forward, backward, emission, step = messages(scores, np.arange(0, n, SEQUENCE), model.transitions)
    prob = forward * backward
    prob /= prob.sum(axis=1, keepdims=True)
    wrong = prob.copy()
    wrong[np.arange(n), truth] -= 1
    size = np.diff(np.append(words.first, len(words.letters)))
    spread = np.repeat(wrong, size, axis=0)
    numbers = np.concatenate((words.letters[:, 0], words.letters[:, 1], words.affixes.T.ravel(), known))
    errors = np.concatenate((spread, spread, np.tile(wrong, (8, 1)), wrong))
    touched, place = np.unique(numbers, return_inverse=True)
    gradient = np.stack([np.bincount(place, errors[:, j], len(touched)) for j in range(k)], 1) / n * SEQUENCE
    gradient += PENALTY * model.weights[touched]
    squares_w[touched] += (gradient**2).astype(np.float32)
    model.weights[touched] -= (STEP * gradient / np.sqrt(squares_w[touched])).astype(np.float32)
    inner = np.flatnonzero(np.arange(n - 1) % SEQUENCE != SEQUENCE - 1) if n > 1 else np.empty(0, np.int64)
    if len(inner):
        pair = forward[inner][:, :, None] * step * (emission * backward)[inner + 1][:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        observed = np.zeros((k, k))
        np.add.at(observed, (truth[inner], truth[inner + 1]), 1)
        gradient = (pair.sum(axis=0) - observed) / n * SEQUENCE + PENALTY * model.transitions
        squares_t += gradient**2
        model.transitions -= STEP * gradient / np.sqrt(squares_t)


# ---------------------------------------------------------------- the operator


def training_rows(docs: DataFrame, usable: Column, per_language: int = ROWS_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Up to ``per_language`` usable rows of each language, chosen by a hash of text and id.

    Only the ``LANGUAGES`` labels with the most usable rows are learned, of equally many the
    first in order of text; texts in other languages are predicted as the learned language
    they resemble most.  The ranking keeps that many rows per language in each task before
    the shuffle.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).filter(
        usable & F.col("text").isNotNull() & F.col("lang").isNotNull()
    )
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    learned = [r["lang"] for r in counted.collect()]
    rows = rows.filter(F.col("lang").isin(learned) if learned else F.lit(False))
    keyed = rows.select("lang", F.xxhash64("_id", "text").alias("_h"))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).filter(F.col("_r") <= per_language)
    chosen = {(r["lang"], r["_h"]) for r in ranked.select("lang", "_h").collect()}
    hashes = sorted({h for _, h in chosen})
    return rows.filter(F.xxhash64("_id", "text").isin(hashes) if hashes else F.lit(False)).select("text", "lang").distinct()


def train(docs: DataFrame, usable: Column, per_language: int = ROWS_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit the field on a bounded sample of the rows that may be used; None if there are none."""
    session(docs.sparkSession)
    sample = sorted((r["lang"], r["text"]) for r in training_rows(docs, usable, per_language, id_col, text_col, lang_col).collect())
    return fit([t for _, t in sample], [lang for lang, _ in sample])


def predict(docs: DataFrame, model: Model | None, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Language of every row: the columns, lang_pred, score and runs.

    score is the language's share of the word probabilities.  runs are the labelled words as
    (lang, words), neighbours of one label together: the pieces of a code-switched text.  A
    null text, or one without a letter, is ``und`` with score 0 and no runs, as is every
    text where nothing was learned.  Rows with null or equal ids are all kept; other columns
    are not read.  No shuffle.
    """
    spark = session(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`").alias(c) for c in columns], F.col(f"`{text_col}`").alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    schema = ", ".join([*kinds, "lang_pred string", "score double", "runs array<struct<lang:string,words:int>>"])
    return rows.mapInArrow(_predict(spark.sparkContext.broadcast(model)), schema)


def _judged(model: Model | None, column: pa.Array) -> Iterator[tuple[str, float, list[dict]]]:
    for first, last, data, offsets in text_slices(column):
        words = Words.of(data, offsets) if model is not None else None
        if words is None:
            yield from ((UNKNOWN, 0.0, []) for _ in range(last - first))
            continue
        prob = model.marginals(words)
        count = np.bincount(words.row, minlength=last - first)
        mass = np.stack([np.bincount(words.row, prob[:, j], last - first) for j in range(len(model.labels))], 1)
        bounds = np.concatenate(([0], np.cumsum(count))).tolist()
        ascii_ = np.bincount(words.row, _has_ascii(words), last - first) > 0
        label = prob.argmax(axis=1)
        for i in range(last - first):
            if not count[i] or not (ascii_[i] or any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))):
                yield UNKNOWN, 0.0, []
                continue
            own = label[bounds[i] : bounds[i + 1]]
            cuts = np.flatnonzero(np.diff(own)) + 1
            edges = [0, *cuts.tolist(), len(own)]
            runs = [{"lang": model.labels[own[a]], "words": b - a} for a, b in zip(edges, edges[1:])]
            best = int(mass[i].argmax())
            yield model.labels[best], float(mass[i, best] / count[i]), runs


def _has_ascii(words: Words) -> np.ndarray:
    """1 for every word that has an ASCII letter (its other bytes need no look)."""
    kinds = words.letters[:, 0] & 0xFF
    return (np.minimum.reduceat(kinds, words.first) < 0x80).astype(np.float64)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            found = list(_judged(model, batch.column("_text")))
            if not found:
                continue
            langs, scores, runs = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(langs, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))),
                ],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "runs"],
            )

    return run


def identified(docs: DataFrame, model: Model | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language has at least ``least`` of the words.

    Rows that are ``und`` (null text, no letter, nothing learned) go.  No shuffle.
    """
    shared = session(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = _judged(shared.value, batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score, _ in judged], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
