"""Learned decision lists over text statistics, as ordered Spark conditional expressions.

Statistics, learning and verdicts are DataFrame expressions.  Sequential covering learns
the list: a rule is grown condition by condition from counts per feature and bin over the
rows that are still open, pruned on rows held back for that, and kept if it is precise
there; the rows it covers leave, and the next rule is learned on the rest.  The driver
sees counts per bin only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelab.llm.common import session, written

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: Bins per feature, conditions per rule and rules per list.
BINS, CONDITIONS, RULES = 24, 4, 8
#: Rejected share of the rows that a rule must cover where it was not grown.
PRECISION = 0.8
#: Rows that a rule must cover where it is grown, and where it is pruned.
COVER = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def words_of(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.array_remove(F.split(F.translate(text, _BLANKS, " " * len(_BLANKS)), " "), "")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that stand twice or more in the text.

    Windows are compared by 64-bit hash.  Texts whose windows all differ stop there; in the
    others the windows are sorted by hash, equal neighbours give their places, and the
    places, in order, cover up to three words each.
    """

    def places(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        marked = _let(ordered, lambda s: F.transform(s, lambda x, k: F.when(same(s, k, k - 1) | same(s, k, k + 1), x["i"])))
        return F.sort_array(F.array_compact(marked))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(w: Column) -> Column:
        hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(1)))
        repeats = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(places(h), covered)))
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(repeats)

    return _let(words, count)


#: Features of the learner, from the counts of ``statistics``.
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_chars, 1)",
    "digit_share": "n_digits / greatest(n_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "words": "cast(n_words AS double)",
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every row: its id, the base counts and those the features need.

    Null and empty texts count as having nothing.  Rows with null or equal ids are all kept.
    """
    raw = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    t = F.col("_t")
    chars = F.char_length(t)
    less = lambda characters: (chars - F.char_length(_without(t, characters))).cast("long")
    lines = _let(
        F.filter(F.split(t, "\n"), lambda x: F.char_length(_without(x, _BLANKS)) > 0),
        lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")),
    )
    counted = _let(
        words_of(t),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d"), repeated_words(w).alias("r")),
    )
    return raw.select(
        id_col,
        counted.alias("_w"), lines.alias("_l"),
        F.char_length(_without(t, _BLANKS)).cast("long").alias("word_chars"),
        less(_SYMBOLS).alias("n_symbols"),
        chars.cast("long").alias("n_chars"),
        less("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        less("0123456789").alias("n_digits"),
        less(".,;:!?").alias("n_marks"),
    ).select(
        id_col,
        F.col("_w.n").alias("n_words"), "word_chars", "n_symbols",
        (F.col("_l.n") - F.col("_l.d")).cast("long").alias("n_dup_lines"),
        F.col("_w.r").alias("n_repeat_words"),
        F.col("_w.d").alias("n_distinct"), F.col("_l.n").cast("long").alias("n_lines"),
        "n_chars", "n_upper", "n_digits", "n_marks",
    )


@dataclass(frozen=True)
class Condition:
    """A feature at or above a threshold, or below it."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects, with what it covered where it was pruned."""

    conditions: tuple[Condition, ...]
    rejected: int
    accepted: int

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c.column() for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + f" -> reject ({self.rejected} of {self.rejected + self.accepted})"


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the first rule that holds rejects; else keep."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), False)
    for rule in rules[1:]:
        out = out.when(rule.column(), False)
    return out.otherwise(True)


def learn(labelled: DataFrame, label: str = "label", part: str = "part", features: dict[str, str] = FEATURES) -> list[Rule]:
    """Sequential covering of the rows with label 0.

    ``labelled`` has the statistics, the label (1 keep, 0 reject) and ``part`` (0 and 1
    grow, 2 prune).  All labelled rows are used; without rows of both labels the list is
    empty.
    """
    names = list(features)
    rows = written(labelled.select(F.col(label).cast("int").alias("y"), F.col(part).cast("int").alias("part"), *[F.expr(c).alias(n) for n, c in features.items()]), "labelled")
    shares = [i / BINS for i in range(1, BINS)]
    told = rows.filter("y = 0").agg(*[F.percentile_approx(n, shares, 2000).alias(n) for n in names]).first()
    more = rows.filter("y = 1").agg(*[F.percentile_approx(n, shares, 2000).alias(n) for n in names]).first()
    cuts = {n: sorted({*(told[n] or []), *(more[n] or [])}) for n in names}
    if not any(cuts.values()) or rows.select("y").distinct().count() < 2:
        return []
    # the bin of a value is the number of thresholds at or below it
    place = lambda n: F.expr(f"size(filter(cast(array({', '.join(f'{t!r}D' for t in cuts[n])}) AS array<double>), t -> t <= {n}))")
    binned = written(rows.select("y", "part", *[place(n).alias(n) for n in names]), "binned")
    rules: list[Rule] = []
    open_: Column = F.lit(True)
    while len(rules) < RULES:
        grown = _grow(binned, open_, cuts)
        rule = _prune(binned, open_, grown, cuts) if grown else None
        if rule is None:
            break
        rules.append(rule)
        open_ = open_ & ~_binned(rule.conditions, cuts)
    return rules


def _binned(conditions: tuple[Condition, ...] | list[Condition], cuts: dict[str, list[float]]) -> Column:
    """The conjunction in terms of bins."""
    tests = []
    for c in conditions:
        place = cuts[c.feature].index(c.threshold) + 1
        tests.append(F.col(c.feature) >= place if c.above else F.col(c.feature) < place)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _grow(binned: DataFrame, open_: Column, cuts: dict[str, list[float]]) -> list[Condition]:
    """Add the condition with the largest information gain until only rejects are covered."""
    names, conditions = list(cuts), []
    feature = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in names]))
    while len(conditions) < CONDITIONS:
        rows = binned.filter(open_ & (F.col("part") < 2) & _binned(conditions, cuts))
        counts = rows.select("y", feature.alias("x")).groupBy("x.f", "x.b").agg(F.sum(1 - F.col("y")).alias("bad"), F.sum("y").alias("good")).collect()
        best, bad_all, good_all = _best(counts, cuts)
        if best is None:
            break
        conditions.append(best)
        if good_all == 0 or bad_all == 0:
            break
    return conditions


def _best(counts: list, cuts: dict[str, list[float]]) -> tuple[Condition | None, int, int]:
    """The condition that gains most over the rows counted, and what it covers."""
    from math import log2

    per: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts:
        per.setdefault(r["f"], {})[r["b"]] = (r["bad"], r["good"])
    best, top, covers = None, 1e-9, (0, 0)
    for f in sorted(per):
        bins = per[f]
        bad_all, good_all = (sum(v[k] for v in bins.values()) for k in (0, 1))
        if not bad_all or not good_all:
            return None, bad_all, good_all
        before = log2(bad_all / (bad_all + good_all))
        bad = good = 0
        for place, threshold in enumerate(cuts[f], 1):
            bad, good = (x + bins.get(place - 1, (0, 0))[k] for k, x in enumerate((bad, good)))
            for above, p, n in ((False, bad, good), (True, bad_all - bad, good_all - good)):
                if p >= COVER and (gain := p * (log2(p / (p + n)) - before)) > top:
                    best, top, covers = Condition(f, above, threshold), gain, (p, n)
    return best, *covers


def _prune(binned: DataFrame, open_: Column, grown: list[Condition], cuts: dict[str, list[float]]) -> Rule | None:
    """The shortest prefix of the rule that is best on the rows held back, if it is precise."""
    rows = binned.filter(open_ & (F.col("part") == 2))
    sums = []
    for k in range(1, len(grown) + 1):
        holds = _binned(grown[:k], cuts)
        sums += [F.sum(F.when(holds, 1 - F.col("y"))).alias(f"bad{k}"), F.sum(F.when(holds, F.col("y"))).alias(f"good{k}")]
    told = rows.agg(*sums).first()
    best, top = None, -1.0
    for k in range(1, len(grown) + 1):
        bad, good = told[f"bad{k}"] or 0, told[f"good{k}"] or 0
        share = (bad + 1) / (bad + good + 2)
        if bad >= COVER / 2 and share > top + 1e-9:
            best, top = Rule(tuple(grown[:k]), bad, good), share
    return best if best is not None and top >= PRECISION else None


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """Base counts, base_failed and kept of every row, the list learned from the labelled rows.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows.
    kept: not base_failed, and not rejected by the list.  Labels of one id are taken
    together (the smallest); labels without a document and null labels are not used.
    A null or empty text fails the base.  Empty tables give an empty result.
    """
    session(docs.sparkSession)
    stats = written(statistics(docs, id_col, text_col), "statistics")
    known = labels.groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.min(F.col(f"`{label_col}`")).alias("label")).filter("_id IS NOT NULL AND label IS NOT NULL")
    labelled = stats.join(known, F.col(id_col) == F.col("_id")).withColumn("part", F.pmod(F.xxhash64("_id"), F.lit(3)))
    rules = learn(labelled)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumns({"base_failed": failed, "kept": ~failed & verdict(rules)})
