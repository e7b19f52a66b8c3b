"""URL filter: host rules first, then a ratio of two character language models.

Two variable-order Markov models, of accepted and of rejected URLs, are counted as tables
of character n-grams.  The probability of a character is smoothed from the shorter context
up (absolute discounting); where a context was never seen the shorter one decides.  A URL's
score is the length-normalised difference of its two log-likelihoods, and a threshold
calibrated on the labelled URLs divides keep from drop.

The threshold is set on scores that no URL had a part in: labelled URLs fall into folds, and
each fold is scored by the models of the others.  The models in use count all of them.

Scoring is one join: the model table holds for each n-gram how much the log ratio changes
against the n-gram without its first character, so the ratio at the longest known context
is the sum over all known n-grams that end at the character.  All of these are endings of the
longest n-gram there, so a URL has one n-gram a character.  URLs are scored in blocks: a
block's n-grams are listed once each, with the URLs they occur in, and only these lists move.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelab.llm.common import session, written
from curvelab.scale import salted_join

#: Longest n-gram, and discount.
ORDER, DISCOUNT = 5, 0.5
#: Parts of the labelled URLs; each is scored by models of the other ones for the threshold.
FOLDS = 5
#: The model of all labelled URLs, beside the folds' numbers.
ALL = -1
#: URLs whose n-grams are listed together.
BLOCK = 2000
#: Marks the beginning of a URL in its first n-grams; cannot stand in one.
START = "\x02"
#: Steps between which the threshold is looked for.
STEPS = 2000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    """``text`` is a host and the beginning of a path, as in ``example.com/en/7``."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


# Fixed values.
RULES = (
    HostRule("com/en/", "block"),
    HostRule("example.com/en/7", "allow"),
    HostRule("net/de/", "allow"),
    HostRule("example.net/de/8", "block"),
    HostRule("org/es/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[HostRule]) -> Column:
    """Index of the longest rule that fits (of equal ones the first); null if none does."""
    out = None
    for i, rule in sorted(enumerate(rules), key=lambda x: -len(x[1].text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, i) if out is None else out.when(fits, i)
    return F.lit(None).cast("int") if out is None else out


def longest_grams(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per character: the columns of ``urls`` and ``word``, the longest n-gram that ends there."""
    padded = F.concat(F.lit(START), F.col("url"))
    ends = F.explode(F.sequence(F.lit(2), F.char_length("url") + 1))
    at = urls.filter(F.char_length("url") > 0).withColumns({"_u": padded, "_end": ends})
    size = F.least(F.lit(order), F.col("_end"))
    return at.withColumn("word", F.substring(F.col("_u"), F.col("_end") - size + 1, size)).drop("_u", "_end")


def endings(words: DataFrame) -> DataFrame:
    """One row per ending of ``word``, itself included, as ``gram``."""
    return words.withColumn("_n", F.explode(F.sequence(F.lit(1), F.char_length("word")))).withColumn("gram", F.right(F.col("word"), F.col("_n"))).drop("_n")


def _spread(urls: DataFrame, key: str) -> DataFrame:
    """A URL becomes some hundred n-grams: the URLs are spread over as many tasks as a shuffle has."""
    return urls.repartition(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def fold_of(url: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(folds)).cast("int")


def counted(labelled: DataFrame, order: int = ORDER, folds: int = FOLDS) -> DataFrame:
    """(fold, gram, c0, c1) from rows (url, good, fold): n-grams of the other folds, and of ``ALL``."""
    sides = [(fold, side) for fold in range(folds) for side in (0, 1)]
    here = [F.when((F.col("fold") == fold) & (F.col("good") == bool(side)), 1).otherwise(0) for fold, side in sides]
    names = [f"f{fold}_{side}" for fold, side in sides]
    words = longest_grams(_spread(labelled, "url"), order).groupBy("word").agg(*[F.sum(h).alias(n) for h, n in zip(here, names)])
    own = endings(words).groupBy("gram").agg(*[F.sum(n).alias(n) for n in names])
    total = [sum((F.col(f"f{fold}_{side}") for fold in range(1, folds)), F.col(f"f0_{side}")) for side in (0, 1)]
    models = [F.struct(F.lit(ALL).alias("fold"), *[t.alias(f"c{side}") for side, t in enumerate(total)])]
    if folds > 1:
        models += [F.struct(F.lit(fold).alias("fold"), *[(t - F.col(f"f{fold}_{side}")).alias(f"c{side}") for side, t in enumerate(total)]) for fold in range(folds)]
    return own.select("gram", F.explode(F.array(*models)).alias("m")).select("m.fold", "gram", "m.c0", "m.c1").filter("c0 + c1 > 0")


def fit(labelled: DataFrame, order: int = ORDER, discount: float = DISCOUNT, folds: int = FOLDS) -> DataFrame:
    """Table (fold, gram, change) from rows (url, good, fold): see the module's text.

    Of both classes every n-gram is in the table that either has seen, so a class that
    lacks one falls back to its shorter context.
    """
    counts = written(counted(labelled, order, folds), "grams")
    size = F.char_length("gram")
    context = F.substring(F.col("gram"), F.lit(1), size - 1)
    rest = F.substring(F.col("gram"), F.lit(2), size - 1)
    per_context = counts.groupBy("fold", context.alias("context")).agg(
        *[F.sum(f"c{s}").alias(f"t{s}") for s in (0, 1)], *[F.sum((F.col(f"c{s}") > 0).cast("long")).alias(f"k{s}") for s in (0, 1)]
    )
    told = counts.select("fold", "gram", size.alias("n"), context.alias("context"), rest.alias("rest"), "c0", "c1").join(per_context, ["fold", "context"])
    told = written(told, "contexts")
    letters = {r["fold"]: r["count"] for r in told.filter("n = 1").groupBy("fold").count().collect()}  # a row per fold
    uniform = F.coalesce(*[F.when(F.col("fold") == fold, 1.0 / (n + 1)) for fold, n in sorted(letters.items())], F.lit(1.0))
    level = told.filter("n = 1").withColumns({f"p{s}": _smoothed(s, discount, uniform) for s in (0, 1)})
    level = written(level.select("fold", "gram", "p0", "p1", (F.log("p1") - F.log("p0")).alias("change")), "order-1")
    out = level.select("fold", "gram", "change")
    for n in range(2, order + 1):
        below = level.select("fold", F.col("gram").alias("rest"), F.col("p0").alias("b0"), F.col("p1").alias("b1"))
        level = told.filter(F.col("n") == n).join(below, ["fold", "rest"]).withColumns({f"p{s}": _smoothed(s, discount, F.col(f"b{s}")) for s in (0, 1)})
        change = F.log(F.col("p1") / F.col("b1")) - F.log(F.col("p0") / F.col("b0"))
        level = written(level.select("fold", "gram", "p0", "p1", change.alias("change")), f"order-{n}")
        out = out.unionByName(level.select("fold", "gram", "change"))
    return out


def _smoothed(side: int, discount: float, lower: Column) -> Column:
    """Absolute discounting; a context that the class has not seen takes the lower order."""
    count, total, kinds = F.col(f"c{side}"), F.col(f"t{side}"), F.col(f"k{side}")
    own = (F.greatest(count - discount, F.lit(0.0)) + discount * kinds * lower) / total
    return F.when(total > 0, own).otherwise(lower)


def scores(urls: DataFrame, model: DataFrame, order: int = ORDER, block: int = BLOCK) -> DataFrame:
    """(url, fold, score) of distinct rows (url, fold): mean log ratio per character, 0 for an empty URL.

    A block of URLs lists each of its n-grams once, in the task that holds the block, with the
    numbers of the URLs it occurs in.  The lists meet the model, dealt to several tasks where
    an n-gram is in every block, and return to their block to be summed.
    """
    blocks = max(1, -(-urls.count() // block))
    dealt = _spread(urls.select("url", "fold", F.pmod(F.xxhash64("url", "fold"), F.lit(blocks)).alias("block")), "block")
    asked = written(dealt.withColumn("id", F.row_number().over(Window.partitionBy("block").orderBy("fold", "url"))), "blocks")
    lists = written(longest_grams(_spread(asked, "block"), order).groupBy("block", "fold", "word").agg(F.collect_list("id").alias("ids")), "lists")
    told = endings(lists.select("fold", "word").distinct()).join(model, ["fold", "gram"]).groupBy("fold", "word").agg(F.sum("change").alias("change"))
    met = salted_join(lists, told, ["fold", "word"], "inner", salts=4).select("block", "ids", "change")
    found = _spread(met, "block").select("block", F.explode("ids").alias("id"), "change").groupBy("block", "id").agg(F.sum("change").alias("_s"))
    kept = asked.join(found, ["block", "id"], "left")
    score = F.coalesce(F.col("_s") / F.greatest(F.char_length("url"), F.lit(1)), F.lit(0.0))
    return kept.select("url", "fold", F.round(score, 9).alias("score"))


def calibrate(scored: DataFrame, steps: int = STEPS) -> float:
    """The threshold on rows (score, good) with the largest sum of both classes' hit rates."""
    ends = scored.agg(F.min("score").alias("a"), F.max("score").alias("b")).first()
    if ends["a"] is None or ends["a"] == ends["b"]:
        return 0.0
    low, width = ends["a"], (ends["b"] - ends["a"]) / steps
    step = F.least(F.floor((F.col("score") - low) / width), F.lit(steps - 1))
    told = {r["s"]: (r["bad"], r["good"]) for r in scored.groupBy(step.alias("s")).agg(
        F.sum(F.when(F.col("good"), 0).otherwise(1)).alias("bad"), F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("good")).collect()}
    bad_all, good_all = (sum(v[k] for v in told.values()) for k in (0, 1))
    if not bad_all or not good_all:
        return 0.0
    best, top, bad, good = [], -math.inf, 0, 0
    for s in range(steps):
        rate = bad / bad_all + (good_all - good) / good_all
        if rate > top + 1e-12:
            best, top = [s], rate
        elif rate > top - 1e-12:
            best.append(s)
        bad, good = (x + told.get(s, (0, 0))[k] for k, x in enumerate((bad, good)))
    return low + width * best[len(best) // 2]  # the middle of the gap


def judge(
    pages: DataFrame, rules: Sequence[HostRule] = RULES, order: int = ORDER, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """id, host, path, rule, score and verdict of every row.

    The models learn from all distinct URLs that a rule allows or blocks, and the threshold is
    calibrated on the scores that these get from the models of the other folds.  A URL
    under a rule has the rule's verdict, others have the method's: allow at the threshold or
    above.

    A null URL, or one without ``://``, has an empty host and path and fits no rule; a null
    or empty one has score 0.  With one class of labelled URLs or none, all scores are 0 and
    the method allows.  Rows with null or equal ids are all kept; an empty table gives an
    empty result; other columns are not read.
    """
    session(pages.sparkSession)
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{url_col}`").alias("url"))
    placed = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    number = rule_of(F.col("host"), F.col("path"), rules)
    texts, verdicts = (F.array(*[F.lit(getattr(r, k)) for r in rules]).cast("array<string>") for k in ("text", "verdict"))
    placed = placed.withColumn("_r", number).select(
        id_col, url.alias("url"), "host", "path", F.get(texts, F.col("_r")).alias("rule"), F.get(verdicts, F.col("_r")).alias("_v")
    )
    distinct = written(placed.groupBy("url").agg(F.first("_v").alias("_v")), "urls")
    labelled = distinct.filter("_v IS NOT NULL").select("url", (F.col("_v") == "allow").alias("good"), fold_of(F.col("url")).alias("fold"))
    if labelled.select("good").distinct().count() < 2:
        scored, threshold = distinct.select("url", F.lit(0.0).alias("score")), 0.0
    else:
        asked = distinct.select("url", F.lit(ALL).alias("fold")).unionByName(labelled.select("url", "fold"))
        told = written(scores(asked, fit(labelled, order), order), "scores")
        threshold = calibrate(told.filter(F.col("fold") != ALL).join(labelled.select("url", "good"), "url"))
        scored = told.filter(F.col("fold") == ALL).select("url", "score")
    own = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return placed.join(scored, "url", "left").select(id_col, "host", "path", "rule", "score", F.coalesce("_v", own).alias("verdict"))
