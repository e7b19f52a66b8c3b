"""How filters interact: what each removes in every order, from tables of failing ids.

Each filter stores one table of the rows that fail it.  What a filter removes after others
depends only on which others came before, so every set of earlier filters is one prefix.
The survivors of all prefixes are one relation of (prefix, row): filter by filter it is
doubled and the half that applies the filter is left-anti joined to its failing rows.
Removals are the survivors' left-semi join to the failing rows of each filter not yet
applied.  All these joins are placed by row once.  Orders, steps and sums over orders are
read off the counts per (part, prefix, filter).

No table that grows with the input is broadcast: Spark takes a stored table for as large as
its compressed files, and a salted one for as large as before it was repeated, while the
driver would hold many times that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelab.llm.common import session, written
from curvelab.scale import salted_join, union_all

#: A to Z, bytes inside a code point after its first, and the marks of filter D.
_CAPITALS = bytes(range(65, 91))
_FOLLOWING = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"
LEAST_WORDS = 50

MEASURES = "id {id}, part string, row bigint, digest binary, few boolean, repetitive boolean, capitals boolean, marks boolean"


def measure(text: bytes) -> tuple[bool, bool, bool, bool]:
    """Fails: under 50 words; under 65 % distinct words; over 5 % capitals; a mark."""
    words = text.split()  # on exactly the white space x20, x09 to x0D
    n = len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _FOLLOWING))
    return n < LEAST_WORDS, 100 * len(set(words)) < 65 * n, 100 * capitals > 5 * points, len(text.translate(None, _MARKS)) < len(text)


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column("text")]
        told = [measure(t) for t in texts]
        digest = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("part"), batch.column("row"), pa.array(digest, pa.binary()),
             *(pa.array([t[k] for t in told], pa.bool_()) for k in range(4))],
            names=["id", "part", "row", "digest", "few", "repetitive", "capitals", "marks"],
        )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Digest and the four text filters of every row; ``row`` tells rows of one id apart."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.monotonically_increasing_id().alias("row"),
        F.encode(F.col(f"`{text_col}`"), "UTF-8").alias("text"),
    )
    return rows.mapInArrow(_measures, MEASURES.format(id=kind))


def _sorted(df: DataFrame) -> DataFrame:
    """Joined by a sort-merge join, however small Spark takes it for."""
    return df.hint("merge")


def repeats(rows: DataFrame) -> DataFrame:
    """Rows whose text a smaller id has too.

    The smallest id of a text is found map-side first; its rows, however many, are dealt to
    several tasks to be compared with it.
    """
    firsts = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return salted_join(rows.select("row", "digest", "id"), _sorted(firsts), "digest", "inner").filter("id > first").select("row")


def text_filters(rows: DataFrame) -> dict[str, DataFrame]:
    """The five filters by letter, each as the ``row`` column of the rows that fail it."""
    flags = {"A": "few", "B": "repetitive", "C": "capitals", "D": "marks"}
    return {**{name: rows.filter(flag).select("row") for name, flag in flags.items()}, "E": repeats(rows)}


def _bit(names: Sequence[str], name: str) -> int:
    return 1 << names.index(name)


def removals(rows: DataFrame, failing: Mapping[str, DataFrame], marked: Mapping[str, DataFrame]) -> DataFrame:
    """(part, prefix, filter, removed, one count per mark): what a filter removes after a prefix.

    ``rows`` has (row, part), ``failing`` and ``marked`` have distinct rows.  ``prefix`` is the
    sum of the bits of the filters before, the n-th name's bit being 2**n.  Counts of zero
    are left out.  Only rows that fail something enter the joins.
    """
    names = list(failing)
    tagged = union_all([f.select("row", F.lit(name).alias("filter")) for name, f in failing.items()])
    some = rows.join(_sorted(tagged.select("row")), "row", "left_semi").select("row", "part", F.lit(0).alias("prefix"))
    for name, ids in marked.items():
        some = some.join(_sorted(ids.select("row", F.lit(1).alias(f"is_{name}"))), "row", "left")
    alive = some
    for name in names:
        bit = _bit(names, name)
        both = alive.withColumn("prefix", F.explode(F.array(F.col("prefix"), F.col("prefix") + bit)))
        a, b = both.alias("a"), _sorted(failing[name].select("row")).alias("b")
        applies = F.col("a.prefix").bitwiseAND(F.lit(bit)) != 0
        alive = a.join(b, (F.col("a.row") == F.col("b.row")) & applies, "left_anti")
    still = F.filter(
        F.array(*[F.struct(F.lit(name).alias("filter"), F.lit(_bit(names, name)).alias("bit")) for name in names]),
        lambda f: F.col("prefix").bitwiseAND(f["bit"]) == 0,
    )
    ahead = alive.withColumn("_f", F.explode(still)).withColumn("filter", F.col("_f.filter")).drop("_f")
    removed = ahead.join(_sorted(tagged), ["row", "filter"], "left_semi")
    return removed.groupBy("part", "prefix", "filter").agg(
        F.count(F.lit(1)).alias("removed"), *[F.count(f"is_{name}").alias(name) for name in marked]
    )


def _orders(names: Sequence[str]) -> Column:
    """Every order of the filters with its steps: filter, prefix before, and the cells of the steps so far."""
    steps = []
    for order in permutations(names):
        before, cells = 0, []
        for step, name in enumerate(order, 1):
            cells = [*cells, f"{before}{name}"]
            steps.append(
                F.struct(
                    F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(name).alias("filter"),
                    F.lit(cells[-1]).alias("cell"), F.array(*map(F.lit, cells)).alias("so_far"),
                )
            )
            before += _bit(names, name)
    return F.array(*steps)


def _shapley(names: Sequence[str], count) -> Column:
    """Removals of each filter summed over all orders: a prefix of k filters occurs k! (n - 1 - k)! times."""
    entries = []
    for name in names:
        total = F.lit(0).cast("long")
        for prefix in range(1 << len(names)):
            if not prefix & _bit(names, name):
                k = prefix.bit_count()
                total = total + count(f"{prefix}{name}") * F.lit(factorial(k) * factorial(len(names) - 1 - k))
        entries += [F.lit(name), total]
    return F.create_map(*entries)


def by_order(parts: DataFrame, cells: DataFrame, names: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``parts`` has (part, total).  A part has at most 2**(n-1) n cells, which travel as one map.
    """
    values = ["removed", *marks]
    cell = F.concat(F.col("prefix").cast("string"), "filter")
    told = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(cell, F.struct(*values)))).alias("_cells"))
    count = lambda key, value="removed": F.coalesce(F.try_element_at("_cells", F.lit(key) if isinstance(key, str) else key)[value], F.lit(0).cast("long"))
    full = (1 << len(names)) - 1
    alone = F.create_map(*[x for name in names for x in (F.lit(name), count(f"{full - _bit(names, name)}{name}"))])
    every = F.create_map(*[x for name in names for x in (F.lit(name), count(f"0{name}"))])
    per_part = parts.join(_sorted(told), "part", "left").withColumns({"_alone": alone, "_every": every, "_shapley": _shapley(names, count)})
    steps = per_part.withColumn("_s", F.explode(_orders(names)))
    name = F.col("_s.filter")
    gone = F.aggregate("_s.so_far", F.lit(0).cast("long"), lambda a, c: a + count(c))
    return steps.select(
        "part", "_s.filter_order", "_s.step",
        (F.col("total") - gone).alias("kept"),
        count(F.col("_s.cell")).alias("removed"),
        (F.col("_every")[name] - count(F.col("_s.cell"))).alias("redundant"),
        F.col("_alone")[name].alias("unique_fails"),
        *[count(F.col("_s.cell"), mark).alias(f"{mark}_lost") for mark in marks],
        F.col("_shapley")[name].alias("shapley"),
    )


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """The five text filters A to E over every part of the documents, in all orders.

    Texts are read whole; null counts as empty, as does a null part.  Rows are counted one by
    one, also those that share an id or have none; E compares only ids that are not null, and
    equal ids are not smaller.  A row is good or toxic if any label of its id says so; labels
    without a document change nothing.  An empty table gives an empty result.  Other columns
    are not read.
    """
    session(docs.sparkSession)
    rows = written(measures(docs, id_col, text_col, part_col), "measures")
    failing = {name: written(f, f"fails-{name.lower()}") for name, f in text_filters(rows).items()}
    key = F.col(f"`{id_col}`").alias("id")
    marked = {}
    for name, holds in (("good", "quality = 1"), ("toxic", "toxic = 1")):
        ids = labels.filter(holds).select(key).distinct()
        marked[name] = written(salted_join(rows.select("row", "id"), _sorted(ids), "id", "left_semi").select("row"), name)
    cells = written(removals(rows.select("row", "part"), failing, marked), "cells")
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("total"))
    return by_order(parts, cells, list(failing), list(marked))
