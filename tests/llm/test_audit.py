import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from curvelab.llm import audit
from tests.llm.conftest import DOCS, rows as table_rows


def fails(rows, i):
    text = rows[i][1] or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    first = min((r[0] for r in rows if r[0] is not None and (r[1] or "") == text), default=None)
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": re.search("[#$%&*|]", text) is not None,
        "E": rows[i][0] is not None and first < rows[i][0],
    }


def brute(rows, labels):
    """Every order applied row by row."""
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    failing = [fails(rows, i) for i in range(len(rows))]
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for step, name in enumerate(order, 1):
            for r, f in zip(rows, failing):
                told = out.setdefault((r[3] or "", order, step), Counter())
                earlier = any(f[x] for x in order[: step - 1])
                told["kept"] += not (earlier or f[name])
                told["removed"] += f[name] and not earlier
                told["redundant"] += f[name] and earlier
                told["unique_fails"] += f[name] and sum(f.values()) == 1
                told["good_lost"] += f[name] and not earlier and r[0] in good
                told["toxic_lost"] += f[name] and not earlier and r[0] in toxic
    total = Counter()
    for (part, order, step), told in out.items():
        total[part, order[step - 1]] += told["removed"]
    return {(p, o, s, *(c[k] for k in NAMES), total[p, o[s - 1]]) for (p, o, s), c in out.items()}


NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def found(frame):
    rows = frame.collect()
    assert len(rows) == len(set(rows))
    return {(r["part"], r["filter_order"], r["step"], *(r[k] for k in NAMES), r["shapley"]) for r in rows}


def test_small_table(spark, small):
    labels = table_rows("labels")
    docs = spark.createDataFrame(small, DOCS)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert found(audit.audit(docs.repartition(5), told)) == brute(small, labels)


def test_edges(spark, edges, edge_rows, nothing):
    labels = [(3, 1, 1), (3, 1, 0), (10, 1, None), (None, 1, 1), (11, None, 1), (999, 1, 1), (7, 0, 0)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert found(audit.audit(edges, told)) == brute(edge_rows, [x for x in labels if x[0] is not None])
    assert audit.audit(nothing, told).count() == 0
    assert found(audit.audit(edges, told.limit(0))) == brute(edge_rows, [])


def test_a_third_of_all_rows_is_one_text(spark):
    rows = [(i, "same $ text" if i % 3 else " ".join(f"w{i}x{k}" for k in range(60)), None, f"s{i % 2}", 0) for i in range(900)]
    told = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audit.audit(spark.createDataFrame(rows, DOCS).repartition(9), told)
    assert got.agg(F.sum("removed")).first()[0] == 120 * 600
    assert got.filter("filter_order = 'EABCD' AND step = 1").agg(F.sum("removed")).first()[0] == 599


def test_any_filters(spark):
    rows = spark.createDataFrame([(i, "p") for i in range(20)], "row long, part string")
    ids = lambda *n: spark.createDataFrame([(x,) for x in n], "row long")
    cells = audit.removals(rows, {"x": ids(1, 2, 3), "y": ids(3, 4)}, {"gold": ids(2, 4)})
    got = {(r["prefix"], r["filter"]): (r["removed"], r["gold"]) for r in cells.collect()}
    assert got == {(0, "x"): (3, 1), (0, "y"): (2, 1), (1, "y"): (1, 1), (2, "x"): (2, 1)}


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    plans = {}

    def ran(df, label):
        df.collect()
        plans[label] = df._jdf.queryExecution().executedPlan().toString()

    def written(df, label, write=audit.written):
        ran(df, label)
        return write(df, label)

    monkeypatch.setattr(audit, "written", written)
    texts = ["few words", "w " * 60, "A $ B", " ".join(f"w{k}" for k in range(60)), " ".join(f"A{k}#" for k in range(60))]
    rows = [(i, texts[i % 5] + " x" * (i % 3), None, f"s{i % 2}", 0) for i in range(40)]
    labels = [(i, i % 2, i % 3) for i in range(50)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = audit.audit(spark.createDataFrame(rows, DOCS), told)
    ran(out, "out")
    assert found(out) == brute(rows, labels)
    joins = {label: plan.partition("== Initial Plan ==")[0].count("SortMergeJoin") for label, plan in plans.items()}
    assert {label: n for label, n in joins.items() if n} == {"fails-e": 1, "good": 1, "toxic": 1, "cells": 9, "out": 1}
    assert not [label for label, plan in plans.items() if "Broadcast" in plan]


def test_words_are_read_whole():
    text = ("w " * 60_000 + "last").encode()
    assert audit.measure(text) == (False, True, False, False)
    assert audit.measure("ÄÖ A B".encode()) == (True, False, True, False)
    assert audit.measure(b"") == (True, False, False, False)
