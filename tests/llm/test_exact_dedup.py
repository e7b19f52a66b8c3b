import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from curvelab.llm import exact_dedup


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) of every row, groups by plain comparison."""
    shas = [hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", r[1] or "").encode()).hexdigest() for r in rows]
    members = defaultdict(list)
    for i, sha in enumerate(shas):
        members[sha].append(i)
    out = []
    for sha, group in members.items():
        first = min(group, key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
        out += [(rows[i][0], rows[first][0], len(group), i == first, sha) for i in group]
    return Counter(out)


def found(frame):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in frame.collect())


def test_edges(edges, edge_rows, nothing):
    assert found(exact_dedup.groups(edges)) == brute(edge_rows)
    assert found(exact_dedup.groups(edges, share=0.2)) == brute(edge_rows)
    assert exact_dedup.groups(nothing).count() == 0


def test_frequent_texts_are_resolved_apart_from_the_rest(spark):
    rows = [(i, "a  hot\ttext" if i % 3 == 0 else f"text {i // 4}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    hot = exact_dedup.frequent(exact_dedup.digests(docs).cache(), 3000, 0.01).collect()
    assert [(r["keep_id"], r["group_size"]) for r in hot] == [(0, 1000)]
    assert found(exact_dedup.groups(docs, share=0.01)) == brute(rows)


def test_the_summary_misses_no_frequent_text(spark):
    # 30 texts just above the share among rows that are all different, dealt over many tasks
    rows = [(i, f"hot {i % 30}" if i < 30 * 45 else f"cold {i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(23)
    assert exact_dedup.frequent(exact_dedup.digests(docs).cache(), 4000, 0.01).count() == 30


def test_white_space_runs_only():
    for text in ("", " ", "  ", " \t", "\t", "\x0b\x0c", "a b", "a  b", "a \n", "   ", "\x1f\x20\x1f"):
        java = re.sub(exact_dedup._RUN, " ", text)
        assert java == re.sub("[\x20\x09-\x0d]+", " ", text)


def test_kept_rows_have_all_columns(edges, edge_rows):
    kept = exact_dedup.deduplicated(edges)
    assert kept.columns == edges.columns
    want = Counter(row[:1] + row[4:] for row in brute(edge_rows) if row[3])
    sha = F.sha2(F.encode(exact_dedup.normalised(F.col("text")), "UTF-8"), 256)
    assert Counter((r[0], r[1]) for r in kept.select("doc_id", sha).collect()) == want


def test_no_python_worker(edges):
    plan = exact_dedup.groups(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
