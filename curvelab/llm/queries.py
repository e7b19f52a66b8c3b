"""Registered queries of the operators: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelab.llm import (
    audit,
    bpe,
    decontaminate,
    discriminant,
    exact_dedup,
    language,
    lloyd,
    ngram_join,
    rules,
    secrets,
    sharding,
    token_counts,
    urls,
)
from curvelab.llm.common import table

#: Five-word shingles of the texts of a table, A-Z lower-cased; of fewer words the whole sequence.
_SHINGLES = r"""{t}_w AS (SELECT {id} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {t}),
{t}_s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM {t}_w),
{t}_n AS (SELECT id, count(*) AS n FROM {t}_s GROUP BY 1)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into eight shards by the Feistel permutation of their row numbers."""
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8, seed=17)


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, through a ledger of blobs begun for this run."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    written = F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string")))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return found.withColumn("spans", F.array_join(written, ",")).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.encode("spans", "UTF-8"), 256).alias("base_sha256"), "spans",
    )


@query
def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe.encode(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", digests=True)


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, through a cache begun for this run."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", limit=4096)


@query
def op4_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains to 0.8 of its five-word shingles."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), inside=True)


# Every item of the given tables has five words or more.
ORACLES["op4_benchmark_containment"] = f"""
WITH {_SHINGLES.format(t='documents', id='doc_id')}, {_SHINGLES.format(t='benchmark', id='item_id')}
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared, any_value(n) AS n_shingles, count(*) / any_value(n) AS containment
FROM documents_s d JOIN benchmark_s i USING (g) JOIN benchmark_n ON benchmark_n.id = i.id GROUP BY d.id, i.id HAVING 100 * count(*) >= 80 * any_value(n)
"""


@query
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under five-word Jaccard similarity of 0.8 or more."""
    return ngram_join.link(table(spark, sf_dir, "documents"), threshold=0.8)


ORACLES["op8_ngram_jaccard"] = f"""
WITH RECURSIVE {_SHINGLES.format(t='documents', id='doc_id')},
both_ AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM documents_s a JOIN documents_s b USING (g) WHERE a.id < b.id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM both_ JOIN documents_n x ON x.id = a JOIN documents_n y ON y.id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
near AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b)
SELECT reach.a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reach.b) AS component_id FROM reach LEFT JOIN documents_n ON id = reach.a GROUP BY reach.a
"""


def remainder(n: int) -> Column:
    """CRC-32 of the document's id as text, modulo n; null where the id is null."""
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(n))


@query
def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; documents with remainder 2 of 4 are held out of the fit."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, remainder(4) != 2)
    predicted = language.predict(docs, model)
    return predicted.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op6_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of every document by base rules and the learned decision list."""
    judged = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op9_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; documents with remainder 1 of 3 are held out of the fit."""
    scored = discriminant.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(3) != 1)
    return scored.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL by host rules and the ratio of two character models."""
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op11_active_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors after four rounds, their errors and the digest of the codebooks."""
    coded, books = lloyd.compress(table(spark, sf_dir, "embeddings"))
    return lloyd.with_errors(coded, books)


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, keeper and digest of every document's normalised text."""
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


ORACLES["op12_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents in every order, per source."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op13_filter_audit"] = r"""
WITH RECURSIVE texts AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
         min(doc_id) OVER (PARTITION BY text) AS first_id
  FROM texts
), fails AS (
  SELECT part,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * capitals > 5 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN first_id < doc_id THEN 'E' ELSE '' END AS pattern,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
         doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
  FROM words
), cells AS (
  SELECT part, pattern, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM fails GROUP BY part, pattern
), orders AS (
  SELECT '' AS filter_order
  UNION ALL
  SELECT filter_order || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE NOT contains(filter_order, f)
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier,
         substr(filter_order, step + 1) AS later
  FROM orders, (VALUES (1), (2), (3), (4), (5)) s(step) WHERE length(filter_order) = 5
), counts AS (
  SELECT part, filter_order, step, f,
         sum(n) FILTER (WHERE translate(pattern, earlier || f, '') = pattern) AS kept,
         sum(n) FILTER (WHERE translate(pattern, earlier, '') = pattern AND contains(pattern, f)) AS removed,
         sum(n) FILTER (WHERE translate(pattern, earlier, '') <> pattern AND contains(pattern, f)) AS redundant,
         sum(n) FILTER (WHERE pattern = f) AS unique_fails,
         sum(good) FILTER (WHERE translate(pattern, earlier, '') = pattern AND contains(pattern, f)) AS good_lost,
         sum(toxic) FILTER (WHERE translate(pattern, earlier, '') = pattern AND contains(pattern, f)) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (coalesce(sum(removed) OVER (PARTITION BY part, f), 0))::BIGINT AS shapley
FROM counts
"""
