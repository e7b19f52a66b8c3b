"""Exact removal of repeated texts, frequent texts apart from the rest.

Rows become (id, digest, row) once, in a stored table.  A Misra-Gries summary of the digests
names every text that holds more than a share of the rows, and perhaps others.  Exact counts of
these few candidates decide which are frequent.  Their groups, fewer than one over the share,
are broadcast, so their rows are resolved where they are read; no group that is left holds
more than that share, and these are shuffled by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelab.llm.common import fresh, session, written

#: A text is frequent if it holds more than this share of the rows.  Bounds the broadcast too.
SHARE = 0.001

#: Runs of white space that are not one space already, as Java reads them.
_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sha, row) of every row; ``row`` tells rows apart whose ids are equal or null."""
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.sha2(F.encode(normalised(F.col(f"`{text_col}`")), "UTF-8"), 256).alias("sha"),
        F.monotonically_increasing_id().alias("row"),
    )


def frequent(keyed: DataFrame, rows: int, share: float = SHARE) -> DataFrame:
    """(sha, keep_id, keep_row, group_size) of the texts that hold more than ``share`` of the rows.

    The summary misses none of them and holds at most 1 / share digests, whatever the
    table; the counts that decide are exact.
    """
    summary = keyed.stat.freqItems(["sha"], share)
    candidates = summary.select(F.explode("sha_freqItems").alias("sha"))
    counted = (
        keyed.join(F.broadcast(candidates), "sha", "left_semi")
        .groupBy("sha")
        .agg(
            F.min("id").alias("keep_id"),
            F.coalesce(F.min_by("row", "id"), F.min("row")).alias("keep_row"),
            F.count(F.lit(1)).alias("group_size"),
        )
    )
    return counted.filter(F.col("group_size") > max(1, int(rows * share)))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """keep_id, group_size, kept and text_sha256 for every row, dropped ones too.

    Texts are equal when they are after each run of ASCII white space became one space; null
    counts as empty, and a text is digested whole however long it is.  Of equal texts the row
    with the smallest id stays; null ids come last, and of rows that share the smallest id one
    stays.  Null ids of a group without other ids give a null ``keep_id``.  Equal ids of
    different texts are different rows.  An empty table gives an empty result.  Other columns
    are not read.
    """
    session(docs.sparkSession)
    keyed = written(digests(docs, id_col, text_col), "digests")
    hot = written(frequent(keyed, keyed.count(), share), "frequent")
    resolved = keyed.join(F.broadcast(hot), "sha")
    group = Window.partitionBy("sha").orderBy(F.col("id").asc_nulls_last(), "row")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shuffled = keyed.join(F.broadcast(hot.select("sha")), "sha", "left_anti").select(
        "id", "sha", "row",
        F.first("id").over(whole).alias("keep_id"),
        F.first("row").over(whole).alias("keep_row"),
        F.count(F.lit(1)).over(whole).alias("group_size"),
    )
    return resolved.unionByName(shuffled).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row that stays is found by digest and id together.  Rows that repeat both are combined
    where they are read, before the rest moves once to meet the keys that stay.
    """
    key = fresh(docs, "_key")
    stay = groups(docs, id_col, text_col, share).filter("kept")
    named = lambda sha, i: F.struct(sha.alias("sha"), i.alias("id"))
    sha = F.sha2(F.encode(normalised(F.col(f"`{text_col}`")), "UTF-8"), 256)
    rows = docs.withColumn(key, named(sha, F.col(f"`{id_col}`"))).dropDuplicates([key])
    return rows.join(stay.select(named(F.col("text_sha256"), F.col(f"`{id_col}`")).alias(key)), key, "left_semi").drop(key)
