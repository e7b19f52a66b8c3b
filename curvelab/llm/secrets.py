"""Secret scan with an incremental ledger of blobs.

Every version of every file is content-addressed by SHA-256.  The ledger keeps, per rule
version, the spans found in each blob; a scan reads the ledger, scans only blobs that
have no entry under the version of a rule, appends them, and joins the spans back to
every path and version with that content.  A copy, an unchanged file in a later
version or a repeated run costs one join; a new rule version scans under that rule only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelab.llm.common import fresh, shared_path
from curvelab.llm.ledger import Ledger, content_digest, distinct_contents
from curvelab.scale import salted_join


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``least`` characters are asked of ``group`` of a match.

    ``hints``: a text whose lower-case form holds none of them cannot match.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    flags: int = re.ASCII
    hints: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        """Digest of everything that decides what is found."""
        said = repr((self.kind, self.pattern, self.least, self.group, int(self.flags)))
        return hashlib.sha256(said.encode()).hexdigest()[:16]

    def spans(self, text: str, lower: str, compiled: re.Pattern) -> list[tuple[int, int]]:
        if self.hints and not any(h in lower for h in self.hints):
            return []
        return [m.span() for m in compiled.finditer(text) if len(m.group(self.group)) >= self.least]


# The three kinds in the order in which equal starts are listed.  The
# quantifiers of access and hex ask for the least length inside the pattern; both match
# maximal runs, so this drops the short runs that a later length test would drop.
RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        8, 2, re.ASCII | re.IGNORECASE, ("password", "passwd", "secret", "token", "api"),
    ),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 16, hints=("akia",)),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)


#: One entry: a blob, the rule versions it was scanned under, and what they found.
ENTRY = "digest binary, versions array<string>, spans array<struct<version:string,start:int,end:int>>"


def _scanner(rules: Sequence[Rule]):
    """Maps blobs (digest, seen versions, text) to ledger entries for the versions not seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r, r.version, re.compile(r.pattern, r.flags)) for r in rules]
        schema = pa.schema([
            ("digest", pa.binary()),
            ("versions", pa.list_(pa.string())),
            ("spans", pa.list_(pa.struct([("version", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
        ])
        for batch in batches:
            versions, spans = [], []
            for value, had in zip(batch.column("text"), batch.column("seen")):
                text, had = value.as_py() or "", had.as_py() or ()
                lower = text.lower()
                todo = [c for c in compiled if c[1] not in had]
                versions.append([v for _, v, _ in todo])
                spans.append([
                    {"version": v, "start": s, "end": e} for rule, v, pattern in todo for s, e in rule.spans(text, lower, pattern)
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest").cast(pa.binary()), pa.array(versions, schema.field(1).type), pa.array(spans, schema.field(2).type)],
                schema=schema,
            )

    return run


def scan(
    docs: DataFrame,
    ledger_path: str | None = None,
    rules: Sequence[Rule] = RULES,
    keys: Sequence[str] = ("doc_id",),
    text_col: str = "text",
) -> DataFrame:
    """Findings of every row of ``docs``: the key columns and ``findings``.

    ``keys`` name what identifies a historical version (path, revision, id).  ``findings``
    is an array of (kind, start, end) in code points, end exclusive, ordered by start and
    then by the order of ``rules``; within a kind matches are leftmost and do not overlap.
    Without ``ledger_path`` the run uses a ledger of its own in the shared folder.

    A null or empty text has no findings.  Rows with null or equal keys are all kept, each
    with the findings of its text.  An empty table gives an empty result.  Other columns
    are not read, whatever their names.
    """
    found = _findings(docs, ledger_path, rules, text_col, "_digest", "_found")
    paths = docs.select(*[F.col(f"`{k}`").alias(k) for k in keys], content_digest(F.col(f"`{text_col}`")).alias("_digest"))
    joined = salted_join(paths, found, "_digest")
    listed = F.transform("_found", lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return joined.select(*keys, F.coalesce(listed, none).alias("findings"))


def _findings(docs: DataFrame, ledger_path: str | None, rules: Sequence[Rule], text_col: str, digest: str, spans: str) -> DataFrame:
    """Bring the ledger up to date; the blobs with findings, each with its ordered spans."""
    spark = docs.sparkSession
    ledger = Ledger(spark, ledger_path or shared_path(spark, "secret-ledger"), ENTRY)
    current = [r.version for r in rules]
    update(docs, ledger, rules, F.col(f"`{text_col}`"))
    place = F.array_position(F.array(*[F.lit(v) for v in current]), F.col("s.version"))
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), place.cast("int"))
    return (
        ledger.read()
        .filter(F.size("spans") > 0)
        .select("digest", F.explode("spans").alias("s"))
        .filter(F.col("s.version").isin(current))
        .select(F.col("digest").alias(digest), F.struct(F.col("s.start"), place.alias("place"), kind.alias("kind"), F.col("s.end")).alias("f"))
        .groupBy(digest)
        .agg(F.sort_array(F.collect_set("f")).alias(spans))
    )


def redacted(
    docs: DataFrame, ledger_path: str | None = None, rules: Sequence[Rule] = RULES, mask: str = "<secret>", text_col: str = "text", length_col: str | None = None
) -> DataFrame:
    """``docs``, all rows and columns, with every finding in the text replaced by ``mask``.

    Overlapping findings are replaced once.  ``length_col`` names a column that holds the
    text's characters and is brought up to date where the text changed.
    """
    digest, spans = fresh(docs, "_digest"), fresh(docs, "_found")
    found = _findings(docs, ledger_path, rules, text_col, digest, spans)
    text = F.col(f"`{text_col}`")
    joined = docs.withColumn(digest, content_digest(text)).join(found, digest, "left")
    hit = F.col(spans).isNotNull()
    out = joined.withColumn(text_col, F.when(hit, _masked(text, F.col(spans), mask)).otherwise(text))
    if length_col is not None:
        length = F.col(f"`{length_col}`")
        out = out.withColumn(length_col, F.when(hit, F.char_length(text).cast(docs.schema[length_col].dataType)).otherwise(length))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _masked(text: Column, spans: Column, mask: str) -> Column:
    def step(done: Column, f: Column) -> Column:
        start, end, at = f["start"], f["end"], done["at"]
        between = F.substring(text, at + 1, F.greatest(start - at, F.lit(0)))
        more = F.concat(done["out"], between, F.when(start >= at, F.lit(mask)).otherwise(F.lit("")))
        return F.struct(more.alias("out"), F.greatest(at, end).alias("at"))

    begun = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(spans, begun, step, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.char_length(text))))


def update(docs: DataFrame, ledger: Ledger, rules: Sequence[Rule], text: Column) -> None:
    """Scan and append every pair of blob and rule version that the ledger lacks."""
    current = [r.version for r in rules]
    seen = (
        ledger.read()
        .select("digest", F.explode("versions").alias("v"))
        .filter(F.col("v").isin(current))
        .groupBy("digest")
        .agg(F.collect_set("v").alias("seen"))
    )
    blobs = distinct_contents(docs, text)
    if ledger.read().isEmpty():
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        blobs = blobs.join(seen, "digest", "left").filter(F.coalesce(F.size("seen"), F.lit(0)) < len(current))
    ledger.append(blobs.mapInArrow(_scanner(rules), ledger.schema))
