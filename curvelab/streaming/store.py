"""A keyed table that micro-batches change: parts by session, and a manifest of the live ones.

Every batch adds its rows as one part per session it touches.  A manifest lists the parts
that count; a new one appears under its final name in a single rename, so readers see all of
a batch or nothing, and whatever fails before leaves the last manifest valid.  Compaction
rewrites only sessions that have more than one part, so a reader scans about the live rows
however many batches there were.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvelab.scale import latest_by

BATCH = "_batch"
_SESSION = "_session"
Combine = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Part:
    path: str
    session: str
    batch: int


@dataclass(frozen=True)
class Manifest:
    """``applied`` is the last batch in it; ``newest`` the latest event time, in microseconds."""

    version: int = 0
    applied: int = -1
    newest: int | None = None
    parts: tuple[Part, ...] = field(default=())


def last_row(keys: Sequence[str], *order: str) -> Combine:
    """Of all versions of a key the last in ``order`` stays (``_batch`` may be part of it)."""
    return lambda rows: latest_by(rows, keys, *order)


class UpsertStore:
    """``combine`` makes one row of a key's rows; it must allow rows to be combined in any grouping.

    ``schema`` is that of the rows without the batch number, which the store adds as ``_batch``.
    ``session`` is the column or expression that parts are cut by; rows of a key must share it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, combine: Combine, session: Column | None = None) -> None:
        self.spark, self.path, self.combine = spark, path.rstrip("/"), combine
        self.schema = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
        self.session = F.lit("all") if session is None else session

    # -- manifest

    @property
    def _fs(self):
        jvm = self.spark._jvm
        return jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        fs, place = self._fs, self._place(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def manifest(self) -> Manifest:
        """The newest complete manifest."""
        names = [n for n in self._names("manifest") if n.endswith(".json")]
        if not names:
            return Manifest()
        stream = self._fs.open(self._place(f"manifest/{names[-1]}"))
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(**{**told, "parts": tuple(Part(**p) for p in told["parts"])})

    def _publish(self, manifest: Manifest) -> Manifest:
        """Write beside, then rename: a name that another writer took first is an error."""
        made = replace(manifest, version=manifest.version + 1)
        fs, draft, final = self._fs, self._place(f"manifest/draft-{uuid.uuid4().hex}"), self._place(f"manifest/{made.version:012d}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(asdict(made)).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"manifest {made.version} of {self.path} exists: another writer changed the table")
        return made

    # -- rows

    def _write(self, rows: DataFrame, label: str, batch: int) -> list[Part]:
        folder = f"data/{label}-{uuid.uuid4().hex[:12]}"
        placed = rows.withColumn(_SESSION, F.coalesce(self.session.cast("string"), F.lit("none"))).hint("rebalance", _SESSION)
        placed.write.partitionBy(_SESSION).option("compression", "zstd").parquet(f"{self.path}/{folder}")
        folders = [n for n in self._names(folder) if n.startswith(f"{_SESSION}=")]
        return [Part(f"{folder}/{n}", n.partition("=")[2], batch) for n in folders]

    def apply(self, rows: DataFrame, batch: int, event_time: str | None = None) -> Manifest:
        """Add a batch.  One that is in the table already, as after a restart, changes nothing."""
        before = self.manifest()
        if batch <= before.applied:
            return before
        whole = self.combine(rows.withColumn(BATCH, F.lit(batch).cast("long"))).select(*self.schema.names)
        parts = self._write(whole, f"batch-{batch}", batch)
        newest = before.newest
        if event_time is not None and parts:
            seen = self._read(parts).agg(F.max(F.unix_micros(F.col(event_time)))).first()[0]
            newest = max((x for x in (newest, seen) if x is not None), default=None)
        return self._publish(replace(before, applied=batch, newest=newest, parts=(*before.parts, *parts)))

    def _read(self, parts: Sequence[Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p.path}" for p in parts])

    def _by_session(self, manifest: Manifest) -> dict[str, list[Part]]:
        out = defaultdict(list)
        for part in manifest.parts:
            out[part.session].append(part)
        return out

    def read(self) -> DataFrame:
        """One row per key.  Sessions of one part are read as they are; only others are combined."""
        grouped = self._by_session(self.manifest()).values()
        single = self._read([parts[0] for parts in grouped if len(parts) == 1])
        several = [p for parts in grouped if len(parts) > 1 for p in parts]
        rows = single.unionByName(self.combine(self._read(several)).select(*self.schema.names)) if several else single
        return rows.drop(BATCH)

    def compact(self, most: int = 1) -> Manifest:
        """Rewrite the sessions that have more than ``most`` parts as one part each."""
        before = self.manifest()
        stale = [p for parts in self._by_session(before).values() if len(parts) > most for p in parts]
        if not stale:
            return before
        made = self._write(self.combine(self._read(stale)).select(*self.schema.names), "compact", before.applied)
        gone = set(stale)
        return self._publish(replace(before, parts=(*[p for p in before.parts if p not in gone], *made)))

    def vacuum(self, keep: int = 2) -> int:
        """Delete parts that none of the last ``keep`` manifests lists, and older manifests."""
        names = [n for n in self._names("manifest") if n.endswith(".json")]
        live = set()
        for name in names[-keep:]:
            stream = self._fs.open(self._place(f"manifest/{name}"))
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            live |= {p["path"] for p in told["parts"]}
        gone = 0
        for folder in self._names("data"):
            for name in self._names(f"data/{folder}"):
                if name.startswith(f"{_SESSION}=") and f"data/{folder}/{name}" not in live:
                    gone += self._fs.delete(self._place(f"data/{folder}/{name}"), True)
        for name in names[:-keep]:
            self._fs.delete(self._place(f"manifest/{name}"), False)
        return gone

    def writer(self, stream: DataFrame, event_time: str | None = None):
        """A stream writer that applies every micro-batch."""

        def apply(batch: DataFrame, batch_id: int) -> None:
            self.apply(batch, batch_id, event_time)

        return stream.writeStream.foreachBatch(apply).trigger(availableNow=True)
