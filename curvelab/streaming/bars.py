"""Streaming twins of the bar, freshness and session operators."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvelab.session import checkpoint_dir
from curvelab.streaming.store import BATCH, UpsertStore, last_row


def read_parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def in_time_order(rows: DataFrame, ts: str, path: str, deliveries: int, files: int = 8) -> list[str]:
    """Write rows as folders that follow each other in time, as a feed would deliver them.

    Borders are quantiles of the time, so deliveries are about equal whatever the gaps.
    """
    micros = rows.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    shares = [i / deliveries for i in range(1, deliveries)]
    cuts = sorted(set(micros.approxQuantile("_at", shares, 0.001))) if shares else []
    bounds = [None, *cuts, None]
    paths = []
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        part = micros
        part = part if low is None else part.filter(F.col("_at") >= F.lit(low))
        part = part if high is None else part.filter(F.col("_at") < F.lit(high))
        paths.append(f"{path}/{i:04d}")
        part.drop("_at").repartitionByRange(files, ts).sortWithinPartitions(ts).write.parquet(paths[-1])
    return paths


def bar_rows(ticks: DataFrame, key: str, ts: str, price: str, seq: str, width: str) -> DataFrame:
    """OHLCV per key and time window, with the times of its first and last tick."""
    w = F.window(ts, width)
    at = F.struct(ts, seq)
    return ticks.groupBy(key, w.alias("w")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        F.count(F.lit(1)).alias("volume"), F.min(at).alias("first"), F.max(at).alias("last"),
    ).select(
        key, F.col("w.start").alias("bar_start"), F.col("w.end").alias("bar_end"), "open", "high", "low", "close", "volume", "first", "last",
        F.col(f"last.{ts}").alias("newest"),
    )


def merged_bars(key: str):
    """Bars of the same window, each made from some of its ticks, as one."""

    def combine(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key, "bar_start", "bar_end").agg(
            F.min_by("open", "first").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last").alias("close"),
            F.sum("volume").alias("volume"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("newest").alias("newest"),
            F.sum("late_rows").alias("late_rows"), F.max(BATCH).alias(BATCH),
        )

    return combine


class LateBars:
    """Bars from ticks in any order, with those counted that came after their bar had closed.

    A bar closes when ``lateness`` has passed since its end by the newest tick of the batches
    before.  Ticks behind that are written to a side table, counted, and repair their bar:
    the store combines what batches know of a bar, so the bars are those of all ticks
    however these arrive.
    """

    def __init__(self, spark: SparkSession, path: str, ticks: T.StructType, key: str, ts: str, price: str, seq: str, width: str, lateness_s: int) -> None:
        self.spark, self.path, self.lateness_us = spark, path, lateness_s * 1_000_000
        self.make = lambda rows: bar_rows(rows, key, ts, price, seq, width)
        self.ticks, self.ts, self.width = ticks, ts, width
        schema = self.make(spark.createDataFrame([], ticks)).withColumn("late_rows", F.lit(0).cast("long")).schema
        self.store = UpsertStore(spark, f"{path}/bars", schema, merged_bars(key), F.to_date("bar_start"))

    def _closed(self, end: Column, newest: int | None) -> Column:
        return F.lit(False) if newest is None else F.unix_micros(end) <= F.lit(newest - self.lateness_us)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        before = self.store.manifest()
        if batch_id <= before.applied:
            return
        late = self._closed(F.col("bar_end"), before.newest)
        bars = self.make(batch).withColumn("late_rows", F.when(late, F.col("volume")).otherwise(F.lit(0).cast("long")))
        if before.newest is not None:
            behind = batch.withColumn("_w", F.window(self.ts, self.width)).filter(self._closed(F.col("_w.end"), before.newest))
            behind.drop("_w").write.mode("overwrite").parquet(f"{self.path}/late/batch-{batch_id}")
        self.store.apply(bars, batch_id, "newest")

    def run(self, stream: DataFrame) -> None:
        """Take all that has arrived; a later call goes on where this one ended."""
        state = f"{self.path}/state"
        stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    def read(self) -> DataFrame:
        newest = self.store.manifest().newest
        return self.store.read().withColumn("closed", self._closed(F.col("bar_end"), newest)).drop("first", "last", "newest")

    def late(self) -> DataFrame:
        """The side table."""
        return self.spark.read.schema(self.ticks).option("recursiveFileLookup", "true").parquet(f"{self.path}/late")


def freshness(ticks: DataFrame, key: str, ts: str) -> DataFrame:
    """Newest event and number of events per key (one row per key, in update mode)."""
    return ticks.groupBy(key).agg(F.max(ts).alias("latest"), F.count(F.lit(1)).alias("events"))


def late_keys(state: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys whose newest event is before the session they should have reached.

    ``expected`` holds (key, expected_session).
    """
    return state.join(expected, key).withColumn("late", F.to_date("latest") < F.col("expected_session"))


def run_to_table(stream: DataFrame, name: str, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Run all available data through the query into Parquet and read it.

    With ``keys`` the stream is one of changing rows (update mode), kept in a store whose last
    row in ``order`` counts (later batches first, unless said otherwise).
    """
    base = posixpath.join(checkpoint_dir(stream.sparkSession), "curvelab-streams", name)
    return run_into(stream, base, keys, order)


def run_into(stream: DataFrame, base: str, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The same in a given folder: a second call goes on from the checkpoint of the first."""
    spark = stream.sparkSession
    if keys is None:
        query = (
            stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    store = UpsertStore(spark, f"{base}/out", stream.schema, last_row(keys, *(order or [BATCH])))
    store.writer(stream).option("checkpointLocation", f"{base}/state").outputMode("update").start().awaitTermination()
    store.compact()
    return store.read()


def _expire(state, newest: pd.Timestamp, idle: pd.Timedelta) -> None:
    """Let the state go once the watermark is ``idle`` past the key's newest row."""
    at = int((newest + idle).timestamp() * 1000)
    state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))


_STATE = T.StructType([T.StructField("weighted", T.DoubleType()), T.StructField("volume", T.DoubleType()), T.StructField("signed", T.DoubleType()), T.StructField("last", T.DoubleType())])
_VWAP_SCHEMA = "key string, session_date date, ts timestamp, session_vwap double, obv double"


def session_vwap_stream(bars: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Running session VWAP and signed volume per (key, session), state kept between batches.

    ``bars`` holds (key, session_date, ts, price, volume).  State is four numbers per
    open session, which leaves a day after its last bar; the batch twin is the window in
    ``session_features``.
    """

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        weighted, volume, signed, last = state.get if state.exists else (0.0, 0.0, 0.0, float("nan"))
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for r in rows.itertuples():
            weighted += r.price * r.volume
            volume += r.volume
            if last == last:
                signed += r.volume * ((r.price > last) - (r.price < last))
            last = r.price
            out.append((keys[0], keys[1], r.ts, weighted / volume if volume else None, signed))
        state.update((weighted, volume, signed, last))
        _expire(state, rows["ts"].iloc[-1], pd.Timedelta(days=1))
        yield pd.DataFrame(out, columns=["key", "session_date", "ts", "session_vwap", "obv"])

    timed = bars.withWatermark("ts", lateness)
    return timed.groupBy("key", "session_date").applyInPandasWithState(update, T.StructType.fromDDL(_VWAP_SCHEMA), _STATE, "append", "EventTimeTimeout")
