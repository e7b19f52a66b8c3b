"""Streaming operators run over all rows of the event and bar tables with ``availableNow``."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelab.edge import settle, settle_sql
from curvelab.operators import board as BD
from curvelab.operators import ledger as L
from curvelab.operators import walkforward as W
from curvelab.queries import ctes, learning
from curvelab.queries.evidence import PACKS, _legs_sql
from curvelab.registry import query
from curvelab.scale import latest_by
from curvelab.session import checkpoint_dir
from curvelab.sources import views
from curvelab.stages import write_stage_path
from curvelab.streaming import bars as S
from curvelab.streaming import keepers as K

#: Micro-batches that a run is cut into, whatever the number of files.
BATCHES = 4


def _place(spark: SparkSession, label: str) -> str:
    """A new folder for the files, tables and checkpoints of one run."""
    return posixpath.join(checkpoint_dir(spark), "curvelab-streams", f"{label}-{uuid.uuid4().hex[:8]}")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _stream(spark: SparkSession, rows: DataFrame, label: str) -> DataFrame:
    """Rows as a file stream of several micro-batches, each with rows of all times."""
    path = write_stage_path(rows.repartition(2 * BATCHES), label)
    return S.read_parquet_stream(spark, path, rows.schema, 2)


def _bar_keeper(spark: SparkSession, ticks: DataFrame, base: str) -> S.LateBars:
    return S.LateBars(spark, base, ticks.schema, "event_type", "ts", "value", "event_id", "1 hour", 3600)


@query(
    "stream_tumbling_bars",
    settle_sql(
        f"WITH {ctes.HOURS} SELECT spread_id AS event_type, strftime(t, '%Y-%m-%d %H:%M:%S') AS bar_start, open, high, low, close, volume::BIGINT AS volume FROM hours",
        "event_type, bar_start, volume", "open, high, low, close",
    ),
)
def stream_tumbling_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars from ticks that arrive in no order over several micro-batches."""
    events = _events(spark, sf_dir)
    bars = _bar_keeper(spark, events, _place(spark, "bars"))
    bars.run(_stream(spark, events, "stream-events"))
    bars.store.compact()
    return settle(bars.read().select("event_type", "bar_start", "open", "high", "low", "close", "volume"))


@query(
    "stream_late_bars",
    settle_sql(
        f"""WITH {ctes.HOURS}, w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events WHERE user_id % 10 <> 3), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events),
        n AS (SELECT event_type, date_trunc('hour', ts) AS t, count(*) FILTER (user_id % 10 = 3) AS after FROM events GROUP BY ALL)
        SELECT spread_id AS event_type, strftime(hours.t, '%Y-%m-%d %H:%M:%S') AS bar_start, open, high, low, close, volume::BIGINT AS volume,
          CASE WHEN hours.t + INTERVAL 1 HOUR <= w.mark THEN after ELSE 0 END AS late_rows, (hours.t + INTERVAL 1 HOUR <= m.mark)::BIGINT AS closed
        FROM hours JOIN n ON n.event_type = spread_id AND n.t = hours.t CROSS JOIN w CROSS JOIN m""",
        "event_type, bar_start, volume, late_rows, closed", "open, high, low, close",
    ),
)
def stream_late_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of some users arrive a delivery later than all others: counted, kept aside and put into their bars (G1)."""
    events = _events(spark, sf_dir)
    base = _place(spark, "late")
    bars = _bar_keeper(spark, events, base)
    slow = F.col("user_id") % 10 == 3
    for delivery in (~slow, slow):
        events.filter(delivery).write.mode("append").parquet(f"{base}/in")
        bars.run(S.read_parquet_stream(spark, f"{base}/in", events.schema, 1_000_000))
    return settle(bars.read().select("event_type", "bar_start", "open", "high", "low", "close", "volume", "late_rows", "closed"))


@query(
    "stream_freshness",
    "SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest, count(*) AS events, (max(ts)::DATE < (SELECT max(ts)::DATE FROM events))::BIGINT AS late FROM events GROUP BY 1",
)
def stream_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest event per type against the session it should have reached."""
    events = _events(spark, sf_dir)
    state = S.run_into(S.freshness(_stream(spark, events, "fresh-events"), "event_type", "ts"), _place(spark, "fresh"), ["event_type"])
    expected = events.select("event_type").distinct().withColumn("expected_session", events.agg(F.to_date(F.max("ts"))).scalar())
    return settle(S.late_keys(state, expected, "event_type").select("event_type", "latest", "events", "late"))


@query(
    "stream_latest_snapshot",
    "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, arg_max(value, {'t': ts, 'i': event_id}) AS value, arg_max(event_type, {'t': ts, 'i': event_id}) AS event_type FROM events GROUP BY 1",
)
def stream_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest event per user, the later id of equal times, upserted batch by batch."""
    newest = S.run_into(_stream(spark, _events(spark, sf_dir), "snap-events"), _place(spark, "snap"), ["user_id"], ["ts", "event_id"])
    return settle(newest.select("user_id", "ts", "value", "event_type"))


#: Daily bars stand for snapshots here, so a snapshot lives for days instead of fifteen minutes.
_LIFE_DAYS = 90


@query(
    "stream_package_depth",
    settle_sql(
        f"""{PACKS}, {_legs_sql('')}, qs AS (SELECT security, d AS qd, vol AS bid, events * 5 AS ask FROM cbars QUALIFY row_number() OVER (PARTITION BY security ORDER BY d DESC) = 1),
        live AS (SELECT * FROM qs WHERE qd + {_LIFE_DAYS} >= (SELECT max(qd) FROM qs)),
        j AS (SELECT ll.*, qd, CASE WHEN sgn > 0 THEN ask ELSE bid END / lots AS b, CASE WHEN sgn > 0 THEN bid ELSE ask END / lots AS s, greatest(0, date_diff('day', qd, d) * 1440.0) AS age FROM ll JOIN live USING (security)),
        g AS (SELECT spread_id, min(b) AS b, min(s) AS s, max(age) AS age FROM j GROUP BY spread_id, n_legs HAVING count(*) = n_legs)
        SELECT spread_id, (SELECT count(*) FROM live) AS live_securities, (SELECT count(*) FROM qs) AS securities, b AS buy_package_depth, s AS sell_package_depth, (b - s) / nullif(b + s, 0) AS package_depth_imbalance,
          age AS depth_snapshot_age_minutes, CAST(coalesce(age <= 15, false) AS BIGINT) AS depth_fresh, CAST(coalesce(age <= 15 AND least(b, s) >= 1, false) AS BIGINT) AS depth_supports_one_package
        FROM (SELECT DISTINCT spread_id FROM lt) LEFT JOIN g USING (spread_id)""",
        "spread_id, live_securities, securities, depth_fresh, depth_supports_one_package", "buy_package_depth, sell_package_depth, package_depth_imbalance, depth_snapshot_age_minutes",
    ),
)
def stream_package_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package depth from keyed snapshots that expire, joined to the newest packages' legs.

    Snapshots arrive in deliveries in order of time; each delivery is a run of its own that
    starts from the checkpoint of the one before.
    """
    base = _place(spark, "depth")
    quotes = views.contract_bars(spark, sf_dir).select(
        "security", F.col("timestamp_utc").cast("timestamp").alias("time"), F.col("volume_contracts").cast("double").alias("bid_size"),
        (F.col("num_events") * 5).alias("ask_size"),
    )
    folders = S.in_time_order(quotes, "time", f"{base}/in", BATCHES)
    state = None
    with K.state_store(spark):
        for folder in folders:
            K.deliver(spark, folder, f"{base}/feed")
            stream = K.live_quotes(S.read_parquet_stream(spark, f"{base}/feed", quotes.schema, 1_000_000), _LIFE_DAYS * 86_400_000)
            state = S.run_into(stream, base, ["security"])
    latest = latest_by(views.market(spark, sf_dir).raw_packages, "spread_id", "timestamp_utc")
    depth = BD.package_depth(latest, state.filter("live").withColumnRenamed("time", "snapshot_time").withColumn("snapshot_time", F.col("snapshot_time").cast("timestamp_ntz")))
    counts = state.agg(F.count_if("live").alias("live_securities"), F.count(F.lit(1)).alias("securities"))
    told = counts.first()
    return settle(depth.drop("depth_source").withColumns({"live_securities": F.lit(told[0]), "securities": F.lit(told[1])}))


@query(
    "stream_session_vwap",
    settle_sql(
        f"""WITH {ctes.HBARS}, c AS (SELECT *, coalesce(sign(x - lag(x) OVER w), 0) * cap AS sv FROM hp WINDOW w AS (PARTITION BY spread_id, session_date ORDER BY t))
        SELECT spread_id AS key, strftime(t, '%Y-%m-%d %H:%M:%S') AS ts, sum(x * cap) OVER w / sum(cap) OVER w AS session_vwap, sum(sv) OVER w AS obv FROM c WINDOW w AS (PARTITION BY spread_id, session_date ORDER BY t)""",
        "key, ts", "session_vwap, obv", dp=9,
    ),
)
def stream_session_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session VWAP and signed volume with keyed running state, bars in deliveries in order of time."""
    bars = views.hour_packages(spark, sf_dir).select(
        F.col("spread_id").alias("key"), "session_date", F.col("timestamp_utc").cast("timestamp").alias("ts"), F.col("spread_close").alias("price"),
        F.col("package_volume_capacity").alias("volume"),
    )
    base = _place(spark, "vwap")
    out = None
    for folder in S.in_time_order(bars, "ts", f"{base}/in", BATCHES):
        K.deliver(spark, folder, f"{base}/feed")
        out = S.run_into(S.session_vwap_stream(S.read_parquet_stream(spark, f"{base}/feed", bars.schema, 1_000_000)), base)
    return settle(out.select("key", "ts", "session_vwap", "obv"), dp=9)


@query("stream_positions", learning.LEDGER)
def stream_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger from keyed state with timers, every delivery a restart from the checkpoint."""
    inputs = learning.hour_inputs(spark, sf_dir)
    bars = K.strategy_bars(inputs)
    base = _place(spark, "positions")
    folders = S.in_time_order(bars, "ts", f"{base}/in", BATCHES)
    # A bar of no structure, far in the future: nothing more will come, so open positions end.
    mark = inputs.orderBy("timestamp_utc").limit(1).withColumns({"spread_id": F.lit("~end"), "timestamp_utc": F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")})
    K.strategy_bars(mark).filter("strategy = 0").withColumn("vote", F.lit(0)).write.parquet(f"{base}/in/end")
    out = None
    with K.state_store(spark):
        for folder in [*folders, f"{base}/in/end"]:
            K.deliver(spark, folder, f"{base}/feed")
            out = S.run_into(K.position_stream(S.read_parquet_stream(spark, f"{base}/feed", bars.schema, 1_000_000)), base)
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("entry_time", "entry_signal_time", "exit_time", "exit_signal_time")}
    trades = L.priced(out.withColumns(times))
    return settle(W.tag_trades(trades, W.phase_days(learning.hour_voted(spark, sf_dir), learning.HOURLY.folds)))
