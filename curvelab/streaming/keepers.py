"""Keyed state that lives between micro-batches, with event-time timers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from curvelab.config import STRATEGIES
from curvelab.operators import walk
from curvelab.operators.ledger import EXIT_REASONS

_HOUR_MS = 3_600_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """Queries begun inside keep their state in RocksDB, which keepers with timers need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def deliver(spark: SparkSession, folder: str, feed: str) -> None:
    """Append a folder's rows to the folder that a stream reads."""
    spark.read.parquet(folder).write.mode("append").parquet(feed)


def _milliseconds(at: pd.Timestamp) -> int:
    return int(at.value // 1_000_000)


def _timer(handle: StatefulProcessorHandle, at: int) -> None:
    """One timer per key: the newest replaces those before."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at)


QUOTES = "security string, time timestamp, bid_size double, ask_size double, live boolean"


class QuoteKeeper(StatefulProcessor):
    """The newest snapshot of a security; it leaves when the watermark is ``life_ms`` past it.

    Rows of one time are the levels of one book and add up, also when they arrive in different
    batches; rows older than the snapshot change nothing.
    """

    def __init__(self, life_ms: int) -> None:
        self.life_ms = life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "time timestamp, bid_size double, ask_size double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        time, bid, ask = self.newest.get() if self.newest.exists() else (None, 0.0, 0.0)
        time = None if time is None else pd.Timestamp(time)
        for chunk in rows:
            top = chunk["time"].max()
            if time is not None and top < time:
                continue
            book = chunk[chunk["time"] == top]
            if time is None or top > time:
                time, bid, ask = top, 0.0, 0.0
            bid, ask = bid + float(book["bid_size"].sum()), ask + float(book["ask_size"].sum())
        if time is None:
            return
        self.newest.update((time.to_pydatetime(), bid, ask))
        _timer(self.handle, _milliseconds(time) + self.life_ms)
        yield pd.DataFrame({"security": [key[0]], "time": [time], "bid_size": [bid], "ask_size": [ask], "live": [True]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists():
            time, bid, ask = self.newest.get()
            self.newest.clear()
            yield pd.DataFrame({"security": [key[0]], "time": [pd.Timestamp(time)], "bid_size": [bid], "ask_size": [ask], "live": [False]})


def live_quotes(quotes: DataFrame, life_ms: int = 15 * 60_000, lateness: str = "1 minute") -> DataFrame:
    """(security, time, sizes, live) as it changes.  ``quotes`` holds (security, time, bid_size, ask_size)."""
    timed = quotes.withWatermark("time", lateness)
    return timed.groupBy("security").transformWithStateInPandas(QuoteKeeper(life_ms), QUOTES, "Update", "EventTime")


_FIELDS = (
    "segment int, side int, pending int, leave int, leave_time timestamp, held int, mae double, mfe double,"
    " entry_time timestamp, entry_signal_time timestamp, entry_session date, entry_spread double, entry_value double, entry_cost double,"
    " roll_id string, earliest_risk_date date, forced_exit_session date, entry_relative_volume double,"
    " entry_max_leg_bid_ask_ticks double, entry_package_capacity double, signal_time timestamp, signal_relative_volume double,"
    " signal_ticks double, signal_capacity double, last_time timestamp, last_session date, last_spread double, last_value double, last_cost double"
)
_NAMES = [part.split()[0] for part in _FIELDS.split(", ")]
_ENTRY = [
    "entry_time", "entry_signal_time", "entry_session", "entry_spread", "entry_value", "entry_cost", "roll_id", "earliest_risk_date",
    "forced_exit_session", "entry_relative_volume", "entry_max_leg_bid_ask_ticks", "entry_package_capacity",
]
#: What a closed position has, as ``ledger.priced`` takes it.
CLOSED = (
    "spread_id string, strategy_id string, side int, entry_time timestamp, entry_signal_time timestamp, entry_session date,"
    " entry_spread double, entry_value double, entry_cost double, roll_id string, earliest_risk_date date, forced_exit_session date,"
    " entry_relative_volume double, entry_max_leg_bid_ask_ticks double, entry_package_capacity double, exit_time timestamp,"
    " exit_signal_time timestamp, exit_session date, exit_spread double, exit_value double, exit_cost double, holding_bars int,"
    " mae_usd double, mfe_usd double, exit_reason string"
)
_CLOSED = [part.split()[0] for part in CLOSED.split(", ")]


def _plain(value):
    """A pandas scalar as state holds it."""
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    return value.to_pydatetime() if isinstance(value, pd.Timestamp) else value.item() if hasattr(value, "item") else value


class PositionKeeper(StatefulProcessor):
    """The position of one strategy in one structure, bar by bar, with the rules of the ledger.

    A position leaves at a bar's opening, at the last close before a roll, or, when the
    watermark is ``idle_ms`` past the newest bar, at the last close of all.
    """

    def __init__(self, limits: list[int], idle_ms: int) -> None:
        self.limits, self.idle_ms = limits, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("position", _FIELDS)

    def _close(self, key, p: dict, reason: str, decided, place: tuple) -> tuple:
        time, session, spread, value, cost = place
        out = (
            key[0], STRATEGIES[key[1]].strategy_id, p["side"], *[p[c] for c in _ENTRY], time, decided, session, spread, value, cost,
            p["held"], p["mae"], p["mfe"], reason,
        )
        p.update(side=0, leave=0, leave_time=None, held=0, mae=0.0, mfe=0.0)
        return out

    def _last(self, p: dict) -> tuple:
        return p["last_time"], p["last_session"], p["last_spread"], p["last_value"], p["last_cost"]

    def _bar(self, key, p: dict, r) -> Iterator[tuple]:
        if r.segment != p["segment"]:
            if p["side"]:
                yield self._close(key, p, "ROLL_SAFETY_PREVIOUS_CLOSE", None, self._last(p))
            p.update(segment=r.segment, pending=0, leave=0)
        opened, closed = _plain(r.open_value), _plain(r.close_value)
        time, session = _plain(r.ts), r.session_date
        place = (time, session, _plain(r.spread_open), opened, r.cost)
        if opened is None or closed is None:
            p["pending"] = 0
        else:
            if p["side"] and r.forced_last:
                yield self._close(key, p, "MANDATORY_D4_EXIT", None, place)
                p["pending"] = 0
            elif p["side"] and p["leave"]:
                yield self._close(key, p, EXIT_REASONS[p["leave"]], p["leave_time"], place)
            if not p["side"] and p["pending"] and r.entry_allowed:
                p.update(
                    side=p["pending"], held=0, mae=0.0, mfe=0.0, entry_time=time, entry_signal_time=p["signal_time"], entry_session=session,
                    entry_spread=place[2], entry_value=opened, entry_cost=r.cost, roll_id=r.roll_id, earliest_risk_date=r.earliest_risk_date,
                    forced_exit_session=r.forced_exit_session, entry_relative_volume=p["signal_relative_volume"],
                    entry_max_leg_bid_ask_ticks=p["signal_ticks"], entry_package_capacity=p["signal_capacity"],
                )
            p["pending"] = 0
            if p["side"]:
                mark = p["side"] * (closed - p["entry_value"])
                p.update(held=p["held"] + 1, mae=min(p["mae"], mark), mfe=max(p["mfe"], mark))
                code = walk.MAX_HOLD if p["held"] >= self.limits[key[1]] else r.long_code if p["side"] > 0 else r.short_code
                p.update(leave=int(code), leave_time=time if code else None)
            elif r.vote and r.entry_allowed and r.liquidity_reason == "PASS":
                p.update(
                    pending=int(r.vote), signal_time=time, signal_relative_volume=_plain(r.relative_volume),
                    signal_ticks=_plain(r.max_leg_bid_ask_ticks), signal_capacity=_plain(r.package_volume_capacity),
                )
        if closed is not None:
            p.update(last_time=time, last_session=session, last_spread=_plain(r.spread_close), last_value=closed, last_cost=r.cost)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p = dict(zip(_NAMES, self.state.get())) if self.state.exists() else {n: None for n in _NAMES}
        if p["segment"] is None:
            p.update(segment=-1, side=0, pending=0, leave=0, held=0, mae=0.0, mfe=0.0)
        bars = pd.concat(list(rows)).sort_values("ts")
        closed = [t for r in bars.itertuples() for t in self._bar(key, p, r)]
        self.state.update(tuple(p[n] for n in _NAMES))
        _timer(self.handle, _milliseconds(bars["ts"].iloc[-1]) + self.idle_ms)
        yield pd.DataFrame(closed, columns=_CLOSED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        p = dict(zip(_NAMES, self.state.get())) if self.state.exists() else {"side": 0}
        self.state.clear()
        closed = [self._close(key, p, "END_OF_SAMPLE", None, self._last(p))] if p["side"] else []
        yield pd.DataFrame(closed, columns=_CLOSED)


def strategy_bars(inputs: DataFrame) -> DataFrame:
    """The ledger's inputs as one row per bar and strategy, as wide as its rules need."""
    strategies = F.array(*[F.struct(F.lit(k).alias("strategy"), *[F.col(f"_{x}{k}").cast("int").alias(n) for x, n in zip("vls", ("vote", "long_code", "short_code"))]) for k in range(len(STRATEGIES))])
    kept = [
        "spread_id", "segment", "session_date", "roll_id", "open_value", "close_value", "spread_open", "spread_close", "cost", "entry_allowed",
        "liquidity_reason", "forced_last", "relative_volume", "package_volume_capacity", "max_leg_bid_ask_ticks", "earliest_risk_date",
        "forced_exit_session",
    ]
    return inputs.select(F.col("timestamp_utc").cast("timestamp").alias("ts"), *kept, F.explode(strategies).alias("s")).select("ts", *kept, "s.*")


def position_stream(bars: DataFrame, lateness: str = "1 hour", idle_days: int = 400) -> DataFrame:
    """Closed positions from a stream of ``strategy_bars``, files in order of time.

    The state is one row per structure and strategy, and leaves with its structure.
    """
    timed = bars.withWatermark("ts", lateness)
    keeper = PositionKeeper([s.maximum_holding_bars for s in STRATEGIES], idle_days * 24 * _HOUR_MS)
    return timed.groupBy("spread_id", "strategy").transformWithStateInPandas(keeper, CLOSED, "Append", "EventTime")
