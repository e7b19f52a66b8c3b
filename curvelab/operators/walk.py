"""The position walk along a structure's bars, in blocks of bounded size.

A position is a pure function of the bar it enters on: where it leaves follows from the
bars after the entry, at most the holding limit and one more.  So a strategy's walk is a
transducer whose only state between bars is the first bar at which it is flat again.

Bars with values are numbered and cut into blocks that see the bars after them which a
position from inside can reach.  Pass one gives, for every block and strategy, the function
from the bar at which the walk becomes flat inside the block to the bar at or past its end
at which it is flat next; that function is constant over long runs, as walks that meet
stay together.  These small tables are composed over groups of blocks, and groups of groups
while a structure has more; then the real walk is followed from the whole down to the
blocks.  Pass two walks every block from the bar at which the walk really enters it.
No task holds more than a block of bars or a group of functions, however long a structure is.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelab.stages import write_stage

# Places of two exit reasons that the walk itself gives.
MAX_HOLD, MANDATORY = 1, 14

_FUNCTION = "spread_id string, strategy int, block long, first long, last long, upto array<long>, out array<long>"
_ENTRY = "spread_id string, block long, strategy int, at long"
_TRADE = (
    "spread_id string, segment int, strategy int, side int, code int, entry_time timestamp_ntz, entry_signal_time timestamp_ntz,"
    " exit_time timestamp_ntz, exit_signal_time timestamp_ntz, entry_session date, exit_session date, entry_spread double,"
    " exit_spread double, entry_value double, exit_value double, entry_cost double, exit_cost double, holding_bars int,"
    " mae_usd double, mfe_usd double, roll_id string, earliest_risk_date date, forced_exit_session date,"
    " entry_relative_volume double, entry_max_leg_bid_ask_ticks double, entry_package_capacity double"
)
_NAMES = [part.split()[0] for part in _TRADE.split(", ")]


@dataclass(frozen=True)
class Positions:
    """Every position that could be opened in a block, by place in the block's bars.

    ``flat`` is the place from which the walk goes on; ``left`` is -1 for positions that no
    bar closes, and ``decided`` is -1 where no close decided the exit.
    """

    signal: np.ndarray
    side: np.ndarray
    decided: np.ndarray
    left: np.ndarray
    flat: np.ndarray
    last: np.ndarray
    code: np.ndarray


def _next_true(flags: np.ndarray) -> np.ndarray:
    """For every place the first true one at or after it; the length where there is none."""
    n = len(flags)
    at = np.where(flags, np.arange(n), n)
    return np.append(np.minimum.accumulate(at[::-1])[::-1], n)


class Bars:
    """A block's bars with values in order: ``own`` ones, then those that its positions may reach."""

    def __init__(self, bars: pd.DataFrame) -> None:
        bars = bars.sort_values("live", kind="stable").reset_index(drop=True)
        self.frame = bars
        self.n = len(bars)
        self.own = int((~bars["ahead"]).sum())
        self.first = int(bars["live"].iat[0]) if self.n else 0
        segment, bar = bars["segment"].to_numpy(), bars["bar"].to_numpy()
        changes = np.flatnonzero(segment[1:] != segment[:-1]) if self.n else np.empty(0, np.int64)
        ends = np.append(changes, self.n - 1)
        self.last = ends[np.searchsorted(ends, np.arange(self.n))]  # last bar of each bar's segment
        follows = np.zeros(self.n, dtype=bool)  # the very next bar has values, is in the segment and takes entries
        follows[:-1] = (bar[1:] == bar[:-1] + 1) & (segment[1:] == segment[:-1]) & bars["entry_allowed"].to_numpy(dtype=bool)[1:]
        signal = bars["entry_allowed"].to_numpy(dtype=bool) & (bars["liquidity_reason"] == "PASS").to_numpy() & follows
        signal[self.own :] = False
        self.signal = signal
        self.forced = _next_true(bars["forced_last"].to_numpy(dtype=bool))

    def positions(self, strategy: int, limit: int) -> Positions:
        votes = self.frame[f"_v{strategy}"].to_numpy()
        signal = np.flatnonzero(self.signal & (votes != 0))
        side = votes[signal].astype(np.int64)
        entry = signal + 1
        long, short = (self.frame[f"_{x}{strategy}"].to_numpy().astype(np.int64) for x in "ls")
        hit = np.where(side > 0, _next_true(long != 0)[entry], _next_true(short != 0)[entry])
        last = self.last[entry]
        held_out = entry + limit - 1
        decided = np.minimum(hit, held_out)
        decided = np.where(decided <= last, decided, -1)
        at = np.maximum(decided, 0)
        code = np.where(decided == held_out, MAX_HOLD, np.where(side > 0, long[at], short[at]))
        filled = np.where((decided >= 0) & (decided < last), decided + 1, self.n)
        stop = self.forced[entry + 1]
        stopped = (stop <= last) & (stop <= filled)
        left = np.where(stopped, stop, filled)
        open_ = left >= self.n
        return Positions(
            signal, side, np.where(stopped | open_, -1, decided), np.where(open_, -1, left),
            np.where(open_, last + 1, left), last, np.where(stopped, MANDATORY, code),
        )


class Flat(NamedTuple):
    """Where a walk that is flat at a bar of a block is flat next, past the block.

    ``upto[i]`` is the last bar of the i-th run and ``out[i]`` its result; ``last`` is the block's
    last bar.  A walk comes into a block at its first bar or out of a position from before,
    so only the bars that such a position reaches are kept, however long the block is.
    """

    upto: list[int]
    out: list[int]
    last: int

    def __call__(self, at: int) -> int:
        return self.out[bisect_left(self.upto, at)]


def _runs(upto: Iterable[int], out: Iterable[int], first: int, last: int, reach: int) -> Flat:
    """Runs of equal results as one, as far as walks come in."""
    ends: list[int] = []
    results: list[int] = []
    for u, o in zip(upto, out):
        if ends and ends[-1] >= first + reach:
            break
        if results and results[-1] == o:
            ends[-1] = u
        else:
            ends.append(u)
            results.append(o)
    return Flat(ends, results, last)


def function(bars: Bars, p: Positions, reach: int) -> Flat:
    """The function of a block's own bars."""
    end = bars.first + bars.own
    following = np.searchsorted(p.signal, p.flat).tolist()
    result, flat = [0] * len(p.signal), (p.flat + bars.first).tolist()
    for i in range(len(result) - 1, -1, -1):
        if flat[i] >= end:
            result[i] = flat[i]
        else:
            result[i] = result[following[i]] if following[i] < len(result) else end
    upto = [*(p.signal + bars.first).tolist(), end - 1]
    if len(upto) > 1 and upto[-1] == upto[-2]:
        upto.pop()
    return _runs(upto, [*result, end], bars.first, end - 1, reach)


def follow(parts: Sequence[Flat], at: int) -> Iterator[tuple[int, int]]:
    """(place, bar) of the parts that the walk enters flat, and at last (their number, the bar past them)."""
    for i, part in enumerate(parts):
        if at <= part.last:
            yield i, at
            at = part(at)
    yield len(parts), at


def compose(parts: Sequence[Flat], first: int, reach: int) -> Flat:
    """The function of consecutive blocks together; ``first`` is their first bar."""
    upto: list[int] = []
    out: list[int] = []
    for i, part in enumerate(parts):
        if i and parts[i - 1].last >= first + reach:
            break
        for u, o in zip(part.upto, part.out):
            *_, (_, past) = follow(parts[i + 1 :], o)
            upto.append(u)
            out.append(past)
    return _runs(upto, out, first, parts[-1].last, reach)


def _parts(rows: pd.DataFrame) -> list[Flat]:
    return [Flat(list(u), list(o), int(x)) for u, o, x in zip(rows["upto"], rows["out"], rows["last"])]


def _frame(keys: Sequence[tuple[str, int, int, int]], functions: Sequence[Flat]) -> pd.DataFrame:
    named = dict(zip(("spread_id", "strategy", "block", "first"), zip(*keys))) if keys else {}
    told = {"last": [f.last for f in functions], "upto": [f.upto for f in functions], "out": [f.out for f in functions]}
    return pd.DataFrame({**named, **told}, columns=["spread_id", "strategy", "block", "first", "last", "upto", "out"])


def _composed(functions: DataFrame, fan: int, reach: int) -> DataFrame:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        first = int(rows["first"].iat[0])
        return _frame([(*key, first)], [compose(_parts(rows), first, reach)])

    grouped = functions.withColumn("above", F.floor(F.col("block") / fan).cast("long"))
    return grouped.groupBy("spread_id", "strategy", "above").applyInPandas(run, _FUNCTION)


def _followed(rows: pd.DataFrame, key: tuple, at: int) -> pd.DataFrame:
    rows = rows.sort_values("block")
    blocks = rows["block"].tolist()
    found = [(key[0], blocks[i], key[1], a) for i, a in follow(_parts(rows), at) if i < len(blocks)]
    return pd.DataFrame(found, columns=["spread_id", "block", "strategy", "at"])


def entries(functions: DataFrame, blocks: int, fan: int, reach: int) -> DataFrame:
    """The bar at which the walk is flat in each block that it enters flat.

    ``blocks`` is the largest number of blocks of a structure, which sets the number of levels.
    """
    if blocks <= fan:
        return functions.groupBy("spread_id", "strategy").applyInPandas(lambda key, rows: _followed(rows, key, 1), _ENTRY)
    above = entries(_composed(functions, fan, reach), -(-blocks // fan), fan, reach)

    def run(key: tuple, rows: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        return _followed(rows, key, int(entered["at"].iat[0]) if len(entered) else np.iinfo(np.int64).max)

    grouped = functions.withColumn("above", F.floor(F.col("block") / fan).cast("long"))
    return (
        grouped.groupBy("spread_id", "strategy", "above")
        .cogroup(above.withColumnRenamed("block", "above").groupBy("spread_id", "strategy", "above"))
        .applyInPandas(run, _ENTRY)
    )


def _walked(bars: Bars, entered: dict[int, int], limits: Sequence[int]) -> pd.DataFrame:
    """Trades whose signal lies in the block."""
    f = bars.frame
    opened, closed, cost = (f[c].to_numpy(dtype=float) for c in ("open_value", "close_value", "cost"))
    times, days = f["timestamp_utc"], f["session_date"]
    rows = []
    for k, at in sorted(entered.items()):
        p = bars.positions(k, limits[k])
        place, flat = at - bars.first, p.flat.tolist()
        i = int(np.searchsorted(p.signal, place))
        while i < len(p.signal):
            s, e, x, d, side = int(p.signal[i]), int(p.signal[i]) + 1, int(p.left[i]), int(p.decided[i]), int(p.side[i])
            held = (x if x >= 0 else int(p.last[i]) + 1) - e
            marks = side * (closed[e : e + held] - opened[e])
            leave = (times.iat[x], days.iat[x], f["spread_open"].iat[x], opened[x], cost[x]) if x >= 0 else (None,) * 5
            rows.append(
                (
                    f["spread_id"].iat[0], f["segment"].iat[e], k, side, int(p.code[i]), times.iat[e], times.iat[s], leave[0],
                    times.iat[d] if d >= 0 else None, days.iat[e], leave[1], f["spread_open"].iat[e], leave[2], opened[e], leave[3],
                    cost[e], leave[4], held, float(min(0.0, marks.min(initial=0.0))), float(max(0.0, marks.max(initial=0.0))),
                    f["roll_id"].iat[e], f["earliest_risk_date"].iat[e], f["forced_exit_session"].iat[e],
                    f["relative_volume"].iat[s], f["max_leg_bid_ask_ticks"].iat[s], f["package_volume_capacity"].iat[s],
                )
            )
            i = int(np.searchsorted(p.signal, flat[i]))
    return pd.DataFrame(rows, columns=_NAMES)


def trades(inputs: DataFrame, limits: Sequence[int], block: int = 4096, fan: int = 1024) -> DataFrame:
    """Every position of every strategy, with its exit unless the segment ended first.

    ``inputs`` has one row per bar: ``bar`` and ``live`` number all bars and those with
    values; ``_v{k}``, ``_l{k}`` and ``_s{k}`` hold vote and exit codes of strategy k.
    """
    live = inputs.filter(F.col("open_value").isNotNull() & F.col("close_value").isNotNull())
    reach = max(limits) + 2
    own, seen = (F.floor((F.col("live") - 1 - back) / block).cast("long") for back in (0, reach))
    placed = (
        live.withColumn("_own", own)
        .withColumn("block", F.explode(F.sequence(F.greatest(seen, F.lit(0).cast("long")), "_own")))
        .withColumn("ahead", F.col("block") < F.col("_own"))
        .drop("_own")
    )
    count = live.agg(F.max(own)).first()[0]
    walked = ["spread_id", "block", "ahead", "segment", "bar", "live", "entry_allowed", "liquidity_reason", "forced_last"]
    codes = [f"_{x}{k}" for k in range(len(limits)) for x in "vls"]

    def functions(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bars = Bars(rows)
        told = [function(bars, bars.positions(k, limit), reach) for k, limit in enumerate(limits)]
        return _frame([(key[0], k, key[1], bars.first) for k in range(len(told))], told)

    def walks(key: tuple, rows: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(entered):
            return pd.DataFrame([], columns=_NAMES)
        return _walked(Bars(rows), dict(zip(entered["strategy"], entered["at"])), limits)

    made = placed.select(*walked, *codes).groupBy("spread_id", "block").applyInPandas(functions, _FUNCTION)
    entered = entries(write_stage(made, "ledger-functions"), (count or 0) + 1, fan, reach)
    return placed.groupBy("spread_id", "block").cogroup(entered.groupBy("spread_id", "block")).applyInPandas(walks, _TRADE)
