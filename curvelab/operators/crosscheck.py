"""Indicators computed a second way, and compared with the ones in use.

The second way folds over an ordered array of a series' newest rows: no window, no block, no
halo.  Recursions begin at the array's first row, which the array's length makes forgotten.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelab.operators.indicators import Windows
from curvelab.operators.smoothers import rsi, span_alpha
from curvelab.scale import row_index


def _fold(values: Column, alpha: float) -> Column:
    first, rest = F.element_at(values, 1), F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, first, lambda y, x: F.lit(1.0 - alpha) * y + F.lit(alpha) * x)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _deviation(values: Column) -> Column:
    mean = _mean(values)
    squares = F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(squares / (F.size(values) - 1))


def _median(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    low, high = F.element_at(ordered, F.floor((n + 1) / 2).cast("int")), F.element_at(ordered, F.floor(n / 2 + 1).cast("int"))
    return (low + high) / 2


def _newest(n: int) -> Column:
    return F.slice("closes", -n, n)


def second_way(p: Windows) -> dict[str, Column]:
    """Indicator to expression over ``closes``, the newest closes in order of time."""
    changes = F.transform(F.sequence(F.lit(2), F.size("closes")), lambda i: F.element_at("closes", i) - F.element_at("closes", i - 1))
    alpha = 1.0 / p.rsi_window
    up = _fold(F.transform(changes, lambda d: F.greatest(d, F.lit(0.0))), alpha)
    down = _fold(F.transform(changes, lambda d: F.greatest(-d, F.lit(0.0))), alpha)
    before = F.slice("closes", -(p.donchian_window + 1), p.donchian_window)
    return {
        "ema_fast": _fold(F.col("closes"), span_alpha(p.macd_fast)),
        "ema_slow": _fold(F.col("closes"), span_alpha(p.macd_slow)),
        "rsi": rsi(up, down),
        "bollinger_mid": _mean(_newest(p.bollinger_window)),
        "bollinger_std": _deviation(_newest(p.bollinger_window)),
        "rolling_median": _median(_newest(p.robust_z_window)),
        "donchian_high": F.array_max(before),
        "donchian_low": F.array_min(before),
    }


def audit_rows(p: Windows) -> int:
    """Rows after which the slowest recursion gives its start a weight below 2e-8."""
    return max(p.twenty_sessions, 9 * p.macd_slow)


def indicator_audit(features: DataFrame, p: Windows = Windows(), tolerance: float = 1e-5) -> DataFrame:
    """(spread_id, as_of, indicator, native, audited, delta, status) on the newest row of every structure.

    Structures with fewer rows than ``audit_rows`` are SHORT_HISTORY; a pair of which one
    side is missing, or that differs by more than ``tolerance``, is DIFFERS.
    """
    wanted, n = second_way(p), audit_rows(p)
    rows = features.select("spread_id", "timestamp_utc", "session_date", "research_close", *wanted)
    by = -F.unix_date(F.trunc("session_date", "month"))
    numbered = row_index(rows, "spread_id", F.col("timestamp_utc").desc(), by, name="_back")
    newest = numbered.filter(F.col("_back") <= n)
    told = newest.groupBy("spread_id").agg(
        F.sort_array(F.collect_list(F.struct("timestamp_utc", "research_close"))).alias("_rows"),
        *[F.max(F.when(F.col("_back") == 1, F.col(c))).alias(c) for c in wanted],
    )
    arrays = told.withColumns({"closes": F.transform("_rows", lambda r: r["research_close"]), "as_of": F.element_at("_rows", -1)["timestamp_utc"]})
    pairs = F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).alias("native"), e.alias("audited")) for c, e in wanted.items()])
    long = arrays.select("spread_id", "as_of", (F.size("closes") >= n).alias("_whole"), F.explode(pairs).alias("p")).select("spread_id", "as_of", "_whole", "p.*")
    delta = F.abs(F.col("native") - F.col("audited"))
    same = (delta <= tolerance) | (F.col("native").isNull() & F.col("audited").isNull())
    status = F.when(~F.col("_whole"), "SHORT_HISTORY").when(F.coalesce(same, F.lit(False)), "AUDITED").otherwise("DIFFERS")
    return long.withColumns({"delta": delta, "status": status}).drop("_whole")


def with_fault(features: DataFrame, where: Column, faults: Mapping[str, float]) -> DataFrame:
    """Features with a number added to some columns of some rows, to see an audit fail."""
    return features.withColumns({c: F.when(where, F.col(c) + F.lit(x)).otherwise(F.col(c)) for c, x in faults.items()})
