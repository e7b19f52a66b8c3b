"""Recursions ``y = a * y + b`` over long series, exact and without a halo.

A step of a smoother is an affine map of the value before, and so is any run of steps: a
block of rows is known by one pair (a, b).  Steps without a value are the identity; the
seed, a plain mean of the first values, is a constant map, which forgets what was before.
The pairs of blocks are composed over groups of blocks, and groups of groups while a series
has more; the values at the beginnings of blocks follow from the whole downwards, and each
block then runs from its own beginning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvelab.functions import rolling as R
from curvelab.operators.smoothers import rsi, span_alpha
from curvelab.scale import blocked, running_total
from curvelab.stages import write_stage


@dataclass(frozen=True)
class Seeded:
    """A smoother of ``value`` whose first result is the plain mean of its first ``period`` values."""

    value: str
    period: int
    alpha: float


def _steps(rows: pd.DataFrame, i: int, s: Seeded) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the rows that change the series, and their maps."""
    x, n = rows[f"_x{i}"].to_numpy(dtype=float), rows[f"_n{i}"].to_numpy()
    at = np.flatnonzero(np.isfinite(x) & (n >= s.period))
    seed = n[at] == s.period
    return at, np.where(seed, 0.0, 1.0 - s.alpha), np.where(seed, rows[f"_s{i}"].to_numpy(dtype=float)[at] / s.period, s.alpha * x[at])


def _run(start: float, a: np.ndarray, b: np.ndarray) -> list[float]:
    out, y = [], start
    for p, q in zip(a.tolist(), b.tolist()):
        y = q if p == 0.0 else p * y + q  # nothing is known before the seed
        out.append(y)
    return out


def _composite(maps: Sequence[tuple[float, float]]) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for p, q in maps:
        a, b = (0.0, q) if p == 0.0 else (p * a, p * b + q)
    return a, b


def _begins(rows: pd.DataFrame, start: Sequence[float]) -> list[list[float]]:
    """The values at the beginning of each of some consecutive blocks."""
    out, y = [], list(start)
    for a, b in zip(rows["a"], rows["b"]):
        out.append(y)
        y = [q if p == 0.0 else p * v + q for v, p, q in zip(y, a, b)]
    return out


def _starts(maps: DataFrame, keys: list[str], blocks: int, fan: int, width: int, schema: str) -> DataFrame:
    """The values at the beginning of every block (NaN before the seed)."""
    unknown = [float("nan")] * width

    def told(rows: pd.DataFrame, start: Sequence[float]) -> pd.DataFrame:
        rows = rows.sort_values("block")
        return rows[[*keys, "block"]].assign(y=_begins(rows, start))

    if blocks <= fan:
        return maps.groupBy(*keys).applyInPandas(lambda rows: told(rows, unknown), schema)

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        pairs = [_composite([(a[i], b[i]) for a, b in zip(rows["a"], rows["b"])]) for i in range(width)]
        out = rows[[*keys, "above"]].iloc[:1].rename(columns={"above": "block"})
        return out.assign(a=[[p for p, _ in pairs]], b=[[q for _, q in pairs]])

    grouped = maps.withColumn("above", F.floor(F.col("block") / fan).cast("long"))
    composed = grouped.groupBy(*keys, "above").applyInPandas(compose, maps.schema)
    above = _starts(composed, keys, -(-blocks // fan), fan, width, schema).withColumnRenamed("block", "above")
    return (
        grouped.groupBy(*keys, "above")
        .cogroup(above.groupBy(*keys, "above"))
        .applyInPandas(lambda rows, begin: told(rows, begin["y"].iat[0]), schema)
    )


def smooth_seeded(
    df: DataFrame, keys: Sequence[str], order: str, bucket: Column, series: Mapping[str, Seeded], block: int = 4096, fan: int = 1024
) -> DataFrame:
    """Adds the smoothers of ``series``; rows without a value, and those before the seed, have none.

    ``df`` should be narrow, as its rows pass through Python once.  No task holds more than a
    block of rows or ``fan`` blocks' pairs, however long a series is.
    """
    keys, smoothers, names = list(keys), list(series.items()), df.columns
    totals = {"_row": F.lit(1.0)}
    for i, (_, s) in enumerate(smoothers):
        x = F.col(s.value)
        known = x.isNotNull() & ~F.isnan(x)
        totals |= {f"_n{i}": known.cast("double"), f"_s{i}": F.when(known, x).otherwise(0.0)}
    counted = running_total(df, keys, order, bucket, totals).withColumn("block", F.floor((F.col("_row") - 1) / block).cast("long"))
    counted = write_stage(counted.withColumns({f"_x{i}": F.col(s.value) for i, (_, s) in enumerate(smoothers)}), "affine")
    count = counted.agg(F.max("block")).first()[0]
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("block", T.LongType())])
    pair = T.StructType([*schema.fields, *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in "ab"]])
    begin = T.StructType([*schema.fields, T.StructField("y", T.ArrayType(T.DoubleType()))])
    out = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in series]])

    def maps(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row")
        pairs = []
        for i, (_, s) in enumerate(smoothers):
            _, a, b = _steps(rows, i, s)
            pairs.append(_composite(list(zip(a.tolist(), b.tolist()))))
        return rows[[*keys, "block"]].iloc[:1].assign(a=[[p for p, _ in pairs]], b=[[q for _, q in pairs]])

    def values(rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row").reset_index(drop=True)
        made = {}
        for i, (name, s) in enumerate(smoothers):
            at, a, b = _steps(rows, i, s)
            y = np.full(len(rows), np.nan)
            y[at] = _run(starts["y"].iat[0][i], a, b)
            made[name] = y
        return rows[names].assign(**made)

    used = [f"_{c}{i}" for i in range(len(smoothers)) for c in "xns"]
    pairs = counted.select(*keys, "block", "_row", *used).groupBy(*keys, "block").applyInPandas(maps, pair)
    starts = _starts(write_stage(pairs, "affine-maps"), keys, (count or 0) + 1, fan, len(smoothers), begin)
    found = counted.groupBy(*keys, "block").cogroup(starts.groupBy(*keys, "block")).applyInPandas(values, out)
    return found.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in series})


@dataclass(frozen=True)
class ChartWindows:
    """Lengths of the indicators drawn beside a price chart."""

    # Fixed values.
    mean: int = 20
    bands: int = 20
    band_width: float = 2.0
    fast: int = 12
    slow: int = 26
    signal: int = 9
    rsi: int = 14


def chart_indicators(
    df: DataFrame, keys: Sequence[str], order: str, value: str, bucket: Column, p: ChartWindows = ChartWindows(), block: int = 4096, fan: int = 1024
) -> DataFrame:
    """Mean, population bands, seeded exponential means, Wilder's RSI and MACD of every series.

    Values are needed in every row for the windows; the MACD's signal begins with its own
    first values.
    """
    halo = max(p.mean, p.bands) + 1
    b = blocked(df.select(*keys, order, value), keys, order, bucket, halo, block)
    summed = R.window_sums(b, b.frame, {"v": R.Track(F.col(value), sorted({p.mean, p.bands}), powers=2)})
    n, mean = F.col(f"v_n{p.bands}"), F.col(f"v_1w{p.bands}") / p.bands
    spread = F.sqrt(F.greatest(F.col(f"v_2w{p.bands}") / p.bands - mean * mean, F.lit(0.0))) * p.band_width
    change = F.col(value) - F.lag(value).over(b.order)
    windowed = b.finish(
        summed.withColumns(
            {
                "sma": F.when(F.col(f"v_n{p.mean}") >= p.mean, F.col(f"v_1w{p.mean}") / p.mean),
                "band_mid": F.when(n >= p.bands, mean), "band_upper": F.when(n >= p.bands, mean + spread),
                "band_lower": F.when(n >= p.bands, mean - spread),
                "_gain": F.when(change > 0, change).when(change.isNotNull(), 0.0), "_loss": F.when(change < 0, -change).when(change.isNotNull(), 0.0),
            }
        )
    ).select(*keys, order, value, "sma", "band_mid", "band_upper", "band_lower", "_gain", "_loss")
    wilder = 1.0 / p.rsi
    first = smooth_seeded(
        windowed, keys, order, bucket,
        {
            "ema_fast": Seeded(value, p.fast, span_alpha(p.fast)), "ema_slow": Seeded(value, p.slow, span_alpha(p.slow)),
            "_up": Seeded("_gain", p.rsi, wilder), "_down": Seeded("_loss", p.rsi, wilder),
        }, block, fan,
    ).withColumns({"rsi": rsi(F.col("_up"), F.col("_down")), "macd": F.col("ema_fast") - F.col("ema_slow")}).drop("_gain", "_loss", "_up", "_down")
    second = smooth_seeded(first, keys, order, bucket, {"macd_signal": Seeded("macd", p.signal, span_alpha(p.signal))}, block, fan)
    return second.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
