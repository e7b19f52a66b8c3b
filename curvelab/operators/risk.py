"""Parametric value at risk, rolling volatility and change histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelab.functions.units import display_round
from curvelab.scale import blocked, last_known, row_index

# Normal multipliers of the three levels.
LEVELS = {"p90": 1.645, "p95": 1.96, "p99": 2.576}


def parametric_var(series: DataFrame, key: str, x: str, bucket: Column, value: str = "value", window: int = 60) -> DataFrame:
    """VaR from the newest ``window`` values: log returns times the last price, or plain
    differences where any value is not positive; zero for a shorter history.

    ``bucket`` is monotone in ``x`` (its year, say) and splits a long series.
    """
    kept = series.filter(F.col(value).isNotNull())
    back = row_index(kept, key, F.col(x).desc(), -bucket, name="_back")
    recent = back.filter(F.col("_back") <= window)
    # At most ``window`` rows per key are left.
    order = Window.partitionBy(key).orderBy(F.col("_back").desc())
    previous = F.lag(value).over(order)
    moved = recent.withColumns({"_diff": F.col(value) - previous, "_log": F.when((F.col(value) > 0) & (previous > 0), F.log(F.col(value) / previous))})
    grouped = moved.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max((F.col(value) <= 0).cast("int")).alias("_low"),
        F.stddev_pop("_diff").alias("_sd"),
        F.stddev_pop("_log").alias("_sl"),
        F.max_by(value, -F.col("_back")).alias("_last"),
    )
    sigma = F.when(F.col("_n") < window, 0.0).when(F.col("_low") == 1, F.col("_sd")).otherwise(F.col("_last") * F.col("_sl"))
    return grouped.select(key, *[(sigma * m).alias(name) for name, m in LEVELS.items()])


def vol_fraction(vol: Column) -> Column:
    """Volatility quoted in percent becomes a fraction."""
    return F.when(vol > 1, vol / 100.0).otherwise(vol)


def var_from_vol(latest: DataFrame, price: Column, vol: Column) -> DataFrame:
    """VaR of the last price from its last volatility."""
    return latest.select("*", *[(price * vol_fraction(vol) * m).alias(name) for name, m in LEVELS.items()])


def multi_leg_var(legs: DataFrame, key: str, n_legs: int, x: str = "x") -> DataFrame:
    """Zero-correlation VaR at the newest x all legs share.

    ``legs`` holds (key, leg, ratio, x, price, vol).
    """
    used = legs.filter((F.col("ratio") != 0) & F.col("price").isNotNull() & F.col("vol").isNotNull())
    part = F.col("ratio") * F.col("price") * vol_fraction(F.col("vol"))
    points = used.groupBy(key, x).agg(F.count_distinct("leg").alias("_n"), F.sqrt(F.sum(part * part)).alias("_sigma"))
    shared = points.filter((F.col("_n") == n_legs) & (F.col("_sigma") > 0))
    latest = shared.groupBy(key).agg(F.max_by("_sigma", x).alias("_sigma"), F.max(x).alias(x))
    return latest.select(key, x, *[(F.col("_sigma") * m).alias(name) for name, m in LEVELS.items()])


def first_available(*sources: DataFrame, key: str) -> DataFrame:
    """Per key and level the first source that has a value."""
    keys = sources[0].select(key)
    for s in sources[1:]:
        keys = keys.unionByName(s.select(key))
    out = keys.distinct()
    for i, s in enumerate(sources):
        out = out.join(s.select(key, *[F.col(n).alias(f"{n}_{i}") for n in LEVELS]), key, "left")
    return out.select(key, *[F.coalesce(*[F.col(f"{n}_{i}") for i in range(len(sources))], F.lit(0.0)).alias(n) for n in LEVELS])


def rolling_var(series: DataFrame, keys: Sequence[str], x: str = "x", value: str = "value", window: int = 60, multiplier: float = 1.645) -> DataFrame:
    """p90 VaR along a yearly series; a missing return restarts the window.

    ``keys`` name one yearly series, so a partition is bounded by the axis.
    """
    low = series.groupBy(*keys).agg(F.coalesce(F.max((F.col(value) <= 0).cast("int")), F.lit(0)).alias("_low"))
    order = Window.partitionBy(*keys).orderBy(x)
    previous = F.lag(value).over(order)
    step = F.when(F.col("_low") == 1, F.col(value) - previous).when(
        (F.col(value) > 0) & (previous > 0), F.log(F.col(value) / previous)
    )
    moved = series.join(low, list(keys)).withColumn("_r", step)
    island = F.sum(F.col("_r").isNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    inside = Window.partitionBy(*keys, "_island").orderBy(x).rowsBetween(-(window - 1), 0)
    sigma = F.when(F.count("_r").over(inside) == window, F.stddev_pop("_r").over(inside))
    scaled = sigma * multiplier * F.when(F.col("_low") == 1, 1.0).otherwise(F.col(value))
    return moved.withColumn("_island", island).withColumn("var", display_round(scaled)).drop("_r", "_island", "_low")


def restrict_to(full: DataFrame, plotted: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """Values fitted on the full history, shown only where the plot has points."""
    return full.join(plotted.select(*keys, x).distinct(), [*keys, x], "left_semi")


def change_histogram(series: DataFrame, key: str, order: str, value: str = "value", width: float = 5.0) -> DataFrame:
    """Share of percentage changes per bin, empty bins between included."""
    w = Window.partitionBy(key, F.year(order)).orderBy(order)
    previous = F.lag(value).over(w)
    pct = F.try_divide(F.col(value) - previous, F.nullif(F.abs(previous), F.lit(0.0))) * 100.0
    bins = series.withColumn("_pct", pct).filter(F.col("_pct").isNotNull()).withColumn("bin", F.floor((F.col("_pct") + width / 2) / width))
    counts = bins.groupBy(key, "bin").agg(F.count(F.lit(1)).alias("n"))
    span = counts.groupBy(key).agg(F.min("bin").alias("_lo"), F.max("bin").alias("_hi"), F.sum("n").alias("total"))
    dense = span.select(key, "total", F.explode(F.sequence("_lo", "_hi")).alias("bin"))
    return dense.join(counts, [key, "bin"], "left").select(
        key, (F.col("bin") * width).alias("bin_start"), (F.coalesce("n", F.lit(0)) / F.col("total") * 100.0).alias("share"), "total"
    )


def annualised_vol(
    series: DataFrame, keys: Sequence[str], day: str, price: str, rows: int = 30, minimum: int = 20, block: int = 4096
) -> DataFrame:
    """Thirty-observation volatility a year, carried forward, filled and clipped.

    A series of any length: windows run inside blocks, and carrying is a scan over years.
    """
    year = F.trunc(F.col(day), "year")
    b = blocked(series, list(keys), day, year, rows, block)
    step = F.log(F.col(price)) - F.log(F.lag(price).over(b.order))
    frame = b.trailing(rows)
    vol = F.when(F.count("_r").over(frame) >= minimum, F.stddev_samp("_r").over(frame) * F.sqrt(F.lit(252.0)))
    measured = b.finish(b.frame.withColumn("_r", step).withColumn("_vol", vol)).drop("_r")
    carried = F.coalesce("_vol", F.lit(0.26))
    return (
        last_known(measured, list(keys), day, year, "_vol")
        .withColumn("vol_30d", F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.5), carried)), 5))
        .drop("_vol")
    )
