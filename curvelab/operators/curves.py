"""Seasonal series: strips, interpolation, weighted combination, cycles and runs.

A series is a long table (series, year, x, value) with x on the 366-day leap axis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelab.functions import tokens as K
from curvelab.functions.dates import LEAP_BOUNDARIES, PLAIN_BOUNDARIES
from curvelab.functions.units import convert, display_round
from curvelab.scale import keep_last

LEAP_SPAN = 366
PLAIN_SPAN = 365
MAX_SPAN_DAYS = 7
# Circular day windows (month numbers) of the derived periods.
DERIVED_PERIODS = {"Q1": (1, 3), "Q2": (4, 6), "Q3": (7, 9), "Q4": (10, 12), "Half 1": (1, 6), "Half 2": (7, 12)}


def interpolate_at(observations: DataFrame, targets: DataFrame, keys: Sequence[str], x: str = "x", value: str = "value", max_span: float = MAX_SPAN_DAYS) -> DataFrame:
    """Values at targets: the observation itself, or the line between its two neighbours.

    Nothing is extrapolated and no gap longer than ``max_span`` is bridged.  ``keys``
    name one yearly series, so a partition is bounded by the axis.
    """
    both = observations.select(*keys, x, F.col(value).alias("_obs"), F.lit(False).alias("_asked")).unionByName(
        targets.select(*keys, x).distinct().select(*keys, x, F.lit(None).cast("double").alias("_obs"), F.lit(True).alias("_asked"))
    )
    points = both.groupBy(*keys, x).agg(F.max("_obs").alias("_obs"), F.max("_asked").alias("_asked"))
    known = F.when(F.col("_obs").isNotNull(), F.struct(F.col(x).alias("x"), F.col("_obs").alias("y")))
    order = Window.partitionBy(*keys).orderBy(x)
    back = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.first(known, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    line = F.col("_b.y") + (F.col("_a.y") - F.col("_b.y")) * ((F.col(x) - F.col("_b.x")) / (F.col("_a.x") - F.col("_b.x")))
    between = F.when(F.col("_a.x") - F.col("_b.x") <= max_span, display_round(line))
    return (
        points.withColumns({"_b": back, "_a": ahead})
        .filter("_asked")
        .select(*keys, x, F.coalesce("_obs", between).alias(value), (F.col("_obs").isNull() & between.isNotNull()).alias("interpolated"))
    )


def densify(observations: DataFrame, keys: Sequence[str], x: str = "x", value: str = "value", max_span: float = MAX_SPAN_DAYS) -> DataFrame:
    """Every integer x between the first and the last observation of a series."""
    kept = observations.filter(F.col(value).isNotNull())
    grid = kept.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")).select(
        *keys, F.explode(F.sequence("_lo", "_hi")).alias(x)
    )
    return interpolate_at(kept, grid, keys, x, value, max_span)


def combine_weighted(legs: DataFrame, n_legs: int | str, keys: Sequence[str], x: str = "x", value: str = "value", max_span: float = MAX_SPAN_DAYS) -> DataFrame:
    """Weighted sum on the union of all legs' x; a point needs a value of every leg.

    ``legs`` holds (keys, leg, ratio, x, value) in one unit; legs with ratio 0 count as
    absent.  ``n_legs`` is a number, or the key column that holds it.
    """
    used = legs.filter((F.col("ratio") != 0) & F.col(value).isNotNull())
    points = used.select(*keys, x).distinct()
    names = used.select(*keys, "leg", "ratio").distinct()
    wanted = points.join(names, list(keys))
    filled = interpolate_at(used, wanted, [*keys, "leg"], x, value, max_span).join(names, [*keys, "leg"])
    return (
        filled.groupBy(*keys, x)
        .agg(
            F.count(value).alias("_n"),
            F.sum(F.col("ratio") * F.col(value)).alias("_sum"),
            F.count_if("interpolated").alias("interpolated_legs"),
        )
        .filter(F.col("_n") == (F.col(n_legs) if isinstance(n_legs, str) else F.lit(n_legs)))
        .select(*keys, x, display_round(F.col("_sum")).alias(value), "interpolated_legs")
    )


def derived_legs(monthly: DataFrame, keys: Sequence[str], x: str = "x", value: str = "value", max_span: float = MAX_SPAN_DAYS) -> DataFrame:
    """Quarter and half legs as the mean of their months, each month's gaps bridged first.

    ``monthly`` holds (keys, month, x, value), months by name.  A period exists where all of
    its months have a value, observed or interpolated.
    """
    of = lambda label, n: F.struct(label.alias("period"), F.lit(n).alias("n_legs"))
    periods = F.array(of(K.quarter_of(F.col("month")), 3), of(K.half_of(F.col("month")), 6))
    legs = monthly.withColumn("_p", F.explode(periods)).select(
        *keys, "_p.period", "_p.n_legs", F.col("month").alias("leg"), (F.lit(1.0) / F.col("_p.n_legs")).alias("ratio"), x, value
    )
    return combine_weighted(legs, "n_legs", [*keys, "period", "n_legs"], x, value, max_span).drop("n_legs")


def weighted_sum(legs: DataFrame, keys: Sequence[str], target_unit: str) -> DataFrame:
    """Mixed-unit weighted sum: each leg converted first; one invalid leg makes the sum null."""
    part = F.when(F.col("ratio") == 0, 0.0).otherwise(
        F.col("ratio") * convert(F.col("value"), F.col("native_unit"), F.lit(target_unit), F.col("bbl_per_mt"), F.col("gal_per_bbl"))
    )
    return legs.groupBy(*keys).agg(
        F.when(F.count(part) == F.count(F.lit(1)), display_round(F.sum(part))).alias("value")
    )


def sum_on_shared(legs: DataFrame, n_legs: int, keys: Sequence[str], x: str = "x", value: str = "value") -> DataFrame:
    """Sum where every leg has the x (volumes)."""
    grouped = legs.groupBy(*keys, x).agg(F.count_distinct("leg").alias("_n"), F.sum(value).alias("_sum"))
    return grouped.filter(F.col("_n") == n_legs).select(*keys, x, display_round(F.col("_sum")).alias(value))


def longest_run(observations: DataFrame, keys: Sequence[str], x: str = "x", value: str = "value", max_span: float = MAX_SPAN_DAYS) -> DataFrame:
    """The longest stretch of a series without a gap over ``max_span``; the earlier one wins a tie.

    A missing value ends a stretch.
    """
    order = Window.partitionBy(*keys).orderBy(x)
    before = F.lag(F.struct(x, value)).over(order)
    broken = before.isNull() | before[value].isNull() | F.col(value).isNull() | (F.col(x) - before[x] > max_span)
    runs = observations.withColumn("_run", F.sum(broken.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = runs.filter(F.col(value).isNotNull()).groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_n"), F.min(x).alias("_start"))
    best = sizes.groupBy(*keys).agg(F.max_by("_run", F.struct(F.col("_n"), -F.col("_start"))).alias("_run"))
    return runs.join(best, [*keys, "_run"], "left_semi").filter(F.col(value).isNotNull()).drop("_run")


def merge_references(segments: DataFrame, target: Column, keys: Sequence[str], x: str = "x", value: str = "value", order: str = "reference") -> DataFrame:
    """Sibling references on one axis, a year apart each; the later segment wins an x."""
    shifted = segments.filter(F.col(value).isNotNull()).withColumn(x, F.col(x) + (target - F.col("reference")) * LEAP_SPAN)
    return keep_last(shifted, [*keys, x], order).select(*keys, x, value)


def align_flat_curve(flat: DataFrame, target_years: DataFrame, roll_month: int, x: str = "x", value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """A curve without delivery months, cut into the cycle years of the other legs.

    ``keys`` name the leg in both tables where there are several; other columns of ``flat`` are kept.
    """
    boundary = LEAP_BOUNDARIES[roll_month - 1]
    first = flat.filter(F.col(x) >= boundary).withColumn("year", F.col("year") + 1)
    second = flat.filter(F.col(x) < boundary).withColumn(x, F.col(x) + LEAP_SPAN)
    both = first.unionByName(second) if roll_month > 1 else first
    return both.join(target_years.select(*keys, "year").distinct(), [*keys, "year"], "left_semi")


def plain_axis_day(x: Column) -> Column:
    """Leap-axis day on the 365-day axis; 29 February has no place there."""
    day = F.pmod(x - 1, F.lit(LEAP_SPAN)) + 1
    cycle = F.floor((x - 1) / F.lit(LEAP_SPAN))
    return F.when(day != 60, cycle * PLAIN_SPAN + day - F.when(day > 60, 1).otherwise(0))


def rotate_day(day: Column, anchor: Column | int, span: int = PLAIN_SPAN) -> Column:
    """Position of a day in a cycle that ends at the anchor."""
    offset = F.pmod(day - 1, F.lit(span)) + 1 - anchor
    return F.when(offset <= 0, offset + span).otherwise(offset)


def anchor_day(roll_month: Column) -> Column:
    """Last plain-axis day before the roll month begins."""
    start = F.get(F.array(*[F.lit(b) for b in PLAIN_BOUNDARIES]), roll_month.cast("int") - 1)
    return F.when(start == 1, PLAIN_SPAN).otherwise(start - 1)


def clip_cycle(series: DataFrame, roll_month: int | Column, x: str = "x") -> DataFrame:
    """The days of one cycle, which begins with the roll month; rows without a roll month are all kept."""
    month = F.lit(roll_month) if isinstance(roll_month, int) else roll_month
    start = F.get(F.array(*[F.lit(b) for b in LEAP_BOUNDARIES]), month.cast("int") - 1)
    return series.filter(month.isNull() | F.col(x).between(start, start + LEAP_SPAN - 1))


def axis_end(series: DataFrame, keys: Sequence[str], x: str = "x", value: str = "value") -> DataFrame:
    """The last day with a value, on the 365-day axis."""
    last = series.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(plain_axis_day(F.col(x))).alias("_last"))
    return last.select(*keys, (F.pmod(F.col("_last") - 1, F.lit(PLAIN_SPAN)) + 1).cast("int").alias("end_day"))


def season_anchor(series: DataFrame, contracts: DataFrame, ends: DataFrame, key: str = "series", year: str = "year") -> DataFrame:
    """(key, anchor, source): the contract's anchor, else the axis end, else the series' end, of the latest year that has one.

    ``contracts`` holds (key, roll_month), null where a leg has no delivery month; ``ends``
    holds (key, year, end_day) of the combined cycles.
    """
    latest = lambda df, name: df.filter(F.col("end_day").isNotNull()).groupBy(key).agg(F.max_by("end_day", year).alias(name))
    found = (
        contracts.select(key, anchor_day(F.col("roll_month")).alias("_contract"))
        .join(latest(ends, "_axis"), key, "left")
        .join(latest(axis_end(series, [key, year]), "_series"), key, "left")
    )
    source = F.when(F.col("_contract").isNotNull(), "CONTRACT").when(F.col("_axis").isNotNull(), "AXIS_END").when(F.col("_series").isNotNull(), "SERIES_END")
    return found.select(key, F.coalesce("_contract", "_axis", "_series").alias("anchor"), source.alias("source"))


def season_axis(series: DataFrame, keys: Sequence[str], anchor: Column, x: str = "x", value: str = "value") -> DataFrame:
    """Display axis: no leap day, rotated to the anchor, started at day one, longest run kept."""
    placed = (
        series.withColumn("_plain", plain_axis_day(F.col(x)))
        .filter(F.col("_plain").isNotNull())
        .withColumn("day", rotate_day(F.col("_plain"), anchor).cast("int"))
    )
    one = keep_last(placed.select(*keys, "day", x, value), [*keys, "day"], x)
    return longest_run(one, keys, "day", value)


def derived_window(periods: DataFrame, key: str = "key") -> DataFrame:
    """Days all derived periods of a key share on the 366-day ring, as its longest run."""
    cells = F.create_map(
        *[c for name, (a, b) in DERIVED_PERIODS.items() for c in (F.lit(name), F.sequence(F.lit(LEAP_BOUNDARIES[a - 1]), F.lit(LEAP_BOUNDARIES[b] - 1)))]
    )
    known = periods.select(key, K.period_label(F.col("period")).alias("p")).distinct().withColumn("days", F.element_at(cells, F.col("p"))).filter(F.col("days").isNotNull())
    shared = (
        known.select(key, F.explode("days").alias("day"))
        .groupBy(key, "day")
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(known.groupBy(key).agg(F.count(F.lit(1)).alias("_need")), key)
        .filter(F.col("_n") == F.col("_need"))
    )
    # The ring is doubled so a run over New Year stays whole.
    doubled = shared.select(key, F.explode(F.array(F.col("day"), F.col("day") + LEAP_SPAN)).alias("x"), F.lit(1.0).alias("value"))
    run = longest_run(doubled, [key], "x", "value", 1)
    return run.groupBy(key).agg(F.min("x").alias("start_day"), F.least(F.count(F.lit(1)), F.lit(LEAP_SPAN)).alias("days")).withColumn(
        "end_day", F.pmod(F.col("start_day") + F.col("days") - 2, F.lit(LEAP_SPAN)) + 1
    )


def strips(monthly: DataFrame, keys: Sequence[str], values: Sequence[str], averages: Sequence[str] = ()) -> DataFrame:
    """Quarter and half strips: the mean over all months of the period, only where none is missing.

    Each row goes to its quarter and its half in one pass.
    """
    periods = F.array(
        F.struct(K.quarter_of(F.col("month")).alias("period"), F.lit(3).alias("need"), F.lit("Quarterly").alias("frequency")),
        F.struct(K.half_of(F.col("month")).alias("period"), F.lit(6).alias("need"), F.lit("Half").alias("frequency")),
    )
    opened = monthly.withColumn("_p", F.explode(periods)).select("*", "_p.*").drop("_p")
    grouped = opened.groupBy(*keys, "period", "frequency", "need").agg(
        F.count_distinct("month").alias("_months"),
        *[F.sum(v).alias(v) for v in values],
        *[F.avg(v).alias(v) for v in averages],
    )
    return grouped.filter(F.col("_months") == F.col("need")).select(
        *keys, "period", "frequency", *[(F.col(v) / F.col("need")).alias(v) for v in values], *averages
    )


def drop_raw_periods(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delivered quarter and half rows give way where monthly rows exist."""
    monthly = rows.filter(F.col("frequency") == "Monthly").select(*keys).distinct()
    raw = rows.filter(F.col("frequency") != "Monthly").join(monthly, list(keys), "left_anti")
    return rows.filter(F.col("frequency") == "Monthly").unionByName(raw)


def month_adjustment(series: DataFrame, keys: Sequence[str], month: Column, value: str = "value") -> DataFrame:
    """Heuristic shift of a series to another month label."""
    means = series.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    factor = 1 + (month - 6.5) * 0.004
    offset = F.col("_mean") * 0.01 * F.sin(month / 12.0 * 2 * F.pi())
    return series.join(means, list(keys)).withColumn(value, display_round(F.col(value) * factor + offset)).drop("_mean")


def resolve_series(legs: DataFrame, catalog: DataFrame) -> DataFrame:
    """The catalog series each leg means.

    Same root and period; the reference of the year offset if asked for and present,
    else the smallest one; of several the latest year, then the largest code.  Without
    a period match any series of the root counts.
    """
    joined = legs.join(catalog, "root", "left")
    match = F.coalesce(F.lower("period") == F.lower("wanted_period"), F.lit(False)) | (F.col("wanted_period") == "")
    asked = (F.col("year_offset") > 0) & (F.col("reference") == F.col("year_offset") + 1)
    w = Window.partitionBy("leg")
    flagged = joined.withColumns({"_match": match.cast("int"), "_asked": (match & asked).cast("int")}).withColumns(
        {"_any": F.max("_match").over(w), "_any_asked": F.max("_asked").over(w), "_low": F.min(F.when(match, F.col("reference"))).over(w)}
    )
    kept = (
        F.when(F.col("_any") == 0, F.lit(True))
        .when(F.col("_any_asked") == 1, F.col("_asked") == 1)
        .when((F.col("year_offset") > 0) & (F.col("_any_asked") == 0), F.col("_match") == 1)
        .otherwise((F.col("_match") == 1) & (F.col("reference") == F.col("_low")))
    )
    best = flagged.filter(kept).groupBy("leg").agg(
        F.max_by("code", F.struct(F.coalesce("contract_year", F.lit(0)), F.col("code"))).alias("code")
    )
    return legs.select("leg").join(best, "leg", "left")


def field_series(rows: DataFrame, field: str, available: Sequence[str]) -> DataFrame:
    """One price field; a missing value stays missing and never falls back to another field."""
    chosen = F.col(field) if field in available else F.lit(None).cast("double")
    return rows.withColumn("value", chosen)


def pivot_export(series: DataFrame, years: Sequence[int], keys: Sequence[str] = ("x",), value: str = "value") -> DataFrame:
    """Year columns beside the keys: a day by year matrix per series."""
    return series.groupBy(*keys).pivot("year", list(years)).agg(F.first(value, ignorenulls=True))
