"""Seasonal priors from earlier years only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelab.functions.stats import ratio, sorted_quantile

YEAR_SLOTS = 366


@dataclass(frozen=True)
class PriorPool:
    """Which earlier observations a seasonal prior takes, and how far it is shrunk."""

    # Fixed values.
    seasonality_window_days: int = 14
    seasonality_shrinkage: float = 16.0
    seasonality_min_prior_years: int = 2
    expiry_seasonality_window_sessions: int = 5


def _ordered(pool: str, field: str) -> Column:
    """The pool's values with their years, smallest value first; sorted once per pool."""
    valued = F.filter(F.transform(F.col(pool), lambda c: F.struct(c[field].alias("v"), c["y"].alias("y"))), lambda c: c["v"].isNotNull())
    return F.sort_array(valued)


def _before(ordered: str) -> Column:
    """Values of an ordered pool that belong to years before the row's own year, still in order."""
    return F.transform(F.filter(F.col(ordered), lambda c: c["y"] < F.col("asof_year")), lambda c: c["v"])


def seasonality(
    daily: DataFrame,
    p: PriorPool = PriorPool(),
    entity: str = "spread_id",
    day: str = "session_date",
    years: list[int] | None = None,
) -> DataFrame:
    """Level and move quantiles per (entity, year, day of the year).

    The pool of a day holds all earlier years within ``seasonality_window_days`` on the
    366-day ring.  Rows are first put in cells (entity, day of the year); a range window
    over the ring then joins neighbouring cells.  A cell holds one value per year and a
    pool one per year and window day, so both are bounded by the calendar.

    ``daily`` holds one row per entity and day: spread_close, price_change,
    sessions_to_risk_date, settlement_quality.
    """
    radius, expiry_radius = p.seasonality_window_days, p.expiry_seasonality_window_sessions
    move = F.col("price_change")
    finite_move = F.when(~F.isnan(move) & (F.abs(move) < F.lit(float("inf"))), move)
    rows = daily.select(
        entity,
        F.year(day).alias("asof_year"),
        F.dayofyear(day).alias("day_of_year"),
        F.col("spread_close").alias("_level"),
        finite_move.alias("_move"),
        F.col("sessions_to_risk_date").alias("_dte"),
        F.col("settlement_quality").alias("daily_settlement_quality"),
    )
    cell = F.struct(F.col("asof_year").alias("y"), F.col("_level").alias("level"), F.col("_move").alias("move"))

    by_day = rows.groupBy(entity, "day_of_year").agg(F.collect_list(cell).alias("_cell"))
    # The ring is opened: days near its ends appear once more beyond them.
    wraps = F.array(F.col("day_of_year"), F.col("day_of_year") + YEAR_SLOTS, F.col("day_of_year") - YEAR_SLOTS)
    ring = by_day.withColumn("_pos", F.explode(wraps)).filter(
        F.col("_pos").between(1 - radius, YEAR_SLOTS + radius)
    )
    near = Window.partitionBy(entity).orderBy("_pos").rangeBetween(-radius, radius)
    pools = ring.withColumn("_pool", F.flatten(F.collect_list("_cell").over(near))).filter(
        F.col("_pos") == F.col("day_of_year")
    ).select(entity, "day_of_year", _ordered("_pool", "level").alias("_by_level"), _ordered("_pool", "move").alias("_by_move"))

    by_dte = rows.filter(F.col("_dte").isNotNull() & F.col("_move").isNotNull()).groupBy(entity, "_dte").agg(
        F.collect_list(cell).alias("_cell")
    )
    near_expiry = Window.partitionBy(entity).orderBy("_dte").rangeBetween(-expiry_radius, expiry_radius)
    # A target's own distance may have no finite move; its neighbours still count.
    asked = rows.filter(F.col("_dte").isNotNull()).select(entity, "_dte").distinct()
    expiry_pools = asked.join(by_dte, [entity, "_dte"], "left").select(
        entity, "_dte", F.flatten(F.collect_list("_cell").over(near_expiry)).alias("_expiry_pool")
    ).select(entity, "_dte", _ordered("_expiry_pool", "move").alias("_by_expiry"))

    per_year = rows.select(entity, "asof_year").distinct()
    earlier = Window.partitionBy(entity).orderBy("asof_year")
    prior = per_year.select(entity, "asof_year", (F.row_number().over(earlier) - 1).alias("seasonal_prior_years"))

    targets = rows if years is None else rows.filter(F.col("asof_year").isin(*years))
    joined = (
        targets.join(pools, [entity, "day_of_year"])
        .join(expiry_pools, [entity, "_dte"], "left")
        .join(prior, [entity, "asof_year"])
        .filter(F.col("seasonal_prior_years") > 0)
        .withColumns(
            {
                "_levels": _before("_by_level"),
                "_moves": _before("_by_move"),
                "_expiry": F.coalesce(_before("_by_expiry"), F.array().cast("array<double>")),
            }
        )
        .withColumns({"seasonal_n": F.size("_levels"), "_n": F.size("_moves"), "expiry_seasonal_n": F.size("_expiry")})
        .filter((F.col("seasonal_n") >= 8) | (F.col("_n") >= 8))
        .withColumn(
            "seasonal_support",
            F.least(F.col("seasonal_prior_years") / F.lit(8.0), F.lit(1.0))
            * (F.col("_n") / (F.col("_n") + F.lit(p.seasonality_shrinkage))),
        )
    )
    return joined.select(
        entity, "asof_year", "day_of_year",
        sorted_quantile(F.col("_levels"), 0.50).alias("seasonal_median"),
        sorted_quantile(F.col("_levels"), 0.25).alias("seasonal_q25"),
        sorted_quantile(F.col("_levels"), 0.75).alias("seasonal_q75"),
        "seasonal_n",
        "seasonal_prior_years",
        (F.col("seasonal_support") * sorted_quantile(F.col("_moves"), 0.50)).alias("seasonal_move_1d"),
        sorted_quantile(F.col("_moves"), 0.25).alias("seasonal_move_q25"),
        sorted_quantile(F.col("_moves"), 0.75).alias("seasonal_move_q75"),
        (F.col("seasonal_support") * sorted_quantile(F.col("_expiry"), 0.50)).alias("expiry_seasonal_move_1d"),
        "expiry_seasonal_n",
        "seasonal_support",
        F.when(F.col("seasonal_prior_years") >= p.seasonality_min_prior_years, "PRODUCTION_PRIOR")
        .otherwise("PRELIMINARY_PRIOR")
        .alias("seasonal_status"),
        "daily_settlement_quality",
    )


SEASONAL_COLUMNS = (
    "seasonal_median", "seasonal_q25", "seasonal_q75", "seasonal_n", "seasonal_prior_years", "seasonal_move_1d",
    "expiry_seasonal_move_1d", "seasonal_support", "seasonal_status", "daily_settlement_quality",
)


def attach_seasonality(features: DataFrame, prior: DataFrame | None, entity: str = "spread_id") -> DataFrame:
    """Seasonal z, expected move, fair value and confidence beside the features."""
    keys = [entity, "asof_year", "day_of_year"]
    if prior is None:
        kinds = {"seasonal_n": "int", "seasonal_prior_years": "int", "daily_settlement_quality": "string"}
        joined = features.withColumns(
            {
                c: F.lit("UNAVAILABLE") if c == "seasonal_status" else F.lit(None).cast(kinds.get(c, "double"))
                for c in SEASONAL_COLUMNS
            }
        )
    else:
        joined = features.join(prior.select(*keys, *SEASONAL_COLUMNS), keys, "left")
    spread = F.col("seasonal_q75") - F.col("seasonal_q25")
    blend = F.coalesce(
        0.70 * F.col("seasonal_move_1d") + 0.30 * F.col("expiry_seasonal_move_1d"),
        F.col("seasonal_move_1d"),
        F.col("expiry_seasonal_move_1d"),
    )
    return joined.withColumns(
        {
            "seasonal_z": F.when(
                spread > 0, ratio(F.col("spread_close") - F.col("seasonal_median"), spread / F.lit(1.349))
            ),
            "seasonal_expected_move_1d": blend,
            "seasonal_fair_value_1d": F.col("spread_close") + blend,
            "seasonal_move_z": ratio(blend, F.col("realized_vol_5d")),
            "seasonal_confidence": F.col("seasonal_support")
            * F.when(F.col("daily_settlement_quality") == "EXCHANGE_SETTLE", 1.0).otherwise(0.65),
        }
    )
