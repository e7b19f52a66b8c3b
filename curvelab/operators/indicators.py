"""Backward-only indicators of package bars.

Inputs per row: entity, time, session_date, bar_slot, roll_id, research_close,
spread_close, spread_bar_vwap, price_change, package_volume_capacity,
paired_volume_bbl, package_oi_capacity, min_leg_events, leg1_usd_bbl, leg2_usd_bbl,
n_legs.  Three passes, each one shuffle: same-slot baselines by (entity, slot),
session sums by (entity, session), everything else by (entity, block).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelab.functions import rolling as R
from curvelab.functions import stats as S
from curvelab.functions.dates import weekday
from curvelab.operators.smoothers import block_for, check_block, rsi, smooth, smooth_nullable, span_alpha
from curvelab.scale import BLOCK, ROW, Blocked, blocked, focus, running_total

EPSILON = 1e-12
MAD_TO_STD = 1.4826

RISK_OUTPUTS = (
    "tod_normalized_change", "vol_regime_ratio_1d_20d", "liquidity_stress_ratio", "tail_event_rate_20d",
    "robust_volume_surprise", "return_skew_5d", "return_excess_kurtosis_5d", "realized_vol_of_vol_5d",
    "trend_hac_t_stat_3d", "close_path_choppiness_5d",
)


@dataclass(frozen=True)
class Windows:
    """Window lengths.  They are numbers of sessions, so ``bars``, the bars of a session, gives them all."""

    # Bars of a session, same-slot history, and the sessions of each window.
    bars: int = 26
    volume_seasonality_sessions: int = 20
    same_slot_minimum: int = 8

    one_session = rsi_window = macd_fast = macd_signal = hurst_lag = cusum_window = property(lambda self: self.bars)
    three_sessions = bollinger_window = macd_slow = donchian_window = property(lambda self: 3 * self.bars)
    five_sessions = robust_z_window = entropy_window = crossing_window = property(lambda self: 5 * self.bars)
    ten_sessions = property(lambda self: 10 * self.bars)
    twenty_sessions = advanced_window = property(lambda self: 20 * self.bars)

    @property
    def variance_ratio_lag(self) -> int:
        """Ten bars of 26, in proportion."""
        return max(2, 10 * self.bars // 26)

    @property
    def hac_lags(self) -> int:
        return max(1, self.one_session // 4)

    @property
    def minimum_advanced(self) -> int:
        return max(self.three_sessions, self.advanced_window // 2)

    @property
    def entropy_minimum(self) -> int:
        return max(24, self.entropy_window // 2)


@dataclass(frozen=True)
class RiskLimits:
    """Levels of the risk regime; the ledger's optional risk gates read two of them."""

    # Fixed values.
    extreme_tod_shock_z: float = 4.0
    volume_dryness_z: float = -2.5
    tail_event_z: float = 2.5
    tail_cluster_rate: float = 0.10
    vol_expansion_ratio: float = 1.5
    impact_stress_ratio: float = 2.5


def smoothing_alphas(p: Windows) -> list[float]:
    spans = (p.macd_fast, p.macd_slow, p.macd_signal, p.three_sessions, p.one_session)
    return [span_alpha(s) for s in spans] + [1.0 / p.rsi_window]


def needed_halo(p: Windows) -> int:
    """Longest chain of dependent look-backs."""
    smoothing = max(S.seed_rows(a) for a in smoothing_alphas(p)) + S.seed_rows(span_alpha(p.macd_signal))
    windows = max(
        2 * p.robust_z_window + p.crossing_window + 1,
        p.bollinger_window + p.ten_sessions + 1,
        p.ten_sessions + p.crossing_window + 2,
        p.advanced_window + max(p.hurst_lag, p.variance_ratio_lag) + 2,
        p.twenty_sessions + 2,
        p.one_session + p.five_sessions + 1,
        p.five_sessions + p.cusum_window + 1,
    )
    return max(smoothing, windows)


def _or_zero(scale: Column, value: Column, numerator: Column, neutral: float) -> Column:
    """value where the scale is real; the neutral number where both are zero; else null."""
    return F.when(scale > EPSILON, value).when(F.abs(numerator) <= EPSILON, F.lit(neutral))


def signed_volume() -> Column:
    return F.coalesce(F.signum("price_change") * F.col("paired_volume_bbl"), F.lit(0.0))


def with_point_columns(df: DataFrame) -> DataFrame:
    """Row-local inputs of the window stages."""
    change, volume = F.col("price_change"), F.col("paired_volume_bbl")
    return df.withColumns(
        {
            "abs_change": F.abs(change),
            "amihud_impact_proxy": F.abs(change) / (volume + 1.0) * 1_000_000.0,
            "average_trade_size_bbl_proxy": S.ratio(volume, F.col("min_leg_events")),
            "signed_volume": signed_volume(),
            "_log_capacity": F.log1p(S.clip(F.col("package_volume_capacity"), 0.0)),
        }
    )


def same_slot_features(
    df: DataFrame, p: Windows, entity: str = "spread_id", ts: str = "timestamp_utc", slot: str = "bar_slot",
    bucket: Column | None = None, block: int = 4096, base: DataFrame | None = None,
) -> DataFrame:
    """Baselines of the same bar of the day over earlier sessions.

    The window holds at most twenty values, which are collected and sorted per row.
    """
    n, m = p.volume_seasonality_sessions, p.same_slot_minimum
    bucket = F.date_trunc("month", F.col("session_date")) if bucket is None else bucket
    b = blocked(df, [entity, slot], ts, bucket, halo=2 * n + 1, block=block, base=base)
    prior = b.prior(n)
    frame, restore = b.focus(
        b.frame, "package_volume_capacity", "abs_change", "_log_capacity", "amihud_impact_proxy", "price_change"
    )

    def collected(**named: str) -> dict[str, Column]:
        return {out: F.collect_list(column).over(prior) for out, column in named.items()}

    def baseline(column: str) -> Column:
        return F.when(F.size(column) >= m, S.sorted_quantile(F.sort_array(column), 0.5))

    lists = frame.withColumns(
        collected(_l_cap="package_volume_capacity", _l_change="abs_change", _l_volume="_log_capacity", _l_impact="amihud_impact_proxy")
    )
    first = lists.withColumns(
        {
            "expected_tod_package_volume": baseline("_l_cap"),
            "_tod_change": baseline("_l_change"),
            "_tod_volume": baseline("_l_volume"),
            "_tod_impact": baseline("_l_impact"),
        }
    )
    surprise = F.col("_log_capacity") - F.col("_tod_volume")
    errors = first.withColumn("_volume_error", F.abs(surprise))
    second = errors.withColumns(collected(_l_error="_volume_error")).withColumn("_tod_error", baseline("_l_error"))
    change, impact = F.col("price_change"), F.col("amihud_impact_proxy")
    change_scale, error_scale = MAD_TO_STD * F.col("_tod_change"), MAD_TO_STD * F.col("_tod_error")
    done = second.withColumns(
        {
            "relative_volume": S.ratio(F.col("package_volume_capacity"), F.col("expected_tod_package_volume")),
            "tod_normalized_change": _or_zero(change_scale, S.ratio(change, change_scale), change, 0.0),
            "liquidity_stress_ratio": _or_zero(F.col("_tod_impact"), S.ratio(impact, F.col("_tod_impact")), impact, 1.0),
            "robust_volume_surprise": _or_zero(error_scale, S.ratio(surprise, error_scale), surprise, 0.0),
        }
    )
    return b.finish(
        restore(done), "_tod_change", "_tod_volume", "_tod_impact", "_volume_error", "_tod_error", "_log_capacity",
        "_l_cap", "_l_change", "_l_volume", "_l_impact", "_l_error",
    )


def session_features(
    df: DataFrame, entity: str = "spread_id", ts: str = "timestamp_utc", base: DataFrame | None = None
) -> DataFrame:
    """Session VWAP (bounded by one session) and the running signed volume of a roll."""
    session = (
        Window.partitionBy(entity, "session_date", "roll_id").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    )
    inner, restore = focus(
        df, [entity, ts, "session_date", "roll_id", "spread_bar_vwap", "package_volume_capacity", "signed_volume",
             "price_change", "paired_volume_bbl"],
    )
    weighted = F.sum(F.col("spread_bar_vwap") * F.col("package_volume_capacity")).over(session)
    vwap = inner.withColumn(
        "session_vwap_proxy", S.ratio(weighted, F.nullif(F.sum("package_volume_capacity").over(session), F.lit(0.0)))
    )
    summed = running_total(
        vwap, [entity, "roll_id"], ts, F.date_trunc("month", F.col("session_date")), {"obv_proxy": F.col("signed_volume")},
        base=None if base is None else base.withColumn("signed_volume", signed_volume()),
    )
    return restore(summed)


def order_statistics(
    bars: DataFrame, p: Windows, halo: int, block: int, entity: str, ts: str, bucket: Column
) -> DataFrame:
    """Exact rolling medians and the band-width quantile, per (entity, block, row).

    They depend on the continuous close alone, so only four columns travel.  Sorting a
    window of 130 to 260 values again for every row is thirty times slower in a Spark
    frame than the sliding structure pandas keeps, hence the grouped map.  A group is one
    block of bounded length.
    """
    z, band, three = p.robust_z_window, p.bollinger_window, p.three_sessions
    narrow = bars.select(entity, F.col(ts), bucket.alias("_by"), F.col("research_close").alias("_x"))
    b = blocked(narrow, entity, [ts, "_x"], F.col("_by"), halo, block)

    def slide(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(ROW)
        x = group["_x"].reset_index(drop=True)
        median = x.rolling(z, min_periods=three).median()
        mad = (x - median).abs().rolling(z, min_periods=three).median()
        middle = x.rolling(band, min_periods=three)
        width = 4.0 * middle.std() / middle.mean().abs().replace(0.0, np.nan)
        p20 = width.shift(1).rolling(p.ten_sessions, min_periods=p.five_sessions).quantile(0.20, interpolation="linear")
        return pd.DataFrame(
            {
                entity: group[entity].to_numpy(), BLOCK: group[BLOCK].to_numpy(), ROW: group[ROW].to_numpy(),
                "rolling_median": median, "rolling_mad": mad, "bollinger_width_p20": p20,
            }
        )

    schema = (
        f"{entity} string, {BLOCK} bigint, {ROW} bigint, rolling_median double, rolling_mad double,"
        " bollinger_width_p20 double"
    )
    return b.frame.select(entity, BLOCK, ROW, "_x").groupBy(entity, BLOCK).applyInPandas(slide, schema)


def price_features(b: Blocked, df: DataFrame, p: Windows) -> DataFrame:
    """Location, band, momentum, volatility and AR(1) features of the continuous close."""
    df, restore = b.focus(df, "research_close", "price_change", "abs_change")
    x, change = F.col("research_close"), F.col("price_change")
    one, three, five, ten = p.one_session, p.three_sessions, p.five_sessions, p.ten_sessions
    band = p.bollinger_window
    move = x - F.lag(x).over(b.order)
    # The close is measured from the first close of the block, so squares stay small.
    out = df.withColumns(
        {
            "_origin": F.first(x).over(b.running),
            "_lag_x": F.lag(x).over(b.order),
            "_gain": F.when(move > 0, move).otherwise(0.0),
            "_loss": F.when(move < 0, -move).otherwise(0.0),
            "ema_fast": smooth(b, x, span_alpha(p.macd_fast), p.macd_fast),
            "ema_slow": smooth(b, x, span_alpha(p.macd_slow), p.macd_slow),
            "donchian_high": S.high(x, b.prior(p.donchian_window), three),
            "donchian_low": S.low(x, b.prior(p.donchian_window), three),
            "_moved": F.abs(x - F.lag(x, one).over(b.order)),
        }
    )
    rel, lag_rel = x - F.col("_origin"), F.col("_lag_x") - F.col("_origin")
    paired = F.when(lag_rel.isNotNull(), rel)
    series = {
        "x": R.Track(rel, tuple({band, ten}), 2),
        "xp": R.Track(paired, (ten,)),
        "lx": R.Track(lag_rel, (ten,), 2),
        "xl": R.Track(rel * lag_rel, (ten,)),
        "d": R.Track(change, (five,), 2),
        "ad": R.Track(F.abs(change), (one,)),
        "up": R.Track(F.when(change > 0, change * change).otherwise(0.0), (five,)),
        "dn": R.Track(F.when(change < 0, change * change).otherwise(0.0), (five,)),
    }
    out = R.window_sums(b, out, series)
    x_mean, lag_mean = R.mean("x", ten, five), R.mean("lx", ten, five)
    # Means are over each input's own non-null rows; at the start of a series they differ
    # by one row, and the origin then no longer cancels.
    cross = R.mean("xl", ten, five) - x_mean * lag_mean + F.col("_origin") * (R.mean("xp", ten, five) - x_mean)
    lag_var = R.mean("lx", ten, five, power=2) - lag_mean * lag_mean
    out = out.withColumns(
        {
            "bollinger_mid": F.col("_origin") + R.mean("x", band, three),
            "bollinger_std": R.std("x", band, three),
            "realized_vol_5d": R.std("d", five, three),
            "upside_semivol": F.sqrt(S.clip(R.mean("up", five, three), 0.0)),
            "downside_semivol": F.sqrt(S.clip(R.mean("dn", five, three), 0.0)),
            "efficiency_ratio": S.ratio(F.col("_moved"), F.nullif(R.total("ad", one, one), F.lit(0.0))),
            "macd_line": F.col("ema_fast") - F.col("ema_slow"),
            "_avg_gain": smooth(b, F.col("_gain"), 1.0 / p.rsi_window, p.rsi_window),
            "_avg_loss": smooth(b, F.col("_loss"), 1.0 / p.rsi_window, p.rsi_window),
            "ar1_beta": S.ratio(cross, F.nullif(lag_var, F.lit(0.0))),
        }
    ).drop(*R.tracked_columns(series), "_origin", "_lag_x", "_gain", "_loss", "_moved")
    out = smooth_nullable(b, out, "abs_change", span_alpha(three), "ewma_abs_change", one)
    out = smooth_nullable(b, out, "macd_line", span_alpha(p.macd_signal), "macd_signal", p.macd_signal)
    out = out.withColumns(
        {
            "bollinger_upper": F.col("bollinger_mid") + 2 * F.col("bollinger_std"),
            "bollinger_lower": F.col("bollinger_mid") - 2 * F.col("bollinger_std"),
            "normalized_change": S.ratio(change, F.nullif(F.col("realized_vol_5d"), F.lit(0.0))),
            "rsi": rsi(F.col("_avg_gain"), F.col("_avg_loss")),
            "macd_histogram": F.col("macd_line") - F.col("macd_signal"),
            "jump_score": S.ratio(F.abs(change), F.nullif(F.col("ewma_abs_change"), F.lit(0.0))),
            "ou_half_life_bars": F.when(
                (F.col("ar1_beta") > 0) & (F.col("ar1_beta") < 0.9999), -math.log(2.0) / F.log("ar1_beta")
            ),
        }
    )
    std4 = F.nullif(4 * F.col("bollinger_std"), F.lit(0.0))
    out = out.withColumns(
        {
            "bollinger_pct_b": S.ratio(x - F.col("bollinger_lower"), std4),
            "bollinger_width": S.ratio(F.col("bollinger_upper") - F.col("bollinger_lower"), F.abs("bollinger_mid")),
        }
    )
    width = {"bw": R.Track(F.col("bollinger_width"), (five,), 2)}
    out = R.window_sums(b, out, width).withColumn("volatility_of_volatility", R.std("bw", five, three))
    return restore(out.drop(*R.tracked_columns(width), "_avg_gain", "_avg_loss"))


def location_features(df: DataFrame) -> DataFrame:
    """Robust z and the squeeze flag, from the joined order statistics."""
    scale = MAD_TO_STD * F.nullif(F.col("rolling_mad"), F.lit(0.0))
    return df.withColumns(
        {
            "robust_z": S.ratio(F.col("research_close") - F.col("rolling_median"), scale),
            "volatility_squeeze": F.col("bollinger_width") < F.col("bollinger_width_p20"),
        }
    )


def volume_features(b: Blocked, df: DataFrame, p: Windows) -> DataFrame:
    """Volume trend, signed flow, effort against result and open-interest drift."""
    df, restore = b.focus(
        df, "package_volume_capacity", "signed_volume", "paired_volume_bbl", "package_oi_capacity", "relative_volume",
        "normalized_change",
    )
    one = p.one_session
    out = smooth_nullable(b, df, "package_volume_capacity", span_alpha(one), "_vol_fast", one)
    out = smooth_nullable(b, out, "package_volume_capacity", span_alpha(p.three_sessions), "_vol_slow", p.three_sessions)
    series = {"sv": R.Track(F.col("signed_volume"), (one,)), "pv": R.Track(F.col("paired_volume_bbl"), (one,))}
    out = R.window_sums(b, out, series)
    capacity = F.col("package_oi_capacity")
    out = out.withColumns(
        {
            "pvo": S.ratio(F.col("_vol_fast") - F.col("_vol_slow"), F.nullif(F.col("_vol_slow"), F.lit(0.0))),
            "signed_volume_imbalance_proxy": S.ratio(
                R.total("sv", one, one), F.nullif(R.total("pv", one, one), F.lit(0.0))
            ),
            "effort_vs_result": S.ratio(F.col("relative_volume"), F.abs("normalized_change") + 0.25),
            "oi_migration_1d": S.ratio(capacity, F.nullif(F.lag(capacity, one).over(b.order), F.lit(0.0))) - 1.0,
        }
    )
    return restore(out.drop("_vol_fast", "_vol_slow", *R.tracked_columns(series)))


def _ordinal_pattern(a: Column, b: Column, c: Column) -> Column:
    """Rank order of three successive values (a oldest), numbered 0 to 5."""
    return (
        F.when((a <= b) & (b <= c), 0)
        .when((a <= c) & (c < b), 1)
        .when((b < a) & (a <= c), 2)
        .when((b <= c) & (c < a), 3)
        .when((c < a) & (a <= b), 4)
        .otherwise(5)
    )


def structure_features(b: Blocked, df: DataFrame, p: Windows) -> DataFrame:
    """Variance ratios, persistence, entropy, jumps, leg relationship and the regime label."""
    df, restore = b.focus(
        df, "research_close", "price_change", "robust_z", "ou_half_life_bars", "normalized_change", "upside_semivol",
        "downside_semivol", "efficiency_ratio", "leg1_usd_bbl", "leg2_usd_bbl", "n_legs",
    )
    x, change, z = F.col("research_close"), F.col("price_change"), F.col("robust_z")
    w, least, cross, three = p.advanced_window, p.minimum_advanced, p.crossing_window, p.three_sessions
    two_legs = F.col("n_legs") <= 2
    out = df.withColumns(
        {
            "_delta_vr": x - F.lag(x, p.variance_ratio_lag).over(b.order),
            "_delta_hurst": x - F.lag(x, p.hurst_lag).over(b.order),
            "_lag1": F.lag(change, 1).over(b.order),
            "_lag2": F.lag(change, 2).over(b.order),
            "_leg1": F.col("leg1_usd_bbl") - F.lag("leg1_usd_bbl").over(b.order),
            "_leg2": F.col("leg2_usd_bbl") - F.lag("leg2_usd_bbl").over(b.order),
            "_crossed": (z * F.lag(z).over(b.order) < 0).cast("double"),
        }
    ).withColumns(
        {
            "_pattern": _ordinal_pattern(F.col("_lag2"), F.col("_lag1"), change),
            "_leg1_lag": F.lag("_leg1").over(b.order),
            "_leg2_lag": F.lag("_leg2").over(b.order),
        }
    )
    series = {
        "d": R.Track(change, (w,), 2),
        "vr": R.Track(F.col("_delta_vr"), (w,), 2),
        "hu": R.Track(F.col("_delta_hurst"), (w,), 2),
        "zc": R.Track(F.col("_crossed"), (cross,)),
        "hl": R.Track(F.log("ou_half_life_bars"), (cross,), 2),
        "bv": R.Track(F.abs(change) * F.abs("_lag1"), (w,)),
        "nc": R.Track(F.col("normalized_change"), (p.cusum_window,)),
        **{f"p{k}": R.Track((F.col("_pattern") == k).cast("double"), (p.entropy_window,)) for k in range(6)},
        **R.pair_tracks("c", "_leg1", "_leg2", w),
        **R.pair_tracks("f", "_leg1", "_leg2_lag", w),
        **R.pair_tracks("g", "_leg2", "_leg1_lag", w),
    }
    out = R.window_sums(b, out, series)
    shares = [R.mean(f"p{k}", p.entropy_window, p.entropy_minimum) for k in range(6)]
    out = out.withColumns({f"_p{k}": share for k, share in enumerate(shares)})
    entropy = reduce(
        lambda a, c: a + c,
        [F.when(F.col(f"_p{k}") > 0, -F.col(f"_p{k}") * F.log(f"_p{k}")).otherwise(0.0) for k in range(6)],
    )
    up, down = F.col("upside_semivol") * F.col("upside_semivol"), F.col("downside_semivol") * F.col("downside_semivol")
    base_var = F.nullif(R.var("d", w, least), F.lit(0.0))
    realized, bipower = R.total("d", w, least, power=2), math.pi / 2.0 * R.total("bv", w, least)
    out = out.withColumns(
        {
            "variance_ratio_5": S.ratio(R.var("vr", w, least), p.variance_ratio_lag * base_var),
            "variance_ratio_13": S.ratio(R.var("hu", w, least), p.hurst_lag * base_var),
            "hurst_exponent_proxy": S.clip(
                0.5 * S.log_positive(S.ratio(R.var("hu", w, least), base_var)) / math.log(p.hurst_lag), 0.0, 1.0
            ),
            "zero_crossing_rate": R.mean("zc", cross, three),
            "half_life_stability": F.exp(-R.std("hl", cross, three) / math.log(2.0)),
            "cusum_change_score": R.total("nc", p.cusum_window, p.cusum_window) / math.sqrt(p.cusum_window),
            "permutation_entropy_3": entropy / math.log(6.0),
            "leg_return_correlation": F.when(two_legs, R.correlation("c", w, least)),
            "lead_lag_score": F.when(two_legs, R.correlation("f", w, least) - R.correlation("g", w, least)),
            "relationship_health_scope": F.when(two_legs, "TWO_LEG").otherwise("MULTI_LEG_DIAGNOSTIC_UNAVAILABLE"),
            "jump_share": S.ratio(S.clip(realized - bipower, 0.0), F.nullif(realized, F.lit(0.0))),
            "semivariance_asymmetry": S.ratio(up - down, F.nullif(up + down, F.lit(0.0))),
        }
    )
    # A sum of five terms: null as soon as one is missing.
    stability = (
        S.clip(1.0 - F.col("variance_ratio_5"), 0.0, 1.0)
        + S.clip((0.5 - F.col("hurst_exponent_proxy")) * 2.0, 0.0, 1.0)
        + S.clip(F.col("zero_crossing_rate") * 10.0, 0.0, 1.0)
        + S.clip(F.col("half_life_stability"), 0.0, 1.0)
        + S.clip(1.0 - F.col("permutation_entropy_3"), 0.0, 1.0)
    ) / 5.0
    alarm = (F.abs("cusum_change_score") >= 3.0) | (F.col("jump_share") >= 0.45)
    return restore(
        out.withColumn("mean_reversion_stability", stability)
        .withColumn("change_point_alarm", alarm)
        .withColumn(
            "regime",
            F.when(F.col("change_point_alarm"), "BREAK_RISK")
            .when(F.col("mean_reversion_stability") >= 0.55, "MEAN_REVERTING")
            .when(F.col("efficiency_ratio") >= 0.45, "TRENDING")
            .otherwise("MIXED"),
        )
        .drop(
            "_delta_vr", "_delta_hurst", "_lag1", "_lag2", "_leg1", "_leg2", "_crossed", "_pattern", "_leg1_lag",
            "_leg2_lag", *[f"_p{k}" for k in range(6)], *R.tracked_columns(series),
        )
    )


def risk_features(b: Blocked, df: DataFrame, p: Windows, limits: RiskLimits = RiskLimits()) -> DataFrame:
    """Tail, trend, shape and path diagnostics plus the advanced risk regime."""
    df, restore = b.focus(
        df, "research_close", "price_change", "tod_normalized_change", "liquidity_stress_ratio", "robust_volume_surprise",
    )
    x, change = F.col("research_close"), F.col("price_change")
    one, three, five, ten, twenty = (
        p.one_session, p.three_sessions, p.five_sessions, p.ten_sessions, p.twenty_sessions,
    )
    lags = range(1, p.hac_lags + 1)
    out = df.withColumns(
        {
            **{f"_lag{k}": F.lag(change, k).over(b.order) for k in lags},
            "_range": S.high(x, b.trailing(five), five) - S.low(x, b.trailing(five), five),
        }
    )
    tail = (F.abs("tod_normalized_change") >= limits.tail_event_z).cast("double")
    series = {
        "d": R.Track(change, tuple({one, three, five, twenty, *[three - k for k in lags]}), 4),
        "ad": R.Track(F.abs(change), (five - 1,)),
        "te": R.Track(tail, (twenty,)),
        **{f"l{k}": R.Track(F.col(f"_lag{k}"), (three - k,)) for k in lags},
        **{f"q{k}": R.Track(change * F.col(f"_lag{k}"), (three - k,)) for k in lags},
    }
    out = R.window_sums(b, out, series)
    out = out.withColumns(
        {
            "_vol1": R.std("d", one, 8),
            "_vol20": R.std("d", twenty, ten),
            "_rms": F.sqrt(S.clip(R.mean("d", one, 8, power=2), 0.0)),
            "_hac_mean": R.mean("d", three, three),
            "_hac_second": R.mean("d", three, three, power=2),
            "_path": R.total("ad", five - 1, five - 1),
            "return_skew_5d": R.skew("d", five, three),
            "return_excess_kurtosis_5d": R.kurtosis("d", five, three),
            "tail_event_rate_20d": R.mean("te", twenty, ten),
        }
    )
    m = F.col("_hac_mean")
    gammas = [
        (
            R.total(f"q{k}", three - k, three - k)
            - m * (R.total("d", three - k, three - k) + R.total(f"l{k}", three - k, three - k))
            + (three - k) * m * m
        )
        / three
        for k in lags
    ]
    weighted = reduce(lambda a, c: a + c, [(1.0 - k / (p.hac_lags + 1.0)) * g for k, g in zip(lags, gammas, strict=True)])
    rms = {"rm": R.Track(F.col("_rms"), (five,), 2)}
    out = R.window_sums(
        b, out.withColumn("_long_run", S.clip(F.col("_hac_second") - m * m, 0.0) + 2.0 * weighted), rms
    )
    t_stat = F.when(F.col("_long_run") > EPSILON, math.sqrt(three) * m / F.sqrt("_long_run")).when(F.abs(m) <= EPSILON, 0.0)
    path, span = F.col("_path"), F.col("_range")
    rms_mean, rms_std = R.mean("rm", five, three), R.std("rm", five, three)
    out = out.withColumns(
        {
            "vol_regime_ratio_1d_20d": _or_zero(
                F.col("_vol20"), S.ratio(F.col("_vol1"), F.nullif(F.col("_vol20"), F.lit(0.0))), F.col("_vol1"), 1.0
            ),
            "realized_vol_of_vol_5d": _or_zero(rms_mean, S.ratio(rms_std, F.nullif(rms_mean, F.lit(0.0))), rms_std, 0.0),
            "trend_hac_t_stat_3d": S.clip(t_stat, -12.0, 12.0),
            "close_path_choppiness_5d": F.when(
                (path > EPSILON) & (span > EPSILON),
                S.clip(100.0 * F.log(S.ratio(path, F.nullif(span, F.lit(0.0)))) / math.log(five - 1), 0.0, 100.0),
            ).when(F.abs(path) <= EPSILON, 0.0),
        }
    )
    return restore(with_risk_regime(out, limits).drop(
        "_vol1", "_vol20", "_rms", "_hac_mean", "_hac_second", "_path", "_range", "_long_run",
        *[f"_lag{k}" for k in lags], *R.tracked_columns(series), *R.tracked_columns(rms),
    ))


def with_risk_regime(df: DataFrame, limits: RiskLimits = RiskLimits()) -> DataFrame:
    """Ordered risk label: missing inputs, several flags at once, then single flags."""
    inputs = (
        "tod_normalized_change", "tail_event_rate_20d", "vol_regime_ratio_1d_20d", "liquidity_stress_ratio",
        "robust_volume_surprise",
    )
    shock = F.abs("tod_normalized_change") >= limits.extreme_tod_shock_z
    cluster = F.col("tail_event_rate_20d") >= limits.tail_cluster_rate
    expansion = F.col("vol_regime_ratio_1d_20d") >= limits.vol_expansion_ratio
    stress = F.col("liquidity_stress_ratio") >= limits.impact_stress_ratio
    dry = F.col("robust_volume_surprise") <= limits.volume_dryness_z
    flags = reduce(lambda a, c: a + c, [f.cast("int") for f in (shock, cluster, expansion, stress, dry)])
    missing = reduce(lambda a, c: a | c, [F.col(c).isNull() for c in inputs])
    return df.withColumn(
        "advanced_risk_regime",
        F.when(missing, "WARMUP")
        .when(flags >= 2, "COMPOUND_STRESS")
        .when(shock, "EXTREME_TOD_SHOCK")
        .when(cluster, "TAIL_CLUSTER")
        .when(stress, "IMPACT_STRESS")
        .when(dry, "VOLUME_DRYNESS")
        .when(expansion, "VOL_EXPANSION")
        .otherwise("NORMAL"),
    )


def calendar_features(df: DataFrame, local: str = "bar_start_local") -> DataFrame:
    day = F.col("session_date")
    return df.withColumns(
        {
            "asof_year": F.year(day),
            "day_of_year": F.dayofyear(day),
            "calendar_month": F.month(day),
            "weekday": weekday(day),
            "eia_window": (weekday(day) == 3) & (F.hour(local) == 10) & (F.minute(local) == 30),
        }
    )


def open_blocks(
    df: DataFrame, p: Windows, entity: str = "spread_id", ts: str = "timestamp_utc",
    bucket: Column | None = None, block: int = 4096, base: DataFrame | None = None, ordered: bool = True,
) -> Blocked:
    """Blocks fit for every window and smoother of this module.

    With ``ordered`` the rolling medians are joined in; they are computed from the
    narrow ``base`` and meet the rows on (entity, block, row).
    """
    halo = needed_halo(p)
    alphas = smoothing_alphas(p)
    size = block_for(alphas, halo, block)
    check_block(alphas, halo, size)
    by = F.date_trunc("month", F.col("session_date")) if bucket is None else bucket
    # Equal times are ordered by the close here and in the order statistics, so that both number alike.
    b = blocked(df, entity, [ts, "research_close"], by, halo, size, base)
    if not ordered:
        return b
    stats = order_statistics(df if base is None else base, p, halo, size, entity, ts, by)
    return replace(b, frame=b.frame.join(stats, [entity, BLOCK, ROW]))


def add_indicators(
    bars: DataFrame, p: Windows, entity: str = "spread_id", ts: str = "timestamp_utc", block: int = 4096
) -> DataFrame:
    """All indicators; unused ones are pruned from the plan by column.

    ``bars`` should be a stored table: its keys are scanned for the block numbering
    beside the one pass over its rows.
    """
    slotted = same_slot_features(with_point_columns(bars), p, entity, ts, base=bars)
    sessions = session_features(slotted, entity, ts, base=bars)
    b = open_blocks(sessions, p, entity, ts, block=block, base=bars)
    out = location_features(price_features(b, b.frame, p))
    out = volume_features(b, out, p)
    out = structure_features(b, out, p)
    out = risk_features(b, out, p)
    return calendar_features(b.finish(out))
