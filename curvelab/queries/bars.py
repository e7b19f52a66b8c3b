"""Bars, rolling windows and indicators over hourly event bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelab.edge import settle, settle_sql
from curvelab.operators import indicators as I
from curvelab.operators import ingest
from curvelab.queries.ctes import HBARS, HOURS
from curvelab.registry import query
from curvelab.scale import latest_by
from curvelab.sources import views

P = I.Windows(24)
_E = "PARTITION BY spread_id ORDER BY t"


def _w(n: int) -> str:
    return f"({_E} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _prior(n: int) -> str:
    return f"({_E} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def roll(f: str, x: str, n: int, m: int, w: str | None = None) -> str:
    """Rolling aggregate with a minimum count."""
    w = w or _w(n)
    call = f.replace("$", x)
    return f"CASE WHEN count({x}) OVER {w} >= {m} THEN {call} OVER {w} END"


MEDIAN = "quantile_cont($, 0.5)"
KEYS = "spread_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS timestamp_utc"


def _priced(spark: SparkSession, sf_dir: str, ordered: bool = False) -> tuple:
    rows = views.hour_packages(spark, sf_dir)
    b = I.open_blocks(I.with_point_columns(rows), P, base=rows, ordered=ordered)
    out = I.price_features(b, b.frame, P)
    return b, I.location_features(out) if ordered else out


def _pick(b, df: DataFrame, *columns: str) -> DataFrame:
    return settle(b.finish(df).select("spread_id", "timestamp_utc", *columns))


@query(
    "bars_tumbling",
    settle_sql(
        f"WITH {HOURS} SELECT spread_id AS event_type, strftime(t, '%Y-%m-%d %H:%M:%S') AS bar_start, open, high, low,"
        " close, volume::BIGINT AS volume FROM hours",
        "event_type, bar_start, volume", "open, high, low, close",
    ),
)
def bars_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars from ticks."""
    events = views.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return settle(ingest.tumbling_bars(events, "event_type", "ts", "value", "1 hour"))


_Z_BODY = f"""z1 AS (SELECT *, {roll(MEDIAN, 'x', 120, 72)} AS rolling_median FROM hp),
z2 AS (SELECT *, abs(x - rolling_median) AS dev FROM z1),
z3 AS (SELECT *, {roll(MEDIAN, 'dev', 120, 72)} AS rolling_mad FROM z2),
z4 AS (SELECT *, (x - rolling_median) / nullif(1.4826 * rolling_mad, 0) AS robust_z FROM z3)
"""
_Z = f"\nWITH {HBARS},\n{_Z_BODY}"


@query(
    "robust_z",
    settle_sql(f"{_Z} SELECT {KEYS}, rolling_median, rolling_mad, robust_z FROM z4", "spread_id, timestamp_utc",
               "rolling_median, rolling_mad, robust_z"),
)
def robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from the rolling median in robust deviations."""
    b, df = _priced(spark, sf_dir, ordered=True)
    return _pick(b, df, "rolling_median", "rolling_mad", "robust_z")


_BOLL_BODY = f"""b1 AS (SELECT *, {roll('avg($)', 'x', 72, 72)} AS mid, {roll('stddev_samp($)', 'x', 72, 72)} AS sd FROM hp),
b2 AS (SELECT *, mid + 2 * sd AS up, mid - 2 * sd AS lo FROM b1),
b3 AS (SELECT *, (x - lo) / nullif(4 * sd, 0) AS pct_b, (up - lo) / nullif(abs(mid), 0) AS width FROM b2)
"""
_BOLL = f"\nWITH {HBARS},\n{_BOLL_BODY}"


@query(
    "bollinger",
    settle_sql(
        f"{_BOLL} SELECT {KEYS}, mid AS bollinger_mid, sd AS bollinger_std, up AS bollinger_upper, lo AS bollinger_lower,"
        " pct_b AS bollinger_pct_b, width AS bollinger_width FROM b3",
        "spread_id, timestamp_utc",
        "bollinger_mid, bollinger_std, bollinger_upper, bollinger_lower, bollinger_pct_b, bollinger_width",
    ),
)
def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands around the rolling mean."""
    b, df = _priced(spark, sf_dir)
    return _pick(b, df, "bollinger_mid", "bollinger_std", "bollinger_upper", "bollinger_lower", "bollinger_pct_b", "bollinger_width")


@query(
    "donchian",
    settle_sql(
        f"WITH {HBARS} SELECT {KEYS}, {roll('max($)', 'x', 72, 72, _prior(72))} AS donchian_high,"
        f" {roll('min($)', 'x', 72, 72, _prior(72))} AS donchian_low FROM hp",
        "spread_id, timestamp_utc", "donchian_high, donchian_low",
    ),
)
def donchian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel of earlier extremes (I4)."""
    b, df = _priced(spark, sf_dir)
    return _pick(b, df, "donchian_high", "donchian_low")


@query(
    "squeeze",
    settle_sql(
        f"{_BOLL}, q AS (SELECT *, {roll('quantile_cont($, 0.2)', 'width', 240, 120, _prior(240))} AS p20,"
        f" {roll('stddev_samp($)', 'width', 120, 72)} AS vov FROM b3)"
        f" SELECT {KEYS}, p20 AS bollinger_width_p20, vov AS volatility_of_volatility,"
        " CAST(width < p20 AS BIGINT) AS volatility_squeeze FROM q",
        "spread_id, timestamp_utc, volatility_squeeze", "bollinger_width_p20, volatility_of_volatility",
    ),
)
def squeeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band width against its own low quantile."""
    b, df = _priced(spark, sf_dir, ordered=True)
    return _pick(b, df, "bollinger_width_p20", "volatility_of_volatility", "volatility_squeeze")


def scan(expr: str, x: str, source: str, name: str, order: str = "t", entity: str = "spread_id") -> str:
    """Running fold per entity: ``expr`` uses acc (previous value) and v (new input)."""
    return f"""{name}_l AS (
  SELECT {entity}, list({order} ORDER BY {order}) AS ts,
         list_reduce(list_transform(list({x} ORDER BY {order}), lambda v: [v]),
                     lambda a, b: list_append(a, {expr.replace('acc', 'a[-1]').replace('new', 'b[1]')})) AS ys
  FROM {source} WHERE {x} IS NOT NULL GROUP BY {entity}),
{name}_r AS (SELECT {entity}, unnest(ts) AS {order}, unnest(ys) AS {name}, generate_subscripts(ys, 1) AS {name}_i FROM {name}_l)"""


def ewm_sql(span: int) -> str:
    a = 2.0 / (span + 1)
    return f"{1 - a!r} * acc + {a!r} * new"


_MACD_BODY = f"""{scan(ewm_sql(24), 'x', 'hp', 'fast')},
{scan(ewm_sql(72), 'x', 'hp', 'slow')},
m AS (SELECT spread_id, t, CASE WHEN fast_i >= 24 THEN fast END AS ema_fast, CASE WHEN slow_i >= 72 THEN slow END AS ema_slow,
             CASE WHEN slow_i >= 72 THEN fast - slow END AS macd_line FROM fast_r JOIN slow_r USING (spread_id, t)),
{scan(ewm_sql(24), 'macd_line', 'm', 'sig')},
macd AS (SELECT m.*, CASE WHEN sig_i >= 24 THEN sig END AS macd_signal, CASE WHEN sig_i >= 24 THEN macd_line - sig END AS macd_histogram
         FROM m LEFT JOIN sig_r USING (spread_id, t))
"""
_MACD = f"\nWITH {HBARS},\n{_MACD_BODY}"


@query(
    "ema_macd",
    settle_sql(f"{_MACD} SELECT {KEYS}, ema_fast, ema_slow, macd_line, macd_signal, macd_histogram FROM macd",
               "spread_id, timestamp_utc", "ema_fast, ema_slow, macd_line, macd_signal, macd_histogram"),
)
def ema_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential means and MACD."""
    b, df = _priced(spark, sf_dir)
    return _pick(b, df, "ema_fast", "ema_slow", "macd_line", "macd_signal", "macd_histogram")


_WILDER = f"{1 - 1 / 24!r} * acc + {1 / 24!r} * new"
_RSI_BODY = f"""g AS (SELECT spread_id, t, CASE WHEN x - lag(x) OVER ({_E}) > 0 THEN x - lag(x) OVER ({_E}) ELSE 0 END AS gain,
             CASE WHEN x - lag(x) OVER ({_E}) < 0 THEN lag(x) OVER ({_E}) - x ELSE 0 END AS loss FROM hp),
{scan(_WILDER, 'gain', 'g', 'ag')},
{scan(_WILDER, 'loss', 'g', 'al')},
rsi AS (SELECT spread_id, t, CASE WHEN ag_i >= 24 THEN CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END END AS rsi
        FROM ag_r JOIN al_r USING (spread_id, t))
"""
_RSI = f"\nWITH {HBARS},\n{_RSI_BODY}"


@query(
    "rsi_wilder",
    settle_sql(f"{_RSI} SELECT {KEYS}, rsi FROM rsi", "spread_id, timestamp_utc", "rsi"),
)
def rsi_wilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilder's RSI."""
    b, df = _priced(spark, sf_dir)
    return _pick(b, df, "rsi")


_VOL = f"""
v AS (SELECT *, {roll('stddev_samp($)', 'd', 120, 72)} AS vol5,
  sqrt(avg(CASE WHEN d > 0 THEN d * d ELSE 0 END) OVER {_w(120)}) AS up0,
  sqrt(avg(CASE WHEN d < 0 THEN d * d ELSE 0 END) OVER {_w(120)}) AS down0,
  abs(x - lag(x, 24) OVER ({_E})) / nullif({roll('sum(abs($))', 'd', 24, 24)}, 0) AS er FROM hp),
vv AS (SELECT *, CASE WHEN rn >= 72 THEN up0 END AS up, CASE WHEN rn >= 72 THEN down0 END AS down, d / nullif(vol5, 0) AS nc FROM v)
"""


@query(
    "volatility",
    settle_sql(
        f"WITH {HBARS}, {_VOL} SELECT {KEYS}, vol5 AS realized_vol_5d, up AS upside_semivol, down AS downside_semivol,"
        " er AS efficiency_ratio, nc AS normalized_change FROM vv",
        "spread_id, timestamp_utc", "realized_vol_5d, upside_semivol, downside_semivol, efficiency_ratio, normalized_change",
    ),
)
def volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realised volatility, its halves, and efficiency."""
    b, df = _priced(spark, sf_dir)
    return _pick(b, df, "realized_vol_5d", "upside_semivol", "downside_semivol", "efficiency_ratio", "normalized_change")


@query(
    "jump_score",
    settle_sql(
        f"WITH {HBARS}, ad AS (SELECT spread_id, t, abs(d) AS ad FROM hp), {scan(ewm_sql(72), 'ad', 'ad', 'ew')}"
        f" SELECT {KEYS.replace('spread_id', 'hp.spread_id').replace('(t,', '(hp.t,')}, CASE WHEN ew_i >= 24 THEN ew END AS ewma_abs_change,"
        " CASE WHEN ew_i >= 24 THEN abs(d) / nullif(ew, 0) END AS jump_score FROM hp LEFT JOIN ew_r USING (spread_id, t)",
        "spread_id, timestamp_utc", "ewma_abs_change, jump_score",
    ),
)
def jump_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential mean change and jumps against it."""
    b, df = _priced(spark, sf_dir)
    return _pick(b, df, "ewma_abs_change", "jump_score")


_AR = f"""
a0 AS (SELECT *, lag(x) OVER ({_E}) AS lx FROM hp),
a1 AS (SELECT *, {roll('avg($)', 'x', 240, 120)} AS xm, {roll('avg($)', 'lx', 240, 120)} AS lm,
  {roll('avg($)', 'x * lx', 240, 120)} AS cm, {roll('avg($)', 'lx * lx', 240, 120)} AS sm FROM a0),
a2 AS (SELECT *, (cm - xm * lm) / nullif(sm - lm * lm, 0) AS beta FROM a1),
ar AS (SELECT *, CASE WHEN beta > 0 AND beta < 0.9999 THEN -ln(2) / ln(beta) END AS hl FROM a2)
"""


@query(
    "ar1_half_life",
    settle_sql(f"WITH {HBARS}, {_AR} SELECT {KEYS}, beta AS ar1_beta, hl AS ou_half_life_bars FROM ar",
               "spread_id, timestamp_utc", "ar1_beta, ou_half_life_bars"),
)
def ar1_half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-life of mean reversion."""
    b, df = _priced(spark, sf_dir)
    return _pick(b, df, "ar1_beta", "ou_half_life_bars")


_SLOT = "(PARTITION BY spread_id, slot ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_SAME_SLOT = f"""
s0 AS (SELECT *, abs(d) / (bbl + 1) * 1000000 AS impact, ln(1 + greatest(cap, 0)) AS lc FROM hp),
s1 AS (SELECT *, {roll(MEDIAN, 'cap', 20, 8, _SLOT)} AS expect, {roll(MEDIAN, 'abs(d)', 20, 8, _SLOT)} AS tc,
  {roll(MEDIAN, 'lc', 20, 8, _SLOT)} AS tv, {roll(MEDIAN, 'impact', 20, 8, _SLOT)} AS ti FROM s0),
s2 AS (SELECT *, abs(lc - tv) AS ve FROM s1),
s3 AS (SELECT *, {roll(MEDIAN, 've', 20, 8, _SLOT)} AS te FROM s2),
ss AS (SELECT *, cap / nullif(expect, 0) AS relvol,
  CASE WHEN 1.4826 * tc > 1e-12 THEN d / (1.4826 * tc) WHEN abs(d) <= 1e-12 THEN 0 END AS tod,
  CASE WHEN ti > 1e-12 THEN impact / ti WHEN abs(impact) <= 1e-12 THEN 1 END AS stress,
  CASE WHEN 1.4826 * te > 1e-12 THEN (lc - tv) / (1.4826 * te) WHEN abs(lc - tv) <= 1e-12 THEN 0 END AS surprise FROM s3)
"""


@query(
    "same_slot_baselines",
    settle_sql(
        f"WITH {HBARS}, {_SAME_SLOT} SELECT {KEYS}, expect AS expected_tod_package_volume, relvol AS relative_volume,"
        " tod AS tod_normalized_change, stress AS liquidity_stress_ratio, surprise AS robust_volume_surprise FROM ss",
        "spread_id, timestamp_utc",
        "expected_tod_package_volume, relative_volume, tod_normalized_change, liquidity_stress_ratio, robust_volume_surprise",
    ),
)
def same_slot_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines of the same bar of the day."""
    df = I.same_slot_features(I.with_point_columns(views.hour_packages(spark, sf_dir)), P)
    return settle(df.select(
        "spread_id", "timestamp_utc", "expected_tod_package_volume", "relative_volume", "tod_normalized_change",
        "liquidity_stress_ratio", "robust_volume_surprise",
    ))


_SIGNED = "coalesce(sign(d) * bbl, 0)"


@query(
    "session_vwap_obv",
    settle_sql(
        f"WITH {HBARS} SELECT {KEYS},"
        " sum(vw * cap) OVER (PARTITION BY spread_id, session_date ORDER BY t) / nullif(sum(cap) OVER (PARTITION BY spread_id, session_date ORDER BY t), 0) AS session_vwap_proxy,"
        f" sum({_SIGNED}) OVER ({_E}) AS obv_proxy FROM hp",
        "spread_id, timestamp_utc", "session_vwap_proxy, obv_proxy", dp=10,
    ),
)
def session_vwap_obv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session VWAP and signed volume."""
    df = I.session_features(I.with_point_columns(views.hour_packages(spark, sf_dir)))
    return settle(df.select("spread_id", "timestamp_utc", "session_vwap_proxy", "obv_proxy"), dp=10)


def _slotted(spark: SparkSession, sf_dir: str, ordered: bool = False) -> tuple:
    rows = views.hour_packages(spark, sf_dir)
    df = I.same_slot_features(I.with_point_columns(rows), P, base=rows)
    b = I.open_blocks(df, P, base=rows, ordered=ordered)
    out = I.price_features(b, b.frame, P)
    out = I.location_features(out) if ordered else out.withColumn("robust_z", F.lit(None).cast("double"))
    return b, I.volume_features(b, out, P)


@query(
    "flow",
    settle_sql(
        f"WITH {HBARS}, {_VOL}, {_SAME_SLOT}, {scan(ewm_sql(24), 'cap', 'hp', 'vf')}, {scan(ewm_sql(72), 'cap', 'hp', 'vs')}"
        " SELECT ss.spread_id, strftime(ss.t, '%Y-%m-%d %H:%M:%S') AS timestamp_utc,"
        " CASE WHEN vs_i >= 72 THEN (vf - vs) / nullif(vs, 0) END AS pvo,"
        f" ss.bbl / nullif(ss.cap, 0) AS average_trade_size_bbl_proxy, ss.impact AS amihud_impact_proxy,"
        " (sum(coalesce(sign(ss.d) * ss.bbl, 0)) OVER w) / nullif(sum(ss.bbl) OVER w, 0) * CASE WHEN count(*) OVER w >= 24 THEN 1 END AS signed_volume_imbalance_proxy,"
        " relvol / (abs(nc) + 0.25) AS effort_vs_result,"
        " ss.oi / nullif(lag(ss.oi, 24) OVER (PARTITION BY ss.spread_id ORDER BY ss.t), 0) - 1 AS oi_migration_1d"
        " FROM ss JOIN vv USING (spread_id, t) JOIN vf_r USING (spread_id, t) JOIN vs_r USING (spread_id, t)"
        " WINDOW w AS (PARTITION BY ss.spread_id ORDER BY ss.t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)",
        "spread_id, timestamp_utc",
        "pvo, average_trade_size_bbl_proxy, amihud_impact_proxy, signed_volume_imbalance_proxy, effort_vs_result, oi_migration_1d",
    ),
)
def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume momentum, trade size, impact and imbalance."""
    b, df = _slotted(spark, sf_dir)
    return _pick(b, df, "pvo", "average_trade_size_bbl_proxy", "amihud_impact_proxy", "signed_volume_imbalance_proxy",
                 "effort_vs_result", "oi_migration_1d")


_STRUCT = f"""
st0 AS (SELECT *, x - lag(x, {P.variance_ratio_lag}) OVER ({_E}) AS dv, x - lag(x, 24) OVER ({_E}) AS dh,
  lag(d, 1) OVER ({_E}) AS d1, lag(d, 2) OVER ({_E}) AS d2,
  leg1 - lag(leg1) OVER ({_E}) AS g1, leg2 - lag(leg2) OVER ({_E}) AS g2 FROM vv),
st1 AS (SELECT *, lag(g1) OVER ({_E}) AS g1l, lag(g2) OVER ({_E}) AS g2l,
  CASE WHEN d2 <= d1 AND d1 <= d THEN 0 WHEN d2 <= d AND d < d1 THEN 1 WHEN d1 < d2 AND d2 <= d THEN 2
       WHEN d1 <= d AND d < d2 THEN 3 WHEN d < d2 AND d2 <= d1 THEN 4 ELSE 5 END AS pat,
  {roll('var_samp($)', 'd', 480, 240)} AS vd, {roll('var_samp($)', 'dv', 480, 240)} AS vdv, {roll('var_samp($)', 'dh', 480, 240)} AS vdh,
  {roll('sum($)', 'd * d', 480, 240)} AS rv, pi() / 2 * {roll('sum($)', 'abs(d) * abs(d1)', 480, 240)} AS bv,
  {roll('sum($)', 'nc', 24, 24)} / sqrt(24) AS cusum FROM st0),
st2 AS (SELECT *, vdv / nullif({P.variance_ratio_lag} * vd, 0) AS vr5, vdh / nullif(24 * vd, 0) AS vr13,
  CASE WHEN vdh / nullif(vd, 0) > 0 THEN least(greatest(0.5 * ln(vdh / nullif(vd, 0)) / ln(24), 0), 1) END AS hurst,
  CASE WHEN rv - bv IS NOT NULL THEN greatest(rv - bv, 0) END / nullif(rv, 0) AS jump,
  (up * up - down * down) / nullif(up * up + down * down, 0) AS asym,
  {', '.join(f"avg((pat = {k})::INT::DOUBLE) OVER {_w(120)} AS p{k}" for k in range(6))},
  count(*) OVER {_w(120)} AS pn FROM st1),
st3 AS (SELECT *, CASE WHEN pn >= 60 THEN ({' + '.join(f"CASE WHEN p{k} > 0 THEN -p{k} * ln(p{k}) ELSE 0 END" for k in range(6))}) / ln(6) ELSE 0 END AS pe FROM st2)
"""


@query(
    "variance_structure",
    settle_sql(
        f"WITH {HBARS}, {_VOL}, {_STRUCT} SELECT {KEYS}, vr5 AS variance_ratio_5, vr13 AS variance_ratio_13, hurst AS hurst_exponent_proxy,"
        " pe AS permutation_entropy_3, jump AS jump_share, cusum AS cusum_change_score, asym AS semivariance_asymmetry FROM st3",
        "spread_id, timestamp_utc",
        "variance_ratio_5, variance_ratio_13, hurst_exponent_proxy, permutation_entropy_3, jump_share, cusum_change_score, semivariance_asymmetry",
    ),
)
def variance_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance ratio, Hurst exponent, entropy and change points."""
    b, df = _slotted(spark, sf_dir)
    return _pick(b, I.structure_features(b, df, P), "variance_ratio_5", "variance_ratio_13", "hurst_exponent_proxy",
                 "permutation_entropy_3", "jump_share", "cusum_change_score", "semivariance_asymmetry")


def _corr(a: str, b: str) -> str:
    both = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END"
    return f"CASE WHEN count({both}) OVER {_w(480)} >= 240 THEN corr({a}, {b}) OVER {_w(480)} END"


@query(
    "leg_relationship",
    settle_sql(
        f"WITH {HBARS}, {_VOL}, {_STRUCT} SELECT {KEYS}, {_corr('g1', 'g2')} AS leg_return_correlation,"
        f" {_corr('g1', 'g2l')} - {_corr('g2', 'g1l')} AS lead_lag_score, 'TWO_LEG' AS relationship_health_scope FROM st3",
        "spread_id, timestamp_utc, relationship_health_scope", "leg_return_correlation, lead_lag_score",
    ),
)
def leg_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation and beta of the legs."""
    b, df = _slotted(spark, sf_dir)
    return _pick(b, I.structure_features(b, df, P), "leg_return_correlation", "lead_lag_score", "relationship_health_scope")


_REGIME_BODY = f"""{_Z_BODY}, {_VOL}, {_AR}, {_STRUCT},
zc AS (SELECT spread_id, t, robust_z, CASE WHEN robust_z * lag(robust_z) OVER ({_E}) < 0 THEN 1.0
   WHEN robust_z * lag(robust_z) OVER ({_E}) >= 0 THEN 0.0 END AS crossed FROM z4),
zr AS (SELECT spread_id, t, {roll('avg($)', 'crossed', 120, 72)} AS zcr FROM zc),
hs AS (SELECT spread_id, t, exp(-({roll('stddev_samp($)', 'ln(hl)', 120, 72)}) / ln(2)) AS hls FROM ar),
rg0 AS (SELECT st3.spread_id, st3.t, vr5, hurst, zcr, hls, pe, cusum, jump, er FROM st3 JOIN zr USING (spread_id, t) JOIN hs USING (spread_id, t)),
rg1 AS (SELECT *, (CASE WHEN vr5 IS NOT NULL THEN least(greatest(1 - vr5, 0), 1) END
   + CASE WHEN hurst IS NOT NULL THEN least(greatest((0.5 - hurst) * 2, 0), 1) END
   + CASE WHEN zcr IS NOT NULL THEN least(zcr * 10, 1) END + CASE WHEN hls IS NOT NULL THEN least(greatest(hls, 0), 1) END
   + CASE WHEN pe IS NOT NULL THEN least(greatest(1 - pe, 0), 1) END) / 5 AS mrs,
   (abs(cusum) >= 3 OR jump >= 0.45) AS alarm FROM rg0),
rg AS (SELECT *, CASE WHEN alarm THEN 'BREAK_RISK' WHEN mrs >= 0.55 THEN 'MEAN_REVERTING' WHEN er >= 0.45 THEN 'TRENDING' ELSE 'MIXED' END AS regime FROM rg1)
"""
_REGIME = f"\nWITH {HBARS},\n{_REGIME_BODY}"


@query(
    "regime",
    settle_sql(
        f"{_REGIME} SELECT {KEYS}, zcr AS zero_crossing_rate, hls AS half_life_stability, mrs AS mean_reversion_stability,"
        " CAST(alarm AS BIGINT) AS change_point_alarm, regime FROM rg",
        "spread_id, timestamp_utc, change_point_alarm, regime",
        "zero_crossing_rate, half_life_stability, mean_reversion_stability",
    ),
)
def regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regime from trend, reversion and breaks."""
    b, df = _slotted(spark, sf_dir, ordered=True)
    return _pick(b, I.structure_features(b, df, P), "zero_crossing_rate", "half_life_stability", "mean_reversion_stability",
                 "change_point_alarm", "regime")


_SEC = P.three_sessions


def _hac_gamma(k: int) -> str:
    n = _SEC - k
    return (
        f"({roll('sum($)', f'd * l{k}', n, n)} - hm * ({roll('sum($)', 'd', n, n)} + {roll('sum($)', f'l{k}', n, n)}) + {n} * hm * hm) / {_SEC}"
    )


_RISK = f"""
r0 AS (SELECT *, {', '.join(f"lag(d, {k}) OVER ({_E}) AS l{k}" for k in range(1, P.hac_lags + 1))},
  {roll('stddev_samp($)', 'd', 24, 8)} AS v1, {roll('stddev_samp($)', 'd', 480, 240)} AS v20,
  sqrt({roll('avg($)', 'd * d', 24, 8)}) AS rms, {roll('avg($)', 'd', 72, 72)} AS hm, {roll('avg($)', 'd * d', 72, 72)} AS h2,
  {roll('sum($)', 'abs(d)', 119, 119)} AS path, {roll('max($)', 'x', 120, 120)} - {roll('min($)', 'x', 120, 120)} AS span,
  {roll('skewness($)', 'd', 120, 72)} AS skew, {roll('kurtosis($)', 'd', 120, 72)} AS kurt,
  {roll('avg($)', '(abs(tod) >= 2.5)::INT', 480, 240)} AS tail FROM ss),
r1 AS (SELECT *, {roll('avg($)', 'rms', 120, 72)} AS rmsm, {roll('stddev_samp($)', 'rms', 120, 72)} AS rmss,
  CASE WHEN hm IS NOT NULL THEN greatest(h2 - hm * hm, 0) END + 2 * ({' + '.join(f"{1 - k / (P.hac_lags + 1)!r} * {_hac_gamma(k)}" for k in range(1, P.hac_lags + 1))}) AS lr FROM r0),
r2 AS (SELECT *,
  CASE WHEN v20 > 1e-12 THEN v1 / v20 WHEN abs(v1) <= 1e-12 THEN 1 END AS volreg,
  CASE WHEN rmsm > 1e-12 THEN rmss / rmsm WHEN abs(rmss) <= 1e-12 THEN 0 END AS vov,
  CASE WHEN lr > 1e-12 THEN least(greatest(sqrt(72) * hm / sqrt(CASE WHEN lr > 0 THEN lr END), -12), 12) WHEN abs(hm) <= 1e-12 THEN 0 END AS hac,
  CASE WHEN path > 1e-12 AND span > 1e-12 THEN least(greatest(100 * ln(path / span) / ln(119), 0), 100) WHEN abs(path) <= 1e-12 THEN 0 END AS chop FROM r1),
r3 AS (SELECT *, CASE WHEN tod IS NULL OR tail IS NULL OR volreg IS NULL OR stress IS NULL OR surprise IS NULL THEN 'WARMUP'
  WHEN (abs(tod) >= 4)::INT + (tail >= 0.1)::INT + (volreg >= 1.5)::INT + (stress >= 2.5)::INT + (surprise <= -2.5)::INT >= 2 THEN 'COMPOUND_STRESS'
  WHEN abs(tod) >= 4 THEN 'EXTREME_TOD_SHOCK' WHEN tail >= 0.1 THEN 'TAIL_CLUSTER' WHEN stress >= 2.5 THEN 'IMPACT_STRESS'
  WHEN surprise <= -2.5 THEN 'VOLUME_DRYNESS' WHEN volreg >= 1.5 THEN 'VOL_EXPANSION' ELSE 'NORMAL' END AS label FROM r2)
"""


@query(
    "risk_regime",
    settle_sql(
        f"WITH {HBARS}, {_SAME_SLOT}, {_RISK} SELECT {KEYS}, skew AS return_skew_5d, kurt AS return_excess_kurtosis_5d, volreg AS vol_regime_ratio_1d_20d,"
        " vov AS realized_vol_of_vol_5d, hac AS trend_hac_t_stat_3d, chop AS close_path_choppiness_5d, tail AS tail_event_rate_20d,"
        " label AS advanced_risk_regime FROM r3",
        "spread_id, timestamp_utc, advanced_risk_regime",
        "return_skew_5d, return_excess_kurtosis_5d, vol_regime_ratio_1d_20d, realized_vol_of_vol_5d, trend_hac_t_stat_3d,"
        " close_path_choppiness_5d, tail_event_rate_20d",
    ),
)
def risk_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tails, clusters, expansion and the risk regime."""
    rows = views.hour_packages(spark, sf_dir)
    df = I.same_slot_features(I.with_point_columns(rows), P, base=rows)
    b = I.open_blocks(df, P, base=rows, ordered=False)
    return _pick(b, I.risk_features(b, b.frame, P), "return_skew_5d", "return_excess_kurtosis_5d", "vol_regime_ratio_1d_20d",
                 "realized_vol_of_vol_5d", "trend_hac_t_stat_3d", "close_path_choppiness_5d", "tail_event_rate_20d",
                 "advanced_risk_regime")


@query(
    "latest_location",
    settle_sql(
        f"{_Z}, dc AS (SELECT *, {roll('max($)', 'x', 72, 72, _prior(72))} AS donchian_high, {roll('min($)', 'x', 72, 72, _prior(72))} AS donchian_low FROM z4)"
        " SELECT spread_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS timestamp_utc, x AS research_close, robust_z, donchian_high, donchian_low FROM dc"
        " QUALIFY row_number() OVER (PARTITION BY spread_id ORDER BY t DESC) = 1",
        "spread_id, timestamp_utc", "research_close, robust_z, donchian_high, donchian_low",
    ),
)
def latest_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest row per series with its place against median and channel."""
    b, df = _priced(spark, sf_dir, ordered=True)
    rows = b.finish(df).select("spread_id", "timestamp_utc", "research_close", "robust_z", "donchian_high", "donchian_low")
    return settle(latest_by(rows, "spread_id", "timestamp_utc"))


@query(
    "calendar_fields",
    settle_sql(
        f"WITH {HBARS} SELECT {KEYS}, year(t) AS asof_year, dayofyear(t) AS day_of_year, month(t) AS calendar_month, isodow(t) AS weekday,"
        " CAST(isodow(t) = 3 AND hour(t) = 10 AND minute(t) = 30 AS BIGINT) AS eia_window FROM hp",
        "spread_id, timestamp_utc, asof_year, day_of_year, calendar_month, weekday, eia_window",
    ),
)
def calendar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the calendar."""
    df = I.calendar_features(views.hour_packages(spark, sf_dir))
    return settle(df.select("spread_id", "timestamp_utc", "asof_year", "day_of_year", "calendar_month", "weekday", "eia_window"))
