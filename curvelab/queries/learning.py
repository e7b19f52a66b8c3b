"""Seasonal priors, expert votes, labels, ensemble weights, folds and ledgers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvelab.config import STRATEGIES
from curvelab.edge import settle, settle_sql
from curvelab.operators import experts as X
from curvelab.operators import indicators as I
from curvelab.operators import ledger as L
from curvelab.operators import seasonal
from curvelab.operators import walkforward as W
from curvelab.operators.scorecard import Evidence
from curvelab.plans.settings import Settings
from curvelab.queries import bars as B
from curvelab.queries import ctes
from curvelab.registry import query
from curvelab.scale import blocked
from curvelab.sources import views
from curvelab.stages import stage

# Settings scaled to thirty hourly sessions.
HOURLY = Settings(
    windows=B.P,
    gate=L.EntryGate(maximum_volume_participation=1.0, maximum_bid_ask_ticks=30.0),
    folds=W.Folds(train_sessions=10, validation_sessions=3, test_sessions=2, lockbox_sessions=5, embargo_sessions=1),
    learner=X.Learner(adaptive_horizon_bars=24, adaptive_min_observations=5, adaptive_entry_threshold=0.2),
    evidence=Evidence(minimum_oos_trades=2, minimum_profit_factor=1.0, minimum_profitable_fold_share=0.5, minimum_probability_sharpe=0.05),
)


# The daily history that each hourly series has in earlier years, and its scale.
_HISTORY = {"click": "Brand#1", "error": "Brand#10", "purchase": "Brand#11", "signup": "Brand#12", "view": "Brand#13"}
_HISTORY_SCALE = 0.1


def hour_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seasonal prior of the hourly series' sessions from daily closes of earlier years."""

    def build() -> DataFrame:
        pairs = F.create_map(*[F.lit(x) for series, brand in _HISTORY.items() for x in (brand, series)])
        bars = stage(spark, "history-bars", sf_dir, lambda: views.brand_days(spark, sf_dir, *_HISTORY.values()))
        history = _seasonal_moves(bars).withColumns(
            {"spread_id": F.element_at(pairs, F.col("spread_id")), "spread_close": F.col("spread_close") * _HISTORY_SCALE, "price_change": F.col("price_change") * _HISTORY_SCALE}
        )
        own = views.hour_packages(spark, sf_dir).groupBy("spread_id", "session_date").agg(F.max_by("spread_close", "timestamp_utc").alias("spread_close"))
        sessions = _placed(own.withColumn("price_change", F.lit(None).cast("double")))
        rows = history.unionByName(sessions)
        return seasonal.seasonality(rows).join(sessions.select(F.year("session_date").alias("asof_year")).distinct(), "asof_year", "left_semi")

    return stage(spark, "hour-prior", sf_dir, build)


def hour_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(
        spark, "hour-features", sf_dir,
        lambda: seasonal.attach_seasonality(I.add_indicators(views.hour_packages(spark, sf_dir), B.P), hour_prior(spark, sf_dir)),
    )


def hour_voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        features = hour_features(spark, sf_dir)
        return X.add_adaptive_ensemble(X.with_expert_votes(features), HOURLY.learner, HOURLY.folds, base=features)

    return stage(spark, "hour-voted", sf_dir, build)


def _seasonal_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily brand series with its change and a distance to the quarter end."""
    return _seasonal_moves(views.day_bars(spark, sf_dir))


def _seasonal_moves(bars: DataFrame) -> DataFrame:
    b = blocked(bars, "entity", "session_date", F.trunc("session_date", "year"), halo=1)
    moved = b.finish(b.frame.withColumn("price_change", F.col("close") - F.lag("close").over(b.order)))
    return _placed(moved.select(F.col("entity").alias("spread_id"), "session_date", F.col("close").alias("spread_close"), "price_change"))


def _placed(daily: DataFrame) -> DataFrame:
    """Days to the quarter's end, and Sundays marked as settled later."""
    return daily.select(
        "spread_id", "session_date", "spread_close", "price_change",
        F.datediff(F.last_day(F.add_months(F.trunc("session_date", "quarter"), 2)), "session_date").alias("sessions_to_risk_date"),
        F.when(F.dayofweek("session_date") == 1, "DEFERRED").otherwise("EXCHANGE_SETTLE").alias("settlement_quality"),
    )


_SEASON = f"""
WITH {ctes.DBARS},
s AS (SELECT entity, session_date AS sd, close, close - lag(close) OVER (PARTITION BY entity ORDER BY session_date) AS mv,
        year(session_date) AS y, dayofyear(session_date) AS doy,
        date_diff('day', session_date, CAST(date_trunc('quarter', session_date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)) AS dte,
        CASE WHEN dayofweek(session_date) = 0 THEN 'DEFERRED' ELSE 'EXCHANGE_SETTLE' END AS q FROM dbars),
py AS (SELECT a.entity, a.y, count(DISTINCT b.y) AS py FROM (SELECT DISTINCT entity, y FROM s) a JOIN (SELECT DISTINCT entity, y FROM s) b ON a.entity = b.entity AND b.y < a.y GROUP BY 1, 2),
near AS (SELECT t.entity, t.y, t.doy, quantile_cont(h.close, [0.25, 0.5, 0.75]) AS lq, count(h.close) AS ln,
    quantile_cont(h.mv, [0.25, 0.5, 0.75]) AS mq, count(h.mv) AS mn
  FROM s t JOIN s h ON h.entity = t.entity AND h.y < t.y AND least(abs(h.doy - t.doy), 366 - abs(h.doy - t.doy)) <= 14 GROUP BY ALL),
ex AS (SELECT t.entity, t.y, t.doy, median(h.mv) AS em, count(h.mv) AS en FROM s t JOIN s h ON h.entity = t.entity AND h.y < t.y AND abs(h.dte - t.dte) <= 5 GROUP BY ALL),
r AS (SELECT s.entity AS spread_id, s.y AS asof_year, s.doy AS day_of_year, lq, coalesce(ln, 0) AS seasonal_n, py AS seasonal_prior_years, mq, coalesce(mn, 0) AS mn, em,
   coalesce(en, 0) AS expiry_seasonal_n, least(py / 8.0, 1) * coalesce(mn / (mn + 16.0), 0) AS sup, q
  FROM s JOIN py ON py.entity = s.entity AND py.y = s.y LEFT JOIN near ON near.entity = s.entity AND near.y = s.y AND near.doy = s.doy
  LEFT JOIN ex ON ex.entity = s.entity AND ex.y = s.y AND ex.doy = s.doy WHERE coalesce(ln, 0) >= 8 OR coalesce(mn, 0) >= 8)
SELECT spread_id, asof_year, day_of_year, lq[2] AS seasonal_median, lq[1] AS seasonal_q25, lq[3] AS seasonal_q75, seasonal_n, seasonal_prior_years,
  sup * mq[2] AS seasonal_move_1d, mq[1] AS seasonal_move_q25, mq[3] AS seasonal_move_q75, sup * em AS expiry_seasonal_move_1d, expiry_seasonal_n,
  sup AS seasonal_support, CASE WHEN seasonal_prior_years >= 2 THEN 'PRODUCTION_PRIOR' ELSE 'PRELIMINARY_PRIOR' END AS seasonal_status, q AS daily_settlement_quality FROM r
"""


@query(
    "seasonal_prior_years",
    settle_sql(
        _SEASON,
        "spread_id, asof_year, day_of_year, seasonal_n, seasonal_prior_years, expiry_seasonal_n, seasonal_status, daily_settlement_quality",
        "seasonal_median, seasonal_q25, seasonal_q75, seasonal_move_1d, seasonal_move_q25, seasonal_move_q75, expiry_seasonal_move_1d, seasonal_support",
    ),
)
def seasonal_prior_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circular-window quantiles of earlier years per brand and day."""
    return settle(seasonal.seasonality(_seasonal_input(spark, sf_dir)))


_SHORT = {
    "ROBUST_MEAN_REVERSION": ("z <= -1.8 AND rsi <= 42 AND coalesce(er, 0) < 0.55 AND coalesce(mrs, 0.2) >= 0.2",
                              "z >= 1.8 AND rsi >= 58 AND coalesce(er, 0) < 0.55 AND coalesce(mrs, 0.2) >= 0.2"),
    "TREND_BREAKOUT": ("x > dhi AND hist > 0 AND er >= 0.35 AND relvol >= 1", "x < dlo AND hist < 0 AND er >= 0.35 AND relvol >= 1"),
    "VOLATILITY_SQUEEZE": ("width <= 1.25 * p20 AND relvol >= 1.05 AND coalesce(pvo, 0) > -0.1 AND x > dhi",
                           "width <= 1.25 * p20 AND relvol >= 1.05 AND coalesce(pvo, 0) > -0.1 AND x < dlo"),
    "SESSION_VWAP_REVERSION": ("slot < 23 AND (x - svwap) / nullif(ew, 0) <= -1.5", "slot < 23 AND (x - svwap) / nullif(ew, 0) >= 1.5"),
    "ERROR_CORRECTION_RESIDUAL": ("CASE WHEN produced THEN smz >= 0.2 ELSE coalesce(sn, 0) >= 8 AND sz <= -1.6 AND z <= -0.5 END",
                                  "CASE WHEN produced THEN smz <= -0.2 ELSE coalesce(sn, 0) >= 8 AND sz >= 1.6 AND z >= 0.5 END"),
    "STABILITY_REVERSION": ("mrs >= 0.45 AND coalesce(vr5, 0.999) < 1 AND z <= -1.5", "mrs >= 0.45 AND coalesce(vr5, 0.999) < 1 AND z >= 1.5"),
    "FLOW_DIVERGENCE": ("coalesce(effort, 0.5) >= 0.5 AND z <= -1.2 AND flow >= 0.15", "coalesce(effort, 0.5) >= 0.5 AND z >= 1.2 AND flow <= -0.15"),
}
_V = [f"expert_vote_{e.lower()}" for e in _SHORT]

_PLACES = "year($) AS y, dayofyear($) AS doy, date_diff('day', $, CAST(date_trunc('quarter', $) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)) AS dte"
_PRIOR = f"""sp_h AS (SELECT m.s AS spread_id, close * {_HISTORY_SCALE} AS close, {_HISTORY_SCALE} * (close - lag(close) OVER (PARTITION BY entity ORDER BY session_date)) AS mv, {_PLACES.replace('$', 'session_date')}
  FROM dbars JOIN (VALUES {', '.join(f"('{b}', '{s}')" for s, b in _HISTORY.items())}) m(b, s) ON m.b = entity),
sp_t AS (SELECT spread_id, session_date AS sd, {_PLACES.replace('$', 'session_date')} FROM (SELECT DISTINCT spread_id, session_date FROM hp)),
sp_n AS (SELECT t.spread_id, t.sd, quantile_cont(h.close, [0.25, 0.5, 0.75]) AS lq, count(h.close) AS ln, median(h.mv) AS mm, count(h.mv) AS mn FROM sp_t t JOIN sp_h h ON h.spread_id = t.spread_id AND h.y < t.y AND least(abs(h.doy - t.doy), 366 - abs(h.doy - t.doy)) <= 14 GROUP BY ALL),
sp_e AS (SELECT t.spread_id, t.sd, median(h.mv) AS em FROM sp_t t JOIN sp_h h ON h.spread_id = t.spread_id AND h.y < t.y AND abs(h.dte - t.dte) <= 5 GROUP BY ALL),
sp_y AS (SELECT spread_id, count(DISTINCT y) AS py FROM sp_h GROUP BY 1),
sp AS (SELECT spread_id AS sid, sd, lq, ln, py, least(py / 8.0, 1) * (mn / (mn + 16.0)) AS sup, least(py / 8.0, 1) * (mn / (mn + 16.0)) * mm AS m1, least(py / 8.0, 1) * (mn / (mn + 16.0)) * em AS e1,
  CASE WHEN dayofweek(sd) = 0 THEN 0.65 ELSE 1 END AS quality FROM sp_n JOIN sp_y USING (spread_id) LEFT JOIN sp_e USING (spread_id, sd) WHERE ln >= 8 OR mn >= 8)"""

_VOTED = f"""
WITH {ctes.HBARS}, {ctes.DBARS}, {_PRIOR},
{B._REGIME_BODY}, {B._BOLL_BODY}, {B._MACD_BODY}, {B._RSI_BODY}, {B._SAME_SLOT},
{B.scan(B.ewm_sql(24), 'cap', 'hp', 'vf')}, {B.scan(B.ewm_sql(72), 'cap', 'hp', 'vs')},
ad AS (SELECT spread_id, t, abs(d) AS ad FROM hp), {B.scan(B.ewm_sql(72), 'ad', 'ad', 'ew')},
bq AS (SELECT spread_id, t, width, mid, {B.roll('quantile_cont($, 0.2)', 'width', 240, 120, B._prior(240))} AS p20 FROM b3),
dc AS (SELECT spread_id, t, {B.roll('max($)', 'x', 72, 72, B._prior(72))} AS dhi, {B.roll('min($)', 'x', 72, 72, B._prior(72))} AS dlo,
  sum(vw * cap) OVER (PARTITION BY spread_id, session_date ORDER BY t) / nullif(sum(cap) OVER (PARTITION BY spread_id, session_date ORDER BY t), 0) AS svwap,
  CASE WHEN count(*) OVER {B._w(24)} >= 24 THEN sum(coalesce(sign(d) * bbl, 0)) OVER {B._w(24)} / nullif(sum(bbl) OVER {B._w(24)}, 0) END AS flow FROM hp),
f AS (SELECT hp.spread_id, hp.t, hp.session_date, hp.slot, hp.x, hp.cap, z4.robust_z AS z, rsi.rsi, rg.er, rg.mrs, rg.vr5, rg.alarm, dhi, dlo, svwap, flow,
  macd_histogram AS hist, ema_slow, mid, ss.relvol, ss.tod, ss.surprise, width, p20, CASE WHEN vs_i >= 72 THEN (vf - vs) / nullif(vs, 0) END AS pvo, CASE WHEN ew_i >= 24 THEN ew END AS ew,
  ss.relvol / (abs(vv.nc) + 0.25) AS effort, sp.ln AS sn, coalesce(0.7 * m1 + 0.3 * e1, m1, e1) AS smove, (hp.x - lq[2]) / (CASE WHEN lq[3] > lq[1] THEN (lq[3] - lq[1]) / 1.349 END) AS sz,
  coalesce(0.7 * m1 + 0.3 * e1, m1, e1) / nullif(vol5, 0) AS smz, (coalesce(0.7 * m1 + 0.3 * e1, m1, e1) / nullif(vol5, 0)) IS NOT NULL AND coalesce(sp.ln, 0) >= 8 AND coalesce(py, 0) >= 2 AND coalesce(sup * quality, 0) > 0 AS produced, sup * quality AS sconf
  FROM hp LEFT JOIN sp ON sid = hp.spread_id AND sd = hp.session_date JOIN z4 USING (spread_id, t) JOIN rg USING (spread_id, t) JOIN vv USING (spread_id, t) JOIN rsi USING (spread_id, t) JOIN macd USING (spread_id, t)
  JOIN ss USING (spread_id, t) JOIN bq USING (spread_id, t) JOIN dc USING (spread_id, t) JOIN vf_r USING (spread_id, t) JOIN vs_r USING (spread_id, t) LEFT JOIN ew_r USING (spread_id, t)),
vt AS (SELECT *, {', '.join(f"CASE WHEN NOT coalesce(alarm, false) AND ({u}) THEN 1 WHEN NOT coalesce(alarm, false) AND ({d}) THEN -1 ELSE 0 END AS {n}" for n, (u, d) in zip(_V, _SHORT.values(), strict=True))} FROM f),
vc AS (SELECT *, {' + '.join(f'({n} > 0)::INT' for n in _V)} AS longs, {' + '.join(f'({n} < 0)::INT' for n in _V)} AS shorts FROM vt)
"""


@query(
    "expert_votes",
    f"{_VOTED} SELECT spread_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS timestamp_utc, {', '.join(_V)},"
    " CASE WHEN longs >= 2 AND shorts = 0 THEN 1 WHEN shorts >= 2 AND longs = 0 THEN -1 ELSE 0 END AS expert_vote_regime_ensemble FROM vc",
)
def expert_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven rule votes and the two-agree ensemble (K5)."""
    voted = X.with_expert_votes(hour_features(spark, sf_dir))
    return settle(voted.select("spread_id", "timestamp_utc", *X.VOTES, "expert_vote_regime_ensemble"))


_LOSS = f"""{_VOTED},
pv AS (SELECT event_type AS spread_id, date_trunc('hour', ts) AS t, arg_min(value, ts) * 100 AS ov, arg_max(value, ts) * 100 AS cv FROM events GROUP BY ALL),
lb AS (SELECT vc.*, lead(ov, 1) OVER w AS ev, lead(cv, 24) OVER w AS rv, lead(session_date, 24) OVER w AS rs,
   DATE '2024-02-15' AS forced, slot <> 5 AS allowed, greatest(1, 2 * (slot + 1.0)) AS rt
  FROM vc JOIN pv USING (spread_id, t) WINDOW w AS (PARTITION BY spread_id ORDER BY t)),
tg AS (SELECT *, 'HOURLY|' || CASE WHEN spread_id < 'f' THEN 'FRONT' ELSE 'MID' END AS learner_group, sign(rv - ev) * least(1, greatest(0, abs(rv - ev) - 2 * rt) / greatest(4 * rt, 1)) AS target FROM lb
  WHERE allowed AND rs <= forced AND ev IS NOT NULL AND rv IS NOT NULL)
"""


@query(
    "delayed_label_loss",
    settle_sql(
        f"{_LOSS} SELECT learner_group, strftime(rs, '%Y-%m-%d') AS session_date, "
        + ", ".join(f"avg(CASE WHEN {n} <> 0 THEN ({n} - target) * ({n} - target) / 4 END) AS loss_{n[12:]}" for n in _V)
        + f" FROM tg WHERE {' OR '.join(f'{n} <> 0' for n in _V)} GROUP BY ALL",
        "learner_group, session_date", ", ".join(f"loss_{n[12:]}" for n in _V),
    ),
)
def delayed_label_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost-aware labels resolved a day later, averaged per group and session (K2, A3)."""
    voted = X.with_learner_group(X.with_expert_votes(hour_features(spark, sf_dir)))
    return settle(X.resolved_losses(voted, HOURLY.learner, base=hour_features(spark, sf_dir)))


# The learner as a recursion over each group's sessions, weights as a list.
_GROUP = "'HOURLY|' || CASE WHEN spread_id < 'f' THEN 'FRONT' ELSE 'MID' END"
_LEARNED = f"""{_LOSS.replace("WITH", "WITH RECURSIVE", 1)},
ls AS (SELECT learner_group AS g, rs AS d, [{', '.join(f"coalesce(avg(CASE WHEN {n} <> 0 THEN ({n} - target) * ({n} - target) / 4 END), 0)" for n in _V)}] AS loss
  FROM tg WHERE {' OR '.join(f'{n} <> 0' for n in _V)} GROUP BY ALL),
pr AS (SELECT DISTINCT {_GROUP} AS g, session_date AS d FROM f),
nr AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM pr)),
o AS (SELECT pr.g, pr.d, loss, i >= n - 5 AS frozen, loss IS NOT NULL AND i + 1 < n - 5 AS counts, row_number() OVER (PARTITION BY pr.g ORDER BY pr.d) AS r
  FROM pr JOIN nr USING (d) LEFT JOIN ls ON ls.g = pr.g AND ls.d = pr.d),
rec AS (SELECT DISTINCT g, 1::BIGINT AS r, list_transform(range(7), lambda i: 1.0::DOUBLE / 7) AS w, 0::BIGINT AS seen FROM o
  UNION ALL SELECT g, r + 1, CASE WHEN counts THEN list_transform(v, lambda x: least(0.35, x * (1 - k * 0.35) / (1 - held))) ELSE w END, seen + counts::INT FROM (
   SELECT *, coalesce(list_sum(s[1:k]), 0) AS held FROM (
    SELECT *, list_min(list_filter(range(0, 8), lambda j: j = 7 OR s[j + 1] * (1 - j * 0.35) <= 0.35 * (1 - coalesce(list_sum(s[1:j]), 0)))) AS k FROM (
     SELECT *, list_reverse_sort(v) AS s FROM (SELECT *, list_transform(l, lambda x: x / list_sum(l)) AS v FROM (
      SELECT *, list_transform(m, lambda x: greatest(x, 0.1::DOUBLE / 7)) AS l FROM (
       SELECT *, list_transform(gr, lambda x: 0.92 * x / list_sum(gr) + 0.08::DOUBLE / 7) AS m FROM (
        SELECT rec.g, rec.r, rec.w, rec.seen, o.counts, list_transform(range(1, 8), lambda i: rec.w[i] * exp(-0.2 * coalesce(o.loss[i], 0))) AS gr
        FROM rec JOIN o ON o.g = rec.g AND o.r = rec.r JOIN o nx ON nx.g = rec.g AND nx.r = rec.r + 1)))))))),
wt AS (SELECT o.g, o.d, rec.w, rec.seen, o.frozen FROM rec JOIN o USING (g, r))
"""
_SCORE = " + ".join(f"w[{i}] * {n}" for i, n in enumerate(_V, start=1))
_ABOVE = " + ".join(f"CASE WHEN {n} > 0 THEN w[{i}] ELSE 0 END" for i, n in enumerate(_V, start=1))
_BELOW = " + ".join(f"CASE WHEN {n} < 0 THEN w[{i}] ELSE 0 END" for i, n in enumerate(_V, start=1))


@query(
    "fixed_share_weights",
    settle_sql(
        f"""{_LEARNED} SELECT g AS learner_group, strftime(d, '%Y-%m-%d') AS session_date, seen AS adaptive_observations,
          [{', '.join(f"'{e}'" for e in _SHORT)}][list_position(w, list_max(w))] AS adaptive_top_expert, list_max(w) AS adaptive_top_weight,
          CASE WHEN frozen THEN 'LOCKBOX_FROZEN' WHEN seen >= 5 THEN 'ACTIVE' ELSE 'WARMUP' END AS adaptive_status,
          {', '.join(f"w[{i}] AS adaptive_weight_{n[12:]}" for i, n in enumerate(_V, start=1))} FROM wt""",
        "learner_group, session_date, adaptive_observations, adaptive_top_expert, adaptive_status",
        "adaptive_top_weight, " + ", ".join(f"adaptive_weight_{n[12:]}" for n in _V),
    ),
)
def fixed_share_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expert weights per group and session (K3)."""
    voted = hour_voted(spark, sf_dir)
    return settle(voted.select("learner_group", "session_date", "adaptive_observations", "adaptive_top_expert",
                               "adaptive_top_weight", "adaptive_status", *X.WEIGHTS).distinct())


@query(
    "adaptive_votes",
    settle_sql(
        f"""{_LEARNED}, sc AS (SELECT vc.*, seen, {_SCORE} AS score, {_ABOVE} AS pos, {_BELOW} AS neg FROM vc JOIN wt ON wt.g = {_GROUP} AND wt.d = session_date),
          rd AS (SELECT *, seen >= 5 AND NOT coalesce(alarm, false) AS ready, greatest(0, least(0.95, 0.5 + 0.45 * least(1, abs(score)) * least(1, seen / 120.0))) AS trust FROM sc)
          SELECT spread_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS timestamp_utc, score AS adaptive_score, pos AS adaptive_positive_weight, neg AS adaptive_negative_weight,
            CASE WHEN ready AND score >= 0.2 AND longs >= 2 AND neg <= 0.15 THEN 1 WHEN ready AND score <= -0.2 AND shorts >= 2 AND pos <= 0.15 THEN -1 ELSE 0 END AS adaptive_vote,
            CASE WHEN seen < 120 THEN least(trust, 0.55) ELSE trust END AS adaptive_confidence FROM rd""",
        "spread_id, timestamp_utc, adaptive_vote", "adaptive_score, adaptive_positive_weight, adaptive_negative_weight, adaptive_confidence",
    ),
)
def adaptive_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble score, vote and confidence per bar (K4)."""
    return settle(hour_voted(spark, sf_dir).select(
        "spread_id", "timestamp_utc", "adaptive_score", "adaptive_vote", "adaptive_confidence",
        "adaptive_positive_weight", "adaptive_negative_weight",
    ))


_HOUR_SCORE = f"""SELECT vc.*, {_GROUP} AS g, w, seen, frozen, {_SCORE} AS score, {_ABOVE} AS pos, {_BELOW} AS neg,
  greatest(0, least(0.95, 0.5 + 0.45 * least(1, abs({_SCORE})) * least(1, seen / 120.0))) AS trust"""
_HOUR_VOTED = f"""{_LEARNED}, hv0 AS ({_HOUR_SCORE} FROM vc JOIN wt ON wt.g = {_GROUP} AND wt.d = session_date),
hv AS (SELECT *, CASE WHEN longs >= 2 AND shorts = 0 THEN 1 WHEN shorts >= 2 AND longs = 0 THEN -1 ELSE 0 END AS regime_vote,
  CASE WHEN seen < 5 OR coalesce(alarm, false) THEN 0 WHEN score >= 0.2 AND longs >= 2 AND neg <= 0.15 THEN 1 WHEN score <= -0.2 AND shorts >= 2 AND pos <= 0.15 THEN -1 ELSE 0 END AS adaptive_vote,
  CASE WHEN seen < 120 THEN least(trust, 0.55) ELSE trust END AS confidence FROM hv0)"""


@query(
    "frozen_model_scoring",
    settle_sql(
        f"""{_LEARNED}, dv AS (SELECT spread_id, t, d FROM f JOIN (SELECT DISTINCT d, i, n FROM nr) nr ON d = session_date WHERE i < n - 5),
        fz AS (SELECT {_GROUP} AS g, max(d) AS d FROM dv GROUP BY 1),
        fw AS (SELECT wt.g, w, seen, false AS frozen FROM wt JOIN fz USING (g, d)),
        sc AS ({_HOUR_SCORE} FROM vc JOIN fw ON fw.g = {_GROUP})
        SELECT spread_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS timestamp_utc, score AS adaptive_score, 'FROZEN_MODEL_SCORE' AS adaptive_status,
          CASE WHEN seen < 5 OR coalesce(alarm, false) THEN 0 WHEN score >= 0.2 AND longs >= 2 AND neg <= 0.15 THEN 1 WHEN score <= -0.2 AND shorts >= 2 AND pos <= 0.15 THEN -1 ELSE 0 END AS adaptive_vote,
          CASE WHEN seen < 120 THEN least(trust, 0.55) ELSE trust END AS adaptive_confidence FROM sc""",
        "spread_id, timestamp_utc, adaptive_vote, adaptive_status", "adaptive_score, adaptive_confidence",
    ),
)
def frozen_model_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights frozen at the end of development, applied without learning."""
    voted = hour_voted(spark, sf_dir)
    frozen = X.freeze_weights(voted, HOURLY.folds)
    scored = X.apply_frozen_weights(X.with_expert_votes(hour_features(spark, sf_dir)), frozen, HOURLY.learner)
    return settle(scored.select("spread_id", "timestamp_utc", "adaptive_score", "adaptive_vote", "adaptive_confidence", "adaptive_status"))


@query(
    "weight_history",
    settle_sql(
        f"""{_HOUR_VOTED} SELECT strftime(session_date, '%Y-%m-%d') AS session_date, spread_id, g AS learner_group, score AS adaptive_score, adaptive_vote, confidence AS adaptive_confidence,
          seen AS adaptive_observations, [{', '.join(f"'{e}'" for e in _SHORT)}][list_position(w, list_max(w))] AS adaptive_top_expert, list_max(w) AS adaptive_top_weight,
          pos AS adaptive_positive_weight, neg AS adaptive_negative_weight, CASE WHEN frozen THEN 'LOCKBOX_FROZEN' WHEN seen >= 5 THEN 'ACTIVE' ELSE 'WARMUP' END AS adaptive_status,
          {', '.join(f"w[{i}] AS adaptive_weight_{n[12:]}" for i, n in enumerate(_V, start=1))}
          FROM hv QUALIFY row_number() OVER (PARTITION BY spread_id, session_date ORDER BY t DESC) = 1""",
        "session_date, spread_id, learner_group, adaptive_vote, adaptive_observations, adaptive_top_expert, adaptive_status",
        "adaptive_score, adaptive_confidence, adaptive_top_weight, adaptive_positive_weight, adaptive_negative_weight, "
        + ", ".join(f"adaptive_weight_{n[12:]}" for n in _V),
    ),
)
def weight_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last weights per structure and session."""
    return settle(X.weight_history(hour_voted(spark, sf_dir)))


_SESS = "s AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem), n AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM s)"
_FOLDS = f"""WITH {_SESS}, k AS (SELECT unnest(range(1, ((n - 30 - 210) // 20 + 1)::BIGINT)) AS fold, n FROM (SELECT max(n) AS n FROM n)),
  e AS (SELECT fold, 210 + (fold - 1) * 20 AS e, n FROM k)"""


def _day(i: str) -> str:
    return f"(SELECT strftime(d, '%Y-%m-%d') FROM n WHERE n.i = {i})"


@query(
    "walk_forward_windows",
    f"""{_FOLDS} SELECT fold, {_day('0')} AS train_start, {_day('e - 31')} AS train_end, {_day('e - 30')} AS validation_start, {_day('e - 1')} AS validation_end,
      {_day('e')} AS embargo_start, {_day('e + 4')} AS embargo_end, {_day('e + 5')} AS test_start, {_day('e + 19')} AS test_end,
      e - 30 AS train_sessions_in_fold, {_day('e.n - 31')} AS development_end, {_day('e.n - 30')} AS lockbox_start, {_day('e.n - 1')} AS lockbox_end, e.n AS available_sessions FROM e""",
)
def walk_forward_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanding folds and the final lockbox over all shipping days (K8)."""
    days = views.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session_date"))
    return settle(W.walk_forward(days))


@query(
    "phase_tag",
    f"""{_FOLDS}, {ctes.TRADES},
      f AS (SELECT fold, (SELECT d FROM n WHERE n.i = e + 5) AS a, (SELECT d FROM n WHERE n.i = e + 19) AS b FROM e),
      lb AS (SELECT (SELECT d FROM n WHERE n.i = n.n - 30) AS a, (SELECT max(d) FROM n) AS b),
      p AS (SELECT trades.*, CASE WHEN entry_session BETWEEN lb.a AND lb.b THEN 'LOCKBOX' WHEN fi.fold IS NOT NULL THEN 'OOS' ELSE 'DEVELOPMENT' END AS pi, fi.fold AS foi,
          CASE WHEN exit_session BETWEEN lb.a AND lb.b THEN 'LOCKBOX' WHEN fo.fold IS NOT NULL THEN 'OOS' ELSE 'DEVELOPMENT' END AS po, fo.fold AS foo
        FROM trades CROSS JOIN lb LEFT JOIN f fi ON entry_session BETWEEN fi.a AND fi.b LEFT JOIN f fo ON exit_session BETWEEN fo.a AND fo.b),
      q AS (SELECT *, CASE WHEN pi IN ('OOS', 'LOCKBOX') AND (pi <> po OR (pi = 'OOS' AND foi <> foo)) THEN 'PURGED' ELSE pi END AS phase FROM p)
      SELECT spread_id, strategy_id, phase, CASE WHEN phase = 'OOS' THEN foi END AS fold, count(*) AS trades FROM q GROUP BY ALL""",
)
def phase_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Development, fold, lockbox or purged per trade."""
    days = views.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session_date"))
    tagged = W.tag_trades(views.trades(spark, sf_dir), W.phase_days(days))
    return settle(tagged.groupBy("spread_id", "strategy_id", "phase", "fold").agg(F.count(F.lit(1)).alias("trades")))


@query(
    "liquidity_gate",
    f"WITH {ctes.HBARS}, {B._SAME_SLOT} SELECT spread_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS timestamp_utc, CASE WHEN relvol IS NULL OR relvol < 0.35 THEN 'LOW_RELATIVE_VOLUME'"
    " WHEN cap IS NULL OR cap < 1 THEN 'INSUFFICIENT_EXECUTABLE_CAPACITY' WHEN cap * 0.5 < 1 THEN 'CAPACITY_BELOW_ONE_PACKAGE' WHEN cap > 2 AND cap - 2 > 3 THEN 'WIDE_MARKET' ELSE 'PASS' END AS liquidity_gate FROM ss",
)
def liquidity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First failing liquidity test per bar."""
    limits = L.EntryGate(maximum_volume_participation=0.5, maximum_bid_ask_ticks=3.0)
    df = I.same_slot_features(I.with_point_columns(views.hour_packages(spark, sf_dir)), B.P)
    return settle(df.select("spread_id", "timestamp_utc", L.liquidity_reason(limits).alias("liquidity_gate")))


def _rolling(voted: DataFrame) -> DataFrame:
    """Three series change contracts every three days; two of these must be flat early on the second, and take no entry from then on."""
    rolls, forced = F.col("spread_id") < "q", F.col("spread_id").between("d", "q")
    period = F.floor((F.dayofmonth("session_date") - 1) / 3)
    first = F.min("timestamp_utc").over(Window.partitionBy("spread_id", "roll_id"))
    rolled = voted.withColumns(
        {
            "roll_id": F.when(rolls, F.concat(F.lit("R"), period.cast("string"))).otherwise(F.col("roll_id")),
            "forced_exit_session": F.when(forced, F.date_add(F.trunc("session_date", "month"), (period * 3 + 1).cast("int"))).otherwise(F.col("forced_exit_session")),
        }
    )
    return rolled.withColumns(
        {
            "roll_event": rolls & (period > 0) & (first == F.col("timestamp_utc")),
            "entry_allowed": F.col("entry_allowed") & (F.col("session_date") < F.col("forced_exit_session")),
            "session_last_slot": F.when(F.col("session_date") == F.col("forced_exit_session"), 2).otherwise(F.col("session_last_slot")),
        }
    )


def hour_inputs(spark: SparkSession, sf_dir: str, gates: bool = False) -> DataFrame:
    return stage(
        spark, f"hour-ledger-{gates}", sf_dir,
        lambda: L.ledger_inputs(_rolling(hour_voted(spark, sf_dir)), HOURLY.gate, HOURLY.risk if gates else None),
    )


def hour_trades(spark: SparkSession, sf_dir: str, gates: bool = False) -> DataFrame:
    def build() -> DataFrame:
        trades = L.run_ledger(hour_inputs(spark, sf_dir, gates))
        return W.tag_trades(trades, W.phase_days(hour_voted(spark, sf_dir), HOURLY.folds))

    return stage(spark, f"hour-trades-{gates}", sf_dir, build)


# Exit reasons of the strategies in order, for a long (s = 1) or short (s = -1) position.
_EXITS = (
    "CASE WHEN abs(z) <= 0.2 THEN 2 WHEN s * z <= -3.25 THEN 3 ELSE 0 END",
    "CASE WHEN x IS NOT NULL AND ema_slow IS NOT NULL AND hist IS NOT NULL AND (s * (x - ema_slow) < 0 OR s * hist < 0) THEN 4 ELSE 0 END",
    "CASE WHEN s * (x - mid) < 0 THEN 5 ELSE 0 END",
    "CASE WHEN s * (x - svwap) >= 0 THEN 6 WHEN slot >= last_slot THEN 7 ELSE 0 END",
    "CASE WHEN s * smz <= 0 THEN 8 WHEN abs(sz) <= 0.35 THEN 9 WHEN s * z > 0.35 THEN 10 ELSE 0 END",
    "CASE WHEN coalesce(alarm, false) THEN 11 WHEN abs(z) <= 0.25 THEN 2 ELSE 0 END",
    "CASE WHEN coalesce(alarm, false) THEN 11 WHEN abs(z) <= 0.25 THEN 2 WHEN s * flow <= 0 THEN 12 ELSE 0 END",
    "CASE WHEN coalesce(alarm, false) THEN 11 WHEN regime_vote = 0 OR regime_vote = -s THEN 13 ELSE 0 END",
    "CASE WHEN coalesce(alarm, false) THEN 11 WHEN adaptive_vote = 0 OR adaptive_vote = -s THEN 13 ELSE 0 END",
)


def _both_sides(side: int) -> str:
    return ", ".join(e.replace("-s ", f"{-side} ").replace("s * ", f"{side} * ") for e in _EXITS)


def _at_bar(name: str, rows: str, place: str, columns: str, how: str = "") -> str:
    """Columns of the bar whose place in its segment a column names."""
    return f"{name} AS MATERIALIZED (SELECT d.*, {columns} FROM {rows} d {how}JOIN lw b ON b.spread_id = d.spread_id AND b.seg = d.seg AND b.i = d.{place})"


_LEDGER_NAMES = ("lw0", "lw", "walk", "ended", "t1", "t2", "t3", "t4", "tr0", "tr1", "tr", "hn", "hf", "hl")


def second_ledger_sql(gates: bool) -> str:
    """The walk once more, its tables marked by an underscore, to follow ``ledger_sql``."""
    body = ledger_sql(gates).removeprefix(_HOUR_VOTED)
    return re.sub(rf"\b({'|'.join(_LEDGER_NAMES)})\b(?!\()", r"\1_", body)


def ledger_sql(gates: bool = False) -> str:
    """The position walk bar by bar as a recursion, every strategy and roll segment on its own."""
    risk = "abs(tod) >= 4 OR surprise <= -2.5 OR " if gates else ""
    risk_null = f"coalesce({risk[:-4]}, false) OR " if gates else ""
    return f"""{_HOUR_VOTED},
lw0 AS (SELECT hv.*, ov, cv, slot + 1.0 AS cost, CASE WHEN cap > 2 THEN cap - 2 END AS ticks,
  NOT ({risk_null}relvol IS NULL OR relvol < 0.35 OR cap < 1 OR coalesce(cap - 2 > 30 AND cap > 2, false)) AS pass,
  CASE WHEN hv.spread_id < 'q' THEN (day(session_date) - 1) // 3 ELSE 0 END AS week,
  CASE WHEN hv.spread_id BETWEEN 'd' AND 'q' THEN CAST(date_trunc('month', session_date) AS DATE) + ((day(session_date) - 1) // 3 * 3 + 1)::INT ELSE DATE '2024-02-15' END AS forced_day,
  CASE WHEN session_date = forced_day THEN 2 ELSE 23 END AS last_slot, slot = last_slot OR row_number() OVER (PARTITION BY hv.spread_id, session_date ORDER BY t DESC) = 1 AS session_end FROM hv JOIN pv USING (spread_id, t)),
lw AS MATERIALIZED (SELECT spread_id, t, session_date, ov, cv, x, cost, slot <> 5 AND session_date < forced_day AS allowed, pass, relvol, cap, ticks, CASE WHEN spread_id < 'q' THEN 'R' || week ELSE 'CONTINUOUS' END AS roll_id, forced_day,
  dense_rank() OVER (PARTITION BY spread_id ORDER BY week) - 1 AS seg, max(week) OVER (PARTITION BY spread_id) = week AS last_seg,
  [{', '.join(_V)}, regime_vote, adaptive_vote] AS v, [{_both_sides(1)}] AS cl, [{_both_sides(-1)}] AS cs, session_end, session_date = forced_day AND session_end AS forced_bar,
  row_number() OVER (PARTITION BY spread_id, week ORDER BY t) AS i, count(*) OVER (PARTITION BY spread_id, week) AS n FROM lw0),
walk AS (SELECT DISTINCT spread_id, seg, k, 0::BIGINT AS i, 0 AS pos, 0::BIGINT AS e, 0::DOUBLE AS eo, 0 AS held, 0::DOUBLE AS up, 0::DOUBLE AS dn, 0 AS pend, 0::BIGINT AS sig, 0 AS leave, 0::BIGINT AS dec, 0::BIGINT AS esig,
   0 AS xr, 0 AS xpos, 0::BIGINT AS xe, 0::BIGINT AS xsig, 0 AS xheld, 0::DOUBLE AS xup, 0::DOUBLE AS xdn, 0::BIGINT AS xdec FROM lw, range(1, 10) ks(k)
  UNION ALL
  SELECT spread_id, seg, k, i, pos, e, eo, held, greatest(up, g), least(dn, g), CASE WHEN pos = 0 AND vote <> 0 AND allowed AND pass AND i < n THEN vote ELSE 0 END,
   CASE WHEN pos = 0 AND vote <> 0 AND allowed AND pass AND i < n THEN i ELSE 0 END, CASE WHEN pos = 0 THEN 0 WHEN held >= [{', '.join(str(x.maximum_holding_bars) for x in STRATEGIES)}][k] THEN 1 WHEN pos > 0 THEN cl[k] ELSE cs[k] END, i, esig,
   xr, xpos, xe, xsig, xheld, xup, xdn, xdec FROM (
   SELECT *, CASE WHEN pos <> 0 THEN pos * (cv - eo) ELSE 0 END AS g FROM (
    SELECT spread_id, seg, k, i, n, cv, vote, allowed, pass, cl, cs, xr, pos0 AS xpos, e0 AS xe, esig0 AS xsig, held0 AS xheld, up0 AS xup, dn0 AS xdn, dec0 AS xdec,
      CASE WHEN enter THEN pend0 WHEN pos0 = 0 OR xr <> 0 THEN 0 ELSE pos0 END AS pos, CASE WHEN enter THEN i ELSE e0 END AS e, CASE WHEN enter THEN ov ELSE eo0 END AS eo,
      CASE WHEN enter THEN 1 ELSE held0 + 1 END AS held, CASE WHEN enter THEN 0 ELSE up0 END AS up, CASE WHEN enter THEN 0 ELSE dn0 END AS dn, CASE WHEN enter THEN sig0 ELSE esig0 END AS esig FROM (
     SELECT *, (pos0 = 0 OR xr <> 0) AND xr <> 14 AND pend0 <> 0 AND allowed AS enter FROM (
      SELECT b.spread_id, b.seg, r.k, b.i, b.n, b.ov, b.cv, b.v[r.k] AS vote, b.allowed, b.pass, b.cl, b.cs, r.pos AS pos0, r.e AS e0, r.eo AS eo0, r.held AS held0, r.up AS up0, r.dn AS dn0, r.pend AS pend0, r.sig AS sig0,
        r.dec AS dec0, r.esig AS esig0, CASE WHEN r.pos = 0 THEN 0 WHEN b.session_date = b.forced_day AND b.session_end THEN 14 ELSE r.leave END AS xr
      FROM walk r JOIN lw b ON b.spread_id = r.spread_id AND b.seg = r.seg AND b.i = r.i + 1))))),
ended AS MATERIALIZED (SELECT spread_id, seg, k, i AS xi, xr, xpos AS pos, xe AS e, xsig AS sg, xheld AS held, xup AS up, xdn AS dn, CASE WHEN xr <> 14 THEN xdec END AS dec, false AS at_close FROM walk WHERE xr <> 0
  UNION ALL SELECT w.spread_id, w.seg, k, w.i, 0, pos, e, esig, held, up, dn, NULL, true FROM walk w JOIN lw b ON b.spread_id = w.spread_id AND b.seg = w.seg AND b.i = w.i WHERE w.i = b.n AND pos <> 0),
{_at_bar('t1', 'ended', 'e', 'b.t AS et, b.session_date AS esd, b.ov / 100 AS es, b.ov AS evv, b.cost AS ec, b.roll_id, b.forced_day')},
{_at_bar('t2', 't1', 'sg', 'b.t AS st, b.relvol, b.ticks, b.cap')},
{_at_bar('t3', 't2', 'xi', "b.t AS xt, b.session_date AS xsd, b.cost AS xc, CASE WHEN at_close THEN b.cv ELSE b.ov END AS xv, CASE WHEN at_close THEN b.x ELSE b.ov / 100 END AS xs, b.last_seg")},
{_at_bar('t4', 't3', 'dec', 'b.t AS dt', 'LEFT ')},
tr0 AS (SELECT *, {[s.strategy_id for s in STRATEGIES]}[k] AS strategy_id,
   CASE WHEN at_close THEN CASE WHEN last_seg THEN 'END_OF_SAMPLE' ELSE 'ROLL_SAFETY_PREVIOUS_CLOSE' END ELSE {list(L.EXIT_REASONS[1:])}[xr] END AS reason FROM t4),
hn AS MATERIALIZED (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT session_date AS d FROM lw)),
hf AS MATERIALIZED (SELECT fold, (SELECT d FROM hn WHERE i = 13 + (fold - 1) * 3 + 1) AS a, (SELECT d FROM hn WHERE i = 13 + (fold - 1) * 3 + 2) AS b FROM (SELECT unnest(range(1, ((max(n) - 5 - 13) // 3 + 1)::BIGINT)) AS fold FROM hn)),
hl AS (SELECT (SELECT d FROM hn WHERE hn.i = hn.n - 5) AS la, (SELECT max(d) FROM hn) AS lb),
tr1 AS (SELECT tr0.*, pos * (xv - evv) AS gross, ec + xc AS paid, CASE WHEN esd BETWEEN la AND lb THEN 'LOCKBOX' WHEN fi.fold IS NOT NULL THEN 'OOS' ELSE 'DEVELOPMENT' END AS pin, fi.fold AS fin,
   CASE WHEN xsd BETWEEN la AND lb THEN 'LOCKBOX' WHEN fo.fold IS NOT NULL THEN 'OOS' ELSE 'DEVELOPMENT' END AS pout, fo.fold AS fout
  FROM tr0 CROSS JOIN hl LEFT JOIN hf fi ON esd BETWEEN fi.a AND fi.b LEFT JOIN hf fo ON xsd BETWEEN fo.a AND fo.b),
tr AS (SELECT *, gross - paid AS net, CASE WHEN pin IN ('OOS', 'LOCKBOX') AND (pin <> pout OR (pin = 'OOS' AND fin <> fout)) THEN 'PURGED' ELSE pin END AS phase FROM tr1)
"""


LEDGER = settle_sql(
    f"""{ledger_sql()} SELECT spread_id, strategy_id, CASE WHEN pos > 0 THEN 'LONG' ELSE 'SHORT' END AS direction, strftime(et, '%Y-%m-%d %H:%M:%S') AS entry_time, strftime(st, '%Y-%m-%d %H:%M:%S') AS entry_signal_time,
      strftime(xt, '%Y-%m-%d %H:%M:%S') AS exit_time, strftime(dt, '%Y-%m-%d %H:%M:%S') AS exit_signal_time, strftime(esd, '%Y-%m-%d') AS entry_session, strftime(xsd, '%Y-%m-%d') AS exit_session,
      es AS entry_spread, xs AS exit_spread, evv AS entry_package_value_usd, xv AS exit_package_value_usd, gross AS gross_pnl_usd, ec AS entry_cost_usd, paid AS cost_usd, net AS net_pnl_usd,
      gross - 2 * paid AS pnl_2x_cost_usd, gross - 3 * paid AS pnl_3x_cost_usd, held AS holding_bars, dn AS mae_usd, up AS mfe_usd, reason AS exit_reason, strategy_id || '; PASS' AS entry_reason, roll_id,
      strftime(esd + 9, '%Y-%m-%d') AS earliest_risk_date, strftime(forced_day, '%Y-%m-%d') AS forced_exit_session, relvol AS entry_relative_volume, ticks AS entry_max_leg_bid_ask_ticks, cap AS entry_package_capacity,
      phase, CASE WHEN phase = 'OOS' THEN fin END AS fold FROM tr""",
    "spread_id, strategy_id, direction, entry_time, entry_signal_time, exit_time, exit_signal_time, entry_session, exit_session, holding_bars, exit_reason, entry_reason, roll_id, earliest_risk_date, forced_exit_session, phase, fold",
    "entry_spread, exit_spread, entry_package_value_usd, exit_package_value_usd, gross_pnl_usd, entry_cost_usd, cost_usd, net_pnl_usd, pnl_2x_cost_usd, pnl_3x_cost_usd, mae_usd, mfe_usd, entry_relative_volume, entry_max_leg_bid_ask_ticks, entry_package_capacity",
)


@query("position_ledger", LEDGER)
def position_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-bar trades of nine strategies on hourly bars, with rolls and forced exits (K6, P10)."""
    return settle(hour_trades(spark, sf_dir))


@query("package_ledger")
def package_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline from contract bars to phased trades."""
    return settle(views.market(spark, sf_dir).trades)


@query(
    "equity_curve",
    settle_sql(
        f"""{ledger_sql()} SELECT spread_id, strategy_id, strftime(xt, '%Y-%m-%d %H:%M:%S') AS exit_time, strftime(xsd, '%Y-%m-%d') AS exit_session, sum(net) AS realized_increment_usd,
          sum(sum(net)) OVER (PARTITION BY spread_id, strategy_id ORDER BY xt) AS equity_usd FROM tr GROUP BY spread_id, strategy_id, xt, xsd""",
        "spread_id, strategy_id, exit_time, exit_session", "realized_increment_usd, equity_usd",
    ),
)
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realised equity per structure and strategy (A4)."""
    return settle(L.equity_curve(hour_trades(spark, sf_dir)))


@query(
    "marked_equity",
    settle_sql(
        f"""{ledger_sql()}, gone AS MATERIALIZED (SELECT *, CASE WHEN at_close THEN xt + INTERVAL 1 SECOND ELSE xt END AS left_at FROM tr),
        op AS MATERIALIZED (SELECT b.spread_id, s.strategy_id, b.t, b.session_date, b.cv FROM lw b CROSS JOIN (SELECT unnest({[s.strategy_id for s in STRATEGIES]}) AS strategy_id) s)
        SELECT op.spread_id, op.strategy_id, strftime(op.t, '%Y-%m-%d %H:%M:%S') AS timestamp_utc, strftime(op.session_date, '%Y-%m-%d') AS session_date, coalesce(o.pos, 0) AS position,
          coalesce(r.total, 0) AS realized_net_pnl_usd, coalesce(r.total, 0) + coalesce(o.pos * (op.cv - o.evv) - o.ec, 0) AS equity_usd
        FROM op LEFT JOIN gone o ON o.spread_id = op.spread_id AND o.strategy_id = op.strategy_id AND o.et <= op.t AND o.left_at > op.t
        ASOF LEFT JOIN (SELECT spread_id, strategy_id, left_at, sum(sum(net)) OVER (PARTITION BY spread_id, strategy_id ORDER BY left_at) AS total FROM gone GROUP BY spread_id, strategy_id, left_at) r
          ON r.spread_id = op.spread_id AND r.strategy_id = op.strategy_id AND r.left_at <= op.t""",
        "spread_id, strategy_id, timestamp_utc, session_date, position", "realized_net_pnl_usd, equity_usd",
    ),
)
def marked_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, realised result and equity marked at every bar's close (A4, per bar)."""
    return settle(L.marked_equity(hour_inputs(spark, sf_dir), hour_trades(spark, sf_dir)))


@query(
    "seasonal_attach",
    settle_sql(
        f"""{_VOTED} SELECT spread_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS timestamp_utc, sn AS seasonal_n, sz AS seasonal_z, smove AS seasonal_expected_move_1d, x + smove AS seasonal_fair_value_1d, smz AS seasonal_move_z, sconf AS seasonal_confidence,
          expert_vote_error_correction_residual FROM vc""",
        "spread_id, timestamp_utc, seasonal_n, expert_vote_error_correction_residual", "seasonal_z, seasonal_expected_move_1d, seasonal_fair_value_1d, seasonal_move_z, seasonal_confidence",
    ),
)
def seasonal_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prior of earlier years beside every bar, and the seasonal expert's vote on it."""
    voted = X.with_expert_votes(hour_features(spark, sf_dir))
    return settle(voted.select(
        "spread_id", "timestamp_utc", "seasonal_n", "seasonal_z", "seasonal_expected_move_1d", "seasonal_fair_value_1d", "seasonal_move_z", "seasonal_confidence",
        "expert_vote_error_correction_residual",
    ))
