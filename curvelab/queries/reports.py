"""Summaries, exports and histories of the board, the ledger and the registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelab.config import ROOTS, STRATEGIES
from curvelab.edge import settle, settle_sql
from curvelab.functions import tokens as K
from curvelab.functions import units as U
from curvelab.operators import board as BD
from curvelab.operators import ingest
from curvelab.operators import reports as RP
from curvelab.operators import scorecard as SC
from curvelab.operators import structures as G
from curvelab.operators import walkforward as W
from curvelab.queries import ctes, learning
from curvelab.queries.evidence import _BOARD, _HOUR_TRIALS, EVIDENCE_ORDER, _board
from curvelab.queries.learning import HOURLY
from curvelab.registry import query
from curvelab.scale import latest_by
from curvelab.sources import views


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly board with codes and levels in the display unit."""
    board = _board(spark, sf_dir)
    cents = F.col("spread_id") < "f"
    coded = board.withColumns(
        {
            "trade_code": F.concat(F.upper("spread_id"), F.lit(" H1")), "display_unit": F.when(cents, "cpg").otherwise("USD/bbl"),
            "display_level_factor": F.when(cents, 1.0 / 0.42).otherwise(1.0), "advanced_risk_regime": F.lit(None).cast("string"),
        }
    )
    return BD.with_display_levels(coded)


def _hour_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = learning.hour_trades(spark, sf_dir).withColumns({"complexity_tier": F.lit(1), "algebra_group": F.col("spread_id")})
    return SC.scorecard(trades, _HOUR_TRIALS, HOURLY.evidence)


_RECENT = f"""bs AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY spread_id ORDER BY {EVIDENCE_ORDER}) = 1),
  rtd AS (SELECT tr.spread_id, tr.net, xt FROM tr JOIN (SELECT spread_id, strategy_id FROM bs) bs ON bs.spread_id = tr.spread_id AND bs.strategy_id = tr.strategy_id WHERE phase = 'LOCKBOX'),
  rce AS (SELECT *, sum(net) OVER (PARTITION BY spread_id ORDER BY xt ROWS UNBOUNDED PRECEDING) AS eq FROM rtd),
  rcf AS (SELECT *, eq - greatest(max(eq) OVER (PARTITION BY spread_id ORDER BY xt ROWS UNBOUNDED PRECEDING), 0) AS fall FROM rce),
  rcg AS (SELECT spread_id, count(*) AS n, sum(net) AS net, avg((net > 0)::INT) AS win, greatest(-min(fall), 0) AS mdd FROM rcf GROUP BY 1)"""
_LEVEL = "CASE WHEN bd.spread_id < 'f' THEN 1 / 0.42::DOUBLE ELSE 1 END"


@query(
    "structure_summaries",
    settle_sql(
        f"""{_BOARD}, {_RECENT}, lsd AS (SELECT bd.*, med - 1.8 * scale AS buy, med + 1.8 * scale AS sell, {_LEVEL} AS k FROM bd QUALIFY row_number() OVER (PARTITION BY bd.spread_id, session_date ORDER BY t DESC) = 1)
        SELECT lsd.spread_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS timestamp_utc, lsd.status AS current_status, upper(lsd.spread_id) || ' H1' AS trade_code, bs.strategy_id AS selected_strategy_id, bs.status AS selected_strategy_status, bs.oos AS model_oos_trades,
          x * k AS display_current, fair * k AS display_fair_value, buy * k AS display_buy_entry, sell * k AS display_sell_entry, x - buy AS distance_above_buy_entry, sell - x AS distance_below_sell_entry, fair - x AS distance_to_fair_value,
          CASE WHEN lsd.status = 'BUY' THEN 'LONG' WHEN lsd.status = 'SELL' THEN 'SHORT' WHEN longs > shorts THEN 'LONG_BIAS' WHEN longs < shorts THEN 'SHORT_BIAS' ELSE 'NEUTRAL' END AS technical_bias,
          CASE WHEN x <= buy THEN 'AT_OR_BELOW_BUY_LEVEL' WHEN x >= sell THEN 'AT_OR_ABOVE_SELL_LEVEL' ELSE 'BETWEEN_ENTRY_LEVELS' END AS level_position, coalesce(rcg.n, 0) AS recent_30_trades, coalesce(rcg.net, 0) AS recent_30_net_pnl_usd, coalesce(rcg.mdd, 0) AS recent_30_max_drawdown_usd,
          coalesce(rcg.win, 0) AS recent_30_win_rate
        FROM lsd LEFT JOIN bs ON bs.spread_id = lsd.spread_id LEFT JOIN rcg ON rcg.spread_id = lsd.spread_id""",
        "spread_id, timestamp_utc, current_status, trade_code, selected_strategy_id, selected_strategy_status, model_oos_trades, technical_bias, level_position, recent_30_trades",
        "display_current, display_fair_value, display_buy_entry, display_sell_entry, distance_above_buy_entry, distance_below_sell_entry, distance_to_fair_value, recent_30_net_pnl_usd, recent_30_max_drawdown_usd, recent_30_win_rate", 5, nudge=True,
    ),
)
def structure_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's last board row with its frozen strategy, recent result and display levels."""
    told = _summaries(spark, sf_dir)
    return settle(told.select(
        "spread_id", "timestamp_utc", "current_status", "trade_code", "selected_strategy_id", "selected_strategy_status", "model_oos_trades", "display_current", "display_fair_value",
        "display_buy_entry", "display_sell_entry", "distance_above_buy_entry", "distance_below_sell_entry", "distance_to_fair_value", "technical_bias", "level_position",
        "recent_30_trades", "recent_30_net_pnl_usd", "recent_30_max_drawdown_usd", "recent_30_win_rate",
    ), 5, nudge=True)


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = latest_by(_shown(spark, sf_dir), ["spread_id", "session_date"], "timestamp_utc")
    selected = SC.best_strategies(_hour_score(spark, sf_dir))
    trades = learning.hour_trades(spark, sf_dir).filter("phase = 'LOCKBOX'").withColumn("trade_id", F.date_format("entry_time", "yyyyMMddHH"))
    recent = SC.recent_metrics(SC.selected_trades(trades, selected, F.lit("1900-01-01").cast("date"), F.lit("2100-01-01").cast("date")))
    return BD.structure_summaries(board, selected, recent)


@query(
    "structure_briefs",
    f"""{_BOARD}, {_RECENT}, lsd AS (SELECT bd.*, med - 1.8 * scale AS buy, med + 1.8 * scale AS sell, {_LEVEL} AS k FROM bd QUALIFY row_number() OVER (PARTITION BY bd.spread_id, session_date ORDER BY t DESC) = 1)
      SELECT lsd.spread_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS timestamp_utc, lsd.status || ': ' || upper(lsd.spread_id) || ' H1 is ' || format('{{:,.3f}}', x * k) || CASE WHEN lsd.spread_id < 'f' THEN ' cpg' ELSE ' USD/bbl' END || '. Buy at or below ' || coalesce(format('{{:,.3f}}', buy * k), 'n/a')
        || '; sell at or above ' || coalesce(format('{{:,.3f}}', sell * k), 'n/a') || '; fair value ' || coalesce(format('{{:,.3f}}', fair * k), 'n/a') || '; confidence ' || format('{{:,.1f}}', 100 * round(conf, 6)) || '%. Evidence: ' || coalesce(bs.strategy_id, 'none') || ' (' || coalesce(bs.status, 'ANALYTIC_ONLY')
        || '). Recent trades ' || coalesce(rcg.n, 0) || ', net ' || format('{{:,.2f}}', coalesce(rcg.net, 0)::DOUBLE) || '. Pattern ' || pattern || '; risk UNAVAILABLE; liquidity ' || gate || '.' AS summary_description
      FROM lsd LEFT JOIN bs ON bs.spread_id = lsd.spread_id LEFT JOIN rcg ON rcg.spread_id = lsd.spread_id""",
)
def structure_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence for every structure and session."""
    told = BD.with_description(_summaries(spark, sf_dir), 3)
    return settle(told.select("spread_id", "timestamp_utc", "summary_description"))


@query(
    "trade_level_export",
    settle_sql(
        f"""{_BOARD} SELECT bd.spread_id, strftime(bd.t, '%Y-%m-%d %H:%M:%S') AS timestamp_utc, upper(bd.spread_id) || ' H1' AS trade_code, status, CASE WHEN bd.spread_id < 'f' THEN 'cpg' ELSE 'USD/bbl' END AS display_unit, (status IN ('BUY', 'SELL') AND proven AND a.r1 = 1 AND w1.r2 <= 3)::BIGINT AS portfolio_selected,
          x * {_LEVEL} AS display_current, (med - 1.8 * scale) * {_LEVEL} AS display_buy_entry, (med + 1.8 * scale) * {_LEVEL} AS display_sell_entry, fair * {_LEVEL} AS display_fair_value, (x - 2.5 * coalesce(ew, 0)) * {_LEVEL} AS display_long_stop, (x + 2.5 * coalesce(ew, 0)) * {_LEVEL} AS display_short_stop,
          round(conf, 6) AS confidence, 15 AS bar_interval_minutes, 9 AS strategy_count, 5 AS untouched_lockbox_sessions, 10 AS walk_forward_train_sessions, 3 AS walk_forward_validation_sessions, 2 AS walk_forward_test_sessions, 1 AS walk_forward_embargo_sessions, 0 AS lockbox_used_for_training, 3 AS maximum_new_trades_per_session
        FROM bd LEFT JOIN (SELECT spread_id, t, r1 FROM act) a ON a.spread_id = bd.spread_id AND a.t = bd.t LEFT JOIN (SELECT t, grp, r2 FROM win) w1 ON w1.t = bd.t AND w1.grp = bd.grp""",
        "spread_id, timestamp_utc, trade_code, status, display_unit, coalesce(portfolio_selected, 0) AS portfolio_selected, bar_interval_minutes, strategy_count, untouched_lockbox_sessions, walk_forward_train_sessions, walk_forward_validation_sessions, walk_forward_test_sessions, walk_forward_embargo_sessions, lockbox_used_for_training, maximum_new_trades_per_session",
        "display_current, display_buy_entry, display_sell_entry, display_fair_value, display_long_stop, display_short_stop, confidence", 5, nudge=True,
    ),
)
def trade_level_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board's levels with the settings they were made under, in the order they are read."""
    out = RP.trade_level_export(_shown(spark, sf_dir), HOURLY).orderBy(*RP.export_order())
    return settle(out.select(
        "spread_id", "timestamp_utc", "trade_code", "status", "display_unit", F.coalesce("portfolio_selected", F.lit(False)).alias("portfolio_selected"), "display_current", "display_buy_entry",
        "display_sell_entry", "display_fair_value", "display_long_stop", "display_short_stop", "confidence", *out.columns[-9:],
    ), 5, nudge=True)


@query("status_counts", f"{_BOARD} SELECT status AS current_status, count(*) AS structures FROM bd GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each status is given (A10)."""
    return settle(BD.status_counts(_board(spark, sf_dir).withColumnRenamed("status", "current_status")))


@query(
    "top_signals",
    f"{_BOARD} SELECT spread_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS timestamp_utc, status, round(conf, 6) AS confidence FROM bd ORDER BY round(conf, 6) DESC, t DESC, spread_id LIMIT 10",
)
def top_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows of highest confidence (T5)."""
    top = BD.top_rows(_board(spark, sf_dir), [F.col("confidence").desc(), F.col("timestamp_utc").desc(), F.col("spread_id")], 10)
    return settle(top.select("spread_id", "timestamp_utc", "status", "confidence"))


@query(
    "recent_trades",
    f"{learning.ledger_sql()} SELECT spread_id, strategy_id, strftime(et, '%Y-%m-%d %H:%M:%S') AS entry_time, round(net, 6) AS net_pnl_usd FROM tr ORDER BY xt DESC, spread_id, strategy_id LIMIT 300",
)
def recent_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three hundred trades (T5)."""
    top = BD.top_rows(learning.hour_trades(spark, sf_dir), [F.col("exit_time").desc(), F.col("spread_id"), F.col("strategy_id")], 300)
    return settle(top.select("spread_id", "strategy_id", "entry_time", "net_pnl_usd"))


_SNAPSHOT = ("robust_z", "rsi", "efficiency_ratio", "macd_histogram", "relative_volume", "bollinger_width", "session_vwap_proxy", "signed_volume_imbalance_proxy", "pvo", "seasonal_z", "seasonal_move_z", "ewma_abs_change")
_SNAPSHOT_SQL = "z AS robust_z, rsi, er AS efficiency_ratio, hist AS macd_histogram, relvol AS relative_volume, width AS bollinger_width, svwap AS session_vwap_proxy, flow AS signed_volume_imbalance_proxy, pvo, sz AS seasonal_z, smz AS seasonal_move_z, ew AS ewma_abs_change"


@query(
    "indicator_snapshot",
    settle_sql(f"{learning._VOTED} SELECT spread_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS timestamp_utc, {_SNAPSHOT_SQL} FROM f QUALIFY row_number() OVER (PARTITION BY spread_id ORDER BY t DESC) = 1", "spread_id, timestamp_utc", ", ".join(_SNAPSHOT)),
)
def indicator_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest indicators of every structure."""
    features = learning.hour_features(spark, sf_dir).select("spread_id", "timestamp_utc", *_SNAPSHOT)
    return settle(latest_by(features, "spread_id", "timestamp_utc"))


@query(
    "session_history",
    settle_sql(
        f"{learning._VOTED}, d AS (SELECT session_date, row_number() OVER (ORDER BY session_date DESC) AS r FROM (SELECT DISTINCT session_date FROM f)) SELECT spread_id, strftime(session_date, '%Y-%m-%d') AS session_date, {_SNAPSHOT_SQL} FROM f JOIN d USING (session_date) WHERE r <= 12 AND slot = 23",
        "spread_id, session_date", ", ".join(_SNAPSHOT),
    ),
)
def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End-of-session indicators of the newest twelve sessions."""
    return settle(RP.last_bar_history(learning.hour_features(spark, sf_dir), _SNAPSHOT, 12))


@query(
    "nearest_contracts",
    f"WITH {ctes.CURVE_BARS}, n AS (SELECT max(sd) AS sd FROM cbars) SELECT root, security, strftime(delivery, '%Y-%m-%d') AS delivery_month, row_number() OVER (PARTITION BY root ORDER BY delivery, security) AS rank FROM (SELECT DISTINCT root, security, delivery FROM cbars JOIN n USING (sd)) QUALIFY rank <= 2",
)
def nearest_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two contracts of every root on the newest session."""
    bars = views.curve_bars(spark, sf_dir).filter("event_type = 'TRADE'")
    return settle(RP.nearest_contracts(bars, 2).select("root", "security", "delivery_month", "rank"))


@query(
    "strategy_library",
    f"""{learning.ledger_sql()}, s(strategy_id, strategy_name, family, maximum_holding_bars) AS (VALUES {', '.join(f"('{s.strategy_id}', '{s.name}', '{s.family}', {s.maximum_holding_bars})" for s in STRATEGIES)})
      SELECT s.*, count(net) AS trades, round(coalesce(avg(held), 0), 6) AS mean_holding_bars FROM s LEFT JOIN tr USING (strategy_id) GROUP BY ALL""",
)
def strategy_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategies with how often they traded and how long they held."""
    used = learning.hour_trades(spark, sf_dir).groupBy("strategy_id").agg(F.count(F.lit(1)).alias("trades"), F.avg("holding_bars").alias("mean_holding_bars"))
    joined = RP.strategy_library(spark).join(used, "strategy_id", "left")
    return settle(joined.withColumns({"trades": F.coalesce("trades", F.lit(0)), "mean_holding_bars": F.coalesce("mean_holding_bars", F.lit(0.0))}))


_GENERATED = G.curve_structures()


@query(
    "registry_merge",
    f"""WITH g(spread_id, algebra_group, spread_family) AS (VALUES {', '.join(f"('{s.spread_id}', '{s.group}', '{s.family}')" for s in _GENERATED)}),
      own AS (SELECT 'OWN.' || p_partkey AS spread_id, CASE WHEN p_partkey % 50 = 0 THEN 'HO_CAL_12' WHEN p_partkey % 50 = 1 THEN 'HO_WTI_M1' WHEN p_partkey % 50 = 2 THEN 'HOGO_FLY_BOX' ELSE 'OWN_' || p_brand END AS algebra_group, 'User' AS spread_family FROM part)
      SELECT spread_id, algebra_group, spread_family, 'USER' AS origin FROM own UNION ALL SELECT *, 'GENERATED' FROM g WHERE algebra_group NOT IN (SELECT algebra_group FROM own)""",
)
def registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's registry over the generated one: generated structures of its groups go."""
    key = F.col("p_partkey")
    group = F.when(key % 50 == 0, "HO_CAL_12").when(key % 50 == 1, "HO_WTI_M1").when(key % 50 == 2, "HOGO_FLY_BOX").otherwise(F.concat(F.lit("OWN_"), "p_brand"))
    own = views.table(spark, sf_dir, "part").select(F.concat(F.lit("OWN."), key.cast("string")).alias("spread_id"), group.alias("algebra_group"), F.lit("User").alias("spread_family"))
    generated = G.structure_table(spark, _GENERATED, ROOTS).select("spread_id", "algebra_group", "spread_family")
    return settle(G.merged_library(own, generated))


_FREQUENCY = "['monthly', 'QUARTERLY ', 'q3', 'Half-year', 'S1', 'daily', '', 'Months']"
_REFERENCE = "['1', '2.9', '0', '-3', 'x', '', '12', '7.0']"


@query(
    "label_forms",
    f"""WITH t AS (SELECT p_partkey, {_FREQUENCY}[p_partkey % 8 + 1] AS f, {_REFERENCE}[p_size % 8 + 1] AS r FROM part)
      SELECT p_partkey, CASE WHEN trim(f) = '' THEN '' WHEN upper(f) LIKE '%QUART%' OR upper(f) LIKE 'Q%' THEN 'Quarterly' WHEN upper(f) LIKE '%HALF%' OR upper(f) LIKE 'H%' OR upper(f) LIKE 'S%' THEN 'Half' WHEN upper(f) LIKE '%MONTH%' THEN 'Monthly' ELSE 'Daily' END AS frequency,
        CASE WHEN try_cast(r AS DOUBLE) >= 1 THEN floor(try_cast(r AS DOUBLE))::BIGINT ELSE 1 END AS reference FROM t""",
)
def label_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency and reference read from many spellings."""
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), (i % 8).cast("int"))
    rows = views.table(spark, sf_dir, "part").select(
        "p_partkey", pick(["monthly", "QUARTERLY ", "q3", "Half-year", "S1", "daily", "", "Months"], F.col("p_partkey")).alias("f"), pick(["1", "2.9", "0", "-3", "x", "", "12", "7.0"], F.col("p_size")).alias("r")
    )
    return settle(rows.select("p_partkey", K.frequency_label(F.col("f")).alias("frequency"), K.reference_number(F.col("r")).alias("reference")))


@query(
    "column_spellings",
    """SELECT strftime(l_shipdate, '%Y-%m-%d') AS date, l_partkey::VARCHAR AS security_str, l_extendedprice AS "PX_SETTLE", l_quantity AS "PX_VOLUME", NULL::VARCHAR AS "PX_LAST", l_returnflag AS contract_month_yr, l_returnflag AS month FROM lineitem""",
)
def column_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delivery in other spellings, under canonical names; what it lacks is null."""
    delivered = views.table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("DT"), F.col("l_partkey").cast("string").alias("Symbol"), F.col("l_extendedprice").alias("px_settlement"), F.col("l_quantity").alias("Qty"),
        F.col("l_returnflag").alias("Contract_Month"),
    )
    return settle(ingest.pricing_columns(delivered, ("date", "security_str", "PX_SETTLE", "PX_VOLUME", "PX_LAST", "contract_month_yr", "month")))


@query(
    "unit_identities",
    """WITH u(unit, k) AS (VALUES ('cpg', 0), ('$/gal', 1), ('$/bbl', 2), ('$/MT', 3)), p AS (SELECT p_retailprice AS v, 7.0 + (p_size % 9) / 10.0 AS mt FROM part)
      SELECT a.unit AS source_unit, b.unit AS target_unit, count(*) AS prices, 0 AS beyond_tolerance FROM p, u a, u b GROUP BY ALL""",
)
def unit_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices taken to every unit and back that miss themselves by more than a rounding step allows."""
    units = F.array(*[F.lit(u) for u in U.UNITS])
    # Equal prices are taken there and back once, and the shuffle deals them to all tasks.
    prices = views.table(spark, sf_dir, "part").groupBy(F.col("p_retailprice").alias("v"), (7.0 + (F.col("p_size") % 9) / 10.0).alias("mt")).agg(F.count(F.lit(1)).alias("n"))
    rows = prices.select("*", F.explode(units).alias("source_unit")).withColumn("target_unit", F.explode(units))
    there = U.convert(F.col("v"), F.col("source_unit"), F.col("target_unit"), F.col("mt"), F.lit(42.0))
    back = U.convert(F.col("_t"), F.col("target_unit"), F.col("source_unit"), F.col("mt"), F.lit(42.0))
    # A step of 5e-6 in the coarsest unit is 4200 * 7.8 steps of the finest.
    wrong = F.abs(back - F.col("v")) > 5e-6 * 4200 * 7.8 + 1e-9
    return settle(rows.withColumn("_t", there).groupBy("source_unit", "target_unit").agg(F.sum("n").alias("prices"), F.sum(F.when(wrong, F.col("n")).otherwise(0)).alias("beyond_tolerance")))


@query(
    "fold_report",
    f"""{learning._FOLDS} SELECT fold, {learning._day('0')} AS train_start, {learning._day('e + 19')} AS test_end, 30 AS validation_sessions_in_fold, 5 AS embargo_sessions, 15 AS oos_test_sessions, 30 AS lockbox_sessions, 0 AS lockbox_used_for_training, 15 AS bar_interval_minutes, 9 AS strategy_count, e - 30 AS train_sessions_in_fold FROM e""",
)
def fold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folds as they are reported, with their constants (K8)."""
    days = views.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session_date"))
    told = W.describe_windows(W.walk_forward(days))
    return settle(told.select(
        "fold", "train_start", "test_end", "validation_sessions_in_fold", "embargo_sessions", "oos_test_sessions", "lockbox_sessions", "lockbox_used_for_training", "bar_interval_minutes",
        "strategy_count", "train_sessions_in_fold",
    ))


@query(
    "snapshot_append",
    """WITH e AS (SELECT user_id, ts AS time, value, event_id % 3 = 0 AS late FROM events), c AS (SELECT CAST(max(ts) AS DATE) - INTERVAL 1 MONTH AS since FROM events WHERE event_id % 3 = 0)
      SELECT user_id, count(*) AS snapshots, strftime(min(time), '%Y-%m-%d %H:%M:%S') AS first_time, round(sum(value), 4) AS total FROM (SELECT DISTINCT * EXCLUDE late FROM e), c WHERE time >= since GROUP BY 1""",
)
def snapshot_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of a second delivery after those of the first, as far back as a month reaches."""
    rows = views.table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").alias("time"), "value")
    old, new = (rows.filter(test).drop("event_id") for test in (F.col("event_id") % 3 != 0, F.col("event_id") % 3 == 0))
    since = ingest.rolling_cutoff(new.agg(F.to_date(F.max("time"))).scalar(), 1)
    kept = ingest.append_snapshots(old, new, since)
    return settle(kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("snapshots"), F.min("time").alias("first_time"), F.sum("value").alias("total")), dp=4)


@query(
    "user_structures",
    """WITH l AS (SELECT 'USR.' || p_partkey AS spread_id, p_size > 10 AS enabled, p_brand AS r1, p_size % 4 AS off, p_partkey FROM part), g AS (SELECT spread_id, p_partkey, off, unnest([1, 2, 3]) AS leg_order FROM l WHERE enabled),
      f AS (SELECT *, CASE WHEN leg_order = 1 THEN 'HO:delivery:0:1:1:1' WHEN leg_order = 2 THEN 'CL:delivery:' || off || ':1:-1:2' ELSE 'HO:rank:0:2:1:1' END AS text FROM g WHERE leg_order < 3 OR p_partkey % 2 = 0)
      SELECT spread_id, count(*) AS n_legs, string_agg(text, '|' ORDER BY leg_order) AS signature FROM f GROUP BY 1""",
)
def user_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's registry of structures with two or three legs: the enabled ones and their signatures."""
    parts = views.table(spark, sf_dir, "part")
    name = F.concat(F.lit("USR."), F.col("p_partkey").cast("string"))
    library = parts.select(name.alias("spread_id"), (F.col("p_size") > 10).alias("enabled"), F.col("p_name").alias("display_name"), F.lit("User").alias("family"), F.lit("HO").alias("anchor_root"))
    leg = lambda order, root, mode, offset, rank, sign, lots: F.struct(
        F.lit(order).alias("leg_order"), F.lit(root).alias("root"), F.lit(mode).alias("selection_mode"), offset.cast("int").alias("delivery_offset"), F.lit(rank).alias("rank"), F.lit(sign).alias("sign"), F.lit(lots).alias("contracts")
    )
    zero, even = F.lit(0), F.col("p_partkey") % 2 == 0
    two = [leg(1, "HO", "delivery", zero, 1, 1, 1), leg(2, "CL", "delivery", F.col("p_size") % 4, 1, -1, 2)]
    legs = parts.select(name.alias("spread_id"), F.explode(F.when(even, F.array(*two, leg(3, "HO", "rank", zero, 2, 1, 1))).otherwise(F.array(*two))).alias("g")).select("spread_id", "g.*")
    _, keyed = G.user_registry(library, legs)
    return settle(keyed.select("spread_id", "n_legs", "signature").distinct())
