"""Scorecards, selection, budgets, depth, forecasts and the signal board."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelab.config import ROOTS, STRATEGIES, Strategy
from curvelab.edge import settle, settle_sql
from curvelab.functions.stats import expected_maximum_factor, normal_cdf_sql
from curvelab.operators import board as BD
from curvelab.operators import calendar as C
from curvelab.operators import scorecard as SC
from curvelab.queries import ctes, learning
from curvelab.queries.market import PACKS, STRUCTURES
from curvelab.registry import query
from curvelab.scale import latest_by
from curvelab.sources import views
from curvelab.stages import stage

TRIALS = 150

_PH = f"""{ctes.TRADES},
ph AS (SELECT *, CASE WHEN year(exit_session) >= 2001 THEN 'LOCKBOX' WHEN year(exit_session) BETWEEN 1997 AND 2000 THEN 'OOS' ELSE 'DEVELOPMENT' END AS phase,
  CASE WHEN year(exit_session) BETWEEN 1997 AND 2000 THEN year(exit_session) - 1996 END AS fold FROM trades)"""


def _metrics(source: str, keys: str, name: str, trials: int = TRIALS) -> str:
    """Daily metrics per key of a trade CTE."""
    return f"""{name}_d AS (SELECT {keys}, exit_session AS day, sum(net) AS pnl FROM {source} GROUP BY ALL),
{name}_c AS (SELECT *, sum(pnl) OVER (PARTITION BY {keys} ORDER BY day) AS eq, avg(pnl) OVER (PARTITION BY {keys}) AS m0, stddev_samp(pnl) OVER (PARTITION BY {keys}) AS s0 FROM {name}_d),
{name}_e AS (SELECT *, eq - greatest(max(eq) OVER (PARTITION BY {keys} ORDER BY day), 0) AS fall, (pnl - m0) / nullif(s0, 0) AS z FROM {name}_c),
{name}_a AS (SELECT {keys}, count(*) AS n, avg(pnl) AS m, coalesce(stddev_samp(pnl), 0) AS s, coalesce(stddev_samp(CASE WHEN pnl < 0 THEN pnl END), 0) AS ds, abs(min(fall)) AS mdd,
  avg(z * z * z) AS g3, avg(z * z * z * z) AS g4 FROM {name}_e GROUP BY ALL),
{name}_b AS (SELECT *, m / nullif(s, 0) AS sr FROM {name}_a),
{name}_f AS (SELECT *, sr / sqrt(greatest((1 - g3 * sr + (g4 - 1) / 4 * sr * sr) / greatest(1, n - 1), 1e-12)) - {expected_maximum_factor(trials)!r} AS score FROM {name}_b),
{name} AS (SELECT *, coalesce(sr * sqrt(252), 0) AS daily_sharpe, coalesce(m / nullif(ds, 0) * sqrt(252), 0) AS daily_sortino, coalesce(m * 252 / nullif(mdd, 0), 0) AS calmar,
  CASE WHEN n >= 3 AND s > 0 THEN {normal_cdf_sql('score')} ELSE 0 END AS dsr FROM {name}_f)"""


def score_sql(p: SC.Evidence = SC.Evidence(), trials: int = TRIALS) -> str:
    """The scorecard ``sc`` of the phased trades ``ph``."""
    return f"""has AS (SELECT spread_id, strategy_id, max((phase = 'OOS')::INT) AS h FROM ph GROUP BY ALL),
ev AS (SELECT ph.*, h FROM ph JOIN has USING (spread_id, strategy_id) WHERE h = 0 OR phase = 'OOS'), {_metrics('ev', 'spread_id, strategy_id', 'mt', trials)},
tot AS (SELECT spread_id, strategy_id, count(*) AS trades, max(h) AS h, sum(gross) AS gross, sum(net) AS net, sum(cost) AS cost, sum(net2) AS net2, sum(net3) AS net3, avg((net > 0)::INT) AS win,
  sum(CASE WHEN net > 0 THEN net ELSE 0 END) AS wins, sum(CASE WHEN net < 0 THEN net ELSE 0 END) AS losses, avg(net) AS expectancy, median(holding_bars) AS hold,
  count(*) FILTER (exit_reason = 'MANDATORY_D4_EXIT') AS exits, coalesce(sum(net) FILTER (direction = 'LONG'), 0) AS long_net, coalesce(sum(net) FILTER (direction = 'SHORT'), 0) AS short_net, min(complexity_tier) AS tier
  FROM ev GROUP BY ALL),
al AS (SELECT spread_id, strategy_id, count(*) FILTER (phase = 'OOS') AS oos, count(*) FILTER (phase = 'LOCKBOX') AS lock, coalesce(sum(net) FILTER (phase = 'LOCKBOX'), 0) AS lock_net FROM ph GROUP BY ALL),
fs AS (SELECT spread_id, strategy_id, avg((fn > 0)::INT) AS share FROM (SELECT spread_id, strategy_id, fold, sum(net) AS fn FROM ph WHERE phase = 'OOS' GROUP BY ALL) GROUP BY ALL),
sc0 AS (SELECT tot.*, oos, lock, lock_net, coalesce(share, 0) AS share, CASE WHEN abs(losses) > 0 THEN wins / abs(losses) WHEN wins > 0 THEN 99 ELSE 0 END AS pf,
  ceil({p.minimum_oos_trades} * (1 + 0.5 * (tier - 1)))::INT AS hurdle, daily_sharpe, daily_sortino, calmar, mdd, dsr FROM tot JOIN al USING (spread_id, strategy_id) LEFT JOIN fs USING (spread_id, strategy_id) JOIN mt USING (spread_id, strategy_id)),
sc AS (SELECT *, CASE WHEN oos >= hurdle AND share >= {p.minimum_profitable_fold_share} AND pf >= {p.minimum_profit_factor} AND dsr >= {p.minimum_probability_sharpe} AND net > 0 THEN 'VALIDATED' ELSE 'RESEARCH_ONLY' END AS status FROM sc0)
"""


EVIDENCE_ORDER = "(status = 'VALIDATED') DESC, dsr DESC NULLS LAST, share DESC NULLS LAST, daily_sharpe DESC NULLS LAST, net DESC NULLS LAST, oos DESC NULLS LAST, strategy_id"
_SCORE = f"WITH {_PH}, {score_sql()}"


def trial_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, "trial-scores", sf_dir, lambda: SC.scorecard(views.phased_trades(spark, sf_dir), TRIALS))


@query(
    "scorecard",
    settle_sql(
        f"{_SCORE} SELECT spread_id, strategy_id, status, trades, oos AS oos_trades, lock AS lockbox_trades, gross AS gross_pnl_usd, net AS net_pnl_usd, lock_net AS lockbox_net_pnl_usd,"
        " cost AS cost_drag_usd, net2 AS net_pnl_2x_cost_usd, net3 AS net_pnl_3x_cost_usd, daily_sharpe, daily_sortino, mdd AS max_drawdown_usd, calmar, win AS win_rate, pf AS profit_factor,"
        " expectancy AS expectancy_usd, hold AS median_holding_bars, share AS profitable_fold_share, dsr AS deflated_sharpe_probability, exits AS expiry_exits, long_net AS long_net_pnl_usd, short_net AS short_net_pnl_usd, hurdle AS minimum_oos_trades_hurdle FROM sc",
        "spread_id, strategy_id, status, trades, oos_trades, lockbox_trades, expiry_exits, minimum_oos_trades_hurdle",
        "gross_pnl_usd, net_pnl_usd, lockbox_net_pnl_usd, cost_drag_usd, net_pnl_2x_cost_usd, net_pnl_3x_cost_usd, daily_sharpe, daily_sortino, max_drawdown_usd, calmar, win_rate,"
        " profit_factor, expectancy_usd, median_holding_bars, profitable_fold_share, deflated_sharpe_probability, long_net_pnl_usd, short_net_pnl_usd", nudge=True,
    ),
)
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence per brand and strategy with deflated Sharpe and status."""
    return settle(trial_scores(spark, sf_dir).select(
        "spread_id", "strategy_id", "status", "trades", "oos_trades", "lockbox_trades", "gross_pnl_usd", "net_pnl_usd", "lockbox_net_pnl_usd",
        "cost_drag_usd", "net_pnl_2x_cost_usd", "net_pnl_3x_cost_usd", "daily_sharpe", "daily_sortino", "max_drawdown_usd", "calmar", "win_rate",
        "profit_factor", "expectancy_usd", "median_holding_bars", "profitable_fold_share", "deflated_sharpe_probability", "expiry_exits",
        "long_net_pnl_usd", "short_net_pnl_usd", "minimum_oos_trades_hurdle",
    ), nudge=True)


@query(
    "fold_metrics",
    settle_sql(
        f"WITH {_PH}, oo AS (SELECT * FROM ph WHERE phase = 'OOS'), {_metrics('oo', 'spread_id, strategy_id, fold', 'fm')},"
        " c AS (SELECT spread_id, strategy_id, fold, count(*) AS trades, sum(net) AS net_pnl_usd FROM oo GROUP BY ALL)"
        " SELECT spread_id, strategy_id, fold, trades, net_pnl_usd, daily_sharpe AS sharpe, mdd AS max_drawdown_usd FROM c JOIN fm USING (spread_id, strategy_id, fold)",
        "spread_id, strategy_id, fold, trades", "net_pnl_usd, sharpe, max_drawdown_usd",
    ),
)
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net, Sharpe and drawdown per fold."""
    return settle(SC.fold_metrics(views.phased_trades(spark, sf_dir)))


@query(
    "best_strategy",
    f"{_SCORE} SELECT spread_id, strategy_id, status FROM sc QUALIFY row_number() OVER (PARTITION BY spread_id ORDER BY {EVIDENCE_ORDER}) = 1",
)
def best_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one strategy per brand that would be frozen."""
    return settle(SC.best_strategies(trial_scores(spark, sf_dir)).select("spread_id", "strategy_id", "status"))


_PLAN = tuple(Strategy(f"{a}{b}", f"{a}{b}", "", 1) for a in "ANRZ" for b in "FO")


@query(
    "missing_trials",
    f"""{_SCORE}, reg AS (SELECT DISTINCT p_brand AS spread_id FROM part UNION ALL SELECT DISTINCT 'X' || p_brand FROM part),
      grid AS (SELECT spread_id, s AS strategy_id FROM reg, (VALUES ('AF'), ('AO'), ('NF'), ('NO'), ('RF'), ('RO'), ('ZF'), ('ZO')) v(s))
      SELECT g.spread_id, g.strategy_id, coalesce(sc.status, CASE WHEN g.spread_id LIKE 'X%' THEN 'NO_DATA' ELSE 'NO_TRADES' END) AS status, coalesce(sc.trades, 0) AS trades
      FROM grid g LEFT JOIN sc USING (spread_id, strategy_id)""",
)
def missing_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All registered trials, those without trades marked."""
    brands = views.table(spark, sf_dir, "part").select(F.col("p_brand").alias("spread_id")).distinct()
    registry = brands.unionByName(brands.select(F.concat(F.lit("X"), "spread_id").alias("spread_id"))).withColumns(
        {"model_enabled": F.lit(True), "complexity_tier": F.lit(1), "algebra_group": F.col("spread_id")}
    )
    full = SC.complete_scorecard(trial_scores(spark, sf_dir), registry, brands, _PLAN)
    return settle(full.select("spread_id", "strategy_id", "status", "trades"))


@query(
    "recent_structure_metrics",
    settle_sql(
        f"""{_SCORE}, best AS (SELECT spread_id, strategy_id FROM sc QUALIFY row_number() OVER (PARTITION BY spread_id ORDER BY {EVIDENCE_ORDER}) = 1),
        r AS (SELECT ph.* FROM ph JOIN best USING (spread_id, strategy_id) WHERE exit_session BETWEEN DATE '1999-01-01' AND DATE '2000-12-31'),
        e AS (SELECT *, sum(net) OVER w AS eq FROM r WINDOW w AS (PARTITION BY spread_id ORDER BY exit_session, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)),
        f AS (SELECT *, eq - greatest(max(eq) OVER (PARTITION BY spread_id ORDER BY exit_session, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING), 0) AS fall FROM e)
        SELECT spread_id, count(*) AS recent_30_trades, strftime(min(entry_session), '%Y-%m-%d') AS recent_30_first_entry, strftime(max(exit_session), '%Y-%m-%d') AS recent_30_last_exit, sum(gross) AS recent_30_gross_pnl_usd,
          sum(net) AS recent_30_net_pnl_usd, avg((net > 0)::INT) AS recent_30_win_rate, greatest(-min(fall), 0) AS recent_30_max_drawdown_usd, median(holding_bars) AS recent_30_median_holding_bars,
          CASE WHEN abs(sum(least(net, 0))) > 0 THEN sum(greatest(net, 0)) / abs(sum(least(net, 0))) WHEN sum(greatest(net, 0)) > 0 THEN 99 ELSE 0 END AS recent_30_profit_factor FROM f GROUP BY 1""",
        "spread_id, recent_30_trades, recent_30_first_entry, recent_30_last_exit",
        "recent_30_gross_pnl_usd, recent_30_net_pnl_usd, recent_30_win_rate, recent_30_max_drawdown_usd, recent_30_median_holding_bars, recent_30_profit_factor",
    ),
)
def recent_structure_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result of the selected strategy in a window."""
    trades = views.phased_trades(spark, sf_dir)
    selected = SC.best_strategies(trial_scores(spark, sf_dir))
    recent = SC.selected_trades(trades, selected, F.lit("1999-01-01").cast("date"), F.lit("2000-12-31").cast("date"))
    out = SC.recent_metrics(recent)
    return settle(out.select(
        "spread_id", "recent_30_trades", "recent_30_first_entry", "recent_30_last_exit", "recent_30_gross_pnl_usd", "recent_30_net_pnl_usd",
        "recent_30_win_rate", "recent_30_max_drawdown_usd", "recent_30_median_holding_bars", "recent_30_profit_factor",
    ))


_ORDER = "relvol DESC, complexity_tier, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(
    "entry_budget",
    f"""WITH {ctes.TRADES}, g AS (SELECT *, row_number() OVER (PARTITION BY entry_session, algebra_group ORDER BY {_ORDER}) AS r1 FROM trades),
      w AS (SELECT entry_session, algebra_group, row_number() OVER (PARTITION BY entry_session ORDER BY {_ORDER}) AS r2 FROM g WHERE r1 = 1),
      a AS (SELECT g.*, r2, CASE WHEN r1 = 1 AND r2 <= 3 THEN 'SELECTED' WHEN r2 <= 3 THEN 'DUPLICATE_ALGEBRA_GROUP' ELSE 'DAILY_TRADE_BUDGET' END AS action FROM g JOIN w USING (entry_session, algebra_group))
      SELECT strftime(entry_session, '%Y-%m-%d') AS entry_session, algebra_group, action AS portfolio_action, count(*) AS trades, round(sum(net), 6) + 0.0 AS net_pnl_usd FROM a GROUP BY ALL""",
)
def entry_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three entries a day and one per group."""
    order = [-F.col("entry_relative_volume"), F.col("complexity_tier"), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]]
    done = BD.budget_totals(views.trades(spark, sf_dir), ["entry_session"], "algebra_group", order, "net_pnl_usd")
    return settle(done.select("entry_session", "algebra_group", "portfolio_action", "trades", "net_pnl_usd"))


@query(
    "portfolio_metrics",
    f"""WITH {ctes.TRADES}, g AS (SELECT *, row_number() OVER (PARTITION BY entry_session, algebra_group ORDER BY {_ORDER}) AS r1 FROM trades),
      w AS (SELECT entry_session, net, row_number() OVER (PARTITION BY entry_session ORDER BY {_ORDER}) AS r2 FROM g WHERE r1 = 1), s AS (SELECT * FROM w WHERE r2 <= 3)
      SELECT (SELECT count(*) FROM trades) AS candidate_trades, count(*) AS selected_trades, count(DISTINCT entry_session) AS sessions_traded,
        (SELECT max(n) FROM (SELECT count(*) AS n FROM s GROUP BY entry_session)) AS maximum_new_trades_in_session, round(sum(net), 6) + 0.0 AS net_pnl_usd, round(avg((net > 0)::INT), 6) AS win_rate FROM s""",
)
def portfolio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the budgeted portfolio (A10)."""
    order = [-F.col("entry_relative_volume"), F.col("complexity_tier"), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]]
    done = BD.budget_totals(views.trades(spark, sf_dir), ["entry_session"], "algebra_group", order, "net_pnl_usd")
    return settle(BD.portfolio_metrics(done))


@query(
    "strategy_distribution",
    settle_sql(
        f"{_SCORE}, b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY spread_id ORDER BY {EVIDENCE_ORDER}) = 1)"
        " SELECT strategy_id, count(*) AS selected_structures, count(*) FILTER (status = 'VALIDATED') AS validated_structures, sum(oos)::BIGINT AS oos_trades, sum(net) AS oos_net_pnl_usd FROM b GROUP BY 1",
        "strategy_id, selected_structures, validated_structures, oos_trades", "oos_net_pnl_usd",
    ),
)
def strategy_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each strategy is selected, with its evidence."""
    done = BD.strategy_distribution(SC.best_strategies(trial_scores(spark, sf_dir)))
    return settle(done.select("strategy_id", "selected_structures", "validated_structures", "oos_trades", "oos_net_pnl_usd"))


def _legs_sql(columns: str) -> str:
    """Legs of the newest package per structure as rows."""
    values = ", ".join(
        f"('{s.spread_id}', {i}, {g.sign}, {g.contracts}, {float(g.price_weight)}::DOUBLE)" for s in STRUCTURES for i, g in enumerate(s.legs, start=1)
    )
    return f"""lt AS (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY spread_id ORDER BY d DESC) = 1),
lw(spread_id, ord, sgn, lots, pw) AS (VALUES {values}),
ll AS (SELECT lt.spread_id, lt.d, n_legs, sgn, lots, pw, string_split(roll_id, ' | ')[ord] AS security FROM lt JOIN lw USING (spread_id))"""


@query(
    "depth_capacity",
    settle_sql(
        f"""{PACKS}, {_legs_sql('')}, qs AS (SELECT security, d AS qd, vol AS bid, events * 5 AS ask FROM cbars QUALIFY row_number() OVER (PARTITION BY security ORDER BY d DESC) = 1),
        j AS (SELECT ll.*, qd, CASE WHEN sgn > 0 THEN ask ELSE bid END / lots AS b, CASE WHEN sgn > 0 THEN bid ELSE ask END / lots AS s, greatest(0, date_diff('day', qd, d) * 1440.0) AS age FROM ll JOIN qs USING (security)),
        g AS (SELECT spread_id, min(b) AS b, min(s) AS s, max(age) AS age FROM j GROUP BY spread_id, n_legs HAVING count(*) = n_legs)
        SELECT spread_id, b AS buy_package_depth, s AS sell_package_depth, (b - s) / nullif(b + s, 0) AS package_depth_imbalance, age AS depth_snapshot_age_minutes, CAST(coalesce(age <= 15, false) AS BIGINT) AS depth_fresh,
          CAST(coalesce(age <= 15 AND least(b, s) >= 1, false) AS BIGINT) AS depth_supports_one_package FROM (SELECT DISTINCT spread_id FROM lt) LEFT JOIN g USING (spread_id)""",
        "spread_id, depth_fresh, depth_supports_one_package", "buy_package_depth, sell_package_depth, package_depth_imbalance, depth_snapshot_age_minutes",
    ),
)
def depth_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages the newest leg quotes can fill on each side."""
    m = views.market(spark, sf_dir)
    quotes = BD.latest_quotes(views.contract_bars(spark, sf_dir).select(
        "security", F.col("timestamp_utc").alias("time"), F.col("volume_contracts").alias("bid_size"), (F.col("num_events") * 5).alias("ask_size")
    ))
    return settle(BD.package_depth(latest_by(m.raw_packages, "spread_id", "timestamp_utc"), quotes).drop("depth_source"))


@query(
    "forecast_recombination",
    settle_sql(
        f"""{PACKS}, {_legs_sql('')}, fc AS (SELECT security, d AS fd, close * 0.001 * k AS mv FROM prep QUALIFY row_number() OVER (PARTITION BY security ORDER BY d DESC) = 1),
        j AS (SELECT ll.*, CASE WHEN fd = d THEN sgn * pw * mv END AS mv FROM ll LEFT JOIN fc USING (security)),
        g AS (SELECT spread_id, d, n_legs, count(mv) AS have, sum(mv) AS total FROM j GROUP BY ALL)
        SELECT spread_id, strftime(d, '%Y-%m-%d') AS session_date, CASE WHEN have = n_legs THEN total END AS forecast_expected_move_1b, have / n_legs AS forecast_contract_coverage,
          CASE WHEN have = n_legs AND total >= 0.05 THEN 1 WHEN have = n_legs AND total <= -0.05 THEN -1 ELSE 0 END AS forecast_vote,
          CASE WHEN have = n_legs THEN 'EXPERIMENTAL_EVALUATION_REQUIRED' ELSE 'INCOMPLETE_LEG_FORECASTS' END AS forecast_status FROM g""",
        "spread_id, session_date, forecast_vote, forecast_status", "forecast_expected_move_1b, forecast_contract_coverage",
    ),
)
def forecast_recombination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leg forecasts at the exact origin, recombined by package weights."""
    m = views.market(spark, sf_dir)
    forecasts = m.prepared.select(
        "security", F.col("timestamp_utc").alias("forecast_origin_utc"), F.lit(1).alias("forecast_step"), (F.col("close") * 0.001).alias("predicted_close_move_native")
    )
    latest = latest_by(m.raw_packages, "spread_id", "timestamp_utc").withColumn("ewma_abs_change", F.lit(0.1))
    out = BD.recombine_forecasts(latest, forecasts, C.root_table(spark, ROOTS))
    return settle(out.select("spread_id", F.to_date("timestamp_utc").alias("session_date"), "forecast_vote", "forecast_status", "forecast_expected_move_1b", "forecast_contract_coverage"))


_NAMES = "{'HO': 'HO', 'CL': 'WTI', 'QS': 'Gasoil'}"


@query(
    "trade_codes",
    f"""{PACKS}, lt AS (SELECT pk.*, family FROM pk QUALIFY row_number() OVER (PARTITION BY spread_id ORDER BY d DESC) = 1),
      c AS (SELECT spread_id, family, n_legs, string_split(roll_id, ' | ') AS secs FROM lt),
      x AS (SELECT *, list_sort(list_distinct(list_transform(secs, lambda s: make_date(2000 + s[-2:]::INT, instr('FGHJKMNQUVXZ', s[3:3]), 1)))) AS months,
          list_aggregate(list_distinct(list_transform(secs, lambda s: s[1:2])), 'min') AS lo, list_sort(list_distinct(list_transform(secs, lambda s: s[1:2]))) AS roots, secs[1][1:2] AS r1, secs[2][1:2] AS r2 FROM c),
      y AS (SELECT *, list_aggregate(list_transform(months, lambda m: strftime(m, '%b%y')), 'string_agg', '/') AS full_path,
          CASE WHEN len(list_distinct(list_transform(months, lambda m: year(m)))) = 1 THEN list_aggregate(list_transform(months, lambda m: strftime(m, '%b')), 'string_agg', '/') ELSE list_aggregate(list_transform(months, lambda m: strftime(m, '%b%y')), 'string_agg', '/') END AS short_path,
          CASE WHEN roots = ['HO', 'QS'] THEN CASE n_legs WHEN 2 THEN 'HOGO (HO-Gasoil)' ELSE 'HOGO Box' END WHEN family = 'Crack' THEN 'HO/WTI Crack' WHEN family = 'Crack Curve' THEN 'HO/WTI Crack Box'
            ELSE CASE r1 WHEN 'HO' THEN 'HO' WHEN 'CL' THEN 'WTI' ELSE 'Gasoil' END || ' ' || family END AS suffix FROM x)
      SELECT spread_id, full_path || ' ' || suffix AS trade_code, short_path || ' ' || suffix AS trade_code_short,
        CASE WHEN roots = ['HO', 'QS'] OR roots = ['HO'] THEN 'cpg' ELSE 'USD/bbl' END AS display_unit,
        CASE WHEN roots = ['HO', 'QS'] THEN 'HOGO_CPG' WHEN roots = ['HO'] THEN 'HO_CPG' WHEN family LIKE '%Crack%' THEN 'CRACK_USD_BBL' ELSE 'NORMALIZED_USD_BBL' END AS quote_convention FROM y""",
)
def trade_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable codes and display units of the newest packages."""
    latest = latest_by(views.market(spark, sf_dir).raw_packages, "spread_id", "timestamp_utc")
    out = BD.with_trade_codes(latest, ROOTS)
    return settle(out.select("spread_id", "trade_code", "trade_code_short", "display_unit", "quote_convention"))


_HOUR_TRIALS = 45


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board as of every bar, under the evidence of all trades."""

    def build() -> DataFrame:
        trades = learning.hour_trades(spark, sf_dir).withColumns(
            {"complexity_tier": F.lit(1), "algebra_group": F.col("spread_id")}
        )
        s = learning.HOURLY
        score = SC.scorecard(trades, _HOUR_TRIALS, s.evidence)
        latest = learning.hour_voted(spark, sf_dir).withColumns(
            {
                "model_enabled": ~((F.col("spread_id") > "v") & (F.dayofmonth("session_date") % 7 == 0)),
                "complexity_tier": F.dayofmonth("session_date") % 3 + 1, "algebra_group": F.when(F.col("spread_id").between("d", "q"), "X").otherwise(F.substring("spread_id", 1, 1)),
            }
        )
        board = BD.signal_board(latest, score, None, s.board, s.gate, s.learner)
        return BD.board_budget(board, s.board, ["timestamp_utc"])

    return stage(spark, "hour-board", sf_dir, build)


def hour_score_sql(gates: bool = False) -> str:
    """The hourly ledger's trades as ``ph`` and their scorecard ``sc``."""
    return f"""{learning.ledger_sql(gates)},
ph AS (SELECT spread_id, strategy_id, phase, CASE WHEN phase = 'OOS' THEN fin END AS fold, xsd AS exit_session, esd AS entry_session, gross, net, paid AS cost, gross - 2 * paid AS net2, gross - 3 * paid AS net3,
  held AS holding_bars, reason AS exit_reason, CASE WHEN pos > 0 THEN 'LONG' ELSE 'SHORT' END AS direction, 1 AS complexity_tier FROM tr),
{score_sql(learning.HOURLY.evidence, _HOUR_TRIALS)}"""


_BOARD = f"""{hour_score_sql()},
rk AS (SELECT spread_id, list({{'s': strategy_id, 'ok': status = 'VALIDATED', 'net': net}} ORDER BY {EVIDENCE_ORDER}) AS trials FROM sc GROUP BY 1),
bd0 AS (SELECT hv.*, rolling_median AS med, coalesce(0.7 * rolling_median + 0.3 * (x + smove), rolling_median, x + smove) AS fair, 1.4826 * rolling_mad AS scale, coalesce(trials, []) AS trials, slot + 1.0 AS cost, day(session_date) % 3 + 1 AS tier, NOT (hv.spread_id > 'v' AND day(session_date) % 7 = 0) AS enabled,
   CASE WHEN hv.spread_id BETWEEN 'd' AND 'q' THEN 'X' ELSE hv.spread_id[1:1] END AS grp, MAP({[x.strategy_id for x in STRATEGIES]}, [{', '.join(learning._V)}, regime_vote, adaptive_vote]) AS votes,
   CASE WHEN relvol IS NULL OR relvol < 0.35 THEN 'LOW_RELATIVE_VOLUME' WHEN cap < 1 THEN 'INSUFFICIENT_EXECUTABLE_CAPACITY' WHEN cap > 2 AND cap - 2 > 30 THEN 'WIDE_MARKET' ELSE 'PASS' END AS gate
  FROM hv JOIN (SELECT spread_id, t, rolling_median, rolling_mad FROM z3) z3 USING (spread_id, t) LEFT JOIN rk ON rk.spread_id = hv.spread_id),
bd1 AS (SELECT *, list_filter(trials, lambda q: q.ok AND votes[q.s] <> 0)[1].s AS backed FROM bd0),
bd2 AS (SELECT *, coalesce(backed, CASE WHEN adaptive_vote <> 0 THEN 'ADAPTIVE_EXPERT_MIX' ELSE 'REGIME_ENSEMBLE' END) AS strategy, CASE WHEN backed IS NOT NULL THEN votes[backed] WHEN adaptive_vote <> 0 THEN adaptive_vote ELSE regime_vote END AS dir,
   greatest(0, least(0.95, 0.38 + 0.1 * least(3, greatest(longs, shorts)) + 0.12 * least(2.0, coalesce(relvol, 0)) / 2 + 0.08 * least(3.0, abs(coalesce(z, 0))) / 3) - 0.04 * (tier - 1)) AS heur FROM bd1),
bd3 AS (SELECT *, least(0.75, CASE WHEN adaptive_vote <> 0 THEN coalesce(confidence, heur) ELSE heur END) AS conf, len(list_filter(trials, lambda q: q.ok AND q.s = strategy)) > 0 AS proven,
   CASE WHEN dir <> 0 AND x IS NOT NULL AND fair IS NOT NULL THEN greatest(0, dir * (fair - x)) ELSE 0 END * 1000 / (2 * cost) AS edge FROM bd2),
bd AS (SELECT *, CASE WHEN NOT enabled THEN 'ANALYTIC ONLY' WHEN slot = 5 THEN 'EXPIRY BLOCK' WHEN gate <> 'PASS' THEN 'NO TRADE' WHEN coalesce(alarm, false) THEN 'REGIME BLOCK' WHEN dir <> 0 AND edge < 3 THEN 'WATCH'
    WHEN dir > 0 AND conf >= 0.58 AND proven THEN 'BUY' WHEN dir < 0 AND conf >= 0.58 AND proven THEN 'SELL' WHEN longs > 0 OR shorts > 0 THEN 'WATCH' ELSE 'FLAT' END AS status,
   CASE WHEN NOT enabled THEN 'ANALYTIC_ONLY' WHEN coalesce(alarm, false) THEN 'STRUCTURAL_BREAK' WHEN seen < 5 THEN 'WARMUP' WHEN adaptive_vote > 0 THEN 'BULLISH_CONSENSUS' WHEN adaptive_vote < 0 THEN 'BEARISH_CONSENSUS' WHEN longs > 0 AND shorts > 0 THEN 'MIXED_PATTERN'
    WHEN longs >= 2 THEN 'BULLISH_CLUSTER' WHEN shorts >= 2 THEN 'BEARISH_CLUSTER' WHEN longs = 1 THEN 'BULLISH_FRAGMENT' WHEN shorts = 1 THEN 'BEARISH_FRAGMENT' ELSE 'NO_PATTERN' END AS pattern FROM bd3),
act AS (SELECT spread_id, t, grp, row_number() OVER (PARTITION BY t, grp ORDER BY round(conf, 6) DESC, edge DESC, round(abs(score), 6) DESC, coalesce(relvol, 0) DESC, tier, spread_id) AS r1, round(conf, 6) AS c, edge, round(abs(score), 6) AS ps, relvol, tier FROM bd WHERE status IN ('BUY', 'SELL') AND proven),
win AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY c DESC, edge DESC, ps DESC, coalesce(relvol, 0) DESC, tier, spread_id) AS r2 FROM act WHERE r1 = 1)
"""


@query(
    "signal_board",
    settle_sql(
        f"""{_BOARD} SELECT bd.spread_id, strftime(bd.t, '%Y-%m-%d %H:%M:%S') AS timestamp_utc, status, strategy AS signal_strategy_id, dir AS direction, conf AS confidence, edge AS expected_edge_to_cost, med - 1.8 * scale AS buy_entry_ceiling, med + 1.8 * scale AS sell_entry_floor,
          fair AS fair_value_target, x - 2.5 * coalesce(ew, 0) AS long_stop, x + 2.5 * coalesce(ew, 0) AS short_stop, pattern AS pattern_state, longs || ' long / ' || shorts || ' short; top=' || [{', '.join(f"'{e}'" for e in learning._SHORT)}][list_position(w, list_max(w))] AS pattern_components,
          CASE WHEN trials[1].ok THEN 'A - VALIDATED' WHEN coalesce(trials[1].net, 0) > 0 THEN 'B - POSITIVE RESEARCH' ELSE 'C - INSUFFICIENT EVIDENCE' END AS oos_grade, gate AS liquidity_gate, proven::BIGINT AS direction_evidence_validated, floor(cap)::BIGINT AS max_packages,
          CASE WHEN status IN ('BUY', 'SELL') AND proven THEN CASE WHEN a.r1 = 1 AND w1.r2 <= 3 THEN 'SELECTED' WHEN w1.r2 <= 3 THEN 'DUPLICATE_ALGEBRA_GROUP' ELSE 'DAILY_TRADE_BUDGET' END WHEN status = 'WATCH' THEN 'WATCH_ONLY' ELSE 'NOT_ACTIONABLE' END AS portfolio_action
        FROM bd LEFT JOIN (SELECT spread_id, t, r1 FROM act) a ON a.spread_id = bd.spread_id AND a.t = bd.t LEFT JOIN (SELECT t, grp, r2 FROM win) w1 ON w1.t = bd.t AND w1.grp = bd.grp""",
        "spread_id, timestamp_utc, status, signal_strategy_id, direction, pattern_state, pattern_components, oos_grade, liquidity_gate, portfolio_action, direction_evidence_validated, max_packages",
        "confidence, expected_edge_to_cost, buy_entry_ceiling, sell_entry_floor, fair_value_target, long_stop, short_stop", nudge=True,
    ),
)
def signal_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal of every series and bar: levels, confidence, edge, status and budget."""
    return settle(_board(spark, sf_dir).select(
        "spread_id", "timestamp_utc", "status", "signal_strategy_id", "direction", "confidence", "expected_edge_to_cost", "buy_entry_ceiling",
        "sell_entry_floor", "fair_value_target", "long_stop", "short_stop", "pattern_state", "pattern_components", "oos_grade", "liquidity_gate",
        "direction_evidence_validated", "max_packages", "portfolio_action",
    ), nudge=True)


@query("package_board")
def package_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board, trade codes, display levels, summaries and briefs of the package pipeline."""
    m = views.market(spark, sf_dir)
    latest = latest_by(m.voted, "spread_id", "timestamp_utc")
    board = BD.board_budget(BD.signal_board(latest, m.scorecard, None, m.settings.board, m.settings.gate, m.settings.learner), m.settings.board)
    shown = BD.with_display_levels(BD.with_trade_codes(board, ROOTS))
    selected = SC.best_strategies(m.scorecard)
    recent = SC.recent_metrics(SC.selected_trades(m.trades, selected, F.lit("1900-01-01").cast("date"), F.lit("2100-01-01").cast("date")))
    briefs = BD.with_description(BD.structure_summaries(shown, selected, recent))
    return settle(briefs.select(
        "spread_id", "trade_code", "current_status", "display_unit", "display_current", "display_fair_value", "technical_bias", "level_position",
        "recent_30_trades", "portfolio_action", "summary_description",
    ))


@query(
    "chart_history",
    settle_sql(
        f"WITH {ctes.HBARS}, b AS (SELECT *, max(session_date) OVER () AS ls, row_number() OVER (PARTITION BY spread_id, session_date ORDER BY t DESC) AS r FROM hp)"
        " SELECT spread_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS timestamp_utc, x AS spread_close FROM b WHERE session_date = ls OR r = 1",
        "spread_id, timestamp_utc", "spread_close",
    ),
)
def chart_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier closes plus the newest session's bars."""
    rows = BD.session_closes_and_latest(views.hour_packages(spark, sf_dir), ["spread_close"])
    return settle(rows.select("spread_id", "timestamp_utc", "spread_close"))


@query(
    "product_rollup",
    settle_sql(
        f"""{_SCORE}, b AS (SELECT spread_id, strategy_id, status, win, net, CASE WHEN win >= 0.55 THEN 'HIGH' WHEN win >= 0.5 THEN 'MIDDLE' ELSE 'LOW' END AS state FROM sc),
        s AS (SELECT strategy_id, state, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY n DESC, state) AS r FROM s)
        SELECT strategy_id AS product, count(*) AS structures, median(win) AS median_confidence, sum(net) AS recent_net, any_value(x.top_risk) AS top_risk
        FROM b JOIN (SELECT strategy_id, string_agg(state || ' ' || n, ', ' ORDER BY r) AS top_risk FROM t WHERE r <= 3 GROUP BY 1) x USING (strategy_id) GROUP BY 1""",
        "product, structures, top_risk", "median_confidence, recent_net",
    ),
)
def product_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter totals with the three most frequent states."""
    win = F.col("win_rate")
    rows = trial_scores(spark, sf_dir).select(
        "strategy_id", F.lit("NONE").alias("pattern_state"), win.alias("confidence"), F.col("net_pnl_usd").alias("recent_30_net_pnl_usd"),
        F.when(win >= 0.55, "HIGH").when(win >= 0.5, "MIDDLE").otherwise("LOW").alias("advanced_risk_regime"),
    )
    return settle(BD.product_rollup(rows, F.col("strategy_id")).drop("consensus"))


@query(
    "context_arrays",
    f"""WITH {ctes.HBARS}, l AS (SELECT * FROM hp QUALIFY row_number() OVER (PARTITION BY spread_id ORDER BY t DESC) <= 260)
      SELECT spread_id, count(*) AS bars, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first_bar, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last_bar, round(sum(x), 4) AS close_sum, sum(hour(t))::BIGINT AS hour_sum
      FROM l GROUP BY 1 HAVING count(*) = 260""",
)
def context_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 260 bars per series as arrays with time features."""
    from curvelab.operators.reports import context_windows

    windows = context_windows(views.hour_packages(spark, sf_dir), "spread_id", "timestamp_utc", 260, ["spread_close"])
    return settle(windows.select(
        "spread_id",
        F.size("context").alias("bars"),
        F.get("context.time", F.lit(0)).alias("first_bar"),
        F.get("context.time", F.size("context") - 1).alias("last_bar"),
        F.aggregate("context.spread_close", F.lit(0.0), lambda a, v: a + v).alias("close_sum"),
        F.aggregate("context.hour", F.lit(0).cast("long"), lambda a, v: a + v).alias("hour_sum"),
    ), dp=4)




_LOCK_ORDER = "(status <> 'VALIDATED')::INT, dsr DESC, share DESC, daily_sharpe DESC, relvol DESC, complexity_tier, entry_session, spread_id"


@query(
    "lockbox_budget",
    f"""{_SCORE}, best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY spread_id ORDER BY {EVIDENCE_ORDER}) = 1),
      t AS (SELECT ph.entry_session, ph.algebra_group, ph.spread_id, ph.relvol, ph.complexity_tier, b.status, b.dsr, b.share, b.daily_sharpe FROM ph JOIN best b ON b.spread_id = ph.spread_id AND b.strategy_id = ph.strategy_id WHERE ph.phase = 'LOCKBOX'),
      g AS (SELECT *, row_number() OVER (PARTITION BY entry_session, algebra_group ORDER BY {_LOCK_ORDER}) AS r1 FROM t),
      w AS (SELECT entry_session, algebra_group, row_number() OVER (PARTITION BY entry_session ORDER BY {_LOCK_ORDER}) AS r2 FROM g WHERE r1 = 1)
      SELECT strftime(g.entry_session, '%Y-%m-%d') AS entry_session, g.algebra_group, CASE WHEN r1 = 1 AND r2 <= 3 THEN 'SELECTED' WHEN r2 <= 3 THEN 'DUPLICATE_ALGEBRA_GROUP' ELSE 'DAILY_TRADE_BUDGET' END AS portfolio_action, count(*) AS trades
      FROM g JOIN w USING (entry_session, algebra_group) GROUP BY ALL""",
)
def lockbox_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry budget over the lockbox trades of the frozen strategies."""
    best = SC.best_strategies(trial_scores(spark, sf_dir)).select(
        "spread_id", "strategy_id", F.col("status").alias("selected_strategy_status"), F.col("deflated_sharpe_probability").alias("model_deflated_sharpe_probability"),
        F.col("profitable_fold_share").alias("model_profitable_fold_share"), F.col("daily_sharpe").alias("model_daily_sharpe"),
    )
    done = BD.lockbox_budget(views.phased_trades(spark, sf_dir), best)
    return settle(done.select("entry_session", "algebra_group", "portfolio_action", "trades"))
