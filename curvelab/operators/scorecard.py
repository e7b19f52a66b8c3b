"""Scorecards from trades: pre-aggregated by day before anything is ordered."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelab.config import STRATEGIES, Strategy
from curvelab.functions import stats as S
from curvelab.scale import running_total
from curvelab.stages import write_stage


@dataclass(frozen=True)
class Evidence:
    """What a trial must show to be validated, and the sessions of a year."""

    # Fixed values.
    minimum_oos_trades: int = 20
    minimum_profit_factor: float = 1.10
    minimum_profitable_fold_share: float = 0.60
    minimum_probability_sharpe: float = 0.95
    annual_sessions: int = 252


def daily_pnl(trades: DataFrame, keys: Sequence[str], day: str = "exit_session", net: str = "net_pnl_usd") -> DataFrame:
    """One row per key and day, summed map-side; at most one row per calendar day and key."""
    return trades.groupBy(*keys, F.col(day).alias("day")).agg(F.sum(net).alias("pnl"))


def daily_metrics(daily: DataFrame, keys: Sequence[str], p: Evidence = Evidence(), trials: int = 2) -> DataFrame:
    """Sharpe, Sortino, drawdown, Calmar and the deflated Sharpe probability per key."""
    order = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    all_days = Window.partitionBy(*keys)
    curve = daily.withColumns(
        {
            "_equity": F.sum("pnl").over(order),
            "_mean": F.avg("pnl").over(all_days),
            "_std": F.stddev_samp("pnl").over(all_days),
        }
    )
    peak = F.greatest(F.max("_equity").over(order), F.lit(0.0))
    z = S.ratio(F.col("pnl") - F.col("_mean"), F.nullif(F.col("_std"), F.lit(0.0)))
    below = F.when(F.col("pnl") < 0, F.col("pnl"))
    grouped = (
        curve.withColumns({"_fall": F.col("_equity") - peak, "_z": z})
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.avg("pnl").alias("_m"),
            F.coalesce(F.max("_std"), F.lit(0.0)).alias("_s"),
            F.coalesce(F.stddev_samp(below), F.lit(0.0)).alias("_ds"),
            F.abs(F.min("_fall")).alias("max_drawdown_usd"),
            F.avg(F.col("_z") * F.col("_z") * F.col("_z")).alias("_skew"),
            F.avg(F.col("_z") * F.col("_z") * F.col("_z") * F.col("_z")).alias("_kurt"),
        )
    )
    root = math.sqrt(p.annual_sessions)
    m, s = F.col("_m"), F.col("_s")
    sharpe = S.ratio(m, F.nullif(s, F.lit(0.0)))
    variance = (1.0 - F.col("_skew") * sharpe + (F.col("_kurt") - 1.0) / 4.0 * sharpe * sharpe) / F.greatest(
        F.lit(1), F.col("_n") - 1
    )
    error = F.sqrt(F.greatest(variance, F.lit(1e-12)))
    score = sharpe / error - F.lit(S.expected_maximum_factor(trials))
    out = grouped.withColumns(
        {
            "daily_sharpe": F.coalesce(sharpe * root, F.lit(0.0)),
            "daily_sortino": F.coalesce(S.ratio(m, F.nullif(F.col("_ds"), F.lit(0.0))) * root, F.lit(0.0)),
            "calmar": F.coalesce(S.ratio(m * p.annual_sessions, F.nullif(F.col("max_drawdown_usd"), F.lit(0.0))), F.lit(0.0)),
            "_score": score,
        }
    )
    probability = F.when((F.col("_n") >= 3) & (s > 0), S.normal_cdf(F.col("_score"))).otherwise(0.0)
    return out.withColumn("deflated_sharpe_probability", probability).drop(
        "_n", "_m", "_s", "_ds", "_skew", "_kurt", "_score"
    )


def profit_factor(wins: Column, losses: Column) -> Column:
    """Gains over losses; 99 where nothing was lost, 0 where nothing was won or lost."""
    return F.when(F.abs(losses) > 0, wins / F.abs(losses)).when(wins > 0, 99.0).otherwise(0.0)


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, name: str, count: Column | None = None) -> DataFrame:
    """Median from value counts (or sums of ``count``), combined before the shuffle."""
    counts = df.groupBy(*keys, value).agg((F.count(F.lit(1)) if count is None else F.sum(count)).alias("_n"))
    return counts.groupBy(*keys).agg(F.expr(f"percentile({value}, 0.5, _n)").alias(name))


KEYS = ("spread_id", "strategy_id")


def trade_days(trades: DataFrame) -> DataFrame:
    """Totals and counts of held bars per trial, phase, fold and exit day, combined before the only shuffle of trades.

    A scorecard needs nothing else of the trades; this table is written once, and its
    readers scan it by column.
    """
    net = F.col("net_pnl_usd")
    sum_if = lambda test: F.sum(F.when(test, net).otherwise(F.lit(0.0)))
    held = trades.groupBy(*KEYS, "phase", "fold", F.col("exit_session").alias("day"), "holding_bars").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("gross_pnl_usd").alias("_gross"), F.sum(net).alias("_net"), F.sum("cost_usd").alias("_cost"),
        F.sum("pnl_2x_cost_usd").alias("_net2"), F.sum("pnl_3x_cost_usd").alias("_net3"), F.count_if(net > 0).alias("_won"),
        sum_if(net > 0).alias("_wins"), sum_if(net < 0).alias("_losses"), F.count_if(F.col("exit_reason") == "MANDATORY_D4_EXIT").alias("_exits"),
        sum_if(F.col("direction") == "LONG").alias("_long"), sum_if(F.col("direction") == "SHORT").alias("_short"),
        F.min("complexity_tier").alias("complexity_tier"), F.min("algebra_group").alias("algebra_group"),
    )
    return write_stage(held, "trade-days")


def evaluation_days(days: DataFrame) -> DataFrame:
    """OOS days of a trial, or all its days where it has none out of sample."""
    has = days.groupBy(*KEYS).agg(F.max((F.col("phase") == "OOS").cast("int")).alias("_has_oos"))
    return days.join(has, list(KEYS)).filter((F.col("_has_oos") == 0) | (F.col("phase") == "OOS"))


def fold_days(trades: DataFrame, *marks: str) -> DataFrame:
    """Trades and net per trial, fold, exit day and ``marks`` out of sample, written once for all readers."""
    oos = trades.filter((F.col("phase") == "OOS") & F.col("fold").isNotNull())
    days = oos.groupBy(*KEYS, "fold", F.col("exit_session").alias("day"), *marks).agg(F.count(F.lit(1)).alias("_n"), F.sum("net_pnl_usd").alias("_net"))
    return write_stage(days, "fold-days")


def fold_results(days: DataFrame, p: Evidence = Evidence()) -> DataFrame:
    """Trades, net, Sharpe and drawdown per fold of ``fold_days``."""
    keys = [*KEYS, "fold"]
    counts = days.groupBy(*keys).agg(F.sum("_n").alias("trades"), F.sum("_net").alias("net_pnl_usd"))
    metrics = daily_metrics(daily_pnl(days, keys, "day", "_net"), keys, p)
    return counts.join(metrics.select(*keys, F.col("daily_sharpe").alias("sharpe"), "max_drawdown_usd"), keys)


def fold_metrics(trades: DataFrame, p: Evidence = Evidence()) -> DataFrame:
    """Trades, net, Sharpe and drawdown per OOS fold."""
    return fold_results(fold_days(trades), p)


def minimum_trades(tier: Column, p: Evidence) -> Column:
    return F.ceil(F.lit(p.minimum_oos_trades) * (1.0 + 0.5 * (tier - 1))).cast("int")


def scorecard(trades: DataFrame, trials: int, p: Evidence = Evidence()) -> DataFrame:
    """One row per (structure, strategy) with evidence and status.

    The lockbox is reported and takes no part in the status.
    """
    keys, days = list(KEYS), trade_days(trades)
    scope = evaluation_days(days)
    n, net = F.col("_n"), F.col("_net")
    sum_if = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0))
    totals = scope.groupBy(*keys).agg(
        F.sum(n).alias("trades"),
        F.max("_has_oos").alias("_has_oos"),
        F.sum("_gross").alias("gross_pnl_usd"),
        F.sum(net).alias("net_pnl_usd"),
        F.sum("_cost").alias("cost_drag_usd"),
        F.sum("_net2").alias("net_pnl_2x_cost_usd"),
        F.sum("_net3").alias("net_pnl_3x_cost_usd"),
        (F.sum("_won") / F.sum(n)).alias("win_rate"),
        F.sum("_wins").alias("_wins"),
        F.sum("_losses").alias("_losses"),
        (F.sum(net) / F.sum(n)).alias("expectancy_usd"),
        F.sum("_exits").alias("expiry_exits"),
        F.sum("_long").alias("long_net_pnl_usd"),
        F.sum("_short").alias("short_net_pnl_usd"),
        F.min("complexity_tier").alias("complexity_tier"),
        F.min("algebra_group").alias("algebra_group"),
    )
    every = days.groupBy(*keys).agg(
        sum_if(F.col("phase") == "OOS", "_n").alias("oos_trades"),
        sum_if(F.col("phase") == "LOCKBOX", "_n").alias("lockbox_trades"),
        sum_if(F.col("phase") == "LOCKBOX", "_net").alias("lockbox_net_pnl_usd"),
    )
    per_fold = (
        days.filter((F.col("phase") == "OOS") & F.col("fold").isNotNull())
        .groupBy(*keys, "fold")
        .agg(F.sum(net).alias("_fold_net"))
        .groupBy(*keys)
        .agg(F.avg((F.col("_fold_net") > 0).cast("double")).alias("_share"))
    )
    joined = (
        totals.join(every, keys)
        .join(per_fold, keys, "left")
        .join(weighted_median(scope, keys, "holding_bars", "median_holding_bars", n), keys)
        .join(daily_metrics(daily_pnl(scope, keys, "day", "_net"), keys, p, trials), keys)
        .withColumns(
            {
                "profitable_fold_share": F.coalesce("_share", F.lit(0.0)),
                "profit_factor": profit_factor(F.col("_wins"), F.col("_losses")),
                "minimum_oos_trades_hurdle": minimum_trades(F.col("complexity_tier"), p),
                "evaluation_scope": F.when(F.col("_has_oos") == 1, "OOS").otherwise("ALL_PROVISIONAL"),
                "lockbox_used_for_selection": F.lit(False),
                "trial_id": F.concat_ws("|", *keys),
            }
        )
    )
    passes = (
        (F.col("oos_trades") >= F.col("minimum_oos_trades_hurdle"))
        & (F.col("profitable_fold_share") >= p.minimum_profitable_fold_share)
        & (F.col("profit_factor") >= p.minimum_profit_factor)
        & (F.col("deflated_sharpe_probability") >= p.minimum_probability_sharpe)
        & (F.col("net_pnl_usd") > 0)
    )
    return joined.withColumn("status", F.when(passes, "VALIDATED").otherwise("RESEARCH_ONLY")).drop(
        "_has_oos", "_share", "_wins", "_losses"
    )


ZERO_COLUMNS = (
    "trades", "oos_trades", "lockbox_trades", "gross_pnl_usd", "net_pnl_usd", "lockbox_net_pnl_usd", "cost_drag_usd",
    "net_pnl_2x_cost_usd", "net_pnl_3x_cost_usd", "daily_sharpe", "daily_sortino", "max_drawdown_usd", "calmar",
    "win_rate", "profit_factor", "expectancy_usd", "median_holding_bars", "profitable_fold_share",
    "deflated_sharpe_probability", "expiry_exits", "long_net_pnl_usd", "short_net_pnl_usd",
)


def complete_scorecard(
    score: DataFrame, structures: DataFrame, observed: DataFrame, strategies: Sequence[Strategy] = STRATEGIES,
    p: Evidence = Evidence(),
) -> DataFrame:
    """Every registered trial counts: trials without trades are added with zeros.

    ``observed`` holds the structures that have data.  The grid is the registry with its
    strategy list exploded, so its size is known.
    """
    ids = F.array(*[F.lit(s.strategy_id) for s in strategies])
    grid = structures.filter("model_enabled").select(
        "spread_id", "complexity_tier", "algebra_group", F.explode(ids).alias("strategy_id")
    )
    seen = observed.select("spread_id").distinct().withColumn("_seen", F.lit(True))
    missing = grid.join(score.select(*KEYS), list(KEYS), "left_anti").join(seen, "spread_id", "left")
    kinds = {f.name: f.dataType for f in score.schema.fields}
    filled = missing.select(
        *KEYS, "complexity_tier", "algebra_group",
        F.concat_ws("|", *KEYS).alias("trial_id"),
        minimum_trades(F.col("complexity_tier"), p).alias("minimum_oos_trades_hurdle"),
        F.when(F.col("_seen"), "NO_TRADES").otherwise("NO_DATA").alias("status"),
        F.lit("OOS").alias("evaluation_scope"),
        F.lit(False).alias("lockbox_used_for_selection"),
        *[F.lit(0).cast(kinds[c]).alias(c) for c in ZERO_COLUMNS],
    )
    return score.unionByName(filled, allowMissingColumns=True)


def rank_trials(score: DataFrame) -> DataFrame:
    """Evidence order of the trials of a structure; the group holds one row per strategy.

    Strategies that made the same trades differ by the order in which their sums were added
    only.  Evidence is compared in ten digits, so that such trials stand by their names.
    """
    order = Window.partitionBy("spread_id").orderBy(
        (F.col("status") == "VALIDATED").cast("int").desc(),
        *[S.significant(F.col(c)).desc_nulls_last() for c in ("deflated_sharpe_probability", "profitable_fold_share")],
        # A sum of gains and losses may be zero but for its last bits.
        *[S.significant(F.round(c, 9)).desc_nulls_last() for c in ("daily_sharpe", "net_pnl_usd")],
        F.col("oos_trades").desc_nulls_last(),
        F.col("strategy_id").asc_nulls_last(),
    )
    return score.withColumn("evidence_rank", F.row_number().over(order))


def best_strategies(score: DataFrame) -> DataFrame:
    """The one strategy per structure that is frozen into the model."""
    return rank_trials(score).filter(F.col("evidence_rank") == 1).drop("evidence_rank")


def selected_trades(trades: DataFrame, selected: DataFrame, start: Column, end: Column) -> DataFrame:
    """Trades of each structure's selected strategy that exit within the window."""
    keys = selected.select(*KEYS).distinct()
    return trades.join(keys, list(KEYS), "left_semi").filter((F.col("exit_session") >= start) & (F.col("exit_session") <= end))


def recent_metrics(recent: DataFrame) -> DataFrame:
    """Per-structure result of a recent window, drawdown along the trades floored at zero.

    Equity is a two-level running sum and its peak a two-level running maximum, so a
    structure with very many trades is not ordered in one task.  The window's trades are
    written once, as four steps read them.
    """
    used = (*KEYS, "entry_session", "exit_session", "exit_time", "trade_id", "gross_pnl_usd", "cost_usd", "net_pnl_usd", "direction", "holding_bars")
    recent = write_stage(recent.select(*used), "recent-trades")
    month = F.date_trunc("month", F.col("exit_session"))
    order = ["exit_time", "trade_id"]
    equity = running_total(recent, list(KEYS), order, month, {"_equity": F.col("net_pnl_usd")})
    tops = equity.withColumn("_m", month).groupBy(*KEYS, "_m").agg(F.max("_equity").alias("_top"))
    before = Window.partitionBy(*KEYS).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    earlier = tops.select(*KEYS, "_m", F.greatest(F.max("_top").over(before), F.lit(0.0)).alias("_top_before"))
    inside = Window.partitionBy(*KEYS, "_m").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fallen = (
        equity.withColumn("_m", month)
        .join(earlier, [*KEYS, "_m"])
        .withColumn("_fall", F.col("_equity") - F.greatest(F.max("_equity").over(inside), F.col("_top_before")))
    )
    net = F.col("net_pnl_usd")
    sum_if = lambda test: F.sum(F.when(test, net).otherwise(0.0))
    grouped = fallen.groupBy("spread_id").agg(
        F.count(F.lit(1)).alias("recent_30_trades"),
        F.min("entry_session").alias("recent_30_first_entry"),
        F.max("exit_session").alias("recent_30_last_exit"),
        F.sum("gross_pnl_usd").alias("recent_30_gross_pnl_usd"),
        F.sum("cost_usd").alias("recent_30_cost_usd"),
        F.sum(net).alias("recent_30_net_pnl_usd"),
        F.avg((net > 0).cast("double")).alias("recent_30_win_rate"),
        F.avg(net).alias("recent_30_expectancy_usd"),
        F.greatest(-F.min("_fall"), F.lit(0.0)).alias("recent_30_max_drawdown_usd"),
        sum_if(net > 0).alias("_wins"),
        sum_if(net < 0).alias("_losses"),
        sum_if(F.col("direction") == "LONG").alias("recent_30_long_net_pnl_usd"),
        sum_if(F.col("direction") == "SHORT").alias("recent_30_short_net_pnl_usd"),
    )
    return (
        grouped.join(weighted_median(recent, ["spread_id"], "holding_bars", "recent_30_median_holding_bars"), "spread_id")
        .withColumn("recent_30_profit_factor", profit_factor(F.col("_wins"), F.col("_losses")))
        .drop("_wins", "_losses")
    )
