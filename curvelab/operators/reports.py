"""Report tables and model-input windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelab.config import STRATEGIES
from curvelab.functions.dates import weekday
from curvelab.scale import row_index


def context_windows(bars: DataFrame, key: str, ts: str, length: int, columns: Sequence[str]) -> DataFrame:
    """The newest ``length`` complete bars per key in time order, with time features.

    Shorter histories drop out.  Rows are numbered with the two-level count, so only the
    kept rows of a key meet in one task.
    """
    whole = bars.dropna(subset=list(columns))
    numbered = row_index(whole, key, F.col(ts).desc(), -F.unix_date(F.trunc(ts, "month")), name="_back")
    kept = numbered.filter(F.col("_back") <= length)
    features = [
        F.col(ts).alias("time"), F.minute(ts).alias("minute"), F.hour(ts).alias("hour"), (weekday(F.col(ts)) - 1).alias("weekday"),
        F.day(ts).alias("day"), F.month(ts).alias("month"),
    ]
    grouped = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*features, *columns))).alias("context"))
    return grouped.filter(F.size("context") == length)


def nearest_contracts(bars: DataFrame, n: int) -> DataFrame:
    """The first ``n`` contracts per root by delivery on the newest session."""
    from curvelab.scale import top_rows

    newest = bars.agg(F.max("session_date").alias("session_date"))
    current = bars.join(newest, "session_date", "left_semi").select("root", "security", "delivery_month").distinct()
    return top_rows(current, "root", [F.col("delivery_month"), F.col("security")], n)


def parameter_catalog(spark: SparkSession, settings) -> DataFrame:
    """Every setting as (section, parameter, value)."""
    rows = []
    for section in (f.name for f in fields(settings) if f.name != "roots"):
        part = getattr(settings, section)
        rows += [(section, f.name, str(getattr(part, f.name))) for f in fields(part)]
    for root in settings.roots:
        rows += [(f"root.{root.root}", f.name, str(getattr(root, f.name))) for f in fields(root) if f.name not in ("root", "name")]
    return spark.createDataFrame(rows, "section string, parameter string, value string")


def strategy_library(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(s.strategy_id, s.name, s.family, s.maximum_holding_bars) for s in STRATEGIES],
        "strategy_id string, strategy_name string, family string, maximum_holding_bars int",
    )


#: Columns of a trade-level export in order, as far as the board has them.
EXPORT_COLUMNS = (
    "session_date", "timestamp_utc", "trade_code", "trade_code_short", "contract_codes", "contract_months", "spread_id", "spread_name",
    "spread_family", "structure_roots", "quote_convention", "status", "portfolio_action", "portfolio_selected", "portfolio_rank",
    "daily_trade_limit", "signal_strategy_id", "direction_evidence_validated", "display_unit", "display_current", "display_buy_entry",
    "display_sell_entry", "display_fair_value", "display_long_stop", "display_short_stop", "spread_close", "buy_entry_ceiling",
    "sell_entry_floor", "fair_value_target", "confidence", "pattern_state", "pattern_strength", "pattern_agreement", "pattern_components",
    "advanced_risk_regime", "regime", "expected_edge_usd", "round_trip_cost_usd", "expected_edge_to_cost", "relative_volume",
    "liquidity_gate", "package_volume_capacity", "max_leg_bid_ask_ticks", "earliest_risk_date", "forced_exit_session",
    "sessions_to_risk_date", "oos_grade",
)


def trade_level_export(board: DataFrame, settings) -> DataFrame:
    """The board as a broker reads it: its levels, and the settings they were made under.

    A board without one of the columns that a level needs is an error.
    """
    required = ("spread_id", "trade_code", "status", "portfolio_action", "portfolio_selected", "display_unit", "display_current", "display_buy_entry", "display_sell_entry", "display_fair_value")
    missing = [c for c in required if c not in board.columns]
    if missing:
        raise ValueError(f"the board has no {', '.join(missing)}")
    constants = {
        "bar_interval_minutes": settings.trading.bar_interval_minutes, "strategy_count": len(STRATEGIES),
        "untouched_lockbox_sessions": settings.folds.lockbox_sessions, "walk_forward_train_sessions": settings.folds.train_sessions,
        "walk_forward_validation_sessions": settings.folds.validation_sessions, "walk_forward_test_sessions": settings.folds.test_sessions,
        "walk_forward_embargo_sessions": settings.folds.embargo_sessions, "lockbox_used_for_training": False,
        "maximum_new_trades_per_session": settings.board.maximum_new_trades_per_session,
    }
    shown = board.select(*[c for c in EXPORT_COLUMNS if c in board.columns])
    return shown.withColumns({name: F.lit(value) for name, value in constants.items()})


def export_order() -> list:
    """Selected entries first, then by status, confidence and structure."""
    return [F.col("portfolio_selected").desc(), F.col("status"), F.col("confidence").desc(), F.col("spread_id")]


def last_bar_history(features: DataFrame, columns: Sequence[str], sessions: int = 120) -> DataFrame:
    """End-of-session rows of the newest sessions."""
    from curvelab.operators.ingest import last_sessions

    return last_sessions(features, sessions).filter(F.col("bar_slot") == F.col("session_last_slot")).select(
        "session_date", "spread_id", *columns
    )
