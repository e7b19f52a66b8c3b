"""Next-bar trade ledger per structure and strategy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelab.config import STRATEGIES
from curvelab.edge import clean
from curvelab.operators import walk
from curvelab.operators.indicators import RiskLimits
from curvelab.operators.walkforward import tag_trades
from curvelab.scale import row_index, running_total

# Exit reasons and liquidity reasons as reported.
EXIT_REASONS = (
    "", "MAX_HOLD", "FAIR_VALUE", "ROBUST_Z_STOP", "TREND_REVERSAL", "MIDDLE_BAND_REVERSAL", "VWAP_TOUCH",
    "SESSION_CLOSE", "SEASONAL_FORECAST_REVERSAL", "SEASONAL_EQUILIBRIUM", "RESIDUAL_REVERSAL", "RELATIONSHIP_BREAK",
    "FLOW_CONFIRMATION_LOST", "ENSEMBLE_COLLAPSE", "MANDATORY_D4_EXIT", "ROLL_SAFETY_PREVIOUS_CLOSE", "END_OF_SAMPLE",
)
_CODE = {name: i for i, name in enumerate(EXIT_REASONS)}
assert (walk.MAX_HOLD, walk.MANDATORY) == (_CODE["MAX_HOLD"], _CODE["MANDATORY_D4_EXIT"])


@dataclass(frozen=True)
class EntryGate:
    """Limits on volume and quotes that an entry must keep."""

    # Fixed values.
    minimum_relative_volume: float = 0.35
    maximum_volume_participation: float = 0.01
    maximum_bid_ask_ticks: float = 8.0


def liquidity_reason(p: EntryGate = EntryGate(), risk: RiskLimits | None = None) -> Column:
    """First failing liquidity test, or PASS.  With ``risk`` the candidate risk gates come first."""
    relative, capacity = F.col("relative_volume"), F.col("package_volume_capacity")
    events, width = F.col("min_leg_events"), F.col("max_leg_bid_ask_ticks")
    out = F.when(F.lit(False), F.lit(""))
    if risk is not None:
        out = out.when(F.abs("tod_normalized_change") >= risk.extreme_tod_shock_z, "EXTREME_TOD_SHOCK").when(
            F.col("robust_volume_surprise") <= risk.volume_dryness_z, "ROBUST_VOLUME_DRYNESS"
        )
    return (
        out.when(relative.isNull() | (relative < p.minimum_relative_volume), "LOW_RELATIVE_VOLUME")
        .when(
            capacity.isNull() | (capacity < 1.0) | events.isNull() | (events <= 0), "INSUFFICIENT_EXECUTABLE_CAPACITY"
        )
        .when(capacity * p.maximum_volume_participation < 1.0, "CAPACITY_BELOW_ONE_PACKAGE")
        .when(width > p.maximum_bid_ask_ticks, "WIDE_MARKET")
        .otherwise("PASS")
    )


def _ladder(*steps: tuple[Column, str]) -> Column:
    """Code of the first true condition, 0 where none is."""
    out = F.when(F.lit(False), F.lit(0))
    for test, reason in steps:
        out = out.when(F.coalesce(test, F.lit(False)), F.lit(_CODE[reason]))
    return out.otherwise(F.lit(0)).cast("tinyint")


def exit_codes(strategy_id: str, side: int, vote: str) -> Column:
    """Exit reason at a bar close for a long (1) or short (-1) position, before the holding limit."""
    c = F.col
    z, close = c("robust_z"), c("research_close")
    s = F.lit(float(side))
    alarm = F.coalesce("change_point_alarm", F.lit(False))
    if strategy_id == "ROBUST_MEAN_REVERSION":
        return _ladder((F.abs(z) <= 0.20, "FAIR_VALUE"), (s * z <= -3.25, "ROBUST_Z_STOP"))
    if strategy_id == "TREND_BREAKOUT":
        known = close.isNotNull() & c("ema_slow").isNotNull() & c("macd_histogram").isNotNull()
        turned = (s * (close - c("ema_slow")) < 0) | (s * c("macd_histogram") < 0)
        return _ladder((known & turned, "TREND_REVERSAL"))
    if strategy_id == "VOLATILITY_SQUEEZE":
        return _ladder((s * (close - c("bollinger_mid")) < 0, "MIDDLE_BAND_REVERSAL"))
    if strategy_id == "SESSION_VWAP_REVERSION":
        return _ladder(
            (s * (close - c("session_vwap_proxy")) >= 0, "VWAP_TOUCH"),
            (c("bar_slot") >= c("session_last_slot"), "SESSION_CLOSE"),
        )
    if strategy_id == "ERROR_CORRECTION_RESIDUAL":
        return _ladder(
            (s * c("seasonal_move_z") <= 0, "SEASONAL_FORECAST_REVERSAL"),
            (F.abs("seasonal_z") <= 0.35, "SEASONAL_EQUILIBRIUM"),
            (s * z > 0.35, "RESIDUAL_REVERSAL"),
        )
    if strategy_id == "STABILITY_REVERSION":
        return _ladder((alarm, "RELATIONSHIP_BREAK"), (F.abs(z) <= 0.25, "FAIR_VALUE"))
    if strategy_id == "FLOW_DIVERGENCE":
        return _ladder(
            (alarm, "RELATIONSHIP_BREAK"),
            (F.abs(z) <= 0.25, "FAIR_VALUE"),
            (s * c("signed_volume_imbalance_proxy") <= 0, "FLOW_CONFIRMATION_LOST"),
        )
    collapsed = (F.coalesce(vote, F.lit(0)) == 0) | (F.col(vote) == -side)
    return _ladder((alarm, "RELATIONSHIP_BREAK"), (collapsed, "ENSEMBLE_COLLAPSE"))


def ledger_inputs(
    features: DataFrame,
    gate: EntryGate = EntryGate(),
    risk: RiskLimits | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """Votes, exit codes and gates per bar, with the roll segment each bar belongs to.

    A position never survives a roll, so the walk starts anew in each segment.  ``bar`` numbers
    all bars of a structure and ``live`` those with an opening and a closing value; both come
    from one pass of running totals, together with the segment.
    """
    session = Window.partitionBy("spread_id", "session_date").orderBy(F.col("timestamp_utc").desc())
    last_of_session = F.row_number().over(session) == 1
    forced = (F.col("session_date") == F.col("forced_exit_session")) & (
        (F.col("bar_slot") == F.col("session_last_slot")) | last_of_session
    )
    gated = features.withColumns({"_reason": liquidity_reason(gate, risk), "_forced_last": forced})
    opened, closed = clean(F.col("package_open_value_usd")), clean(F.col("package_close_value_usd"))
    counted = running_total(
        gated, "spread_id", "timestamp_utc", F.date_trunc("month", F.col("session_date")),
        {
            "_segment": F.coalesce(F.col("roll_event").cast("double"), F.lit(0.0)), "_bar": F.lit(1.0),
            "_live": (opened.isNotNull() & closed.isNotNull()).cast("double"),
        },
        base=base, whole={"_segment": "_rolls"},
    )
    codes = {}
    for k, s in enumerate(STRATEGIES):
        codes[f"_v{k}"] = F.coalesce(F.col(s.vote), F.lit(0)).cast("tinyint")
        codes[f"_l{k}"] = exit_codes(s.strategy_id, 1, s.vote)
        codes[f"_s{k}"] = exit_codes(s.strategy_id, -1, s.vote)
    return counted.withColumns(codes).select(
        "spread_id", F.col("_segment").cast("int").alias("segment"),
        (F.col("_segment") == F.col("_rolls")).alias("last_segment"),
        F.col("_bar").cast("long").alias("bar"), F.col("_live").cast("long").alias("live"),
        F.col("timestamp_utc").cast("timestamp_ntz").alias("timestamp_utc"), "session_date", "roll_id",
        opened.alias("open_value"), closed.alias("close_value"),
        "spread_open", "spread_close", F.coalesce("one_way_cost_usd", F.lit(0.0)).alias("cost"),
        F.coalesce("entry_allowed", F.lit(False)).alias("entry_allowed"), F.col("_reason").alias("liquidity_reason"),
        F.coalesce("_forced_last", F.lit(False)).alias("forced_last"),
        "relative_volume", "package_volume_capacity", "max_leg_bid_ask_ticks",
        "earliest_risk_date", "forced_exit_session", *codes,
    )


def run_ledger(inputs: DataFrame, block: int = 4096, fan: int = 1024) -> DataFrame:
    """All trades.

    ``inputs`` should be a stored table, as both passes of the walk read it.  A position that no
    bar closes leaves at the last closing value of its segment.
    """
    found = walk.trades(inputs, [s.maximum_holding_bars for s in STRATEGIES], block, fan)
    closing = inputs.filter(F.col("close_value").isNotNull())
    last = closing.groupBy("spread_id", "segment").agg(F.max("timestamp_utc").alias("timestamp_utc"))
    ends = closing.join(last, ["spread_id", "segment", "timestamp_utc"]).select(
        "spread_id", "segment", F.lit(True).alias("at_end"), F.col("timestamp_utc").alias("_time"),
        F.col("session_date").alias("_session"), F.col("spread_close").alias("_spread"), F.col("close_value").alias("_value"),
        F.col("cost").alias("_cost"), F.when(F.col("last_segment"), "END_OF_SAMPLE").otherwise("ROLL_SAFETY_PREVIOUS_CLOSE").alias("_reason"),
    )
    # Only the few positions left open look for the end of their segment.
    met = found.withColumn("at_end", F.col("exit_time").isNull()).join(ends, ["spread_id", "segment", "at_end"], "left")
    pick = lambda own, end: F.when(F.col("at_end"), F.col(end)).otherwise(F.col(own))
    reasons, names = (F.array(*[F.lit(x) for x in xs]) for xs in (EXIT_REASONS, [s.strategy_id for s in STRATEGIES]))
    closed = met.withColumns(
        {
            "strategy_id": names[F.col("strategy")],
            "exit_time": pick("exit_time", "_time"), "exit_session": pick("exit_session", "_session"),
            "exit_spread": pick("exit_spread", "_spread"), "exit_value": pick("exit_value", "_value"), "exit_cost": pick("exit_cost", "_cost"),
            "exit_reason": F.when(F.col("at_end"), F.col("_reason")).otherwise(reasons[F.col("code")]),
        }
    )
    return priced(closed)


def priced(closed: DataFrame) -> DataFrame:
    """Results of closed positions, at once, double and triple cost."""
    side, cost = F.col("side").cast("double"), F.col("entry_cost") + F.col("exit_cost")
    valued = closed.withColumns({"gross_pnl_usd": side * (F.col("exit_value") - F.col("entry_value")), "cost_usd": cost})
    net = lambda times: F.col("gross_pnl_usd") - F.lit(float(times)) * F.col("cost_usd")
    return valued.select(
        "spread_id", "strategy_id", F.when(side > 0, "LONG").otherwise("SHORT").alias("direction"),
        "entry_time", "entry_signal_time", "exit_time", "exit_signal_time", "entry_session", "exit_session",
        "entry_spread", "exit_spread", F.col("entry_value").alias("entry_package_value_usd"), F.col("exit_value").alias("exit_package_value_usd"),
        "gross_pnl_usd", F.col("entry_cost").alias("entry_cost_usd"), "cost_usd", net(1).alias("net_pnl_usd"),
        net(2).alias("pnl_2x_cost_usd"), net(3).alias("pnl_3x_cost_usd"), "holding_bars", "mae_usd", "mfe_usd", "exit_reason",
        F.concat("strategy_id", F.lit("; PASS")).alias("entry_reason"), "roll_id", "earliest_risk_date", "forced_exit_session",
        "entry_relative_volume", "entry_max_leg_bid_ask_ticks", "entry_package_capacity",
    )


def finish_trades(trades: DataFrame, structures: DataFrame, days: DataFrame) -> DataFrame:
    """Names, trade numbers and walk-forward phase."""
    names = structures.select("spread_id", "spread_name", "complexity_tier", "algebra_group")
    numbered = row_index(
        trades, ["spread_id", "strategy_id"], "entry_time", F.date_trunc("month", F.col("entry_session")), name="_no"
    )
    labelled = numbered.join(names, "spread_id", "left").withColumn(
        "trade_id", F.concat_ws("|", "spread_id", "strategy_id", F.lpad(F.col("_no").cast("string"), 4, "0"))
    )
    return tag_trades(labelled.drop("_no"), days)


def equity_curve(trades: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Realised increments per exit time and their running sum."""
    steps = trades.groupBy("spread_id", "strategy_id", "exit_time", "exit_session").agg(
        F.sum("net_pnl_usd").alias("realized_increment_usd")
    )
    return running_total(
        steps, ["spread_id", "strategy_id"], "exit_time", F.date_trunc("month", F.col("exit_session")),
        {"equity_usd": F.col("realized_increment_usd")},
    )


def marked_equity(inputs: DataFrame, trades: DataFrame) -> DataFrame:
    """Position, realised result and equity marked at the close, per bar with values and strategy.

    Trades become two events each, an entry before the bar it fills on and an exit before or,
    for a value taken at a close, after its bar.  Bars and events are one ordered stream of
    running totals per structure and strategy, so no trade is compared with a bar it does not
    touch and no row is made but the bars themselves.
    """
    side = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    at_close = F.col("exit_reason").isin("END_OF_SAMPLE", "ROLL_SAFETY_PREVIOUS_CLOSE")
    kept = trades.withColumn("_side", side)
    zero = F.lit(0.0)

    def events(time: str, session: str, turn: Column, sign: float, realised: Column) -> DataFrame:
        return kept.select(
            "spread_id", "strategy_id", F.col(time).alias("timestamp_utc"), F.col(session).alias("session_date"),
            turn.cast("int").alias("_turn"), (sign * F.col("_side")).alias("_position"),
            (sign * F.col("_side") * F.col("entry_package_value_usd")).alias("_basis"),
            (sign * F.col("entry_cost_usd")).alias("_paid"), realised.alias("_realised"), F.lit(None).cast("double").alias("close_value"),
        )

    strategies = F.array(*[F.lit(s.strategy_id) for s in STRATEGIES])
    bars = inputs.filter(F.col("open_value").isNotNull() & F.col("close_value").isNotNull()).select(
        "spread_id", F.explode(strategies).alias("strategy_id"), "timestamp_utc", "session_date", F.lit(2).alias("_turn"),
        zero.alias("_position"), zero.alias("_basis"), zero.alias("_paid"), zero.alias("_realised"), "close_value",
    )
    leaves = F.when(at_close, F.lit(3)).otherwise(F.lit(0))
    stream = bars.unionByName(events("entry_time", "entry_session", F.lit(1), 1.0, zero)).unionByName(
        events("exit_time", "exit_session", leaves, -1.0, F.col("net_pnl_usd"))
    )
    told = running_total(
        stream, ["spread_id", "strategy_id"], ["timestamp_utc", "_turn"], F.date_trunc("month", F.col("session_date")),
        {"position": F.col("_position"), "basis": F.col("_basis"), "paid": F.col("_paid"), "realized_net_pnl_usd": F.col("_realised")},
    ).filter("_turn = 2")
    open_result = F.col("position") * F.col("close_value") - F.col("basis") - F.col("paid")
    return told.select(
        "spread_id", "strategy_id", "timestamp_utc", "session_date", F.col("position").cast("int").alias("position"),
        "realized_net_pnl_usd", (F.col("realized_net_pnl_usd") + open_result).alias("equity_usd"),
    )
