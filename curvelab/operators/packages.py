"""Contract bars to executable multi-leg packages, back-adjusted over rolls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelab.config import GASOIL_BBL_PER_MT, USD_BBL_PER_CPG
from curvelab.operators.calendar import TradingDay
from curvelab.functions import dates as D
from curvelab.functions.stats import ratio
from curvelab.operators.ingest import quote_columns
from curvelab.scale import blocked, running_total

REGISTRY_COLUMNS = (
    "root", "security", "delivery_month", "last_trade_date", "risk_date", "blackout_start",
    "forced_exit_session", "expiry_verified", "expiry_source",
)


def lagged_open_interest(daily: DataFrame) -> DataFrame:
    """Open interest one session late and its five-session change.

    A security is one contract, so a partition is bounded by a contract's life.
    """
    w = Window.partitionBy("security").orderBy("session_date")
    lag1 = F.lag("open_interest", 1).over(w)
    return daily.select(
        "security",
        "session_date",
        lag1.alias("open_interest_lag1"),
        (lag1 - F.lag("open_interest", 6).over(w)).alias("oi_change_5d"),
    )


def prepare_bars(bars: DataFrame, contracts: DataFrame, roots: DataFrame, daily: DataFrame | None = None) -> DataFrame:
    """Trade bars with quotes, expiry state, units, eligibility and the generic rank."""
    trade = bars.filter(F.col("event_type") == "TRADE")
    trade = trade.join(quote_columns(bars), ["timestamp_utc", "security"], "left")
    trade = trade.join(contracts.select(*REGISTRY_COLUMNS), ["root", "security", "delivery_month"], "left")
    if daily is None:
        trade = trade.withColumns(
            {c: F.lit(None).cast("double") for c in ("open_interest_lag1", "oi_change_5d")}
        )
    else:
        trade = trade.join(lagged_open_interest(daily), ["security", "session_date"], "left")
    verified = F.coalesce("expiry_verified", F.lit(False))
    # The root table is configuration: a handful of rows.
    rows = trade.join(roots.drop("ticker_template", "generic_template"), "root", "left").withColumns(
        {
            "delivery_index": D.delivery_index(F.col("delivery_month")),
            "close_usd_bbl": F.col("close") * F.col("price_to_usd_bbl"),
            "open_usd_bbl": F.col("open") * F.col("price_to_usd_bbl"),
            "volume_bbl": F.col("volume_contracts") * F.col("contract_barrels"),
            "entry_contract_eligible": (F.col("session_date") < F.col("forced_exit_session")) & verified,
            "position_contract_eligible": (F.col("session_date") < F.col("blackout_start")) & verified,
        }
    )
    # Ranked on position eligibility, so the last exit bar before the blackout stays.
    curve = Window.partitionBy("root", "timestamp_utc").orderBy("delivery_month", "security")
    return rows.filter("position_contract_eligible").withColumn("generic_rank", F.row_number().over(curve))


def align_legs(prepared: DataFrame, legs: DataFrame) -> DataFrame:
    """One row per (signature, time, anchor, leg) where every leg of the signature has a bar.

    Instead of one join per structure there is a single equi-join of all wanted legs to
    the bars.  Bars and wanted legs are placed by time once; the join, the completeness
    check and the ranking all use that placement.
    """
    wanted = legs.select(
        "signature", F.col("anchor_root"), "n_legs", "leg_order", F.col("root").alias("leg_root"),
        "mode", "delivery_offset", "rank",
    ).distinct()
    placed = prepared.repartition("timestamp_utc")
    anchors = placed.select(
        "timestamp_utc",
        F.col("root").alias("anchor_root"),
        F.col("delivery_month").alias("anchor_delivery_month"),
        F.col("delivery_index").alias("anchor_delivery_index"),
    )
    # Signature legs are bounded by the registry.
    need = anchors.join(wanted, "anchor_root").withColumn(
        "leg_key",
        F.when(F.col("mode") == "rank", F.col("rank")).otherwise(
            F.col("anchor_delivery_index") + F.col("delivery_offset")
        ),
    )
    keyed = placed.withColumn(
        "_key",
        F.explode(
            F.array(
                F.struct(F.lit("delivery").alias("mode"), F.col("delivery_index").alias("leg_key")),
                F.struct(F.lit("rank").alias("mode"), F.col("generic_rank").alias("leg_key")),
            )
        ),
    ).select("*", "_key.mode", "_key.leg_key").drop("_key").withColumnRenamed("root", "leg_root")
    found = need.join(keyed, ["timestamp_utc", "leg_root", "mode", "leg_key"])
    package = Window.partitionBy("signature", "timestamp_utc", "anchor_delivery_index")
    complete = found.withColumn("_have", F.count(F.lit(1)).over(package)).filter(F.col("_have") == F.col("n_legs"))
    curve = Window.partitionBy("signature", "timestamp_utc").orderBy("anchor_delivery_index")
    return complete.withColumn("structure_rank", F.dense_rank().over(curve)).drop("_have", "mode", "rank", "delivery_offset")


def _all(x: Column, total: Column) -> Column:
    """A package total exists only where every leg has its value."""
    return F.when(F.count(x) == F.count(F.lit(1)), total)


def _leg_sum(x: Column) -> Column:
    return _all(x, F.sum(x))


def build_packages(prepared: DataFrame, legs: DataFrame, structures: DataFrame) -> DataFrame:
    """Package bars: one row per structure and time, all legs priced by their weights."""
    aligned = align_legs(prepared, legs)
    weights = legs.select("spread_id", "signature", "leg_order", "sign", "contracts", "price_weight")
    ranked = structures.select("spread_id", "signature", F.col("anchor_rank").alias("structure_rank"))
    use = weights.join(ranked, ["spread_id", "signature"])
    rows = aligned.join(use, ["signature", "structure_rank", "leg_order"])

    sign, lots, unit = F.col("sign"), F.col("contracts"), F.col("price_to_usd_bbl")
    weight = sign * F.col("price_weight") * unit
    long_quote = F.coalesce("ask_close", "close")
    short_quote = F.coalesce("bid_close", "close")
    buy = F.when(sign > 0, long_quote).otherwise(short_quote)
    sell = F.when(sign > 0, short_quote).otherwise(long_quote)
    vwap = F.when(F.col("volume_contracts") > 0, F.coalesce(ratio(F.col("value"), F.col("volume_contracts")), F.col("close"))).otherwise(F.col("close"))
    size = F.col("contract_size_native")
    verified = F.coalesce("expiry_verified", F.lit(False))
    open_leg = F.coalesce(F.col("session_date") < F.col("forced_exit_session"), F.lit(False)) & verified
    nth = lambda n, c: F.max(F.when(F.col("leg_order") == n, c))
    first = lambda root: F.min_by(
        F.when(F.col("leg_root") == root, F.col("close")), F.when(F.col("leg_root") == root, F.col("leg_order"))
    )
    packed = rows.groupBy("spread_id", "timestamp_utc").agg(
        F.max("session_date").alias("session_date"),
        F.max("bar_slot").alias("bar_slot"),
        F.max("bar_start_local").alias("bar_start_local"),
        _leg_sum(weight * F.col("open")).alias("spread_open"),
        _leg_sum(weight * F.col("close")).alias("spread_close"),
        _leg_sum(weight * buy).alias("spread_buy_quote"),
        _leg_sum(weight * sell).alias("spread_sell_quote"),
        F.min(F.col("volume_contracts") / lots).alias("package_volume_capacity"),
        F.min(F.col("open_interest_lag1") / lots).alias("package_oi_capacity"),
        _leg_sum(F.col("one_way_cost_usd") * lots).alias("one_way_cost_usd"),
        F.min("num_events").alias("min_leg_events"),
        _leg_sum(sign * lots * F.col("open") * size).alias("package_open_value_usd"),
        _leg_sum(sign * lots * F.col("close") * size).alias("package_close_value_usd"),
        _leg_sum(weight * vwap).alias("spread_bar_vwap"),
        F.max(ratio(F.col("ask_close") - F.col("bid_close"), F.col("tick_size_native"))).alias("max_leg_bid_ask_ticks"),
        F.min("risk_date").alias("earliest_risk_date"),
        F.min("blackout_start").alias("blackout_start"),
        F.min("forced_exit_session").alias("forced_exit_session"),
        F.min(verified).alias("expiry_verified"),
        F.min(open_leg).alias("entry_allowed"),
        nth(1, F.col("close") * unit).alias("leg1_usd_bbl"),
        nth(2, F.col("close") * unit).alias("leg2_usd_bbl"),
        (first("HO") * 100.0).alias("heating_oil_cpg"),
        first("QS").alias("gasoil_usd_mt"),
        # At most eight legs per package.
        F.sort_array(
            F.collect_list(F.struct("leg_order", "security", F.col("leg_root").alias("root"), "delivery_month", "sign", "contracts", "price_weight"))
        ).alias("legs"),
    )
    return (
        packed.withColumn("roll_id", F.array_join(F.transform("legs", lambda g: g["security"]), " | "))
        .join(structures.drop("signature"), "spread_id")
        .withColumns(
            {
                "quoted_width_usd_bbl": F.col("spread_buy_quote") - F.col("spread_sell_quote"),
                "gasoil_usd_bbl": F.col("gasoil_usd_mt") / GASOIL_BBL_PER_MT,
                "gasoil_cpg": F.col("gasoil_usd_mt") / GASOIL_BBL_PER_MT / USD_BBL_PER_CPG,
                "hogo_cpg": F.when(F.col("economic_roots") == "HO|QS", F.col("spread_close") / USD_BBL_PER_CPG),
                "paired_volume_bbl": F.col("package_volume_capacity") * F.col("package_barrels"),
                "paired_open_interest_bbl": F.col("package_oi_capacity") * F.col("package_barrels"),
            }
        )
        .drop("spread_buy_quote", "spread_sell_quote")
    )


def back_adjust(
    packages: DataFrame, entity: str = "spread_id", ts: str = "timestamp_utc", bucket: Column | None = None,
    block: int = 4096,
) -> DataFrame:
    """Continuous close across rolls, on the scale of the latest contract, plus bar changes.

    The gap at a roll is the previous close less the new one.  A row is shifted by all
    gaps after it, that is by (gaps up to it) less (all gaps).  A missing roll identity
    is an error, because no adjustment would be right.
    """
    bucket = F.date_trunc("month", F.col("session_date")) if bucket is None else bucket
    checked = packages.withColumn(
        "roll_id", F.coalesce("roll_id", F.raise_error(F.lit("roll_id must not be null")).cast("string"))
    )
    b = blocked(checked, entity, ts, bucket, halo=1, block=block, base=packages)
    previous = F.lag("spread_close").over(b.order)
    rolled = F.coalesce(F.col("roll_id") != F.lag("roll_id").over(b.order), F.lit(False))
    same_day = F.col("session_date") == F.lag("session_date").over(b.order)
    seen = b.finish(b.frame.withColumns({"_previous": previous, "roll_event": rolled, "_same_day": same_day}))
    change = F.when(~F.col("roll_event"), F.col("spread_close") - F.col("_previous"))
    changes = seen.withColumns(
        {
            "price_change": change,
            "intraday_change": F.when(F.col("_same_day"), change),
            "overnight_change": F.when(~F.col("_same_day"), change),
        }
    )
    gap = F.when(F.col("roll_event"), F.col("_previous") - F.col("spread_close")).otherwise(0.0)
    summed = running_total(changes, entity, ts, bucket, {"_shift": gap}, whole={"_shift": "_all_gaps"})
    return summed.withColumn("research_close", F.col("spread_close") + F.col("_shift") - F.col("_all_gaps")).drop(
        "_previous", "_same_day", "_shift", "_all_gaps"
    )


def risk_distance(packages: DataFrame) -> DataFrame:
    return packages.withColumn(
        "sessions_to_risk_date", D.business_days(F.col("session_date"), F.col("earliest_risk_date"))
    )


def daily_as_bars(daily: DataFrame, trading: TradingDay = TradingDay()) -> DataFrame:
    """Daily settles as bars of the last slot, so the package operators apply to them."""
    hour, minute = (int(x) for x in trading.session_end.split(":"))
    start = hour * 60 + minute - trading.bar_interval_minutes
    local = F.col("session_date").cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(start))
    return daily.select(
        F.to_utc_timestamp(local.cast("timestamp"), trading.timezone).alias("timestamp_utc"),
        local.alias("bar_start_local"),
        "session_date",
        F.lit(trading.complete_bars_per_session - 1).alias("bar_slot"),
        F.lit("TRADE").alias("event_type"),
        "root",
        "security",
        "delivery_month",
        *[F.col("close").alias(c) for c in ("open", "high", "low", "close")],
        "volume_contracts",
        F.lit(None).cast("double").alias("num_events"),
        F.lit(None).cast("double").alias("value"),
    )


def latest_leg_securities(packages: DataFrame) -> DataFrame:
    """Securities quoted by any package at the newest time."""
    newest = packages.agg(F.max("timestamp_utc").alias("timestamp_utc"))
    return (
        packages.join(newest, "timestamp_utc", "left_semi")
        .select(F.explode("legs.security").alias("security"))
        .distinct()
    )
