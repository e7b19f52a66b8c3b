"""Views over the star-schema and event tables that give the operators their inputs.

Every view is one aggregation over a whole table.  Views that stand for a bar store
(``stored``) are written as a stage table on first use in an application, as a real
store would be, and scanned by column afterwards.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelab.stages import stage


def stored(view: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(view)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stage(spark, view.__name__, sf_dir, lambda: view(spark, sf_dir))

    return read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("kind"),
        "value", "props",
    )


@stored
def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per event type: a session is a day of 24 slots."""
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("spread_id"), hour.alias("timestamp_utc"))
        .agg(
            F.min_by("value", "ts").alias("open"),
            F.max_by("value", "ts").alias("close"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.count(F.lit(1)).cast("double").alias("volume"),
            F.round(F.sum("value"), 2).alias("value"),
        )
        .withColumn("session_date", F.to_date("timestamp_utc"))
        .withColumn("bar_slot", F.hour("timestamp_utc"))
    )


@stored
def hour_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars in the column layout of package bars (one leg, no rolls)."""
    from curvelab.scale import blocked

    bars = hour_bars(spark, sf_dir)
    b = blocked(bars, "spread_id", "timestamp_utc", F.col("session_date"), halo=1, base=bars)
    out = b.frame.withColumn("price_change", F.round(F.col("close") - F.lag("close").over(b.order), 4))
    return b.finish(out).select(
        "spread_id", "timestamp_utc", "session_date", "bar_slot",
        F.col("timestamp_utc").alias("bar_start_local"),
        F.lit("CONTINUOUS").alias("roll_id"),
        F.col("close").alias("research_close"),
        F.col("close").alias("spread_close"),
        F.round((F.col("open") + F.col("close")) / 2, 4).alias("spread_bar_vwap"),
        "price_change",
        F.col("volume").alias("package_volume_capacity"),
        (F.col("volume") * 1000.0).alias("paired_volume_bbl"),
        (F.col("volume") * 7.0 + F.col("bar_slot")).alias("package_oi_capacity"),
        F.col("volume").alias("min_leg_events"),
        F.col("high").alias("leg1_usd_bbl"),
        F.col("low").alias("leg2_usd_bbl"),
        F.lit(2).alias("n_legs"),
        F.col("open").alias("spread_open"),
        (F.col("open") * 100.0).alias("package_open_value_usd"),
        (F.col("close") * 100.0).alias("package_close_value_usd"),
        (F.col("bar_slot") + 1.0).alias("one_way_cost_usd"),
        (F.col("bar_slot") != 5).alias("entry_allowed"),
        F.lit("2024-02-15").cast("date").alias("forced_exit_session"),
        F.date_add("session_date", 9).alias("earliest_risk_date"),
        F.lit(False).alias("roll_event"),
        F.lit(23).alias("session_last_slot"),
        F.lit("HOURLY").alias("spread_family"),
        F.when(F.col("spread_id") < "f", "FRONT").otherwise("MID").alias("tenor_bucket"),
        F.when(F.col("volume") > 2, F.col("volume") - 2).alias("max_leg_bid_ask_ticks"),
        F.lit(1000.0).alias("package_barrels"),
    )


@stored
def day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily average unit price and quantity per brand."""
    return brand_days(spark, sf_dir)


def brand_days(spark: SparkSession, sf_dir: str, *brands: str) -> DataFrame:
    """The daily bars of ``brands``, or of all where none is named; parts of other brands are left out ahead of the join."""
    part = table(spark, sf_dir, "part")
    if brands:
        part = part.filter(F.col("p_brand").isin(*brands))
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
        .join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
        .groupBy(F.col("p_brand").alias("entity"), F.to_date("l_shipdate").alias("session_date"))
        .agg(
            (F.avg(F.col("l_extendedprice") / F.col("l_quantity")) / 1.07).alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )


# The roots the return flags stand for, and a price scale per root.
ROOT_OF_FLAG = {"A": ("HO", 503.0), "N": ("CL", 15.1), "R": ("QS", 1.99)}


def _by_flag(index: int) -> Column:
    out = F.when(F.lit(False), F.lit(ROOT_OF_FLAG["A"][index]))
    for flag, values in ROOT_OF_FLAG.items():
        out = out.when(F.col("l_returnflag") == flag, F.lit(values[index]))
    return out


def _bars_of_items(items: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Bars of line items with a ``_scale``: the item of the largest quantity, then price, opens.

    Totals per quantity come first.  Their buffers are plain numbers, so the line items go
    through a hash aggregate; the pair that orders them, which would make Spark sort every
    line item, is compared in that small table only.
    """
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    unit = price / quantity / F.col("_scale")
    per_quantity = items.groupBy(*keys, "l_quantity").agg(
        F.max_by(unit, price).alias("_open"), F.max(price).alias("_price"), F.max(unit).alias("_high"), F.min(unit).alias("_low"),
        F.sum(unit).alias("_sum"), F.count(unit).alias("_known"), F.count(F.lit(1)).alias("_n"), F.sum(price / F.col("_scale")).alias("_value"),
    )
    return per_quantity.groupBy(*keys).agg(
        F.round(F.max_by("_open", F.struct("l_quantity", "_price")), 10).alias("open"),
        F.round(F.max("_high"), 10).alias("high"),
        F.round(F.min("_low"), 10).alias("low"),
        F.round(F.try_divide(F.sum("_sum"), F.sum("_known")), 10).alias("close"),
        F.sum(quantity * F.col("_n")).alias("volume_contracts"),
        F.sum("_n").cast("double").alias("num_events"),
        F.sum("_value").alias("value"),
    )


@stored
def contract_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of dated contracts: two deliveries per root, rolling every quarter."""
    quarter_end = F.add_months(F.trunc("session_date", "quarter"), 3)
    month = F.col("delivery_month")
    items = table(spark, sf_dir, "lineitem").select(
        _by_flag(0).alias("root"), _by_flag(1).alias("_scale"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("step"),
        F.to_date("l_shipdate").alias("session_date"), "l_extendedprice", "l_quantity",
    )
    return (
        _bars_of_items(items, ("root", "step", "session_date"))
        .withColumn("delivery_month", F.add_months(quarter_end, F.col("step")))
        .withColumn(
            "security",
            F.concat(
                F.col("root"), F.substring(F.lit("FGHJKMNQUVXZ"), F.month(month), F.lit(1)),
                F.date_format(month, "yy"),
            ),
        )
        .withColumn("timestamp_utc", F.col("session_date").cast("timestamp_ntz"))
        .withColumn("bar_start_local", F.col("timestamp_utc"))
        .withColumn("bar_slot", F.weekday("session_date"))
        .withColumn("event_type", F.lit("TRADE"))
        .drop("step")
    )


# Price scales that bring the four roots near each other.
_CURVE_SCALE = {"HO": 503.0, "CL": 15.1, "CO": 15.1, "QS": 1.99}


def curve_period(day: Column) -> Column:
    """The first day of the four months that a day lies in."""
    return F.add_months(F.trunc(day, "year"), (F.floor((F.month(day) - 1) / 4) * 4).cast("int"))


@stored
def curve_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of four roots with four deliveries each, two a weekly session, rolling every four months."""
    flag, item = F.col("l_returnflag"), F.col("l_partkey")
    root = F.when(flag == "A", "HO").when(flag == "R", "QS").when(item % 2 == 0, "CL").otherwise("CO")
    scale = F.element_at(F.create_map(*[F.lit(x) for pair in _CURVE_SCALE.items() for x in pair]), F.col("root"))
    day = F.to_date("l_shipdate")
    month = F.col("delivery_month")
    items = table(spark, sf_dir, "lineitem").select(
        root.alias("root"), (F.col("l_linenumber") % 4).cast("int").alias("step"), F.trunc(day, "week").alias("session_date"),
        F.when(F.weekday(day) < 3, 0).otherwise(1).alias("bar_slot"), "l_extendedprice", "l_quantity",
    )
    bars = (
        _bars_of_items(items.withColumn("_scale", scale), ("root", "step", "session_date", "bar_slot"))
        .withColumn("delivery_month", F.add_months(F.add_months(curve_period(F.col("session_date")), 4), F.col("step")))
        .withColumn("timestamp_utc", F.col("session_date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("bar_slot") * 12))
    )
    code = F.substring(F.lit("FGHJKMNQUVXZ"), F.month(month), F.lit(1))
    trade = bars.withColumns(
        {"security": F.concat(F.col("root"), code, F.date_format(month, "yy")), "bar_start_local": F.col("timestamp_utc"), "event_type": F.lit("TRADE")}
    ).drop("step")
    busy = trade.filter(F.col("num_events") >= 3)
    bid = busy.withColumns({"event_type": F.lit("BID"), "close": F.col("close") * 0.999})
    ask = busy.withColumns({"event_type": F.lit("ASK"), "close": F.col("close") * 1.001})
    return trade.unionByName(bid).unionByName(ask)


def curve_market(spark: SparkSession, sf_dir: str):
    """The pipeline on the bars of four roots, with every template up to six legs and two packages by rank."""
    from curvelab.operators.structures import CURVE_STRUCTURES
    from curvelab.plans.settings import Settings
    from curvelab.plans.technical import Inputs, prepare

    bars = curve_bars(spark, sf_dir)
    trade = bars.filter("event_type = 'TRADE'")
    daily = trade.groupBy("session_date", "root", "security", "delivery_month").agg(
        F.max_by("close", "bar_slot").alias("close"), F.sum("volume_contracts").alias("volume_contracts"),
        (F.sum("volume_contracts") * 10 + F.sum("num_events")).alias("open_interest"),
    )
    universe = contract_dates(trade, F.date_sub(F.add_months(curve_period(F.min("session_date")), 4), 1))
    return prepare(
        spark, Inputs(bars, universe, universe, daily), CURVE_STRUCTURES, Settings(),
        store=lambda label, build: stage(spark, f"curve-{label}", sf_dir, build),
    )


def contract_dates(bars: DataFrame, last: Column | None = None) -> DataFrame:
    """Contracts seen in the bars, with the end of their first quarter, or ``last``, as last trading day."""
    quarter_end = F.date_sub(F.add_months(F.trunc(F.min("session_date"), "quarter"), 3), 1) if last is None else last
    return bars.groupBy("root", "security", "delivery_month").agg(
        quarter_end.alias("last_trade"),
        F.lit(None).cast("date").alias("first_notice"),
        F.lit(None).cast("date").alias("first_delivery"),
        quarter_end.alias("fallback_expiry"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as closed trades of a brand (structure) under a flag pair (strategy)."""
    item = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    joined = item.join(orders, "l_orderkey").join(part, "l_partkey")
    ordered, shipped = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    net = F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))
    cost = 0.001 * F.col("l_extendedprice")
    return joined.select(
        F.col("p_brand").alias("spread_id"),
        F.concat("l_returnflag", "l_linestatus").alias("strategy_id"),
        F.least(ordered, shipped).alias("entry_session"),
        F.greatest(ordered, shipped).alias("exit_session"),
        net.alias("net_pnl_usd"),
        cost.alias("cost_usd"),
        (net + cost).alias("gross_pnl_usd"),
        (net - cost).alias("pnl_2x_cost_usd"),
        (net - 2 * cost).alias("pnl_3x_cost_usd"),
        F.when(F.col("l_discount") >= F.col("l_tax"), "LONG").otherwise("SHORT").alias("direction"),
        F.col("l_quantity").cast("int").alias("holding_bars"),
        F.when(F.col("l_linenumber") == 7, "MANDATORY_D4_EXIT").otherwise("MAX_HOLD").alias("exit_reason"),
        (F.col("l_linenumber") % 3 + 1).cast("int").alias("entry_rank"),
        F.col("l_quantity").alias("entry_relative_volume"),
        F.substring("p_brand", 1, 7).alias("algebra_group"),
        (F.col("p_size") % 3 + 1).alias("complexity_tier"),
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice",
    )


@stored
def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily average order value per priority: a dated series with gaps."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day"))
        .agg((F.avg("o_totalprice") / 1.07).alias("value"), F.count(F.lit(1)).alias("n"))
    )


def quoted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract bars with BID and ASK rows beside the trades of busier days."""
    trade = contract_bars(spark, sf_dir)
    busy = trade.filter(F.col("num_events") >= 3)
    bid = busy.withColumns({"event_type": F.lit("BID"), "close": F.col("close") * 0.999})
    ask = busy.withColumns({"event_type": F.lit("ASK"), "close": F.col("close") * 1.001})
    return trade.unionByName(bid).unionByName(ask)


def contract_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = contract_bars(spark, sf_dir)
    return bars.select(
        "session_date", "root", "security", "delivery_month", "close",
        F.col("volume_contracts"), (F.col("volume_contracts") * 10 + F.col("num_events")).alias("open_interest"),
    )


def market(spark: SparkSession, sf_dir: str, settings=None, horizon: int = 2, quoted: bool = True):
    """The technical pipeline prepared on the contract bars; its stages are kept per application."""
    from curvelab.operators.indicators import Windows
    from curvelab.operators.structures import curve_structures
    from curvelab.plans.settings import Settings
    from curvelab.plans.technical import Inputs, prepare

    settings = settings or Settings(windows=Windows(8))
    key = f"{settings!r}|{horizon}|{quoted}"
    bars = quoted_bars(spark, sf_dir) if quoted else contract_bars(spark, sf_dir)
    universe = contract_dates(contract_bars(spark, sf_dir))
    return prepare(
        spark,
        Inputs(bars, universe, universe, contract_daily(spark, sf_dir)),
        curve_structures(horizon, ("HO", "CL", "QS")),
        settings,
        store=lambda label, build: stage(spark, label, sf_dir, build, key),
        bars_are_daily=True,
    )


def phased_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with phases by exit year: development, four yearly folds, lockbox."""
    year = F.year("exit_session")
    oos = year.between(1997, 2000)
    return trades(spark, sf_dir).withColumns(
        {
            "phase": F.when(year >= 2001, "LOCKBOX").when(oos, "OOS").otherwise("DEVELOPMENT"),
            "fold": F.when(oos, year - 1996),
            "entry_time": F.col("entry_session"),
            "exit_time": F.col("exit_session"),
            "trade_id": F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"),
        }
    )
