"""Exchange calendars, session offsets, expiry rules and contract universes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvelab.config import RootSpec
from curvelab.functions import dates as D
from curvelab.functions import tokens as K


@dataclass(frozen=True)
class TradingDay:
    """The bar session, and how long before its risk date a structure is flat."""

    # Fixed values.
    session_start: str = "08:00"
    session_end: str = "14:30"
    timezone: str = "America/New_York"
    bar_interval_minutes: int = 15
    complete_bars_per_session: int = 26
    freshness_grace_minutes: int = 15
    expiry_flat_sessions: int = 3


# Exchange group per root.
EXCHANGE = {"HO": "NYMEX", "CL": "NYMEX", "CO": "ICE", "QS": "ICE"}


def exchange_of(root: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, group in EXCHANGE.items():
        out = out.when(F.upper(root) == name, F.lit(group))
    return out.otherwise(F.lit("NONE"))


# Closure rules per exchange group on the columns of ``marked_days``.
# A date-bound holiday on a Saturday closes the Friday before, on a Sunday the Monday
# after; a New Year on a Saturday would close a day of the old year and is not looked up.
CLOSURES = {
    "NYMEX": {
        "NEW_YEAR": "(month = 1 AND (day = 1 OR (day = 2 AND dow = 1)))",
        "KING_DAY": "(month = 1 AND dow = 1 AND nth = 3)",
        "PRESIDENTS_DAY": "(month = 2 AND dow = 1 AND nth = 3)",
        "GOOD_FRIDAY": "(past_easter = -2)",
        "MEMORIAL_DAY": "(month = 5 AND dow = 1 AND to_end < 7)",
        "JUNETEENTH": "(month = 6 AND (day = 19 OR (day = 18 AND dow = 5) OR (day = 20 AND dow = 1)))",
        "INDEPENDENCE_DAY": "(month = 7 AND (day = 4 OR (day = 3 AND dow = 5) OR (day = 5 AND dow = 1)))",
        "LABOR_DAY": "(month = 9 AND dow = 1 AND nth = 1)",
        "THANKSGIVING": "(month = 11 AND dow = 4 AND nth = 4)",
        "CHRISTMAS": "(month = 12 AND (day = 25 OR (day = 24 AND dow = 5) OR (day = 26 AND dow = 1)))",
    },
    "ICE": {
        "NEW_YEAR": "(month = 1 AND (day = 1 OR (day = 2 AND dow = 1)))",
        "GOOD_FRIDAY": "(past_easter = -2)",
        "EASTER_MONDAY": "(past_easter = 1)",
        "EARLY_MAY": "(month = 5 AND dow = 1 AND nth = 1)",
        "LATE_MAY": "(month = 5 AND dow = 1 AND to_end < 7)",
        "AUGUST": "(month = 8 AND dow = 1 AND to_end < 7)",
        "CHRISTMAS": "(month = 12 AND (day = 25 OR (day = 24 AND dow = 5) OR (day = 26 AND dow = 1)))",
        "BOXING_DAY": "(month = 12 AND ((day = 26 AND dow BETWEEN 2 AND 5) OR (day = 27 AND dow IN (1, 2))))",
    },
}


def easter_sundays(years: DataFrame) -> DataFrame:
    """Gregorian Easter per ``year``: golden number, century, epact, full moon, Sunday."""
    return (
        years.selectExpr("year", "year % 19 + 1 AS golden", "year DIV 100 + 1 AS century")
        .selectExpr("*", "3 * century DIV 4 - 12 AS skipped", "(8 * century + 5) DIV 25 - 5 AS moon")
        .selectExpr("*", "5 * year DIV 4 - skipped - 10 AS sunday", "pmod(11 * golden + 20 + moon - skipped, 30) AS epact")
        .selectExpr(
            "year", "sunday",
            "44 - epact - CASE WHEN epact = 24 OR (epact = 25 AND golden > 11) THEN 1 ELSE 0 END AS moon_day",
        )
        .selectExpr("year", "sunday", "moon_day + CASE WHEN moon_day < 21 THEN 30 ELSE 0 END AS full")
        .selectExpr("year", "date_add(make_date(year, 3, 1), CAST(full + 6 - pmod(sunday + full, 7) AS INT)) AS easter")
    )


def marked_days(days: DataFrame) -> DataFrame:
    """Weekday, position in the month and distance from Easter per ``date``."""
    shaped = days.selectExpr("date", "year(date) AS year")
    return shaped.join(easter_sundays(shaped.select("year").distinct()), "year").selectExpr(
        "date",
        "month(date) AS month",
        "day(date) AS day",
        "weekday(date) + 1 AS dow",
        "(day(date) - 1) DIV 7 + 1 AS nth",
        "datediff(last_day(date), date) AS to_end",
        "datediff(date, easter) AS past_easter",
    )


def holidays(days: DataFrame) -> DataFrame:
    """Weekday closures (exchange, rule, date) among the given days."""
    cells = [
        f"CASE WHEN {test} THEN struct('{group}' AS exchange, '{rule}' AS rule) END"
        for group, rules in CLOSURES.items()
        for rule, test in rules.items()
    ]
    marked = marked_days(days).filter("dow <= 5").selectExpr("date", f"filter(array({', '.join(cells)}), c -> c IS NOT NULL) AS hit")
    return marked.select("date", F.explode("hit").alias("h")).select("h.exchange", "h.rule", "date")


def session_calendar(span: DataFrame, margin_days: int = 40) -> DataFrame:
    """One row per exchange and day: is it a session, and how many sessions came before.

    ``span`` has one row with ``first_day`` and ``last_day``.  The table grows with the
    calendar only (366 rows per year and exchange), never with the data.
    """
    days = span.selectExpr(
        f"explode(sequence(date_sub(first_day, {margin_days}), date_add(last_day, {margin_days}), interval 1 day)) AS date"
    )
    states = [
        f"struct('{group}' AS exchange, dow <= 5 AND NOT ({' OR '.join(rules.values())}) AS is_session)"
        for group, rules in CLOSURES.items()
    ] + ["struct('NONE' AS exchange, dow <= 5 AS is_session)"]
    grid = marked_days(days).selectExpr("date AS day", f"inline(array({', '.join(states)}))")
    before = Window.partitionBy("exchange").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return grid.select(
        "exchange", "day", "is_session",
        F.coalesce(F.count_if("is_session").over(before), F.lit(0)).alias("sessions_before"),
    )


def offset_sessions(df: DataFrame, calendar: DataFrame, day: str, exchange: str, offsets: dict[str, int]) -> DataFrame:
    """The n-th session after (n > 0) or before (n < 0) a day that need not be a session.

    The session is found by its number, however far away it is.  A day, or a session,
    outside the calendar gives null; ``outside_calendar`` lists such rows.
    """
    sessions = calendar.filter("is_session").select("exchange", F.col("sessions_before").alias("_no"), "day")
    table = calendar.select("exchange", "day", "sessions_before", F.col("is_session").cast("long").alias("_open"))
    for name, n in offsets.items():
        wanted = F.col("sessions_before") + n if n < 0 else F.col("sessions_before") + F.col("_open") + (n - 1)
        found = sessions.select("exchange", "_no", F.col("day").alias(name))
        table = table.withColumn("_no", wanted).join(found, ["exchange", "_no"], "left")
    table = table.select(F.col("exchange").alias(exchange), F.col("day").alias(day), *offsets)
    return df.join(table, [exchange, day], "left")


def outside_calendar(moved: DataFrame, *names: str) -> DataFrame:
    """Rows for which an offset found no session: the calendar ends too early."""
    return moved.filter(reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names]))


def fallback_expiry(root: Column, delivery: Column) -> Column:
    """Conservative expiry per root where no verified date exists."""
    month_end = lambda back: D.previous_weekday(F.last_day(F.add_months(delivery, -back)))
    before_25th = D.previous_weekday(F.date_add(F.trunc(F.add_months(delivery, -1), "month"), 24))
    before_14th = D.previous_weekday(F.date_add(F.trunc(delivery, "month"), 13))
    return (
        F.when(root == "HO", month_end(1))
        .when(root == "CO", month_end(2))
        .when(root == "CL", D.weekday_offset(before_25th, 3))
        .when(root == "QS", D.weekday_offset(before_14th, 2))
    )


def root_table(spark: SparkSession, roots: tuple[RootSpec, ...]) -> DataFrame:
    return spark.createDataFrame(
        [
            (
                r.root, r.name, r.native_unit, r.price_to_usd_bbl, r.contract_size_native, r.contract_barrels,
                r.tick_size_native, r.one_way_cost_usd, r.ticker_template, r.generic_template,
            )
            for r in roots
        ],
        "root string, root_label string, native_unit string, price_to_usd_bbl double, contract_size_native double,"
        " contract_barrels double, tick_size_native double, one_way_cost_usd double, ticker_template string,"
        " generic_template string",
    )


def contract_universe(
    spans: DataFrame, roots: DataFrame, history_months: int = 3, forward_months: int = 18
) -> DataFrame:
    """Roots times delivery months: one generated row per month, no cross join.

    ``spans`` holds (root, first_day, last_day).
    """
    month = F.col("delivery_month")
    year_text = F.year(month).cast("string")
    grid = spans.join(roots, "root").withColumn(
        "delivery_month",
        F.explode(
            F.sequence(
                F.add_months(F.trunc("first_day", "month"), -history_months),
                F.add_months(F.trunc("last_day", "month"), forward_months),
                F.expr("interval 1 month"),
            )
        ),
    )
    return grid.select(
        "root",
        K.ticker(
            F.col("ticker_template"), F.col("root"), D.month_code(month), F.year(month), F.lit(""),
            F.right(year_text, F.lit(1)), F.right(year_text, F.lit(2)),
        ).alias("security"),
        "delivery_month",
        fallback_expiry(F.col("root"), month).alias("fallback_expiry"),
    )


def contract_registry(
    universe: DataFrame, reference: DataFrame | None, calendar: DataFrame, trading: TradingDay = TradingDay()
) -> DataFrame:
    """Expiry registry: risk date, blackout start and last exit session per contract.

    ``reference`` may hold verified dates (security, last_trade, first_notice,
    first_delivery); without them the fallback date counts, marked unverified.
    """
    if reference is None:
        known = universe.withColumns(
            {c: F.lit(None).cast("date") for c in ("last_trade", "first_notice", "first_delivery")}
        )
    else:
        known = universe.select("root", "security", "delivery_month", "fallback_expiry").join(
            reference.select("security", "last_trade", "first_notice", "first_delivery"), "security", "left"
        )
    verified = F.col("last_trade").isNotNull()
    dated = known.select(
        "root",
        "security",
        "delivery_month",
        F.coalesce("last_trade", "fallback_expiry").alias("last_trade_date"),
        F.col("first_notice").alias("first_notice_date"),
        F.col("first_delivery").alias("first_delivery_date"),
        F.coalesce(F.least("last_trade", "first_notice", "first_delivery"), "fallback_expiry").alias("risk_date"),
        verified.alias("expiry_verified"),
        F.when(verified, "REFERENCE").otherwise("FALLBACK_UNVERIFIED").alias("expiry_source"),
    ).withColumn("exchange", exchange_of(F.col("root")))
    n = trading.expiry_flat_sessions
    return offset_sessions(
        dated, calendar, "risk_date", "exchange", {"blackout_start": -n, "forced_exit_session": -n - 1}
    ).drop("exchange")


def merge_registries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Newest row per contract, but a verified row is never replaced by an unverified one."""
    from curvelab.scale import latest_by, union_all

    both = union_all([old.withColumn("_seq", F.lit(0)), new.withColumn("_seq", F.lit(1))]).withColumn(
        "_ok", F.coalesce("expiry_verified", F.lit(False)).cast("int")
    )
    return latest_by(both, ["root", "security", "delivery_month"], "_ok", "_seq").drop("_ok", "_seq")


def expected_latest_session(
    observed: DataFrame, calendar: DataFrame, trading: TradingDay = TradingDay()
) -> DataFrame:
    """Latest session that should already have a finished bar.

    ``observed`` holds (exchange, as_of, observed_at): the day asked for and the local
    time it is asked at.
    """
    opened = F.to_timestamp_ntz(F.concat(F.date_format("as_of", "yyyy-MM-dd"), F.lit(f" {trading.session_start}:00")))
    ready = opened + F.make_dt_interval(mins=F.lit(trading.bar_interval_minutes + trading.freshness_grace_minutes))
    state = offset_sessions(observed, calendar, "as_of", "exchange", {"previous_session": -1}).join(
        calendar.select("exchange", F.col("day").alias("as_of"), "is_session"), ["exchange", "as_of"], "left"
    )
    too_early = (F.to_date("observed_at") == F.col("as_of")) & (F.col("observed_at") < ready)
    return state.withColumn(
        "expected_session",
        F.when(~F.col("is_session") | too_early, F.col("previous_session")).otherwise(F.col("as_of")),
    ).drop("is_session", "previous_session")


def next_bar_times(
    origins: DataFrame, calendar: DataFrame, count: int, slots: int, minutes: int, start_minute: int
) -> DataFrame:
    """The next ``count`` bar starts after an origin, running over session ends.

    ``origins`` holds (key, exchange, session_date, bar_slot).
    """
    steps = origins.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(count)))).withColumn(
        "_slot", F.col("bar_slot") + F.col("step")
    )
    numbered = steps.join(
        calendar.select("exchange", F.col("day").alias("session_date"), "sessions_before"),
        ["exchange", "session_date"],
    ).withColumn("_target", F.col("sessions_before") + 1 + F.floor(F.col("_slot") / F.lit(slots)))
    days = calendar.filter("is_session").select(
        "exchange", (F.col("sessions_before") + 1).alias("_target"), F.col("day").alias("bar_session")
    )
    slot = F.pmod(F.col("_slot"), F.lit(slots)).cast("int")
    return (
        numbered.join(days, ["exchange", "_target"])
        .withColumn("next_slot", slot)
        .withColumn("minute_of_day", F.lit(start_minute) + F.col("next_slot") * minutes)
        .drop("_slot", "_target", "sessions_before")
    )


def pull_chunks(ranges: DataFrame, days: int = 28) -> DataFrame:
    """Split [start_date, end_date] into chunks of at most ``days`` days."""
    starts = F.transform(F.sequence("start_date", "end_date", F.make_dt_interval(F.lit(days))), lambda d: d.cast("date"))
    return (
        ranges.filter(F.col("start_date") <= F.col("end_date"))
        .withColumn("chunk_start", F.explode(starts))
        .withColumn("chunk_end", F.least(F.col("end_date"), F.date_add("chunk_start", days - 1)))
    )


def expiry_calendar(contracts: DataFrame, as_of: Column) -> DataFrame:
    """Contracts at risk within a year of ``as_of``."""
    return contracts.filter((F.col("risk_date") >= as_of) & (F.col("risk_date") <= F.add_months(as_of, 12)))
