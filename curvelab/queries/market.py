"""Calendars, contract registries, structures and package bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelab.edge import settle, settle_sql
from curvelab.operators import calendar as C
from curvelab.operators import packages as PK
from curvelab.operators import structures as G
from curvelab.queries import ctes
from curvelab.registry import query
from curvelab.sources import views

STRUCTURES = G.curve_structures(2, ("HO", "CL", "QS"))
PACKS = f"WITH {ctes.PREPARED},\n{ctes.packages_cte(STRUCTURES)}"
ADJ = f"{PACKS},\n{ctes.ADJUSTED}"


def _order_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "orders").agg(
        F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day")
    )


_FIRST, _LAST = "(SELECT min(o_orderdate) FROM orders)", "(SELECT max(o_orderdate) FROM orders)"
_CAL = ctes.calendar_cte(_FIRST, _LAST)


@query(
    "holiday_calendar",
    f"""WITH {_CAL} SELECT ex AS exchange, year(d) AS year, strftime(d, '%Y-%m-%d') AS holiday FROM cal_h
        WHERE isodow(d) <= 5 AND year(d) IN (SELECT DISTINCT year(o_orderdate) FROM orders)
          AND d BETWEEN {_FIRST}::DATE - 40 AND {_LAST}::DATE + 40 GROUP BY ALL""",
)
def holiday_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekday closures of every year that has orders."""
    span = _order_span(spark, sf_dir)
    days = span.selectExpr("explode(sequence(date_sub(first_day, 40), date_add(last_day, 40), interval 1 day)) AS date")
    years = views.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    closed = C.holidays(days).select("exchange", F.year("date").alias("year"), F.col("date").alias("holiday")).distinct()
    return settle(closed.join(years, "year", "left_semi").select("exchange", "year", "holiday"))


@query(
    "session_offsets",
    f"""WITH {_CAL}, q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderpriority < '3' THEN 'NYMEX' ELSE 'ICE' END AS ex FROM orders),
      n AS (SELECT q.*, (SELECT count(*) FROM sess WHERE sess.ex = q.ex AND sess.d < q.day) AS b, (SELECT count(*) FROM sess WHERE sess.ex = q.ex AND sess.d <= q.day) AS u FROM q)
      SELECT n.ex AS exchange, strftime(day, '%Y-%m-%d') AS day, strftime(p.d, '%Y-%m-%d') AS three_before, strftime(f.d, '%Y-%m-%d') AS two_after
      FROM n LEFT JOIN sess p ON p.ex = n.ex AND p.i = b - 2 LEFT JOIN sess f ON f.ex = n.ex AND f.i = u + 2""",
)
def session_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions three before and two after each order day."""
    calendar = C.session_calendar(_order_span(spark, sf_dir))
    days = views.table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("day"),
        F.when(F.col("o_orderpriority") < "3", "NYMEX").otherwise("ICE").alias("exchange"),
    ).distinct()
    return settle(C.offset_sessions(days, calendar, "day", "exchange", {"three_before": -3, "two_after": 2}))


_ROOTS = "CASE l_returnflag WHEN 'A' THEN 'HO' WHEN 'N' THEN 'CL' ELSE 'QS' END"


@query(
    "contract_universe",
    f"""WITH s AS (SELECT {_ROOTS} AS root, date_trunc('month', min(l_shipdate)) - INTERVAL 3 MONTH AS a, date_trunc('month', max(l_shipdate)) + INTERVAL 18 MONTH AS b FROM lineitem GROUP BY 1),
      m AS (SELECT root, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS dm FROM s),
      e AS (SELECT *, CASE root WHEN 'HO' THEN CAST(dm - INTERVAL 1 DAY AS DATE) WHEN 'CL' THEN CAST(dm - INTERVAL 1 MONTH + INTERVAL 24 DAY AS DATE) ELSE CAST(dm + INTERVAL 13 DAY AS DATE) END AS raw FROM m),
      p AS (SELECT *, raw - greatest(isodow(raw) - 5, 0)::INT AS anchor FROM e)
      SELECT root, root || substr('FGHJKMNQUVXZ', month(dm), 1) || (year(dm) % 10) || ' Comdty' AS security, strftime(dm, '%Y-%m-%d') AS delivery_month,
        strftime(CASE root WHEN 'HO' THEN anchor
          ELSE list_filter(generate_series(anchor - INTERVAL 10 DAY, anchor - INTERVAL 1 DAY, INTERVAL 1 DAY), lambda v: isodow(v) <= 5)[CASE root WHEN 'CL' THEN -3 ELSE -2 END] END, '%Y-%m-%d') AS fallback_expiry
      FROM p""",
)
def contract_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery months around the bars of every root, with ticker and fallback expiry."""
    from curvelab.config import ROOTS

    bars = views.contract_bars(spark, sf_dir)
    spans = bars.groupBy("root").agg(F.min("session_date").alias("first_day"), F.max("session_date").alias("last_day"))
    return settle(C.contract_universe(spans, C.root_table(spark, ROOTS)))


@query(
    "contract_registry",
    f"""WITH {ctes.CBARS}, {ctes.REGISTRY} SELECT root, security, strftime(delivery, '%Y-%m-%d') AS delivery_month, strftime(risk_date, '%Y-%m-%d') AS risk_date,
      strftime(blackout, '%Y-%m-%d') AS blackout_start, strftime(forced, '%Y-%m-%d') AS forced_exit_session, 1 AS expiry_verified, 'REFERENCE' AS expiry_source FROM reg""",
)
def contract_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk, blackout and last exit session per contract."""
    contracts = views.market(spark, sf_dir).contracts
    return settle(contracts.select("root", "security", "delivery_month", "risk_date", "blackout_start", "forced_exit_session",
                                   "expiry_verified", "expiry_source"))


@query(
    "expiry_calendar",
    f"""WITH {ctes.CBARS}, {ctes.REGISTRY}, ref_day AS (SELECT CAST(max(risk_date) - INTERVAL 400 DAY AS DATE) AS d FROM cbars)
      SELECT root, security, strftime(delivery, '%Y-%m-%d') AS delivery_month, strftime(risk_date, '%Y-%m-%d') AS risk_date,
      strftime(blackout, '%Y-%m-%d') AS blackout_start, strftime(forced, '%Y-%m-%d') AS forced_exit_session
      FROM reg, ref_day WHERE risk_date >= ref_day.d AND risk_date <= ref_day.d + INTERVAL 1 YEAR""",
)
def expiry_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts whose risk date falls in the next twelve months."""
    contracts = views.market(spark, sf_dir).contracts
    near = C.expiry_calendar(contracts, contracts.agg(F.date_sub(F.max("risk_date"), 400)).scalar())
    return settle(near.select("root", "security", "delivery_month", "risk_date", "blackout_start", "forced_exit_session"))


@query(
    "expected_session",
    f"""WITH {_CAL}, q AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS as_of, CASE WHEN o_orderkey % 2 = 0 THEN 'NYMEX' ELSE 'ICE' END AS ex,
        o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR AS seen FROM orders),
      n AS (SELECT q.*, (SELECT max(d) FROM sess WHERE sess.ex = q.ex AND sess.d < as_of) AS prev FROM q)
      SELECT o_orderkey, ex AS exchange, strftime(CASE WHEN (as_of, ex) NOT IN (SELECT (d, ex) FROM sess) OR hour(seen) * 60 + minute(seen) < 510 THEN prev ELSE as_of END, '%Y-%m-%d') AS expected_session FROM n""",
)
def expected_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest session that should have a bar at the time an order is seen."""
    seen = views.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.to_date("o_orderdate").alias("as_of"),
        F.when(F.col("o_orderkey") % 2 == 0, "NYMEX").otherwise("ICE").alias("exchange"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))).alias("observed_at"),
    )
    out = C.expected_latest_session(seen, C.session_calendar(_order_span(spark, sf_dir)))
    return settle(out.select("o_orderkey", "exchange", "expected_session"))


@query(
    "next_bars",
    f"""WITH {_CAL}, q AS (SELECT o_orderpriority AS key, max(CAST(o_orderdate AS DATE)) AS day FROM orders WHERE isodow(o_orderdate) <= 5
          AND (CAST(o_orderdate AS DATE), 'NYMEX') IN (SELECT (d, ex) FROM sess) GROUP BY 1),
      s AS (SELECT key, day, unnest(range(1, 41)) AS step FROM q)
      SELECT key, step, strftime(t.d, '%Y-%m-%d') AS bar_session, 480 + ((20 + step) % 26) * 15 AS minute_of_day
      FROM s JOIN sess o ON o.d = day AND o.ex = 'NYMEX' JOIN sess t ON t.ex = 'NYMEX' AND t.i = o.i + (20 + step) // 26""",
)
def next_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next forty bar starts after each series' last session."""
    calendar = C.session_calendar(_order_span(spark, sf_dir))
    sessions = calendar.filter("is_session AND exchange = 'NYMEX'").select(F.col("day").alias("session_date"))
    origins = (
        views.table(spark, sf_dir, "orders")
        .select(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("session_date"))
        .join(sessions, "session_date", "left_semi")
        .groupBy("key")
        .agg(F.max("session_date").alias("session_date"))
        .withColumns({"exchange": F.lit("NYMEX"), "bar_slot": F.lit(20)})
    )
    out = C.next_bar_times(origins, calendar, 40, 26, 15, 480)
    return settle(out.select("key", "step", "bar_session", "minute_of_day"))


@query(
    "pull_chunks",
    """WITH r AS (SELECT o_orderpriority AS key, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1),
      c AS (SELECT key, b, CAST(unnest(generate_series(a, b, INTERVAL 28 DAY)) AS DATE) AS s FROM r)
      SELECT key, strftime(s, '%Y-%m-%d') AS chunk_start, strftime(least(b, CAST(s + INTERVAL 27 DAY AS DATE)), '%Y-%m-%d') AS chunk_end FROM c""",
)
def pull_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull range of each series in chunks of 28 days."""
    ranges = views.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(
        F.to_date(F.min("o_orderdate")).alias("start_date"), F.to_date(F.max("o_orderdate")).alias("end_date")
    )
    return settle(C.pull_chunks(ranges).select("key", "chunk_start", "chunk_end"))


@query(
    "prepared_bars",
    settle_sql(
        f"WITH {ctes.PREPARED} SELECT root, security, strftime(d, '%Y-%m-%d') AS session_date, close * k AS close_usd_bbl, open * k AS open_usd_bbl,"
        " vol * bbl AS volume_bbl, bid AS bid_close, ask AS ask_close, oi1 AS open_interest_lag1, oi5 AS oi_change_5d,"
        " CAST(d < forced AS BIGINT) AS entry_contract_eligible, di AS delivery_index, grank AS generic_rank FROM prep",
        "root, security, session_date, entry_contract_eligible, delivery_index, generic_rank",
        "close_usd_bbl, open_usd_bbl, volume_bbl, bid_close, ask_close, open_interest_lag1, oi_change_5d",
    ),
)
def prepared_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade bars with quotes, expiry state, units, lagged open interest and rank."""
    return settle(views.market(spark, sf_dir).prepared.select(
        "root", "security", "session_date", "close_usd_bbl", "open_usd_bbl", "volume_bbl", "bid_close", "ask_close",
        "open_interest_lag1", "oi_change_5d", "entry_contract_eligible", "delivery_index", "generic_rank",
    ))


_K = "spread_id, strftime(d, '%Y-%m-%d') AS session_date"


_AT = "spread_id, strftime(d, '%Y-%m-%d %H:%M:%S') AS timestamp_utc"
CURVE_PACKS = f"WITH {ctes.CURVE_PREPARED},\n{ctes.packages_cte(G.CURVE_STRUCTURES)}"
_ROLLED = (
    "s_open AS spread_open, s_close AS spread_close, cap AS package_volume_capacity, oicap AS package_oi_capacity,"
    " cost AS one_way_cost_usd, events AS min_leg_events, v_open AS package_open_value_usd, v_close AS package_close_value_usd,"
    " s_vwap AS spread_bar_vwap, ticks AS max_leg_bid_ask_ticks, s_buy - s_sell AS quoted_width_usd_bbl, cap * barrels AS paired_volume_bbl,"
    " strftime(risk_date, '%Y-%m-%d') AS earliest_risk_date, strftime(forced, '%Y-%m-%d') AS forced_exit_session, CAST(entry_allowed AS BIGINT) AS entry_allowed,"
    " tenor AS tenor_bucket, settlement AS settlement_quality"
)
_ROLLED_KEYS = "spread_id, timestamp_utc, earliest_risk_date, forced_exit_session, entry_allowed, tenor_bucket, settlement_quality"
_ROLLED_VALUES = (
    "spread_open, spread_close, package_volume_capacity, package_oi_capacity, one_way_cost_usd, min_leg_events, package_open_value_usd,"
    " package_close_value_usd, spread_bar_vwap, max_leg_bid_ask_ticks, quoted_width_usd_bbl, paired_volume_bbl"
)
_CHANGES = "CAST(rolled AS BIGINT) AS roll_event, chg AS price_change, intraday AS intraday_change, overnight AS overnight_change, x AS research_close, to_risk AS sessions_to_risk_date"


def _columns(text: str) -> list[str]:
    return [c.strip() for c in text.split(",")]


@query("package_align", f"{PACKS} SELECT {_AT}, roll_id, n_legs FROM pk")
def package_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All legs of a structure at one time, for structures of two and four legs."""
    return settle(views.market(spark, sf_dir).raw_packages.select("spread_id", "timestamp_utc", "roll_id", "n_legs"))


@query("curve_package_align", f"{CURVE_PACKS} SELECT {_AT}, roll_id, n_legs, string_split(roll_id, ' | ')[1] AS first_leg FROM pk")
def curve_package_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four roots with four deliveries: packages of two, three, four and six legs by delivery, and two by rank."""
    packages = views.curve_market(spark, sf_dir).raw_packages
    first = F.element_at("legs", 1)["security"].alias("first_leg")
    return settle(packages.select("spread_id", "timestamp_utc", "roll_id", "n_legs", first))


@query("package_rollup", settle_sql(f"{PACKS} SELECT {_AT}, {_ROLLED} FROM pk", _ROLLED_KEYS, _ROLLED_VALUES, nudge=True))
def package_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package prices, quotes, capacity, cost and value from the legs, tenor and settlement label."""
    return settle(views.market(spark, sf_dir).raw_packages.select(*_columns(_ROLLED_KEYS), *_columns(_ROLLED_VALUES)), nudge=True)


@query("curve_package_rollup", settle_sql(f"{CURVE_PACKS} SELECT {_AT}, {_ROLLED} FROM pk", _ROLLED_KEYS, _ROLLED_VALUES, 3, nudge=True))
def curve_package_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up over four roots, cross-market labels included."""
    return settle(views.curve_market(spark, sf_dir).raw_packages.select(*_columns(_ROLLED_KEYS), *_columns(_ROLLED_VALUES)), 3, nudge=True)


@query(
    "roll_back_adjust",
    settle_sql(f"{ADJ} SELECT {_AT}, {_CHANGES} FROM adj", "spread_id, timestamp_utc, roll_event, sessions_to_risk_date", "price_change, intraday_change, overnight_change, research_close"),
)
def roll_back_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous close over rolls, bar change and its parts, business days to expiry."""
    df = views.market(spark, sf_dir).packages
    return settle(df.select("spread_id", "timestamp_utc", "roll_event", "price_change", "intraday_change", "overnight_change", "research_close", "sessions_to_risk_date"))


@query(
    "curve_back_adjust",
    settle_sql(f"{CURVE_PACKS},\n{ctes.ADJUSTED} SELECT {_AT}, {_CHANGES} FROM adj", "spread_id, timestamp_utc, roll_event, sessions_to_risk_date", "price_change, intraday_change, overnight_change, research_close", 4, nudge=True),
)
def curve_back_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with two bars a session, so that changes fall inside a session and between sessions."""
    df = views.curve_market(spark, sf_dir).packages
    return settle(df.select("spread_id", "timestamp_utc", "roll_event", "price_change", "intraday_change", "overnight_change", "research_close", "sessions_to_risk_date"), 4, nudge=True)


#: All templates: prefix, and root:offset:sign:contracts:weight of each leg; @ is each root.
_LEGS = """r(root) AS (VALUES ('HO'), ('CL'), ('CO'), ('QS')),
      t(prefix, legs) AS (VALUES ('CAL.@', '@:0:1:1:1 @:1:-1:1:1'), ('FLY.@', '@:0:1:1:1 @:1:-1:2:2 @:2:1:1:1'), ('CDR.@', '@:0:1:1:1 @:1:-1:1:1 @:2:-1:1:1 @:3:1:1:1'),
        ('CRK.HO_CL', 'HO:0:1:1:1 CL:0:-1:1:1'), ('CRK.QS_CO', 'QS:0:1:4:1 CO:0:-1:3:1'), ('RV.HO_QS', 'HO:0:1:3:1 QS:0:-1:4:1'), ('RV.CO_CL', 'CO:0:1:1:1 CL:0:-1:1:1'),
        ('BOX.CRACK.TRANSATL', 'HO:0:1:3:1 CL:0:-1:3:1 QS:0:-1:4:1 CO:0:1:3:1'),
        ('BOX.CRKCAL.HO_CL', 'HO:0:1:1:1 CL:0:-1:1:1 HO:1:-1:1:1 CL:1:1:1:1'), ('BOX.CRKCAL.QS_CO', 'QS:0:1:4:1 CO:0:-1:3:1 QS:1:-1:4:1 CO:1:1:3:1'),
        ('BOX.CURVE.HO_QS', 'HO:0:1:3:1 QS:0:-1:4:1 HO:1:-1:3:1 QS:1:1:4:1'), ('BOX.CURVE.CO_CL', 'CO:0:1:1:1 CL:0:-1:1:1 CO:1:-1:1:1 CL:1:1:1:1'),
        ('FLY.HOGO', 'HO:0:1:3:1 HO:1:-1:6:1 HO:2:1:3:1 QS:0:-1:4:1 QS:1:1:8:1 QS:2:-1:4:1')),
      u AS (SELECT replace(prefix, '@', root) AS prefix, string_split(replace(legs, '@', root), ' ') AS ls FROM t, r WHERE prefix LIKE '%@' UNION ALL SELECT prefix, string_split(legs, ' ') FROM t WHERE prefix NOT LIKE '%@'),
      e AS (SELECT prefix, unnest(range(1, len(ls) + 1)) AS ord, unnest(ls) AS leg FROM u),
      p AS (SELECT prefix, ord, split_part(leg, ':', 1) AS root, split_part(leg, ':', 2)::INT AS off, split_part(leg, ':', 3)::INT AS sgn, split_part(leg, ':', 4) AS lots, split_part(leg, ':', 5) AS w FROM e),
      s AS (SELECT prefix, max(off) AS span FROM p GROUP BY 1), k AS (SELECT prefix, span, unnest(range(1, 17 - span)) AS rank FROM s),
      legs AS (SELECT prefix || '.M' || array_to_string(list_transform(range(rank, rank + span + 1), lambda i: lpad(i::VARCHAR, 2, '0')), '_M') AS spread_id, p.* EXCLUDE (prefix) FROM k JOIN p USING (prefix))"""


@query(
    "structure_library_all",
    f"""WITH {_LEGS}, seen AS (SELECT DISTINCT {_ROOTS} AS root FROM lineitem),
      f AS (SELECT *, CASE WHEN sgn > 0 THEN '+' ELSE '-' END AS side, ' ' || legs.root || '[M+' || off || ']' AS told FROM legs)
      SELECT spread_id, ltrim(string_agg(side || w || told, ' ' ORDER BY ord), '+') AS normalized_price_formula,
        ltrim(string_agg(side || lots || told, ' ' ORDER BY ord), '+') AS executable_package, count(seen.root) AS legs_seen
      FROM f LEFT JOIN seen ON seen.root = f.root GROUP BY 1""",
)
def structure_library_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every structure of the library with both formulas and how many legs have bars."""
    seen = views.contract_bars(spark, sf_dir).select("root").distinct().withColumn("seen", F.lit(1))
    legs = G.leg_table(spark, G.curve_structures())
    told = legs.join(seen, "root", "left").groupBy("spread_id").agg(F.count("seen").alias("legs_seen"))
    return settle(G.formula_table(legs).join(told, "spread_id").select("spread_id", "normalized_price_formula", "executable_package", "legs_seen"))


@query(
    "leg_library_all",
    settle_sql(
        f"""WITH {ctes.CBARS}, {_LEGS}, costs(root, cost, tick) AS (VALUES ('HO', 6.7::DOUBLE, 0.0001::DOUBLE), ('CL', 12.5, 0.01), ('CO', 12.5, 0.01), ('QS', 27.5, 0.25)),
        v AS (SELECT root, sum(vol) AS seen_volume FROM cbars GROUP BY 1)
        SELECT spread_id, ord AS leg_order, root, sgn AS sign, lots::BIGINT AS contracts, off AS delivery_offset, w::DOUBLE AS price_weight,
          CASE WHEN sgn > 0 THEN 'Long ' ELSE 'Short ' END || lots || ' ' || root || ' delivery offset +' || off AS description,
          cost AS one_way_cost_usd, tick AS tick_size_native, seen_volume FROM legs JOIN costs USING (root) LEFT JOIN v USING (root)""",
        "spread_id, leg_order, root, sign, contracts, delivery_offset, description", "price_weight, one_way_cost_usd, tick_size_native, seen_volume",
    ),
)
def leg_library_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leg of the library with its root's economics; the volume is null where no bar has the root."""
    from curvelab.config import ROOTS

    every = G.curve_structures()
    library = G.leg_library(G.leg_table(spark, every), G.structure_table(spark, every, ROOTS), C.root_table(spark, ROOTS))
    volume = views.contract_bars(spark, sf_dir).groupBy("root").agg(F.sum("volume_contracts").alias("seen_volume"))
    return settle(library.join(volume, "root", "left").select(
        "spread_id", "leg_order", "root", "sign", "contracts", "delivery_offset", "description", "price_weight",
        "one_way_cost_usd", "tick_size_native", "seen_volume",
    ))


@query(
    "structure_library",
    f"""{CURVE_PACKS}, {_LEGS}, f AS (SELECT *, CASE WHEN sgn > 0 THEN '+' ELSE '-' END AS side FROM legs),
      g AS (SELECT spread_id, ltrim(string_agg(side || w || ' ' || root || '[M+' || off || ']', ' ' ORDER BY ord), '+') AS normalized_price_formula FROM f GROUP BY 1),
      n AS (SELECT spread_id, count(*) AS package_bars, strftime(min(d), '%Y-%m-%d') AS first_session, strftime(max(d), '%Y-%m-%d') AS last_session FROM pk GROUP BY 1)
      SELECT spread_id, normalized_price_formula, coalesce(package_bars, 0) AS package_bars, first_session, last_session FROM g LEFT JOIN n USING (spread_id)""",
)
def structure_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every structure of the library with its formula and the package bars that four roots give it."""
    packages = views.curve_market(spark, sf_dir).raw_packages
    seen = packages.groupBy("spread_id").agg(F.count(F.lit(1)).alias("package_bars"), F.min("session_date").alias("first_session"), F.max("session_date").alias("last_session"))
    formulas = G.formula_table(G.leg_table(spark, G.curve_structures())).select("spread_id", "normalized_price_formula")
    return settle(formulas.join(seen, "spread_id", "left").withColumn("package_bars", F.coalesce("package_bars", F.lit(0))))


@query(
    "leg_library",
    settle_sql(
        f"""WITH {ctes.CURVE_BARS}, {ctes.ECON}, {_LEGS}, v AS (SELECT root, step, sum(vol) AS seen_volume FROM cbars GROUP BY ALL)
        SELECT spread_id, ord AS leg_order, legs.root, sgn AS sign, off AS delivery_offset, cost AS one_way_cost_usd, tick AS tick_size_native, seen_volume FROM legs JOIN econ USING (root) LEFT JOIN v ON v.root = legs.root AND v.step = off""",
        "spread_id, leg_order, root, sign, delivery_offset", "one_way_cost_usd, tick_size_native, seen_volume",
    ),
)
def leg_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leg of the library with its root's economics and what was traded so many deliveries out."""
    from curvelab.config import ROOTS

    every = G.curve_structures()
    library = G.leg_library(G.leg_table(spark, every), G.structure_table(spark, every, ROOTS), C.root_table(spark, ROOTS))
    trade = views.curve_bars(spark, sf_dir).filter("event_type = 'TRADE'")
    placed = trade.withColumn("delivery_offset", F.months_between("delivery_month", F.add_months(views.curve_period(F.col("session_date")), 4)).cast("int"))
    volume = placed.groupBy("root", "delivery_offset").agg(F.sum("volume_contracts").alias("seen_volume"))
    return settle(library.join(volume, ["root", "delivery_offset"], "left").select(
        "spread_id", "leg_order", "root", "sign", "delivery_offset", "one_way_cost_usd", "tick_size_native", "seen_volume"
    ))


@query(
    "latest_legs",
    f"{PACKS}, n AS (SELECT * FROM pk WHERE d = (SELECT max(d) FROM pk)) SELECT DISTINCT unnest(string_split(roll_id, ' | ')) AS security FROM n",
)
def latest_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leg securities at the newest time."""
    m = views.market(spark, sf_dir)
    return settle(PK.latest_leg_securities(m.raw_packages))


@query(
    "structure_coverage",
    settle_sql(
        f"""{PACKS}, o AS (SELECT spread_id, count(*) AS feature_rows, count(DISTINCT d) AS sessions, min(d) AS a, max(d) AS b, avg(entry_allowed::INT) AS share, median(cap) AS med FROM pk GROUP BY 1),
        r AS (SELECT * FROM (VALUES {', '.join(f"('{s.spread_id}', '{s.family}')" for s in G.curve_structures(4, ('HO', 'CL', 'QS')))}) t(spread_id, family))
        SELECT spread_id, family, CASE WHEN o.spread_id IS NULL THEN 'INCOMPLETE_CURVE' ELSE 'OBSERVED' END AS status, coalesce(feature_rows, 0) AS feature_rows, coalesce(sessions, 0) AS sessions,
          strftime(a, '%Y-%m-%d') AS coverage_start, strftime(b, '%Y-%m-%d') AS coverage_end, share AS entry_allowed_share, med AS median_package_capacity
        FROM r LEFT JOIN o USING (spread_id)""",
        "spread_id, family, status, feature_rows, sessions, coverage_start, coverage_end", "entry_allowed_share, median_package_capacity",
    ),
)
def structure_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered structure with what was observed of it."""
    from curvelab.operators.quality import structure_coverage as coverage

    m = views.market(spark, sf_dir, horizon=4)
    return settle(coverage(m.structure_table, m.raw_packages).select(
        "spread_id", "family", "status", "feature_rows", "sessions", "coverage_start", "coverage_end",
        "entry_allowed_share", "median_package_capacity",
    ))


@query(
    "daily_settle_packages",
    settle_sql(
        f"{ADJ} SELECT {_K}, s_close AS spread_close, chg AS price_change, x AS research_close FROM adj",
        "spread_id, session_date", "spread_close, price_change, research_close",
    ),
)
def daily_settle_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of daily settles placed in the last slot."""
    df = views.market(spark, sf_dir).daily_packages
    return settle(df.select("spread_id", "session_date", "spread_close", "price_change", "research_close"))
