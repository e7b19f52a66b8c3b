"""Upserts, pull plans, pricing tables and data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelab.edge import settle, settle_sql
from curvelab.operators import calendar as C
from curvelab.operators import curves as CV
from curvelab.operators import experts as X
from curvelab.operators import ingest
from curvelab.operators import pricing as PR
from curvelab.operators import quality as Q
from curvelab.operators import scorecard as SC
from curvelab.queries import ctes, learning
from curvelab.queries.evidence import _PH, _metrics
from curvelab.registry import query
from curvelab.sources import views
from curvelab.stages import stage


@query(
    "upsert_keep_last",
    """WITH v AS (SELECT user_id, event_type, date_trunc('hour', ts) AS h, event_id AS seq, value FROM events), o AS (SELECT user_id, event_type, h, 0 AS s, arg_max(value, seq) AS value FROM v WHERE seq % 3 <> 0 GROUP BY ALL),
      n AS (SELECT user_id, event_type, h, 1 AS s, arg_max(value, seq) AS value FROM v WHERE seq % 3 = 0 GROUP BY ALL), u AS (SELECT * FROM o UNION ALL SELECT * FROM n)
      SELECT user_id, event_type, strftime(h, '%Y-%m-%d %H:%M:%S') AS bar, arg_max(value, s) AS value FROM u WHERE h >= TIMESTAMP '2024-01-08' GROUP BY ALL""",
)
def upsert_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows over old ones by key, older days dropped."""
    from curvelab.scale import keep_last

    rows = views.table(spark, sf_dir, "events").select(
        "user_id", "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bar"), F.to_date("ts").alias("session_date"), F.col("event_id").alias("seq"), "value"
    )
    keys = ["user_id", "event_type", "bar"]
    old = keep_last(rows.filter(F.col("seq") % 3 != 0), keys, "seq")
    new = keep_last(rows.filter(F.col("seq") % 3 == 0), keys, "seq")
    return settle(ingest.upsert(old, new, keys, F.lit("2024-01-08").cast("date")).select(*keys, "value"))


@query(
    "pull_plan",
    """WITH u AS (SELECT p_partkey AS security, DATE '1995-01-01' + (p_size * 20)::INT AS a, DATE '1996-01-01' + (p_size * 60)::INT AS b FROM part),
      l AS (SELECT l_partkey AS security, CAST(max(l_shipdate) AS DATE) AS last FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-06-01' GROUP BY 1)
      SELECT security, strftime(greatest(a, last - 5), '%Y-%m-%d') AS start_date, strftime(b, '%Y-%m-%d') AS end_date FROM u LEFT JOIN l USING (security)
      WHERE a <= b AND NOT coalesce(last IS NOT NULL AND (b < DATE '1999-01-01' OR last >= b), false)""",
)
def pull_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to request per part from its last stored day."""
    universe = views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("security"), F.date_add(F.lit("1995-01-01").cast("date"), F.col("p_size") * 20).alias("start_date"),
        F.date_add(F.lit("1996-01-01").cast("date"), F.col("p_size") * 60).alias("end_date"),
    )
    stored = views.table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") < "1999-06-01").select(
        F.col("l_partkey").alias("security"), F.to_date("l_shipdate").alias("date")
    )
    return settle(ingest.pull_plan(universe, stored, F.lit("1999-01-01").cast("date")).select("security", "start_date", "end_date"))


@query(
    "pivot_long",
    """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'view') AS view FROM events GROUP BY ALL""",
)
def pivot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field and value rows to columns, the last value wins."""
    rows = views.table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("field"), "value", "event_id")
    return settle(ingest.pivot_long(rows, ["user_id", "day"], ["click", "view"], "event_id"))


@query(
    "parse_dates",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""",
)
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in four layouts read back."""
    layouts = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyyMMdd")
    text = F.when(F.lit(False), "")
    for i, layout in enumerate(layouts):
        text = text.when(F.col("o_orderkey") % 4 == i, F.date_format("o_orderdate", layout))
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return settle(rows.select("o_orderkey", ingest.parse_date(F.col("text")).alias("day")))


@query(
    "daily_settles",
    """WITH d AS (SELECT l_partkey AS security, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_linenumber % 3 > 0 THEN l_extendedprice END AS settle, CASE WHEN l_linenumber <> 3 THEN l_extendedprice + 1 END AS last, l_orderkey * 10 + l_linenumber AS seq, l_quantity,
         l_extendedprice AS e, l_suppkey AS s FROM lineitem),
      k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY security, day ORDER BY seq DESC, e DESC, s DESC) = 1)
      SELECT p_brand AS root, CASE WHEN settle IS NOT NULL THEN 'PX_SETTLE' WHEN last IS NOT NULL THEN 'PX_LAST_FALLBACK' ELSE 'MISSING' END AS settle_source_field, count(*) AS n, round(sum(coalesce(settle, last)), 2) + 0.0 AS close_sum
      FROM k JOIN part ON security = p_partkey GROUP BY ALL""",
)
def daily_settles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settle first, last price labelled as fallback, last version kept."""
    number = F.col("l_linenumber")
    raw = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("security"), F.to_date("l_shipdate").alias("session_date"),
        F.when(number % 3 > 0, F.col("l_extendedprice")).alias("settle"), F.when(number != 3, F.col("l_extendedprice") + 1).alias("last_price"),
        F.col("l_quantity").alias("volume_contracts"), F.lit(None).cast("double").alias("open_interest"),
        F.struct(F.col("l_orderkey") * 10 + number, "l_extendedprice", "l_suppkey").alias("ingest_seq"),
    )
    universe = views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("security"), F.col("p_brand").alias("root"), F.add_months(F.lit("1995-01-01").cast("date"), F.col("p_size")).alias("delivery_month")
    )
    daily = ingest.normalize_daily(raw, universe)
    return settle(daily.groupBy("root", "settle_source_field").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("close_sum")), dp=2)


@query(
    "intraday_bars",
    """WITH l AS (SELECT event_type AS security, date_trunc('minute', ts) - (minute(ts) % 15) * INTERVAL 1 MINUTE AS b, value, event_id FROM events),
      k AS (SELECT security, b, arg_max(value, event_id) AS close FROM l WHERE hour(b) * 60 + minute(b) BETWEEN 480 AND 855 GROUP BY ALL)
      SELECT security, strftime(b AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS timestamp_utc, strftime(b, '%Y-%m-%d') AS session_date, (hour(b) * 60 + minute(b) - 480) // 15 AS bar_slot, close FROM k""",
)
def intraday_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local bars cut to the session window, slotted, moved to UTC, deduplicated."""
    minute = F.date_trunc("minute", "ts").cast("timestamp_ntz")
    raw = views.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("ticker"), (minute - F.make_dt_interval(mins=F.minute("ts") % 15)).alias("time"), F.col("value").alias("close"), F.col("event_id").alias("ingest_seq"),
    )
    universe = raw.select(F.col("ticker").alias("security")).distinct().withColumns({"root": F.lit("X"), "delivery_month": F.lit("2024-06-01").cast("date")})
    bars = ingest.import_backfill(raw, universe)
    return settle(bars.select("security", "timestamp_utc", "session_date", "bar_slot", "close"))


@query(
    "merged_registry",
    """WITH o AS (SELECT p_partkey AS security, p_size % 2 = 0 AS v, 0 AS s FROM part), n AS (SELECT p_partkey, p_size % 3 = 0, 1 FROM part WHERE p_partkey % 5 > 0), u AS (SELECT * FROM o UNION ALL SELECT * FROM n)
      SELECT security, CAST(v AS BIGINT) AS expiry_verified, s AS version FROM u QUALIFY row_number() OVER (PARTITION BY security ORDER BY v DESC, s DESC) = 1""",
)
def merged_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verified contract row survives a newer unverified one."""
    parts = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("security"), F.col("p_brand").alias("root"), F.lit("2024-01-01").cast("date").alias("delivery_month"), "p_size")
    old = parts.withColumns({"expiry_verified": F.col("p_size") % 2 == 0, "version": F.lit(0)})
    new = parts.filter(F.col("security") % 5 > 0).withColumns({"expiry_verified": F.col("p_size") % 3 == 0, "version": F.lit(1)})
    return settle(C.merge_registries(old, new).select("security", "expiry_verified", "version"))




def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as pricing roots: letters only, one flat, one disabled."""
    brand = views.table(spark, sf_dir, "part").select("p_brand").distinct()
    digits = F.substring("p_brand", 7, 2)
    code = F.translate(digits, "0123456789", "ABCDEFGHIJ")
    return brand.select(
        code.alias("root"), F.col("p_brand").alias("common_name"), F.col("p_brand").alias("aliases"), F.lit("Comdty").alias("yellow_key"), F.lit("$/bbl").alias("native_unit"),
        F.lit(7.45).alias("bbl_per_mt"), F.lit(42.0).alias("gal_per_bbl"), F.when(digits == "11", "flat").otherwise("monthly").alias("curve_mode"),
        F.when(digits == "11", "{root} SPOT {yellow_key}").otherwise("{root}{month_code}{y} {yellow_key}").alias("ticker_template"),
        F.lit("").alias("default_price_field"), F.lit(None).cast("int").alias("time_zone_override"), (digits != "25").alias("enabled"), digits.cast("int").alias("row_number"),
    )


_CODE = "translate(substr(p_brand, 7, 2), '0123456789', 'ABCDEFGHIJ')"


@query(
    "pricing_universe",
    f"""WITH r AS (SELECT DISTINCT {_CODE} AS root, p_brand FROM part), y AS (SELECT root, y, m FROM r, range(1989, 2011) a(y), range(1, 13) b(m) WHERE root <> 'BB')
      SELECT root, root || substr('FGHJKMNQUVXZ', m, 1) || lpad((y % 100)::VARCHAR, 2, '0') || ' Comdty' AS security, substr('FGHJKMNQUVXZ', m, 1) || lpad((y % 100)::VARCHAR, 2, '0') AS contract_month_yr, y AS contract_year,
        strftime(greatest(DATE '1995-01-01', CAST(make_date(y, m, 1) - INTERVAL 24 MONTH AS DATE)), '%Y-%m-%d') AS start_date, strftime(least(DATE '2001-12-31', make_date(y, m, 1) - 1), '%Y-%m-%d') AS end_date FROM y
      UNION ALL SELECT root, root || ' SPOT Comdty', '', NULL, '1995-01-01', '2001-12-31' FROM r WHERE root = 'BB'""",
)
def pricing_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated and flat securities of the brands with collision-safe year digits."""
    as_of, start = F.lit("2001-12-31").cast("date"), F.lit("1995-01-01").cast("date")
    out = PR.pricing_universe(_roots(spark, sf_dir), 1989, 2010, as_of, start, 24)
    return settle(out.select("root", "security", "contract_month_yr", "contract_year", "start_date", "end_date"))


def _priced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Line items as delivered price rows of the brands' contracts: rows, what was left out, universe.

    Universe and rows are stage tables, as the checks read them several times.
    """
    as_of, start = F.lit("2001-12-31").cast("date"), F.lit("1995-01-01").cast("date")
    monthly = _roots(spark, sf_dir).filter(F.col("curve_mode") != "flat")
    universe = stage(spark, "priced-universe", sf_dir, lambda: PR.pricing_universe(monthly, 1996, 2003, as_of, start, 24))
    part = views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.translate(F.substring("p_brand", 7, 2), "0123456789", "ABCDEFGHIJ").alias("code"), "p_size"
    )
    year = (F.lit(1996) + F.col("l_suppkey") % 8).cast("string")
    month = F.substring(F.lit("FGHJKMNQUVXZ"), (F.col("p_size") % 12 + 1).cast("int"), F.lit(1))
    raw = views.table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(
        F.lower(F.concat(F.col("code"), month, F.right(year, F.lit(2)), F.lit(" Comdty"))).alias("security"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("l_linenumber") != 5, F.col("l_extendedprice").cast("string")).otherwise("n/a").alias("PX_LAST"),
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey", "l_partkey").alias("ingest_seq"),
    )
    rows, skipped = PR.normalize_pricing(raw, universe, ["PX_LAST"], 2)
    return stage(spark, "priced-rows", sf_dir, lambda: rows), skipped, universe


_PRICED = f"""WITH i AS (SELECT {_CODE} AS root, p_size % 12 + 1 AS m, 1996 + l_suppkey % 8 AS y, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_linenumber <> 5 THEN l_extendedprice END AS px, l_orderkey, l_linenumber, l_extendedprice, l_suppkey, l_partkey
    FROM lineitem JOIN part ON l_partkey = p_partkey),
  b AS (SELECT *, root || substr('FGHJKMNQUVXZ', m::INT, 1) || lpad((y % 100)::VARCHAR, 2, '0') || ' Comdty' AS security, y - (year(day) + (month(day) >= m)::INT) + 1 AS reference FROM i
    WHERE root <> 'BB' AND day >= greatest(DATE '1995-01-01', CAST(make_date(y::INT, m::INT, 1) - INTERVAL 24 MONTH AS DATE)) AND day <= least(DATE '2001-12-31', make_date(y::INT, m::INT, 1) - 1)),
  k AS (SELECT * FROM b WHERE reference BETWEEN 1 AND 2 AND px IS NOT NULL QUALIFY row_number() OVER (PARTITION BY security, day ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_suppkey DESC, l_partkey DESC) = 1)"""


@query(
    "pricing_rows",
    f"{_PRICED} SELECT security AS security_str, root, strftime(day, '%Y-%m-%d') AS date, reference::BIGINT AS reference, round(px, 5) AS PX_LAST FROM k",
)
def pricing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered rows cut to universe, dates and depth."""
    rows, _, _ = _priced(spark, sf_dir)
    return settle(rows.select("security_str", "root", "date", "reference", "PX_LAST"))


@query(
    "pricing_skips",
    f"""{_PRICED} SELECT (SELECT count(DISTINCT root || m || '-' || y) FROM i WHERE root = 'BB') AS unknown_securities, count(*) FILTER (reference NOT BETWEEN 1 AND 2) AS outside_depth,
      count(*) FILTER (reference BETWEEN 1 AND 2 AND px IS NULL) AS missing_last FROM b""",
)
def pricing_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many delivered rows were left out, by reason."""
    return settle(_priced(spark, sf_dir)[1])


@query(
    "root_statistics",
    f"""{_PRICED} SELECT root, count(*) AS rows, count(DISTINCT security) AS securities, strftime(min(day), '%Y-%m-%d') AS min_date, strftime(max(day), '%Y-%m-%d') AS max_date FROM k GROUP BY 1""",
)
def root_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, securities and dates per root."""
    return settle(PR.root_statistics(_priced(spark, sf_dir)[0]))


@query(
    "canonical_checks",
    f"""{_PRICED}, p AS (SELECT count(*) AS n FROM k WHERE day > DATE '2001-06-30'), f AS (SELECT count(*) AS n FROM (SELECT DISTINCT {_CODE} AS root FROM part WHERE p_brand NOT LIKE '%#25' AND {_CODE} NOT IN (SELECT root FROM k))),
      e AS (SELECT count(DISTINCT root) AS n FROM k WHERE root = 'CF')
      SELECT * FROM (SELECT 'future observation date' AS issue, n AS rows FROM p UNION ALL SELECT 'enabled root without rows', n FROM f UNION ALL SELECT 'unconfigured root', n FROM e) WHERE rows > 0""",
)
def canonical_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the canonical table as seen mid-2001."""
    rows, _, universe = _priced(spark, sf_dir)
    return settle(Q.canonical_issues(rows, universe, _roots(spark, sf_dir), F.lit("2001-06-30").cast("date"), 2, ["PX_LAST"]))


@query(
    "alias_resolution",
    f"SELECT p_partkey, {_CODE} AS root FROM part",
)
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root of each part's brand name through the alias list."""
    parts = views.table(spark, sf_dir, "part").select("p_partkey", F.lower("p_brand").alias("code"))
    return settle(PR.resolve_aliases(parts, _roots(spark, sf_dir), "code").select("p_partkey", "root"))


@query("root_config_issues", f"SELECT * FROM (SELECT substr(p_brand, 7, 2)::INT AS row_number, 'root is required' AS issue FROM (SELECT DISTINCT p_brand FROM part) WHERE p_brand LIKE '%#13' UNION ALL SELECT substr(p_brand, 7, 2)::INT, 'bbl_per_mt must be positive' FROM (SELECT DISTINCT p_brand FROM part) WHERE p_brand LIKE '%#14')")
def root_config_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root table with two planted faults."""
    broken = _roots(spark, sf_dir).withColumns({
        "root": F.when(F.col("row_number") == 13, "").otherwise(F.col("root")), "bbl_per_mt": F.when(F.col("row_number") == 14, -1.0).otherwise(F.col("bbl_per_mt")),
    })
    return settle(PR.root_config_issues(broken))


@query(
    "quality_report",
    f"""WITH {ctes.CBARS}, g AS (SELECT security, d, count(*) AS n FROM cbars GROUP BY ALL),
      m AS (SELECT count(DISTINCT d) AS s, min(d) AS a, max(d) AS b, (SELECT avg((n = 1)::INT) FROM g) AS cs, avg((vol IS NOT NULL)::INT) AS vc FROM cbars),
      cu AS (SELECT CASE WHEN count(*) = 3 THEN min(c) ELSE 0 END AS c FROM (SELECT root, count(DISTINCT security) AS c FROM cbars WHERE d = (SELECT max(d) FROM cbars) GROUP BY 1))
      SELECT "check", status, blocking FROM (
      SELECT 'history_sessions' AS "check", CASE WHEN s >= 300 THEN 'PASS' WHEN s >= 120 THEN 'WARN' ELSE 'FAIL' END AS status, (s < 120)::BIGINT AS blocking FROM m
      UNION ALL SELECT 'rolling_intraday_coverage', CASE WHEN a <= b - INTERVAL 20 MONTH THEN 'PASS' ELSE 'WARN' END, 0 FROM m
      UNION ALL SELECT 'forward_curve_contracts', CASE WHEN c >= 16 THEN 'PASS' ELSE 'WARN' END, 0 FROM cu
      UNION ALL SELECT 'daily_settle_history', 'PASS', 0
      UNION ALL SELECT 'complete_session_security_groups', CASE WHEN cs >= 0.95 THEN 'PASS' ELSE 'WARN' END, (cs < 0.8)::BIGINT FROM m
      UNION ALL SELECT 'volume_coverage', CASE WHEN vc >= 0.9 THEN 'PASS' ELSE 'FAIL' END, (vc < 0.9)::BIGINT FROM m
      UNION ALL SELECT 'verified_expiry_metadata', 'PASS', 0 UNION ALL SELECT 'market_depth_source', 'WARN', 0 UNION ALL SELECT 'frozen_model_freshness', 'FAIL', 0)""",
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the contract bars and the model's age."""
    trading = C.TradingDay(complete_bars_per_session=1)
    bars = views.contract_bars(spark, sf_dir)
    daily = bars.select("session_date", F.lit("PX_SETTLE").alias("settle_source_field"))
    contracts = views.market(spark, sf_dir).contracts
    report = Q.quality_report(bars, contracts, daily, 3, trading=trading, depth_source="TOP_OF_BOOK", model_as_of=F.lit("2000-01-01").cast("date"))
    return settle(report.select("check", "status", "blocking"))


@query(
    "session_completeness",
    """WITH h AS (SELECT event_type AS security, CAST(ts AS DATE) AS d, hour(ts) AS s FROM events GROUP BY ALL) SELECT security, strftime(d, '%Y-%m-%d') AS session_date, count(*) AS bars, count(DISTINCT s) AS distinct_slots, 0 AS invalid_slots, (count(*) = 24)::BIGINT AS complete FROM h GROUP BY ALL""",
)
def session_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots present per series and day (V6)."""
    return settle(Q.session_completeness(views.hour_bars(spark, sf_dir).withColumnRenamed("spread_id", "security"), 24))


@query(
    "core_packages",
    f"WITH {ctes.HOURS}, l AS (SELECT spread_id, count(*) AS n FROM hours WHERE CAST(t AS DATE) = (SELECT max(CAST(t AS DATE)) FROM hours) GROUP BY 1) SELECT DISTINCT spread_id FROM hours WHERE spread_id NOT IN (SELECT spread_id FROM l WHERE n = 24)",
)
def core_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series without a full newest session (V7)."""
    bars = views.hour_bars(spark, sf_dir)
    return settle(Q.core_packages_missing(bars, bars.select("spread_id").distinct(), 24))


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are not unique (V9)."""
    return settle(Q.duplicate_keys(views.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query(
    "table_difference",
    """SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 'LEFT_ONLY' ELSE 'RIGHT_ONLY' END AS side FROM orders WHERE o_orderkey % 10 IN (0, 5)""",
)
def table_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only one of two tables has (V4)."""
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    left, right = orders.filter(F.col("o_orderkey") % 10 != 5), orders.filter(F.col("o_orderkey") % 10 != 0)
    return settle(Q.table_difference(left, right, ["o_orderkey", "o_orderpriority"]))


_AB = f"""WITH {_PH}, oa AS (SELECT * FROM ph WHERE phase = 'OOS'), ob AS (SELECT * FROM oa WHERE relvol > 10), {_metrics('oa', 'spread_id, strategy_id, fold', 'fa')}, {_metrics('ob', 'spread_id, strategy_id, fold', 'fb')},
  na AS (SELECT spread_id, strategy_id, fold, sum(net) AS net FROM oa GROUP BY ALL), nb AS (SELECT spread_id, strategy_id, fold, sum(net) AS net FROM ob GROUP BY ALL),
  x AS (SELECT na.spread_id, na.strategy_id, na.fold, na.net AS a, coalesce(nb.net, 0) AS b, fa.mdd AS am, coalesce(fb.mdd, 0) AS bm FROM na JOIN fa USING (spread_id, strategy_id, fold) LEFT JOIN nb USING (spread_id, strategy_id, fold) LEFT JOIN fb USING (spread_id, strategy_id, fold))"""


def _ab(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    trades = views.phased_trades(spark, sf_dir).withColumn("gated", F.coalesce(F.col("entry_relative_volume") > 10, F.lit(False)))
    days = SC.fold_days(trades, "gated")
    return SC.fold_results(days), SC.fold_results(days.filter("gated"))


@query(
    "ab_compare",
    f"""{_AB} SELECT 'net_pnl_usd' AS metric, count(*) AS joined_rows, count(*) FILTER (b - a > 1e-9) AS improved, count(*) FILTER (b - a < -1e-9) AS worse, count(*) FILTER (abs(b - a) <= 1e-9) AS same FROM x
      UNION ALL SELECT 'max_drawdown_usd', count(*), count(*) FILTER (bm - am < -1e-9), count(*) FILTER (bm - am > 1e-9), count(*) FILTER (abs(bm - am) <= 1e-9) FROM x""",
)
def ab_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds improved and worse under a volume gate."""
    a, b = _ab(spark, sf_dir)
    out = Q.compare_results(a, b, ["spread_id", "strategy_id", "fold"], {"net_pnl_usd": False, "max_drawdown_usd": True})
    return settle(out.select("metric", "joined_rows", "improved", "worse", "same"))


@query(
    "family_outcomes",
    f"""{_AB}, f AS (SELECT substr(spread_id, 1, 7) AS family, bm - am AS d FROM x) SELECT family, count(*) FILTER (d < -1e-9) AS improved, count(*) FILTER (d > 1e-9) AS worse,
      (count(*) FILTER (d < -1e-9) >= 0.6 * count(*) FILTER (abs(d) > 1e-9) AND count(*) FILTER (abs(d) > 1e-9) > 0)::BIGINT AS qualifies FROM f GROUP BY 1""",
)
def family_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawdown outcome per brand family."""
    a, b = _ab(spark, sf_dir)
    families = a.select("spread_id", F.substring("spread_id", 1, 7).alias("family")).distinct()
    return settle(Q.family_outcomes(a, b, ["spread_id", "strategy_id", "fold"], families).select("family", "improved", "worse", "qualifies"))


def _hour_folds(trades: str, mark: str) -> str:
    """Net and drawdown per fold of a ledger's trades."""
    return f"""oo{mark} AS (SELECT spread_id, strategy_id, fin AS fold, xsd AS exit_session, net FROM {trades} WHERE phase = 'OOS'), {_metrics(f'oo{mark}', 'spread_id, strategy_id, fold', f'fm{mark}')},
fd{mark} AS (SELECT spread_id, strategy_id, fold, sum(net) AS net, any_value(mdd) AS mdd FROM oo{mark} JOIN fm{mark} USING (spread_id, strategy_id, fold) GROUP BY ALL)"""


@query(
    "gate_ablation",
    f"""{learning.ledger_sql()}{learning.second_ledger_sql(True)}, {_hour_folds('tr', '1')}, {_hour_folds('tr_', '2')},
    j AS (SELECT spread_id, strategy_id, fold, coalesce(b.net, 0) - coalesce(a.net, 0) AS dn, coalesce(a.mdd, 0) - coalesce(b.mdd, 0) AS dd FROM fd1 a FULL JOIN fd2 b USING (spread_id, strategy_id, fold)),
    n AS (SELECT count(*) FILTER (dn > 1e-9) AS up, count(*) FILTER (dn < -1e-9) AS dn, count(*) FILTER (dd > 1e-9) AS dup, count(*) FILTER (dd < -1e-9) AS ddn FROM j),
    fa AS (SELECT spread_id[1:1] AS family, count(*) FILTER (dd > 1e-9) AS up, count(*) FILTER (dd < -1e-9) AS dn FROM j GROUP BY 1),
    c AS (SELECT (SELECT sum(gross - 2 * paid) FROM tr) AS base, (SELECT sum(gross - 2 * paid) FROM tr_) AS cand),
    o AS (SELECT n.up > n.dn AS p1, coalesce((cand - base) / nullif(abs(base), 0) >= -0.1, cand >= -1e-9) AS p2, coalesce(dup / nullif(dup + ddn, 0) >= 0.6, false) AS p3, (SELECT count(*) FROM fa WHERE up / nullif(up + dn, 0) >= 0.6) >= 2 AS p4 FROM n, c)
    SELECT (SELECT count(*) FROM tr) AS trades_without, (SELECT count(*) FROM tr_) AS trades_with, p1::BIGINT AS broad_fold_net_improvement, p2::BIGINT AS double_cost_net_retention, p3::BIGINT AS fold_drawdown_improvement, p4::BIGINT AS family_breadth,
      CASE WHEN p1 AND p2 AND p3 AND p4 THEN 'PROMOTE' ELSE 'REJECT' END AS decision FROM o""".replace(" o AS (SELECT n.up", " oc AS (SELECT n.up").replace("AS decision FROM o", "AS decision FROM oc").replace("    n AS (", "    nb AS (").replace("n.up > n.dn", "nb.up > nb.dn").replace("FROM n, c)", "FROM nb, cb)").replace("    c AS (", "    cb AS ("),
)
def gate_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with and without candidate risk gates, and the promotion decision."""
    off = learning.hour_trades(spark, sf_dir).withColumns({"complexity_tier": F.lit(1), "algebra_group": F.col("spread_id")})
    on = learning.hour_trades(spark, sf_dir, gates=True).withColumns({"complexity_tier": F.lit(1), "algebra_group": F.col("spread_id")})
    keys = ["spread_id", "strategy_id", "fold"]
    a, b = SC.fold_metrics(off, learning.HOURLY.evidence), SC.fold_metrics(on, learning.HOURLY.evidence)
    compared = Q.compare_results(a, b, keys, {"net_pnl_usd": False, "max_drawdown_usd": True})
    families = off.select("spread_id", F.substring("spread_id", 1, 1).alias("family")).distinct()
    candidate = on.agg(F.sum("pnl_2x_cost_usd")).scalar()
    cost = off.agg(F.sum("pnl_2x_cost_usd").alias("baseline")).select("baseline", candidate.alias("candidate"))
    outcome = Q.promotion(compared.filter("metric = 'net_pnl_usd'"), compared.filter("metric = 'max_drawdown_usd'"), cost, Q.family_outcomes(a, b, keys, families))
    counts = {"trades_without": off.agg(F.count(F.lit(1))).scalar(), "trades_with": on.agg(F.count(F.lit(1))).scalar()}
    return settle(outcome.withColumns(counts))


@query(
    "series_catalog",
    settle_sql(
        f"""{_PRICED} SELECT root || '::' || strftime(make_date(2000, m::INT, 1), '%b') || '::' || reference AS series_key, root, reference::BIGINT AS reference, min(y)::BIGINT AS first_year, max(y)::BIGINT AS last_year,
          count(*) AS points, 7.45 AS bbl_per_mt FROM k GROUP BY root, m, reference""",
        "series_key, root, reference, first_year, last_year, points", "bbl_per_mt",
    ),
)
def series_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per series key with years, points and factor."""
    rows = _priced(spark, sf_dir)[0].withColumn("plot_year", F.col("contract_year"))
    return settle(PR.series_catalog(rows).select("series_key", "root", "reference", "first_year", "last_year", "points", "bbl_per_mt"))


_FACTOR = "CASE WHEN root < 'C' THEN 7.45 ELSE 7.33 END"


@query(
    "root_config",
    settle_sql(
        f"{_PRICED} SELECT root, root || '-name' AS common_name, count(*) AS rows, min({_FACTOR}) AS bbl_per_mt, max(42.0) AS gal_per_bbl FROM k WHERE root <> 'CF' GROUP BY root",
        "root, common_name, rows", "bbl_per_mt, gal_per_bbl",
    ),
)
def root_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured names and factors over those of the data; disabled roots fall out."""
    rows = _priced(spark, sf_dir)[0].drop("common_name").withColumns({"bbl_per_mt": F.lit(7.33), "gal_per_bbl": F.lit(None).cast("double")})
    roots = _roots(spark, sf_dir).select(
        "root", "enabled", F.concat("root", F.lit("-name")).alias("common_name"), F.when(F.col("root") < "C", 7.45).alias("bbl_per_mt"), F.lit(42.0).alias("gal_per_bbl")
    )
    done = PR.apply_root_config(rows, roots)
    return settle(done.groupBy("root", "common_name").agg(F.count(F.lit(1)).alias("rows"), F.min("bbl_per_mt").alias("bbl_per_mt"), F.max("gal_per_bbl").alias("gal_per_bbl")))


@query(
    "pricing_upsert",
    settle_sql(
        f"""{_PRICED}, a AS (SELECT security, day, root, y, px, 0 AS v FROM k WHERE l_linenumber < 6 UNION ALL SELECT security, day, root, y, px + 1, 1 FROM k WHERE l_linenumber % 2 = 0),
          u AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY security, day ORDER BY v DESC) = 1)
          SELECT security AS security_str, strftime(day, '%Y-%m-%d') AS date, root, y::BIGINT AS contract_year, '$/bbl' AS native_unit, px AS PX_LAST FROM u""",
        "security_str, date, root, contract_year, native_unit", "PX_LAST",
    ),
)
def pricing_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulled rows over stored ones, metadata from the universe again."""
    rows, _, universe = _priced(spark, sf_dir)
    line = F.col("ingest_seq.l_linenumber")
    stale = {"root": F.lit("old"), "month": F.lit("old"), "contract_month_yr": F.lit("old"), "native_unit": F.lit("old")}
    columns = ["security_str", "date", "root", "contract_year", "month", "contract_month_yr", "native_unit", "PX_LAST"]
    stored = rows.filter(line < 6).withColumns(stale).select(*columns)
    pulled = rows.filter(line % 2 == 0).withColumn("PX_LAST", F.col("PX_LAST") + 1).select(*columns)
    done = PR.upsert_pricing(stored, pulled, universe)
    return settle(done.select("security_str", "date", "root", "contract_year", "native_unit", "PX_LAST"))


@query(
    "extreme_returns",
    settle_sql(
        f"""{_PRICED}, r AS (SELECT *, ln(px) - ln(lag(px) OVER (PARTITION BY security ORDER BY day)) AS lr FROM k)
          SELECT security AS security_str, strftime(day, '%Y-%m-%d') AS date, lr AS log_return FROM r WHERE abs(lr) > 0.5""",
        "security_str, date", "log_return",
    ),
)
def extreme_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log returns within one contract beyond the limit (V3)."""
    out = Q.extreme_returns(_priced(spark, sf_dir)[0], ["security_str"], "date", "PX_LAST")
    return settle(out.select("security_str", "date", "log_return"))


_FILE_FAULTS = {
    ("ISSUE", "PX_LAST is not a number"): "n = 5",
    ("WARN", "PX_LAST is not positive"): "n = 6",
    ("ISSUE", "PX_VOLUME is negative"): "q < 3",
    ("WARN", "VOL_30D outside [0, 3]"): "d > 0.075",
    ("ISSUE", "PX_LAST exceeds precision"): "n = 4",
    ("ISSUE", "month differs from contract"): "n = 7 AND m <> 1",
    ("ISSUE", "year differs from contract"): "n = 3",
    ("ISSUE", "security does not start with its root"): "n = 2",
    ("ISSUE", "bbl_per_mt is not positive"): "q > 48",
}


@query(
    "pricing_file_issues",
    f"""WITH f AS (SELECT l_linenumber AS n, l_quantity AS q, l_discount AS d, p_size % 12 + 1 AS m, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
      t AS ({" UNION ALL ".join(f"SELECT '{s}' AS severity, '{i}' AS issue, count(*) AS rows FROM f WHERE {w}" for (s, i), w in _FILE_FAULTS.items())}
        UNION ALL SELECT 'ISSUE', 'bbl_per_mt varies within a root', count(*) FROM (SELECT p_brand FROM f GROUP BY 1 HAVING count(DISTINCT q > 48) > 1))
      SELECT * FROM t WHERE rows > 0""",
)
def pricing_file_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of a delivered file, faults planted by line number and quantity (V3)."""
    part = views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.translate(F.substring("p_brand", 7, 2), "0123456789", "ABCDEFGHIJ").alias("root"), (F.col("p_size") % 12 + 1).cast("int").alias("m")
    )
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    code = F.concat(F.substring(F.lit("FGHJKMNQUVXZ"), F.col("m"), F.lit(1)), F.lit("25"))
    names = F.split(F.lit("Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec"), ",")
    rows = views.table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(
        "root", F.concat(F.when(n == 2, "x").otherwise(""), "root", code, F.lit(" Comdty")).alias("security_str"), code.alias("contract_month_yr"),
        F.when(n == 5, "n/a").when(n == 6, "-1.5").when(n == 4, "10.1234567").otherwise(F.col("l_extendedprice").cast("string")).alias("PX_LAST"),
        (q - 3).cast("string").alias("PX_VOLUME"), (F.col("l_discount") * 40).cast("string").alias("VOL_30D"),
        F.when(n == 7, "Jan").otherwise(F.element_at(names, F.col("m"))).alias("month"), F.when(n == 3, "2031").otherwise("2025").alias("contract_year"),
        F.when(q > 48, "0").otherwise("7.45").alias("bbl_per_mt"),
    )
    return settle(Q.pricing_file_issues(rows))


@query(
    "resolve_series",
    f"""{_PRICED}, c AS (SELECT root, m, reference, max(y) AS y, root || '-' || m || '-' || reference AS code FROM k GROUP BY root, m, reference),
      l AS (SELECT p_partkey AS leg, {_CODE} AS root, p_size % 13 AS wm, p_partkey % 3 AS yo FROM part),
      j AS (SELECT leg, code, y, reference, yo, c.root IS NOT NULL AND (wm = 0 OR m = wm) AS match FROM l LEFT JOIN c ON c.root = l.root),
      f AS (SELECT *, match AND yo > 0 AND reference = yo + 1 AS asked, bool_or(match) OVER w AS any_, bool_or(match AND yo > 0 AND reference = yo + 1) OVER w AS any_asked,
          min(reference) FILTER (match) OVER w AS low FROM j WINDOW w AS (PARTITION BY leg))
      SELECT leg, arg_max(code, (y, code)) FILTER (code IS NOT NULL AND CASE WHEN NOT any_ THEN true WHEN any_asked THEN asked WHEN yo > 0 THEN match ELSE match AND reference = low END) AS code FROM f GROUP BY leg""",
)
def resolve_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog series that each part's leg means."""
    rows = _priced(spark, sf_dir)[0]
    catalog = rows.groupBy("root", "month_number", "reference").agg(F.max("contract_year").alias("contract_year")).select(
        "root", F.col("month_number").cast("string").alias("period"), "reference", "contract_year",
        F.concat_ws("-", "root", F.col("month_number").cast("string"), F.col("reference").cast("string")).alias("code"),
    )
    month = F.col("p_size") % 13
    legs = views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("leg"), F.translate(F.substring("p_brand", 7, 2), "0123456789", "ABCDEFGHIJ").alias("root"),
        F.when(month == 0, "").otherwise(month.cast("string")).alias("wanted_period"), (F.col("p_partkey") % 3).alias("year_offset"),
    )
    return settle(CV.resolve_series(legs, catalog))
