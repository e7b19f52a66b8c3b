"""Normalisation and upsert of intraday bars, daily settles and snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelab.operators.calendar import TradingDay
from curvelab.scale import keep_last, union_all

# Input column spellings and their canonical names.
COLUMN_SPELLINGS = {
    "time": "time",
    "datetime": "time",
    "timestamp": "time",
    "num_events": "num_events",
    "numevents": "num_events",
    "number_of_events": "num_events",
    "volume": "volume_contracts",
    "px_volume": "volume_contracts",
    "ticker": "security",
    "security": "security",
}

BAR_KEYS = ("security", "event_type", "timestamp_utc")


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename known spellings; of two columns with one meaning the first one wins."""
    used: set[str] = set()
    out: list[Column] = []
    for column in df.columns:
        key = column.strip().lower().replace(" ", "_")
        name = COLUMN_SPELLINGS.get(key, key)
        if name in used:
            out.append(F.col(f"`{column}`"))
            continue
        used.add(name)
        out.append(F.col(f"`{column}`").alias(name))
    return df.select(*out)


def pick_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate present, whatever its case."""
    by_lower = {c.lower(): c for c in columns}
    return next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)


# Spellings of pricing columns, the preferred one first.
PRICING_SPELLINGS: dict[str, tuple[str, ...]] = {
    "date": ("date", "dt", "datetime"),
    "security_str": ("security_str", "security", "ticker", "symbol", "code", "security_id", "fut_cur_gen_ticker"),
    "PX_LAST": ("px_last", "px_last_st", "px_last_price"),
    "PX_CLOSE": ("px_close", "px_closing", "px_close_price"),
    "PX_SETTLE": ("px_settle", "px_settlement"),
    "PX_FAIR_1430": (
        "px_fair_1430", "px_fair_value_1430", "px_1430_fair", "px_1430_fair_value", "px_fair_value", "fair_value_1430", "fair_value",
        "px_fv_1430", "fv_1430",
    ),
    "VOL_30D": ("vol_30d", "vol30d", "volatility_30d", "hist_vol_30d", "hist_volatility_30d", "vol_30_day", "volatility_30_day"),
    "PX_VOLUME": ("px_volume", "volume", "vol", "qty", "quantity"),
    "CLEAN_NAME": ("clean_name", "clean name", "cleanname", "name", "common_name", "security_name", "description"),
    "security_prefix": ("security_prefix", "security_code", "root_code", "code"),
    "month": ("month", "contract_month", "delivery_month", "contract_period"),
    "frequency": ("frequency", "freq"),
    "reference": ("reference", "ref", "ref_num"),
    "contract_month_yr": (
        "current_contract_month_yr", "current_contract_month_year", "contract_month_yr", "contract_month_year", "contract_month",
        "contract_code", "fut_cur_gen_ticker",
    ),
    "contract_year": ("contract_year", "contractYear", "contract_yr", "contract_year_num", "year"),
    "bbl_per_mt": ("bbl_per_mt", "bblpermt", "bbl_per_metric_ton"),
    "gal_per_bbl": ("gal_per_bbl", "galperbbl", "gallons_per_bbl"),
}


def pricing_columns(df: DataFrame, wanted: Sequence[str] = tuple(PRICING_SPELLINGS)) -> DataFrame:
    """The wanted pricing columns under their canonical names; what no spelling delivers is null.

    One source column may serve several meanings, as a contract code does.
    """
    found = {name: pick_column(df.columns, PRICING_SPELLINGS[name]) for name in wanted}
    return df.select(*[(F.col(f"`{c}`") if c is not None else F.lit(None).cast("string")).alias(name) for name, c in found.items()])


def pivot_long(df: DataFrame, index: Sequence[str], fields: Sequence[str], seq: str) -> DataFrame:
    """(index, field, value) rows to one wide row; the last value per field wins."""
    cells = [
        F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col(seq))).alias(f)
        for f in fields
    ]
    return df.groupBy(*index).agg(*cells)


def parse_date(text: Column) -> Column:
    """Date from the four accepted layouts, tried in order."""
    text = F.trim(text.cast("string"))
    return F.coalesce(
        F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))),
        F.to_date(F.try_to_timestamp(text, F.lit("yyyy/MM/dd"))),
        F.to_date(F.try_to_timestamp(text, F.lit("MM/dd/yyyy"))),
        F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd"))),
    )


def _minutes(hhmm: str) -> int:
    hour, minute = hhmm.split(":")
    return int(hour) * 60 + int(minute)


def normalize_intraday(
    raw: DataFrame, local_time: Column, trading: TradingDay = TradingDay(), seq: str = "ingest_seq"
) -> DataFrame:
    """Complete session bars: local session window, slot number, UTC time, keep-last.

    ``raw`` holds security, root, delivery_month, event_type, the OHLCV columns and
    ``seq``; ``local_time`` is the exchange-local start of the bar.
    """
    start, end = _minutes(trading.session_start), _minutes(trading.session_end)
    minute = F.hour("bar_start_local") * 60 + F.minute("bar_start_local")
    bars = (
        raw.withColumn("bar_start_local", local_time.cast("timestamp_ntz"))
        .filter((minute >= start) & (minute + trading.bar_interval_minutes <= end))
        .withColumn("session_date", F.to_date("bar_start_local"))
        .withColumn("bar_slot", F.floor((minute - start) / F.lit(trading.bar_interval_minutes)).cast("int"))
        .withColumn("event_type", F.upper("event_type"))
        .withColumn(
            "timestamp_utc",
            F.to_utc_timestamp(F.col("bar_start_local").cast("timestamp"), trading.timezone),
        )
        .filter(F.col("timestamp_utc").isNotNull() & F.col("close").isNotNull())
    )
    return keep_last(bars, list(BAR_KEYS), seq)


def import_backfill(
    raw: DataFrame, universe: DataFrame, trading: TradingDay = TradingDay(), local_time: str = "time"
) -> DataFrame:
    """User-supplied history in vendor-like columns: known securities only, one pass for all."""
    frame = canonical_columns(raw)
    kind = pick_column(frame.columns, ("event_type", "type"))
    event = F.coalesce(F.upper(F.col(kind)), F.lit("TRADE")) if kind else F.lit("TRADE")
    known = (
        frame.drop("root", "delivery_month")
        .withColumn("event_type", event)
        .join(universe.select("security", "root", "delivery_month"), "security")
        .withColumn("source", F.lit("IMPORTED_BACKFILL"))
    )
    if "ingest_seq" not in known.columns:
        raise ValueError("the order of ingestion must be given as ingest_seq: the last version of a bar stays")
    return normalize_intraday(known, F.col(local_time), trading)


def normalize_daily(raw: DataFrame, universe: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """Settle is authoritative, last price is a labelled fallback."""
    settle, last = F.col("settle").cast("double"), F.col("last_price").cast("double")
    rows = raw.join(universe.select("security", "root", "delivery_month"), "security").select(
        "session_date",
        "root",
        "security",
        "delivery_month",
        F.coalesce(settle, last).alias("close"),
        settle.alias("settle"),
        last.alias("last_price"),
        F.when(settle.isNotNull(), "PX_SETTLE")
        .when(last.isNotNull(), "PX_LAST_FALLBACK")
        .otherwise("MISSING")
        .alias("settle_source_field"),
        F.col("volume_contracts").cast("double").alias("volume_contracts"),
        F.col("open_interest").cast("double").alias("open_interest"),
        seq,
    )
    return keep_last(rows, ["session_date", "security"], seq).drop(seq)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], since: Column | None = None, day: str = "session_date") -> DataFrame:
    """Keyed upsert: new rows replace old ones, rows before ``since`` fall out.

    Both sides are reduced to one candidate per key by a map-side combined
    aggregate, so a key with many versions does not gather in one task.
    """
    both = union_all([old.withColumn("_seq", F.lit(0)), new.withColumn("_seq", F.lit(1))])
    if since is not None:
        both = both.filter(F.col(day) >= since)
    return keep_last(both, list(keys), "_seq").drop("_seq")


def rolling_cutoff(as_of: Column, months: int) -> Column:
    """Same day ``months`` earlier, or the last day of a shorter month."""
    return F.add_months(as_of, -months)


def append_snapshots(old: DataFrame, new: DataFrame, since: Column, time: str = "time") -> DataFrame:
    """Snapshot log with the rows from ``since`` on: retention by time, whatever the number of rows."""
    return union_all([old, new]).filter(F.col(time) >= since)


def pull_plan(universe: DataFrame, existing: DataFrame, as_of: Column, overlap_days: int = 5, full: bool = False) -> DataFrame:
    """What to request per security: from the last stored day less the overlap.

    ``universe`` holds (security, start_date, end_date).  Complete or expired
    securities drop out.
    """
    last = existing.groupBy("security").agg(F.max("date").alias("last_date"))
    if full:
        last = last.filter(F.lit(False))
    plan = universe.filter(F.col("start_date") <= F.col("end_date")).join(last, "security", "left")
    done = F.col("last_date").isNotNull() & (
        (F.col("end_date") < as_of) | (F.col("last_date") >= F.col("end_date"))
    )
    return plan.filter(~done).withColumn(
        "start_date",
        F.greatest(F.col("start_date"), F.date_sub(F.col("last_date"), overlap_days)),
    )


def quote_columns(bars: DataFrame, keys: Sequence[str] = ("timestamp_utc", "security"), seq: str | None = None) -> DataFrame:
    """BID and ASK closes beside the trade bars, in one aggregate over the bar table."""
    order = F.col(seq) if seq else F.col("timestamp_utc")
    side = lambda k: F.max_by(F.when(F.col("event_type") == k, F.col("close")), F.when(F.col("event_type") == k, order))
    return bars.filter(F.col("event_type").isin("BID", "ASK")).groupBy(*keys).agg(
        side("BID").alias("bid_close"), side("ASK").alias("ask_close")
    )


def tumbling_bars(ticks: DataFrame, key: str, ts: str, price: str, width: str) -> DataFrame:
    """OHLCV bars from ticks; the same expression runs as a batch and as a stream."""
    w = F.window(F.col(ts), width)
    return (
        ticks.groupBy(F.col(key), w.alias("w"))
        .agg(
            F.min_by(price, ts).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, ts).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
        .select(key, F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume")
    )


def last_sessions(df: DataFrame, n: int, day: str = "session_date") -> DataFrame:
    """Rows of the newest ``n`` sessions.

    A semi join on the kept days, so a table partitioned by day is pruned at run time.
    """
    w = Window.orderBy(F.col(day).desc())
    days = df.select(day).distinct().withColumn("_i", F.row_number().over(w))
    return df.join(days.filter(F.col("_i") <= n).select(day), day, "left_semi")
