"""Data-quality reports, parity checks and invariants as aggregate queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelab.operators.calendar import TradingDay
from curvelab.operators.walkforward import Folds


@dataclass(frozen=True)
class Coverage:
    """How much history and volume the bar store must hold."""

    # Fixed values.
    minimum_preliminary_sessions: int = 120
    minimum_production_sessions: int = 300
    rolling_intraday_months: int = 18
    daily_history_start: str = "2022-01-01"
    forward_curve_months: int = 16
    minimum_volume_coverage: float = 0.90
    maximum_model_age_sessions: int = 5


def structure_coverage(structures: DataFrame, packages: DataFrame) -> DataFrame:
    """All registered structures, observed or not."""
    # The median comes from value counts, so a busy structure is combined before its shuffle.
    capacity = packages.groupBy("spread_id", "package_volume_capacity").agg(F.count(F.lit(1)).alias("_n"))
    medians = capacity.groupBy("spread_id").agg(
        F.expr("percentile(package_volume_capacity, 0.5, _n)").alias("median_package_capacity")
    )
    days = packages.groupBy("spread_id", "session_date").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(F.col("entry_allowed").cast("long")).alias("_open")
    )
    seen = days.groupBy("spread_id").agg(
        F.sum("_rows").alias("feature_rows"),
        F.count(F.lit(1)).alias("sessions"),
        F.min("session_date").alias("coverage_start"),
        F.max("session_date").alias("coverage_end"),
        (F.sum("_open") / F.sum("_rows")).alias("entry_allowed_share"),
    )
    observed = F.col("feature_rows").isNotNull()
    return (
        structures.join(seen, "spread_id", "left")
        .join(medians, "spread_id", "left")
        .select(
            "spread_id", "spread_name", F.col("spread_family").alias("family"), F.col("anchor_rank").alias("tenor_start"),
            "tenor_end", "model_enabled",
            F.when(observed, "OBSERVED").otherwise("INCOMPLETE_CURVE").alias("status"),
            F.coalesce("feature_rows", F.lit(0)).alias("feature_rows"),
            F.coalesce("sessions", F.lit(0)).alias("sessions"),
            "coverage_start", "coverage_end", "entry_allowed_share", "median_package_capacity",
            F.when(observed, "").otherwise("a leg was missing or not synchronous").alias("missing_reason"),
        )
    )


# -- bar store -----------------------------------------------------------------------


def _check(name: str, status, actual, expected: str, blocking) -> "F.Column":
    return F.struct(
        F.lit(name).alias("check"), status.alias("status"), actual.cast("string").alias("actual"), F.lit(expected).alias("expected"),
        blocking.alias("blocking"),
    )


def quality_report(bars: DataFrame, contracts: DataFrame, daily: DataFrame, roots: int, coverage: Coverage = Coverage(), trading: TradingDay = TradingDay(),
                   depth_source: str = "UNKNOWN", depth_required: bool = False, model_as_of=None) -> DataFrame:
    """Coverage checks of the bar store as (check, status, actual, expected, blocking).

    Every measure is aggregated to one row; nothing but scalars meets.
    """
    trade = bars.filter(F.col("event_type") == "TRADE")
    per_session = trade.groupBy("security", "session_date").agg(F.count(F.lit(1)).alias("n"), F.count("volume_contracts").alias("v"))
    groups = per_session.agg(
        F.avg((F.col("n") == trading.complete_bars_per_session).cast("double")).alias("completeness"),
        (F.sum("v") / F.sum("n")).alias("volume_coverage"),
    )
    days = trade.select("session_date").distinct().agg(F.count(F.lit(1)).alias("sessions"), F.min("session_date").alias("earliest"), F.max("session_date").alias("latest"))
    newest = trade.agg(F.max("timestamp_utc").alias("timestamp_utc"))
    curve = trade.join(newest, "timestamp_utc", "left_semi").groupBy("root").agg(F.count_distinct("security").alias("c")).agg(
        F.when(F.count(F.lit(1)) == roots, F.min("c")).otherwise(0).alias("curve_depth")
    )
    verified = contracts.agg(F.coalesce(F.avg(F.col("expiry_verified").cast("double")), F.lit(0.0)).alias("verified"))
    settles = daily.agg(
        F.min("session_date").alias("settle_start"),
        F.coalesce(F.avg((F.col("settle_source_field") == "PX_SETTLE").cast("double")), F.lit(0.0)).alias("settle_share"),
    )
    keyed = [d.withColumn("_one", F.lit(1)) for d in (groups, days, curve, verified, settles)]
    one = keyed[0]
    for other in keyed[1:]:
        one = one.join(other, "_one")
    c = F.col
    ok = lambda test, bad="WARN": F.when(test, "PASS").otherwise(bad)
    first_rolling = F.add_months(F.trunc("latest", "month"), -coverage.rolling_intraday_months)
    on_weekday = lambda d: F.date_add(d, F.when(F.weekday(d) == 5, 2).when(F.weekday(d) == 6, 1).otherwise(0))
    history = F.lit(coverage.daily_history_start).cast("date")
    checks = [
        _check("history_sessions", F.when(c("sessions") >= coverage.minimum_production_sessions, "PASS").when(c("sessions") >= coverage.minimum_preliminary_sessions, "WARN").otherwise("FAIL"),
               c("sessions"), f">={coverage.minimum_production_sessions}", c("sessions") < coverage.minimum_preliminary_sessions),
        _check("rolling_intraday_coverage", ok(c("earliest") <= on_weekday(first_rolling)), c("earliest"), f"{coverage.rolling_intraday_months} months", F.lit(False)),
        _check("forward_curve_contracts", ok(c("curve_depth") >= coverage.forward_curve_months), c("curve_depth"), f">={coverage.forward_curve_months}", F.lit(False)),
        _check("daily_settle_history", ok((c("settle_start") <= on_weekday(history)) & (c("settle_share") >= 0.90)), F.round("settle_share", 6), ">=90% settle", F.lit(False)),
        _check("complete_session_security_groups", ok(c("completeness") >= 0.95), F.round("completeness", 6), "95%", c("completeness") < 0.80),
        _check("volume_coverage", ok(c("volume_coverage") >= coverage.minimum_volume_coverage, "FAIL"), F.round("volume_coverage", 6),
               f"{coverage.minimum_volume_coverage:.0%}", c("volume_coverage") < coverage.minimum_volume_coverage),
        _check("verified_expiry_metadata", ok(c("verified") >= 0.95, "FAIL"), F.round("verified", 6), "95%", c("verified") < 0.95),
        _check("market_depth_source", ok(F.lit(depth_source == "BPIPE_L2")), F.lit(depth_source), "level 2 preferred",
               F.lit(depth_required and depth_source != "BPIPE_L2")),
    ]
    report = one.select(F.explode(F.array(*checks)).alias("c")).select("c.*")
    if model_as_of is None:
        return report
    age = trade.select("session_date").distinct().agg(F.count_if(F.col("session_date") > model_as_of).alias("age"))
    limit = coverage.maximum_model_age_sessions
    fresh = age.select(
        F.lit("frozen_model_freshness").alias("check"), F.when(F.col("age") > limit, "FAIL").otherwise("PASS").alias("status"),
        F.col("age").cast("string").alias("actual"), F.lit(f"<={limit} sessions").alias("expected"), F.lit(False).alias("blocking"),
    )
    return report.unionByName(fresh)


def session_completeness(bars: DataFrame, slots: int) -> DataFrame:
    """Bars, distinct and invalid slots per security and session, and whether it is whole."""
    return bars.groupBy("security", "session_date").agg(
        F.count(F.lit(1)).alias("bars"), F.count_distinct("bar_slot").alias("distinct_slots"),
        F.count_if(~F.col("bar_slot").between(0, slots - 1)).alias("invalid_slots"),
    ).withColumn("complete", (F.col("bars") == slots) & (F.col("distinct_slots") == slots) & (F.col("invalid_slots") == 0))


def core_packages_missing(packages: DataFrame, core: DataFrame, slots: int) -> DataFrame:
    """Core structures without a full newest session."""
    newest = packages.agg(F.max("session_date").alias("session_date"))
    counts = packages.join(newest, "session_date", "left_semi").groupBy("spread_id").agg(F.count(F.lit(1)).alias("bars"))
    return core.select("spread_id").join(counts.filter(F.col("bars") == slots), "spread_id", "left_anti")


def training_gate(bars: DataFrame, packages: DataFrame, p: Folds = Folds(), trading: TradingDay = TradingDay()) -> DataFrame:
    """Is the last session closed, and is there enough history to train on?"""
    need = p.train_sessions + p.validation_sessions + p.embargo_sessions + p.test_sessions + p.lockbox_sessions
    latest = bars.agg(F.max("session_date").alias("s"), F.max("pulled_at_local").alias("pulled"))
    closes = F.to_timestamp_ntz(F.concat(F.date_format("pulled", "yyyy-MM-dd"), F.lit(f" {trading.session_end}:00")))
    ready = closes + F.make_dt_interval(mins=F.lit(trading.freshness_grace_minutes))
    sessions = packages.select("session_date").distinct().agg(F.count(F.lit(1))).scalar()
    return latest.select(
        (F.col("pulled").isNotNull() & ~((F.col("s") == F.to_date("pulled")) & (F.col("pulled") < ready))).alias("session_closed"),
        sessions.alias("sessions"), F.lit(need).alias("needed"), (sessions >= need).alias("enough_history"),
    )


# -- tables and comparisons ----------------------------------------------------------


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def over_precision(column, places: int):
    """Finite values with more decimals than allowed."""
    x = column.try_cast("double")
    return x.isNotNull() & ~F.isnan(x) & (x != F.round(x, places))


def canonical_issues(rows: DataFrame, universe: DataFrame, roots: DataFrame, as_of, depth: int, fields, precision: int = 5) -> DataFrame:
    """Issues of the canonical pricing table as (issue, rows); no row means a clean table."""
    c = F.col
    flat = c("curve_mode") == "flat"
    blank = lambda name: F.trim(F.coalesce(name, F.lit(""))) == ""
    last = c("PX_LAST")
    tests = {
        "future observation date": c("date") > as_of,
        "PX_LAST null or not finite": last.isNull() | F.isnan(last) | (F.abs(last) == F.lit(float("inf"))),
        "invalid reference": c("reference").isNull() | ~c("reference").between(1, depth),
        "flat row with wrong frequency": flat & (F.lower(F.trim(F.coalesce("frequency", F.lit("")))) != "flat"),
        "flat row with a month": flat & ~blank("month"),
        "flat row with a contract": flat & ~blank("contract_month_yr"),
        "flat row with a contract year": flat & c("contract_year").isNotNull(),
        "flat row with reference above 1": flat & (F.coalesce("reference", F.lit(0)) != 1),
        "dated row with wrong frequency": ~flat & (F.lower(F.trim(F.coalesce("frequency", F.lit("")))) != "monthly"),
        "dated row without month": ~flat & blank("month"),
        "dated row without contract": ~flat & blank("contract_month_yr"),
        "dated row without contract year": ~flat & c("contract_year").isNull(),
        **{f"{f} exceeds {precision} decimals": over_precision(c(f), precision) for f in fields},
    }
    counted = rows.agg(*[F.count_if(test).alias(f"t{i}") for i, test in enumerate(tests.values())])
    cells = F.array(*[F.struct(F.lit(name).alias("issue"), F.col(f"t{i}").alias("rows")) for i, name in enumerate(tests)])
    simple = counted.select(F.explode(cells).alias("c")).select("c.issue", "c.rows")
    doubled = duplicate_keys(rows, ["date", "security_str"]).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("duplicate key").alias("issue"), "rows")
    present = rows.select("root").distinct()
    expected = roots.filter("enabled").select("root")
    missing = expected.join(present, "root", "left_anti").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("enabled root without rows").alias("issue"), "rows")
    extra = present.join(expected, "root", "left_anti").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("unconfigured root").alias("issue"), "rows")
    strange = rows.join(universe.select(F.col("security").alias("security_str")), "security_str", "left_anti").agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("security outside the universe").alias("issue"), "rows"
    )
    out = simple
    for more in (doubled, missing, extra, strange):
        out = out.unionByName(more)
    return out.filter(F.col("rows") > 0)


def pricing_file_issues(rows: DataFrame, places: int = 5) -> DataFrame:
    """Checks of a delivered pricing file as (severity, issue, rows).

    Values arrive as text; contract texts are parsed and compared with the month and
    year columns.  Rows are counted by their texts first, combined before the shuffle, so a
    contract's texts are parsed once and not once a row.
    """
    from curvelab.functions import tokens as K

    c = F.col
    last, volume, vol = (c(n).try_cast("double") for n in ("PX_LAST", "PX_VOLUME", "VOL_30D"))
    of_values = {
        ("ISSUE", "PX_LAST is not a number"): c("PX_LAST").isNotNull() & last.isNull(),
        ("WARN", "PX_LAST is not positive"): last <= 0,
        ("ISSUE", "PX_VOLUME is negative"): volume < 0,
        ("WARN", "VOL_30D outside [0, 3]"): ~vol.between(0, 3),
        ("ISSUE", "PX_LAST exceeds precision"): over_precision(c("PX_LAST"), places),
    }
    of_texts = {
        ("ISSUE", "month differs from contract"): K.period_label(c("month")) != K.contract_month(c("contract_month_yr")),
        ("ISSUE", "year differs from contract"): c("contract_year").cast("int") != K.contract_year(c("contract_month_yr")),
        ("ISSUE", "security does not start with its root"): ~F.startswith(F.upper("security_str"), F.upper("root")),
        ("ISSUE", "bbl_per_mt is not positive"): F.coalesce(c("bbl_per_mt").try_cast("double") <= 0, F.lit(True)),
    }
    texts = ["root", "security_str", "contract_month_yr", "month", "contract_year", "bbl_per_mt"]
    values = [f"v{i}" for i in range(len(of_values))]
    parsed = [f"p{i}" for i in range(len(of_texts))]
    by_text = rows.groupBy(*texts).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(t).alias(v) for v, t in zip(values, of_values.values(), strict=True)])
    by_root = by_text.withColumns({p: F.when(t, c("n")).otherwise(0) for p, t in zip(parsed, of_texts.values(), strict=True)}).groupBy("root").agg(
        *[F.sum(t).alias(t) for t in (*values, *parsed)], (F.min("bbl_per_mt") != F.max("bbl_per_mt")).alias("uneven")
    )
    counted = by_root.agg(*[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in (*values, *parsed)], F.count_if("uneven").alias("uneven"))
    told = {**dict(zip(of_values, values, strict=True)), **dict(zip(of_texts, parsed, strict=True)), ("ISSUE", "bbl_per_mt varies within a root"): "uneven"}
    cells = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(i).alias("issue"), c(t).alias("rows")) for (s, i), t in told.items()])
    return counted.select(F.explode(cells).alias("c")).select("c.*").filter(c("rows") > 0)


def extreme_returns(rows: DataFrame, keys, day: str, price: str, limit: float = 0.5) -> DataFrame:
    """Rows whose log return within one contract exceeds the limit."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(day)
    step = F.log(F.col(price)) - F.log(F.lag(price).over(w))
    return rows.filter(F.col(price) > 0).withColumn("log_return", step).filter(F.abs("log_return") > limit)


def table_difference(left: DataFrame, right: DataFrame, columns) -> DataFrame:
    """Rows only one of two tables has, duplicates counted."""
    a, b = left.select(*columns), right.select(*columns)
    return (
        a.exceptAll(b).withColumn("side", F.lit("LEFT_ONLY")).unionByName(b.exceptAll(a).withColumn("side", F.lit("RIGHT_ONLY")))
    )


def row_parity(train: DataFrame, score: DataFrame, key: str, labels, numbers, tolerance: float = 1e-9) -> DataFrame:
    """The scored rows with ``max_delta`` against training and a status; rows of one side only fail."""
    a, b = train.alias("a"), score.alias("b")
    joined = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full")
    same = F.lit(True)
    for c in labels:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    for c in numbers:
        same = same & (F.col(f"a.{c}").isNull() == F.col(f"b.{c}").isNull())
    gaps = [F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")), F.lit(0.0)) for c in numbers]
    largest = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    both = F.col(f"a.{key}").isNotNull() & F.col(f"b.{key}").isNotNull()
    status = F.when(~both, "MISSING").when(~same, "LABEL_DIFFERS").when(largest > tolerance, "NUMBER_DIFFERS").otherwise("PASS")
    return joined.select(
        F.coalesce(f"b.{key}", f"a.{key}").alias(key), *[F.col(f"b.{c}") for c in (*labels, *numbers)],
        F.when(largest > tolerance, largest).otherwise(0.0).alias("max_delta"), status.alias("status"),
    )


def compare_results(baseline: DataFrame, candidate: DataFrame, keys, metrics: dict[str, bool], tolerance: float = 1e-9) -> DataFrame:
    """Improved, worse and same per metric over the outer join; absent rows count as zero.

    ``metrics`` maps a column to whether lower is better.
    """
    a = baseline.select(*keys, *[F.col(m).alias(f"a_{m}") for m in metrics], F.lit(1).alias("_a"))
    b = candidate.select(*keys, *[F.col(m).alias(f"b_{m}") for m in metrics], F.lit(1).alias("_b"))
    joined = a.join(b, list(keys), "full")
    cells = []
    for m, lower in metrics.items():
        delta = (F.coalesce(f"b_{m}", F.lit(0.0)) - F.coalesce(f"a_{m}", F.lit(0.0))) * (-1 if lower else 1)
        cells.append(F.struct(F.lit(m).alias("metric"), F.when(F.abs(delta) <= tolerance, "same").when(delta > 0, "improved").otherwise("worse").alias("outcome")))
    opened = joined.select("_a", "_b", F.explode(F.array(*cells)).alias("c")).select("_a", "_b", "c.*")
    return opened.groupBy("metric").agg(
        F.count(F.lit(1)).alias("joined_rows"),
        F.count_if(F.col("_b").isNull()).alias("baseline_only"),
        F.count_if(F.col("_a").isNull()).alias("candidate_only"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("improved", "worse", "same")],
    ).withColumn("improvement_share", F.try_divide(F.col("improved"), F.col("improved") + F.col("worse")))


def family_outcomes(baseline: DataFrame, candidate: DataFrame, keys, families: DataFrame, metric: str = "max_drawdown_usd", tolerance: float = 1e-9) -> DataFrame:
    """Improved and worse folds per family; a family qualifies from 60 percent on."""
    a = baseline.select(*keys, F.col(metric).alias("_a"))
    b = candidate.select(*keys, F.col(metric).alias("_b"))
    delta = F.coalesce("_b", F.lit(0.0)) - F.coalesce("_a", F.lit(0.0))
    rows = a.join(b, list(keys), "full").withColumn("_d", delta).join(families, "spread_id")
    grouped = rows.groupBy("family").agg(
        F.count_if(F.col("_d") < -tolerance).alias("improved"), F.count_if(F.col("_d") > tolerance).alias("worse"), F.count_if(F.abs("_d") <= tolerance).alias("same")
    )
    share = F.try_divide(F.col("improved"), F.col("improved") + F.col("worse"))
    return grouped.withColumns({"improvement_share": share, "qualifies": F.coalesce(share >= 0.60, F.lit(False))})


def promotion(net: DataFrame, drawdown: DataFrame, cost: DataFrame, families: DataFrame) -> DataFrame:
    """PROMOTE only where all four criteria hold.

    ``net`` and ``drawdown`` are rows of ``compare_results``, none where no fold has a trade
    (then nothing improved); ``cost`` has the baseline and candidate net at double cost.
    """
    n = net.agg(F.coalesce(F.bool_or(F.col("improved") > F.col("worse")), F.lit(False)).alias("p")).scalar()
    d = drawdown.agg(F.coalesce(F.bool_or(F.col("improvement_share") >= 0.60), F.lit(False)).alias("p")).scalar()
    f = families.agg((F.count_if("qualifies") >= 2).alias("p")).scalar()
    change = F.try_divide(F.col("candidate") - F.col("baseline"), F.nullif(F.abs("baseline"), F.lit(0.0)))
    kept = F.coalesce(change >= -0.10, F.col("candidate") >= -1e-9)
    return cost.select(
        n.alias("broad_fold_net_improvement"), kept.alias("double_cost_net_retention"), d.alias("fold_drawdown_improvement"), f.alias("family_breadth")
    ).withColumn(
        "decision",
        F.when(F.col("broad_fold_net_improvement") & F.col("double_cost_net_retention") & F.col("fold_drawdown_improvement") & F.col("family_breadth"), "PROMOTE").otherwise("REJECT"),
    )
