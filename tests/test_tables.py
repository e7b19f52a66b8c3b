"""Calendars, units, tokens, curves, checks, files and streams."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from curvelab.functions import dates as D
from curvelab.functions import tokens as K
from curvelab.functions import units as U
from curvelab.operators import calendar as C
from curvelab.operators import curves as CV
from curvelab.operators import ingest
from curvelab.operators import quality as Q
from curvelab.operators import risk as R
from curvelab.operators.packages import daily_as_bars
from curvelab.sources import files


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_holidays_and_offsets(spark):
    span = spark.createDataFrame([(date(2024, 1, 1), date(2024, 12, 31))], "first_day date, last_day date")
    calendar = C.session_calendar(span)
    closed = {r["day"] for r in calendar.filter("exchange = 'NYMEX' AND NOT is_session AND weekday(day) < 5 AND year(day) = 2024").collect()}
    assert closed == {date(2024, 1, 1), date(2024, 1, 15), date(2024, 2, 19), date(2024, 3, 29), date(2024, 5, 27), date(2024, 6, 19),
                      date(2024, 7, 4), date(2024, 9, 2), date(2024, 11, 28), date(2024, 12, 25)}
    ice = {r["day"] for r in calendar.filter("exchange = 'ICE' AND NOT is_session AND weekday(day) < 5 AND year(day) = 2024").collect()}
    assert ice == {date(2024, 1, 1), date(2024, 3, 29), date(2024, 4, 1), date(2024, 5, 6), date(2024, 5, 27), date(2024, 8, 26), date(2024, 12, 25), date(2024, 12, 26)}
    days = spark.createDataFrame([("NYMEX", date(2024, 4, 1))], "exchange string, day date")
    moved = C.offset_sessions(days, calendar, "day", "exchange", {"back": -1, "on": 1}).first()
    assert (moved["back"], moved["on"]) == (date(2024, 3, 28), date(2024, 4, 2))


def test_easter(spark):
    years = spark.createDataFrame([(1999,), (2000,), (2008,), (2024,), (2038,)], "year int")
    got = {r["year"]: r["easter"] for r in C.easter_sundays(years).collect()}
    assert got == {1999: date(1999, 4, 4), 2000: date(2000, 4, 23), 2008: date(2008, 3, 23), 2024: date(2024, 3, 31), 2038: date(2038, 4, 25)}


def test_business_days(spark):
    d = lambda text: F.lit(text).cast("date")
    assert _one(spark, D.business_days(d("2024-01-05"), d("2024-01-09"))) == 2
    assert _one(spark, D.business_days(d("2024-01-09"), d("2024-01-05"))) == 0


def test_unit_identities(spark):
    lit = F.lit
    assert _one(spark, U.convert(lit(1.0), lit("USD/gal"), lit("$/bbl"))) == 42.0
    assert _one(spark, U.convert(lit(250.0), lit("cents/gal"), lit("$/gal"))) == 2.5
    assert _one(spark, U.convert(lit(745.0), lit("$/MT"), lit("$/bbl"), lit(7.45))) == 100.0
    assert _one(spark, U.convert(lit(1.0), lit("bananas"), lit("$/bbl"))) is None


def test_tokens(spark):
    assert _one(spark, K.period_label(F.lit("quarter-3"))) == "Q3"
    assert _one(spark, K.period_label(F.lit("1H"))) == "Half 1"
    assert _one(spark, K.frequency_label(F.lit("quarterly strip"))) == "Quarterly"
    parsed = _one(spark, K.parse_ticker(F.lit("HO F5 Comdty"), 2024))
    assert (parsed["root"], parsed["month"], parsed["year"], parsed["yellow_key"]) == ("HO", "Jan", 2025, "Comdty")
    assert _one(spark, K.parse_ticker(F.lit("SPOT Index"), 2024)) is None


def _series(spark, points):
    return spark.createDataFrame([("s", x, y) for x, y in points], "k string, x int, value double")


def test_interpolation_is_bounded(spark):
    obs = _series(spark, [(1, 10.0), (4, 40.0), (20, 5.0)])
    got = {r["x"]: r["value"] for r in CV.densify(obs, ["k"]).collect()}
    assert got[2] == 20.0 and got[3] == 30.0 and got[10] is None and got[20] == 5.0


def test_longest_run_takes_the_earlier_tie(spark):
    got = CV.longest_run(_series(spark, [(1, 1.0), (2, 1.0), (30, 1.0), (31, 1.0), (60, 1.0)]), ["k"]).collect()
    assert sorted(r["x"] for r in got) == [1, 2]


def test_var_needs_sixty_values(spark):
    rows = [("a", date(2024, 1, 1) + timedelta(days=i), 100.0 * (1.01 if i % 2 else 1.0)) for i in range(60)] + [("b", date(2024, 1, 1), 5.0)]
    got = {r["k"]: r for r in R.parametric_var(spark.createDataFrame(rows, "k string, day date, value double"), "k", "day", F.year("day")).collect()}
    assert got["b"]["p95"] == 0.0 and got["a"]["p99"] > got["a"]["p90"] > 0


def test_daily_bars_land_in_the_last_slot(spark):
    rows = spark.createDataFrame([(date(2024, 7, 1), "HO", "HOQ4", date(2024, 8, 1), 2.5, 10.0)], "session_date date, root string, security string, delivery_month date, close double, volume_contracts double")
    bar = daily_as_bars(rows).first()
    assert bar["bar_slot"] == 25 and bar["timestamp_utc"] == datetime(2024, 7, 1, 18, 15)


def test_column_spellings(spark):
    df = ingest.canonical_columns(spark.range(1).selectExpr("id AS `Ticker`", "id AS `PX_VOLUME`", "id AS `Num Events`"))
    assert df.columns == ["security", "volume_contracts", "num_events"]


def test_promotion_needs_every_criterion(spark):
    cells = "metric string, improved int, worse int, improvement_share double"
    net = spark.createDataFrame([("n", 6, 4, 0.6)], cells)
    families = spark.createDataFrame([("a", True), ("b", True)], "family string, qualifies boolean")
    cost = spark.createDataFrame([(100.0, 95.0)], "baseline double, candidate double")
    assert Q.promotion(net, net, cost, families).first()["decision"] == "PROMOTE"
    worse = spark.createDataFrame([(100.0, 80.0)], "baseline double, candidate double")
    assert Q.promotion(net, net, worse, families).first()["decision"] == "REJECT"


def test_promotion_without_a_fold(spark):
    folds = spark.createDataFrame([], "spread_id string, fold int, net double, mdd double")
    compared = Q.compare_results(folds, folds, ["spread_id", "fold"], {"net": False, "mdd": True})
    cost = spark.createDataFrame([(None, None)], "baseline double, candidate double")
    families = spark.createDataFrame([], "family string, qualifies boolean")
    got = Q.promotion(compared.filter("metric = 'net'"), compared.filter("metric = 'mdd'"), cost, families).first()
    assert (got["broad_fold_net_improvement"], got["fold_drawdown_improvement"], got["family_breadth"], got["decision"]) == (False, False, False, "REJECT")


def test_file_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [1, 2])], "a int, x double, l array<int>")
    files.write_parquet(df, str(tmp_path / "t"))
    assert files.read_table(spark, str(tmp_path / "t"), df.schema).count() == 1
    assert files.read_table(spark, str(tmp_path / "missing"), df.schema).count() == 0
    files.write_csv(df, str(tmp_path / "c"), compressed=True)
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).first()["l"] == "[1,2]"
    assert files.json_records(df).first()["record"] == '{"a":1,"x":null,"l":[1,2]}'


def test_canonical_issues_pass_and_fail(spark):
    schema = "security_str string, root string, date date, reference int, PX_LAST double, curve_mode string, frequency string, month string, contract_month_yr string, contract_year int"
    good = ("HOF25", "HO", date(2024, 1, 2), 1, 2.5, "monthly", "Monthly", "Jan", "F25", 2025)
    bad = ("HOF25", "HO", date(2024, 1, 2), 9, 2.1234567, "monthly", "Flat", "", "F25", 2025)
    universe = spark.createDataFrame([("HOF25",)], "security string")
    roots = spark.createDataFrame([("HO", True)], "root string, enabled boolean")
    check = lambda rows: {r["issue"] for r in Q.canonical_issues(spark.createDataFrame(rows, schema), universe, roots, F.lit("2024-06-01").cast("date"), 3, ["PX_LAST"]).collect()}
    assert check([good]) == set()
    assert check([good, bad]) == {"duplicate key", "invalid reference", "dated row with wrong frequency", "dated row without month", "PX_LAST exceeds 5 decimals"}


@pytest.mark.parametrize("mode,want", [("Flat forward", "flat"), ("Monthly", "monthly"), (None, "monthly")])
def test_curve_mode(spark, mode, want):
    assert _one(spark, U.curve_mode(F.lit(mode).cast("string"))) == want
