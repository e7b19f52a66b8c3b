"""Seeded recursions, the second way, the stored model, joins of declared cardinality and tie-outs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvelab.operators import affine
from curvelab.operators import crosscheck as CC
from curvelab.operators import experts as X
from curvelab.operators import release as RL
from curvelab.operators.indicators import Windows

SHORT = affine.ChartWindows(mean=5, bands=5, fast=3, slow=6, signal=4, rsi=4)


def _series(seed, name, n, gaps=0.0):
    rng = np.random.default_rng(seed)
    x = 50 + rng.normal(size=n).cumsum()
    return pd.DataFrame({"e": name, "t": pd.date_range("2024-01-01", periods=n), "x": np.where(rng.random(n) < gaps, np.nan, x)})


def _seeded(values, period, alpha):
    """Plain loop: mean of the first values, then the recursion; missing values are skipped."""
    out, seen, y = [], [], None
    for v in values:
        if v is None or math.isnan(v):
            out.append(None)
            continue
        seen.append(v)
        if len(seen) == period:
            y = sum(seen) / period
        elif len(seen) > period:
            y = (1 - alpha) * y + alpha * v
        out.append(y)
    return out


def _close(got, want):
    assert [v is None or math.isnan(v) for v in got] == [v is None for v in want]
    np.testing.assert_allclose([g for g, w in zip(got, want) if w is not None], [w for w in want if w is not None], rtol=1e-9)


# One series holds most rows; blocks of a few rows and several levels; gaps before and after the seed.
@pytest.mark.parametrize("block, fan", [(7, 2), (16, 3), (4096, 1024)])
def test_seeded_recursions_do_not_depend_on_blocks(spark, block, fan):
    tables = [_series(1, "hot", 500, 0.2), _series(2, "warm", 60, 0.5), _series(3, "cold", 4), _series(4, "none", 9, 1.0)]
    df = spark.createDataFrame(pd.concat(tables)).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(5)
    made = affine.smooth_seeded(
        df, ["e"], "t", F.trunc("t", "month"), {"a": affine.Seeded("x", 5, 0.3), "b": affine.Seeded("x", 12, 1 / 12)}, block, fan
    ).toPandas().sort_values(["e", "t"])
    for table in tables:
        got = made[made["e"] == table["e"][0]]
        assert len(got) == len(table)
        _close(got["a"].tolist(), _seeded(table["x"], 5, 0.3))
        _close(got["b"].tolist(), _seeded(table["x"], 12, 1 / 12))


def test_no_rows_and_null_keys(spark):
    df = spark.createDataFrame(_series(1, "s", 20)).withColumn("e", F.lit(None).cast("string"))
    one = {"a": affine.Seeded("x", 5, 0.3)}
    assert affine.smooth_seeded(df.limit(0), ["e"], "t", F.trunc("t", "month"), one, 4, 2).count() == 0
    got = affine.smooth_seeded(df, ["e"], "t", F.trunc("t", "month"), one, 4, 2).orderBy("t").toPandas()["a"].tolist()
    _close(got, _seeded(_series(1, "s", 20)["x"], 5, 0.3))


def test_chart_indicators_equal_the_loops(spark):
    table = _series(5, "s", 80)
    got = affine.chart_indicators(spark.createDataFrame(table), ["e"], "t", "x", F.trunc("t", "month"), SHORT, 16, 2).orderBy("t").toPandas()
    x = table["x"]
    alpha = lambda n: 2 / (n + 1)
    fast, slow = _seeded(x, 3, alpha(3)), _seeded(x, 6, alpha(6))
    macd = [None if f is None or s is None else f - s for f, s in zip(fast, slow)]
    signal = _seeded([math.nan if m is None else m for m in macd], 4, alpha(4))
    _close(got["ema_fast"].tolist(), fast)
    _close(got["macd_signal"].tolist(), signal)
    _close(got["macd_histogram"].tolist(), [None if s is None else m - s for m, s in zip(macd, signal)])
    np.testing.assert_allclose(got["band_upper"][4:].astype(float), (x.rolling(5).mean() + 2 * x.rolling(5).std(ddof=0))[4:])
    change = x.diff()
    up, down = _seeded(change.clip(lower=0), 4, 1 / 4), _seeded((-change).clip(lower=0), 4, 1 / 4)
    _close(got["rsi"].tolist(), [None if u is None else 100.0 if d == 0 else 100 - 100 / (1 + u / d) for u, d in zip(up, down)])


def test_the_audit_sees_a_fault_and_a_short_history(spark):
    p = Windows(4)
    n = CC.audit_rows(p)
    parts = []
    for name, rows in (("long", n + 30), ("short", n - 5)):
        s = _series(len(name), name, rows)
        x = s["x"]
        s["ema_fast"], s["ema_slow"] = (x.ewm(alpha=2 / (k + 1), adjust=False).mean() for k in (p.macd_fast, p.macd_slow))
        change = x.diff().fillna(0.0)
        up, down = (c.clip(lower=0).ewm(alpha=1 / p.rsi_window, adjust=False).mean() for c in (change, -change))
        s["rsi"] = 100 - 100 / (1 + up / down)
        s["bollinger_mid"], s["bollinger_std"] = x.rolling(p.bollinger_window).mean(), x.rolling(p.bollinger_window).std()
        s["rolling_median"] = x.rolling(p.robust_z_window).median()
        s["donchian_high"], s["donchian_low"] = x.shift().rolling(p.donchian_window).max(), x.shift().rolling(p.donchian_window).min()
        parts.append(s.rename(columns={"e": "spread_id", "t": "timestamp_utc", "x": "research_close"}))
    features = spark.createDataFrame(pd.concat(parts)).withColumn("session_date", F.to_date("timestamp_utc"))
    told = {(r["spread_id"], r["indicator"]): r["status"] for r in CC.indicator_audit(features, p).collect()}
    assert {s for (e, _), s in told.items() if e == "long"} == {"AUDITED"} and {s for (e, _), s in told.items() if e == "short"} == {"SHORT_HISTORY"}
    faulty = CC.with_fault(features, F.col("spread_id") == "long", {"rsi": 0.01})
    told = {(r["spread_id"], r["indicator"]): r["status"] for r in CC.indicator_audit(faulty, p).collect()}
    assert [k for k, s in told.items() if s == "DIFFERS"] == [("long", "rsi")]


def _model(spark, path):
    weights = spark.createDataFrame([("g", 9, "A", 0.35, *[0.35, 0.3, 0.0, 0.0, 0.0, 0.0, 0.35])], "learner_group string, adaptive_observations int, adaptive_top_expert string, adaptive_top_weight double, " + ", ".join(f"{w} double" for w in X.WEIGHTS))
    folds = spark.createDataFrame([(1, "2024-01-05")], "fold int, test_end string")
    return weights, folds, RL.save_model(path, ("settings", 1), weights, folds, "2024-01-05")


def test_a_model_is_taken_only_as_it_was_stored(spark, tmp_path):
    path = str(tmp_path)
    weights, folds, version = _model(spark, path)
    model = RL.load_model(spark, path, version, ("settings", 1))
    assert model.as_of == "2024-01-05" and model.weights.count() == 1
    with pytest.raises(RL.ModelMismatch):
        RL.load_model(spark, path, version, ("settings", 2))
    other = RL.save_model(path, ("settings", 1), weights, folds, "2024-01-05")
    assert other != version
    weights.withColumn(X.WEIGHTS[0], F.lit(0.34)).write.mode("overwrite").parquet(f"{path}/{other}/weights")
    with pytest.raises(RL.ModelMismatch):
        RL.load_model(spark, path, other, ("settings", 1))
    assert RL.load_model(spark, path, version, ("settings", 1)).digest == model.digest


def test_one_to_one_fails_on_a_planted_duplicate(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    right = spark.createDataFrame([("a", "HO"), ("b", "CL"), ("c", "QS")], "k string, root string")
    assert {tuple(r) for r in RL.one_to_one(left, right, "k", ("l", "r"), ["root"]).collect()} == {("a", 1, "HO"), ("b", 2, "CL")}
    twice = right.unionByName(spark.createDataFrame([("a", "XX")], right.schema))
    for frame, other in ((left, twice), (left.unionByName(left.limit(1)), right)):
        with pytest.raises(Exception, match="not unique: a"):
            RL.one_to_one(frame, other, "k", ("l", "r")).collect()
    with pytest.raises(Exception, match="no root for b"):
        RL.one_to_one(left, right.filter("k = 'a'"), "k", ("l", "r"), ["root"]).collect()
    assert RL.one_to_one(left, right.filter("k = 'a'"), "k", ("l", "r")).filter("root IS NULL").count() == 1


def test_tie_outs_read_every_table_once(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double")
    checks = [
        RL.Check("same rows", "a", F.count(F.lit(1)), ("b", F.count(F.lit(1)))),
        RL.Check("sum", "a", F.sum("v"), 5.0),
        RL.Check("cap", "b", F.max("v"), 2.5, at_most=True),
        RL.Check("nothing there", "none", F.count(F.lit(1)), 7.0),
    ]
    told = {r["check"]: r["status"] for r in RL.tie_outs({"a": a, "b": a, "none": a.limit(0)}, checks).collect()}
    assert told == {"same rows": "OK", "sum": "OK", "cap": "FAIL", "nothing there": "OK"}


def test_a_ledger_without_trades_tells_no_rules(spark):
    from curvelab.queries.checks import _where_traded

    rules = spark.createDataFrame([("daily entry limit", 0), ("exit before entry", 2)], "rule string, violations long")
    trades = spark.range(3)
    assert _where_traded(rules, trades).count() == 2
    assert _where_traded(rules, trades.filter("id > 5")).count() == 0
