"""Rolls, experts, learner, ledger and budget against plain loops."""

import math
from datetime import datetime
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvelab.config import EXPERTS, STRATEGIES
from curvelab.functions.stats import normal_cdf
from curvelab.operators import board as BD
from curvelab.operators import experts as X
from curvelab.operators import ledger as L
from curvelab.operators import packages as P
from curvelab.operators import scorecard as SC
from curvelab.operators import structures as G
from curvelab.operators import walkforward as W
from curvelab.queries import learning
from curvelab.sources import views
from tests.conftest import SMALL


def _rolls(spark, rolls):
    rows = [("s", datetime(2024, 1, 1 + i), r, c) for i, (r, c) in enumerate(zip(rolls, (10.0, 11.0, 20.0, 21.0)))]
    df = spark.createDataFrame(rows, "spread_id string, timestamp_utc timestamp, roll_id string, spread_close double")
    return df.withColumn("session_date", F.to_date("timestamp_utc"))


def test_back_adjust_keeps_the_latest_scale(spark):
    out = P.back_adjust(_rolls(spark, ["A", "A", "B", "B"])).orderBy("timestamp_utc").collect()
    assert [r["research_close"] for r in out] == [19.0, 20.0, 20.0, 21.0]
    assert [r["price_change"] for r in out] == [None, 1.0, None, 1.0]


def test_missing_roll_identity_fails(spark):
    with pytest.raises(Exception, match="roll_id"):
        P.back_adjust(_rolls(spark, ["A", None, "B", "B"])).collect()


def test_registry_counts_and_merge():
    made = G.curve_structures()
    assert len(made) == 322 and len({s.spread_id for s in made}) == 322
    own = G.Structure("MINE", "mine", "Crack", "HO", 1, 1, "HO_WTI_M1", (G.Leg("HO", 0, 1), G.Leg("CL", 0, -1)))
    merged = G.merge_structures([own], made)
    assert len(merged) == 322 and not any(s.spread_id == "CRK.HO_CL.M01" for s in merged)


def test_normal_cdf(spark):
    xs = [-9.0, -3.3, -1.0, -0.1, 0.0, 0.7, 2.5, 8.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf(F.col("x"))).collect()]
    np.testing.assert_allclose(got, [NormalDist().cdf(x) for x in xs], rtol=1e-9, atol=1e-15)


def _learn_loop(losses, p, folds):
    """Straight dictionary version of the learner for one group."""
    w = {e: 1 / 7 for e in EXPERTS}
    out, seen, start = [], 0, len(losses) - folds.lockbox_sessions
    for i, _ in enumerate(losses):
        if i and i < start and losses[i - 1]:
            w = {e: w[e] * math.exp(-p.adaptive_learning_rate * losses[i - 1].get(e, 0.0)) for e in EXPERTS}
            total = sum(w.values())
            w = {e: (1 - p.adaptive_uniform_shrinkage) * v / total + p.adaptive_uniform_shrinkage / 7 for e, v in w.items()}
            w = {e: max(0.1 / 7, v) for e, v in w.items()}
            for _ in range(12):
                total = sum(w.values())
                w = {e: v / total for e, v in w.items()}
                over = [e for e in w if w[e] > p.adaptive_max_expert_weight]
                if not over:
                    break
                excess = sum(w[e] - p.adaptive_max_expert_weight for e in over)
                rest = sum(w[e] for e in w if e not in over)
                w = {e: p.adaptive_max_expert_weight if e in over else v * (1 + excess / rest) for e, v in w.items()}
            total = sum(w.values())
            w = {e: v / total for e, v in w.items()}
            seen += 1
        out.append((seen, dict(w)))
    return out


def test_fixed_share_equals_the_loop_and_freezes(spark):
    p, folds = X.Learner(), W.Folds(lockbox_sessions=10)
    rng = np.random.default_rng(3)
    days = pd.date_range("2024-01-01", periods=80, freq="D")
    losses = [{e: float(rng.random() * (8 if k == 0 else 1)) for k, e in enumerate(EXPERTS) if rng.random() < 0.7} for _ in days]
    sessions = spark.createDataFrame([("g", d.date()) for d in days], "learner_group string, session_date date")
    rows = [("g", d.date(), *[l.get(e) for e in EXPERTS]) for d, l in zip(days, losses) if l]
    table = spark.createDataFrame(rows, "learner_group string, session_date date, " + ", ".join(f"{c} double" for c in X.LOSSES))
    got = X.fixed_share_weights(sessions, table, p, folds).orderBy("session_date").toPandas()
    want = _learn_loop(losses, p, folds)
    np.testing.assert_allclose(got[list(X.WEIGHTS)].to_numpy(), [[w[e] for e in EXPERTS] for _, w in want], rtol=1e-6)
    assert got["adaptive_observations"].tolist() == [s for s, _ in want]
    assert got["adaptive_status"].tolist()[-10:] == ["LOCKBOX_FROZEN"] * 10
    frozen = got[list(X.WEIGHTS)].tail(10)
    assert (frozen.nunique() == 1).all() and frozen.to_numpy().max() <= 0.35 + 1e-9


def _ledger_loop(bars, k, limit):
    """Bar-by-bar ledger of one strategy in one segment."""
    position, entry, pending, leave, held, trades = 0, None, None, None, 0, []
    rows = bars.to_dict("records")

    def close(i, value, reason):
        nonlocal position, entry, held, leave
        trades.append((entry, i, position, value, reason, held))
        position, entry, held, leave = 0, None, 0, None

    for i, r in enumerate(rows):
        if not (math.isfinite(r["open_value"]) and math.isfinite(r["close_value"])):
            pending = None
            continue
        if position and r["forced_last"]:
            close(i, r["open_value"], "MANDATORY_D4_EXIT")
            pending = None
        if position and leave:
            close(i, r["open_value"], leave)
        if not position and pending is not None:
            if r["entry_allowed"]:
                position, entry, held = pending, i, 0
            pending = None
        if position:
            held += 1
            code = r[f"_l{k}"] if position > 0 else r[f"_s{k}"]
            reason = "MAX_HOLD" if held >= limit else L.EXIT_REASONS[code]
            if reason:
                leave = reason
        elif r[f"_v{k}"] and r["entry_allowed"] and r["liquidity_reason"] == "PASS" and i + 1 < len(rows):
            pending = int(r[f"_v{k}"])
    if position:
        last = max(i for i, r in enumerate(rows) if math.isfinite(r["close_value"]))
        close(last, rows[last]["close_value"], "END_OF_SAMPLE")
    return trades


def _ledger_bars(seed, n, name, tail=0):
    """Random bars of one structure with rolls, forced exits and bars without values."""
    rng = np.random.default_rng(seed)
    price = 100 + rng.normal(size=n).cumsum()
    when = pd.date_range("2024-01-01", periods=n, freq="3h")
    bars = pd.DataFrame({
        "spread_id": name, "segment": np.cumsum(rng.random(n) < 0.004), "timestamp_utc": when, "session_date": when.date, "roll_id": "r",
        "open_value": np.where(rng.random(n) < 0.04, np.nan, price + rng.normal(size=n)), "close_value": price,
        "spread_open": price, "spread_close": price, "cost": 1.0, "entry_allowed": rng.random(n) < 0.9,
        "liquidity_reason": np.where(rng.random(n) < 0.8, "PASS", "WIDE_MARKET"), "forced_last": rng.random(n) < 0.02,
        "relative_volume": 1.0, "package_volume_capacity": 5.0, "max_leg_bid_ask_ticks": 1.0, "earliest_risk_date": when.date, "forced_exit_session": when.date,
    })
    for k in range(len(STRATEGIES)):
        bars[f"_v{k}"] = rng.choice([-1, 0, 0, 0, 1], n).astype("int8")
        bars[f"_l{k}"] = np.where(rng.random(n) < 0.05, 2, 0).astype("int8")
        bars[f"_s{k}"] = np.where(rng.random(n) < 0.05, 3, 0).astype("int8")
    if tail:
        bars.loc[bars.index[-tail:], "close_value"] = np.nan
    bars["last_segment"] = bars["segment"] == bars["segment"].max()
    bars["bar"] = np.arange(1, n + 1)
    bars["live"] = (np.isfinite(bars["open_value"]) & np.isfinite(bars["close_value"])).cumsum()
    return bars


def _ledger_frame(spark, tables):
    """The table as the library's inputs have it: missing values are null."""
    bars = spark.createDataFrame(pd.concat(tables))
    values = {c: F.when(~F.isnan(c), F.col(c)) for c in ("open_value", "close_value")}
    return bars.withColumns({**values, "timestamp_utc": F.col("timestamp_utc").cast("timestamp_ntz")})


# One structure holds a third of all rows; blocks shorter than a holding time, several levels.
@pytest.mark.parametrize("block, fan", [(40, 2), (64, 3), (4096, 1024)])
def test_ledger_walk_equals_the_bar_loop(spark, block, fan):
    tables = [_ledger_bars(0, 1200, "hot"), *[_ledger_bars(i, 400, f"s{i}", tail=7 * (i % 2)) for i in range(1, 6)]]
    got = L.run_ledger(_ledger_frame(spark, tables), block, fan).toPandas()
    for bars in tables:
        for k, s in enumerate(STRATEGIES):
            mine = got[(got["strategy_id"] == s.strategy_id) & (got["spread_id"] == bars["spread_id"][0])].sort_values("entry_time")
            want = []
            for _, segment in bars.groupby("segment"):
                segment = segment.reset_index(drop=True)
                for e, x, side, value, reason, held in _ledger_loop(segment, k, s.maximum_holding_bars):
                    if reason == "END_OF_SAMPLE" and not segment["last_segment"][0]:
                        reason = "ROLL_SAFETY_PREVIOUS_CLOSE"
                    times = segment["timestamp_utc"]
                    want.append((times[e], times[x], reason, held, round(side * (value - segment["open_value"][e]), 9)))
            rows = zip(mine["entry_time"], mine["exit_time"], mine["exit_reason"], mine["holding_bars"], mine["gross_pnl_usd"].round(9))
            assert list(rows) == want


def test_ledger_without_bars(spark):
    bars = _ledger_frame(spark, [_ledger_bars(1, 50, "s")])
    assert L.run_ledger(bars.limit(0)).count() == 0
    assert L.run_ledger(bars.withColumn("open_value", F.lit(None).cast("double"))).count() == 0


def test_marked_equity_equals_the_loop(spark):
    tables = [_ledger_bars(i, 300, f"s{i}", tail=5 * i) for i in range(2)]
    inputs = _ledger_frame(spark, tables)
    trades = L.run_ledger(inputs, 64, 3)
    got = {(r["spread_id"], r["strategy_id"], r["timestamp_utc"]): r for r in L.marked_equity(inputs, trades).collect()}
    made = trades.toPandas()
    for bars in tables:
        live = bars[np.isfinite(bars["open_value"]) & np.isfinite(bars["close_value"])]
        for s in STRATEGIES:
            mine = made[(made["strategy_id"] == s.strategy_id) & (made["spread_id"] == bars["spread_id"][0])]
            late = mine["exit_reason"].isin(["END_OF_SAMPLE", "ROLL_SAFETY_PREVIOUS_CLOSE"])
            for t, close in zip(live["timestamp_utc"], live["close_value"]):
                gone = np.where(late, mine["exit_time"] < t, mine["exit_time"] <= t)
                held = mine[(mine["entry_time"] <= t) & ~gone]
                side = 1 if len(held) and held["direction"].iat[0] == "LONG" else -1
                r = got[bars["spread_id"][0], s.strategy_id, t]
                assert len(held) <= 1 and r["position"] == (side if len(held) else 0)
                mark = side * (close - held["entry_package_value_usd"].iat[0]) - held["entry_cost_usd"].iat[0] if len(held) else 0
                assert r["realized_net_pnl_usd"] == pytest.approx(mine["net_pnl_usd"][gone].sum())
                assert r["equity_usd"] == pytest.approx(mine["net_pnl_usd"][gone].sum() + mark)
    assert len(got) == len(STRATEGIES) * sum((np.isfinite(b["open_value"]) & np.isfinite(b["close_value"])).sum() for b in tables)


def test_capped_weights_sum_to_one(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.random(7) ** 8).tolist()) for i in range(200)] + [(200, [1.0] + [0.0] * 6), (201, [0.0] * 7)]
    out = spark.createDataFrame(rows, "i int, w array<double>").select("i", "w", X.capped_weights(F.col("w"), 7, 0.35).alias("c")).collect()
    for r in out:
        w, c = np.maximum(r["w"], 0.1 / 7), np.array(r["c"])
        assert c.sum() == pytest.approx(1) and c.max() <= 0.35 + 1e-12
        free = c < 0.35 - 1e-12
        ratio = c[free] / w[free]
        assert ratio.max() == pytest.approx(ratio.min()) and (w[~free] * ratio.max() >= 0.35 - 1e-9).all()


def test_budget_equals_the_greedy_walk(spark):
    rng = np.random.default_rng(11)
    rows = [(int(d), f"g{rng.integers(5)}", float(rng.random()), i) for i, d in enumerate(rng.choice([1, 1, 1, 2, 3], 400))]
    df = spark.createDataFrame(rows, "day int, g string, score double, id int")
    got = {r["id"]: r["portfolio_action"] for r in BD.entry_budget(df, ["day"], "g", [-F.col("score"), F.col("id")]).collect()}
    for day in (1, 2, 3):
        used, taken = set(), 0
        for _, g, _, i in sorted((r for r in rows if r[0] == day), key=lambda r: (-r[2], r[3])):
            if g in used:
                want = "DUPLICATE_ALGEBRA_GROUP"
            elif taken >= 3:
                want = "DAILY_TRADE_BUDGET"
            else:
                want, taken = "SELECTED", taken + 1
                used.add(g)
            assert got[i] == want


def test_budget_takes_one_of_tied_rows(spark):
    rows = [(1, "a", 5.0, 7)] * 3 + [(1, "a", 2.0, 9), (1, "b", 4.0, 1), (1, "b", 4.0, 2), (1, "c", 3.0, 1), (1, "d", 1.0, 1), (1, "d", 1.0, 1), (2, "a", 0.0, 1)]
    df = spark.createDataFrame(rows, "day int, g string, score double, id int").withColumn("net", F.col("score") - 3)
    order = [-F.col("score")]
    want = {(1, "a", "SELECTED"): 1, (1, "a", "DUPLICATE_ALGEBRA_GROUP"): 3, (1, "b", "SELECTED"): 1, (1, "b", "DUPLICATE_ALGEBRA_GROUP"): 1, (1, "c", "SELECTED"): 1,
            (1, "d", "DAILY_TRADE_BUDGET"): 2, (2, "a", "SELECTED"): 1}
    done = BD.entry_budget(df, ["day"], "g", order).groupBy("day", "g", "portfolio_action").count()
    assert {tuple(r)[:3]: r["count"] for r in done.collect()} == want
    totals = BD.budget_totals(df, ["day"], "g", order, "net").collect()
    assert {tuple(r)[:3]: r["trades"] for r in totals} == want
    assert {tuple(r)[:3]: r["net_pnl_usd"] for r in totals}[1, "a", "DUPLICATE_ALGEBRA_GROUP"] == 3.0


def test_scorecards_read_trades_once(spark, tmp_path):
    from curvelab.sources import views
    from tests.conftest import SMALL

    path = str(tmp_path / "trades")
    views.phased_trades(spark, SMALL).write.parquet(path)
    trades = spark.read.parquet(path)
    window = [F.lit(d).cast("date") for d in ("1999-01-01", "2000-12-31")]
    recent = SC.recent_metrics(SC.selected_trades(trades, SC.best_strategies(SC.scorecard(trades, 10)), *window))
    for told in (SC.scorecard(trades, 10), SC.fold_metrics(trades), recent):
        assert not [f for f in told.inputFiles() if path in f]
    assert SC.scorecard(trades, 10).agg(F.sum("lockbox_trades")).first()[0] == trades.filter("phase = 'LOCKBOX'").count()


def _hourly(rows):
    """Two synthetic entities in the layout of package bars."""
    rng = np.random.default_rng(2)
    frames = []
    for name in ("a", "b"):
        close = 50 + rng.normal(size=rows).cumsum()
        t = pd.date_range("2024-01-01", periods=rows, freq="h")
        frames.append(pd.DataFrame({
            "spread_id": name, "timestamp_utc": t, "session_date": t.date, "bar_slot": t.hour, "bar_start_local": t, "roll_id": "r",
            "research_close": close, "spread_close": close, "spread_bar_vwap": close, "price_change": np.append(np.nan, np.diff(close)),
            "package_volume_capacity": rng.integers(1, 9, rows).astype(float), "paired_volume_bbl": 1000.0, "package_oi_capacity": 5.0,
            "min_leg_events": 1.0, "leg1_usd_bbl": close, "leg2_usd_bbl": -close, "n_legs": 2,
        }))
    return pd.concat(frames, ignore_index=True)


def test_trials_of_the_same_trades_stand_by_name(spark):
    """Evidence that differs in the last bits only is a tie; a difference in the tail of the probability is none."""
    rows = [
        ("click", "REGIME_ENSEMBLE", "VALIDATED", 0.27750862065049370, 2 / 3, 14.652574227008424, 35635.000000000007, 5),
        ("click", "ADAPTIVE_EXPERT_MIX", "VALIDATED", 0.27750862065049364, 2 / 3, 14.652574227008422, 35635.0, 5),
        ("view", "REGIME_ENSEMBLE", "RESEARCH_ONLY", 4.4e-26, 0.5, 1e-17, -1e-12, 2),
        ("view", "ADAPTIVE_EXPERT_MIX", "RESEARCH_ONLY", 4.4e-26, 0.5, -1e-17, 0.0, 2),
        ("view", "FLOW_DIVERGENCE", "RESEARCH_ONLY", 4.5e-26, 0.0, -3.0, -5.0, 1),
        ("view", "TREND_BREAKOUT", "RESEARCH_ONLY", None, 1.0, 1.0, 1.0, 1),
    ]
    score = spark.createDataFrame(
        rows, "spread_id string, strategy_id string, status string, deflated_sharpe_probability double, profitable_fold_share double,"
        " daily_sharpe double, net_pnl_usd double, oos_trades long",
    )
    ranked = SC.rank_trials(score).orderBy("spread_id", "evidence_rank").collect()
    assert [r["strategy_id"] for r in ranked] == [
        "ADAPTIVE_EXPERT_MIX", "REGIME_ENSEMBLE", "FLOW_DIVERGENCE", "ADAPTIVE_EXPERT_MIX", "REGIME_ENSEMBLE", "TREND_BREAKOUT",
    ]


@pytest.mark.parametrize("view", [views.contract_bars, views.curve_bars])
def test_bars_do_not_sort_line_items(spark, view):
    """What reads the line items ahead of the shuffle is a hash aggregate."""
    plan = view.__wrapped__(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.rindex("Exchange"):]
    assert "Scan parquet" in read and "HashAggregate" in read and "Sort" not in read


def test_history_is_built_from_its_brands_only(spark, monkeypatch):
    """The hourly prior reads no daily bars of other brands, and those it reads are the same."""
    kept = []
    monkeypatch.setattr(learning, "stage", lambda s, label, folder, build: kept.append((label, build())) or kept[-1][1])
    learning.hour_prior(spark, SMALL)
    bars = dict(kept)["history-bars"]
    brands = list(learning._HISTORY.values())
    every = views.day_bars(spark, SMALL).filter(F.col("entity").isin(brands))
    rounded = lambda df: sorted((r[0], r[1], round(r[2], 6), r[3]) for r in df.select("entity", "session_date", "close", "volume").collect())
    assert rounded(bars) == rounded(every) and bars.select("entity").distinct().count() > 1


def test_indicators_are_causal_and_isolated(spark):
    from curvelab.operators.indicators import Windows, add_indicators

    p = Windows(8)
    base = _hourly(240)
    shocked = base.copy()
    last = shocked[shocked["spread_id"] == "a"].index[-1]
    shocked.loc[last, ["research_close", "spread_close", "price_change"]] = [500.0, 500.0, 450.0]

    def run(frame):
        df = spark.createDataFrame(frame).withColumn("price_change", F.when(~F.isnan("price_change"), F.col("price_change")))
        cols = ["robust_z", "rsi", "macd_histogram", "trend_hac_t_stat_3d", "return_skew_5d", "tod_normalized_change", "variance_ratio_5"]
        out = add_indicators(df, p).select("spread_id", "timestamp_utc", *cols).toPandas()
        return out.sort_values(["spread_id", "timestamp_utc"]).reset_index(drop=True)

    a, b = run(base), run(shocked)
    same = ~((a["spread_id"] == "a") & (a["timestamp_utc"] == a["timestamp_utc"].max()))
    pd.testing.assert_frame_equal(a[same], b[same])
    assert not a[~same].equals(b[~same])
    early = a.groupby("spread_id")["robust_z"].head(p.three_sessions - 1)
    assert early.isna().all()
