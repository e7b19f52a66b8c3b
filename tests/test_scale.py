"""Blocked windows, prefix sums and smoothers against plain pandas on skewed data."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvelab.functions import rolling as R
from curvelab.operators import smoothers as M
from curvelab.scale import blocked, focus, last_known, latest_by, row_index, running_total, salted_join


@pytest.fixture(scope="module")
def series():
    """One entity holds most rows."""
    rng = np.random.default_rng(5)
    parts = []
    for name, n in (("hot", 900), ("warm", 120), ("cold", 15)):
        x = 100 + rng.normal(size=n).cumsum()
        t = pd.date_range("2024-01-01", periods=n, freq="6h")
        gap = rng.random(n) < 0.1
        parts.append(pd.DataFrame({"e": name, "t": t, "x": x, "y": np.where(gap, np.nan, x)}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def frame(spark, series):
    df = spark.createDataFrame(series)
    return df.withColumn("y", F.when(~F.isnan("y"), F.col("y"))).repartition(4)


def month():
    return F.date_trunc("month", F.col("t"))


def test_row_index_equals_plain_numbering(frame, series):
    got = row_index(frame, "e", "t", month()).select("e", "t", "_rn").toPandas().sort_values(["e", "t"])
    want = series.sort_values(["e", "t"]).groupby("e").cumcount() + 1
    assert got["_rn"].tolist() == want.tolist()


def test_running_total_equals_cumsum(frame, series):
    got = running_total(frame, "e", "t", month(), {"s": F.col("x")}).toPandas().sort_values(["e", "t"])
    want = series.sort_values(["e", "t"]).groupby("e")["x"].cumsum()
    np.testing.assert_allclose(got["s"], want)


def test_last_known_equals_a_forward_fill(frame, series):
    gaps = frame.withColumn("y", F.when((F.dayofmonth("t") > 3) & (F.col("e") != "cold"), F.lit(None)).otherwise(F.col("y")))
    got = last_known(gaps, "e", "t", month(), "y").toPandas().sort_values(["e", "t"])
    plain = gaps.toPandas().sort_values(["e", "t"])
    want = plain.groupby("e")["y"].ffill()
    np.testing.assert_allclose(got["y"].to_numpy(dtype=float), want.to_numpy(dtype=float))


def test_blocks_do_not_change_rolling_results(frame, series):
    b = blocked(frame, "e", "t", month(), halo=40, block=64)
    out = R.window_sums(b, b.frame, {"y": R.Track(F.col("y"), (20, 40), 4)}).withColumns(
        {"m": R.mean("y", 20, 8), "s": R.std("y", 40, 10), "k": R.skew("y", 40, 10), "u": R.kurtosis("y", 40, 10)}
    )
    got = b.finish(out).toPandas().sort_values(["e", "t"]).reset_index(drop=True)
    assert len(got) == len(series)
    by = series.sort_values(["e", "t"]).groupby("e")["y"]
    for name, w, m, f in (("m", 20, 8, "mean"), ("s", 40, 10, "std"), ("k", 40, 10, "skew"), ("u", 40, 10, "kurt")):
        want = by.transform(lambda v: getattr(v.rolling(w, min_periods=m), f)()).to_numpy()  # noqa: B023
        np.testing.assert_allclose(got[name].to_numpy(dtype=float), want, rtol=1e-6, atol=1e-6)


def _loop(values, alpha, minimum):
    y, seen, gap, out = None, 0, 0, []
    for v in values:
        if v == v:
            w = (1 - alpha) ** (gap + 1)
            y = v if y is None else (w * y + alpha * v) / (w + alpha)
            seen, gap = seen + 1, 0
        else:
            gap += 1
        out.append(y if seen >= minimum and y is not None else np.nan)
    return out


def test_smoothers_equal_the_recursion(frame, series):
    alpha = 0.3
    b = blocked(frame, "e", "t", month(), halo=130, block=200)
    out = M.smooth_nullable(b, b.frame.withColumn("a", M.smooth(b, F.col("x"), alpha, 5)), "y", alpha, "c", 5)
    got = b.finish(out).toPandas().sort_values(["e", "t"])
    by = series.sort_values(["e", "t"]).groupby("e")
    np.testing.assert_allclose(got["a"].to_numpy(dtype=float), np.concatenate([_loop(g, alpha, 5) for _, g in by["x"]]), rtol=1e-9)
    np.testing.assert_allclose(got["c"].to_numpy(dtype=float), np.concatenate([_loop(g, alpha, 5) for _, g in by["y"]]), rtol=1e-9)


def test_blocks_reject_windows_longer_than_the_halo(frame):
    b = blocked(frame, "e", "t", month(), halo=10)
    with pytest.raises(ValueError):
        b.trailing(12)
    with pytest.raises(ValueError):
        M.check_block([0.5], halo=10, block=64)


def test_salted_join_and_latest(spark):
    big = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 < 2 THEN 'hot' ELSE concat('k', id % 7) END AS k")
    small = big.select("k").distinct().withColumn("v", F.length("k"))
    assert salted_join(big, small, "k").filter("v = length(k)").count() == 1000
    nulls = big.select("id", F.when(F.col("k") != "hot", F.col("k")).alias("k"))
    with_null = small.unionByName(spark.createDataFrame([(None, -1)], small.schema))
    joined = salted_join(nulls, with_null, "k")
    assert joined.count() == 1000 and joined.filter("k IS NULL AND v IS NULL").count() == big.filter("k = 'hot'").count()
    assert salted_join(nulls, with_null, "k", "left_semi").count() == nulls.filter("k IS NOT NULL").count()
    # A side placed by the key must not bring a hot key's rows together.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        counted = salted_join(big, big.groupBy("k").agg(F.count("id").alias("n")), "k")
        plan = counted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert counted.filter("k = 'hot'").first()["n"] == big.filter("k = 'hot'").count()
    assert len(re.findall(r"hashpartitioning\((?:cast\()?_salted", plan)) == 2
    assert {(r["k"], r["id"]) for r in latest_by(big, "k", "id").collect()} == {
        (r["k"], r["m"]) for r in big.groupBy("k").agg(F.max("id").alias("m")).collect()
    }



def test_focus_gives_all_columns_back(spark):
    df = spark.range(5).selectExpr("id", "id * 2 AS a", "id * 3 AS b", "id * 4 AS c")
    narrow, restore = focus(df, ["id", "a"])
    assert set(narrow.columns) == {"id", "a", "_rest"}
    back = restore(narrow.withColumn("d", F.col("a") + 1))
    assert sorted(back.columns) == ["a", "b", "c", "d", "id"]
    assert back.filter("b = id * 3 AND d = a + 1").count() == 5


def test_rows_with_null_keys_stay(spark):
    rows = [(None, 1, 5.0), (None, 2, 7.0), ("a", 1, 1.0), ("a", None, 2.0), ("a", 3, None)] + [("hot", i, 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    numbered = row_index(df, "k", "t", F.floor(F.col("t") / 50)).collect()
    assert len(numbered) == len(rows)
    assert sorted(r["_rn"] for r in numbered if r["k"] is None) == [1, 2] and sorted(r["_rn"] for r in numbered if r["k"] == "a") == [1, 2, 3]
    summed = running_total(df, "k", "t", F.floor(F.col("t") / 50), {"s": F.col("v")}).collect()
    assert len(summed) == len(rows)
    assert {r["t"]: r["s"] for r in summed if r["k"] is None} == {1: 5.0, 2: 12.0}
    assert max(r["s"] for r in summed if r["k"] == "hot") == 300.0


def test_stage_follows_its_input(spark, tmp_path):
    from curvelab.stages import stage

    source = str(tmp_path / "in")
    read = lambda: stage(spark, "t", source, lambda: spark.read.parquet(f"{source}/t.parquet")).count()
    spark.range(5).write.parquet(f"{source}/t.parquet")
    assert read() == 5 and read() == 5
    spark.range(9).write.mode("overwrite").parquet(f"{source}/t.parquet")
    assert read() == 9
