"""Stores, late rows, expiring snapshots and positions over several micro-batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvelab.operators import ingest
from curvelab.operators import ledger as L
from curvelab.streaming import bars as S
from curvelab.streaming import keepers as K
from curvelab.streaming.store import UpsertStore, last_row
from tests.test_technical import _ledger_bars, _ledger_frame

ROW = T.StructType([T.StructField("k", T.StringType()), T.StructField("day", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("v", T.DoubleType())])


def _store(spark, path, **how):
    return UpsertStore(spark, str(path), ROW, last_row(["k"], "seq", "_batch"), F.col("day"), **how)


def _rows(spark, *rows):
    return spark.createDataFrame(rows, ROW)


def _values(store):
    return {r["k"]: r["v"] for r in store.read().collect()}


def test_store_keeps_the_last_version_and_applies_a_batch_once(spark, tmp_path):
    store = _store(spark, tmp_path)
    assert store.read().count() == 0
    store.apply(_rows(spark, ("a", "mon", 1, 1.0), ("b", "tue", 1, 1.0), ("a", "mon", 2, 2.0)), 0)
    store.apply(_rows(spark, ("b", "tue", 3, 9.0), ("c", "wed", 4, 4.0), ("a", "mon", 1, 7.0)), 1)
    again = store.apply(_rows(spark, ("a", "mon", 9, 99.0)), 1)
    assert again.applied == 1 and _values(store) == {"a": 2.0, "b": 9.0, "c": 4.0}
    assert _values(_store(spark, tmp_path)) == {"a": 2.0, "b": 9.0, "c": 4.0}


def test_compaction_rewrites_touched_sessions_only(spark, tmp_path):
    store = _store(spark, tmp_path)
    store.apply(_rows(spark, ("a", "mon", 1, 1.0), ("b", "tue", 1, 1.0)), 0)
    store.apply(_rows(spark, ("a", "mon", 2, 2.0)), 1)
    untouched = [p for p in store.manifest().parts if p.session == "tue"]
    after = store.compact()
    assert [p for p in after.parts if p.session == "tue"] == untouched and len(after.parts) == 2
    assert _values(store) == {"a": 2.0, "b": 1.0} and store.compact() == after
    assert store.vacuum(keep=1) == 2 and _values(store) == {"a": 2.0, "b": 1.0}
    # What compaction made is one part a session: reading it needs no shuffle.
    assert "Exchange" not in store.read()._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("work", ["compact", "apply"])
def test_a_failure_leaves_the_old_manifest_valid(spark, tmp_path, work, monkeypatch):
    store = _store(spark, tmp_path)
    store.apply(_rows(spark, ("a", "mon", 1, 1.0)), 0)
    store.apply(_rows(spark, ("a", "mon", 2, 2.0)), 1)
    before = store.manifest()

    def fails(manifest):
        raise OSError("lost")

    monkeypatch.setattr(store, "_publish", fails)
    with pytest.raises(OSError):
        store.compact() if work == "compact" else store.apply(_rows(spark, ("a", "mon", 3, 3.0)), 2)
    monkeypatch.undo()
    assert store.manifest() == before and _values(store) == {"a": 2.0}
    store.apply(_rows(spark, ("a", "mon", 3, 3.0)), 2)
    assert _values(store) == {"a": 3.0}


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    store = _store(spark, tmp_path)
    old = store.manifest()
    store.apply(_rows(spark, ("a", "mon", 1, 1.0)), 0)
    with pytest.raises(RuntimeError):
        store._publish(old)


TICKS = T.StructType([T.StructField("i", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("k", T.StringType()), T.StructField("p", T.DoubleType())])


def _ticks(n):
    start = datetime(2024, 1, 1)
    return [(i, start + timedelta(minutes=7 * i), "hot" if i % 3 else f"k{i % 5}", float((i * 37) % 101)) for i in range(n)]


def test_bars_are_whole_however_ticks_arrive(spark, tmp_path):
    ticks = spark.createDataFrame(_ticks(600), TICKS)
    want = {(r["k"], r["bar_start"]): r for r in ingest.tumbling_bars(ticks, "k", "ts", "p", "1 hour").collect()}
    bars = S.LateBars(spark, str(tmp_path / "bars"), TICKS, "k", "ts", "p", "i", "1 hour", 1800)
    source = str(tmp_path / "in")
    late = 0
    for part in (4, 1, 3, 0, 2):  # fifths of the time, out of order
        ticks.filter((F.col("i") / 120).cast("int") == part).coalesce(2).write.mode("append").parquet(source)
        bars.run(S.read_parquet_stream(spark, source, TICKS, 1))
        late += 0 if part == 4 else 120
    got = {(r["k"], r["bar_start"]): r for r in bars.read().collect()}
    assert got.keys() == want.keys()
    for place, r in got.items():
        assert all(r[c] == want[place][c] for c in ("open", "high", "low", "close", "volume"))
    # The first hours of the last fifth may count as late too: its own files come one by one.
    counted = sum(r["late_rows"] for r in got.values())
    assert counted == bars.late().count() and late - 10 <= counted <= late + 120
    bars.store.compact()
    assert {(r["k"], r["bar_start"]): r["late_rows"] for r in bars.read().collect()} == {p: r["late_rows"] for p, r in got.items()}


QUOTE = T.StructType([T.StructField("security", T.StringType()), T.StructField("time", T.TimestampType()), T.StructField("bid_size", T.DoubleType()), T.StructField("ask_size", T.DoubleType())])


def test_snapshots_expire_and_ties_add_up(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, 10, m)
    source, base = str(tmp_path / "in"), str(tmp_path / "run")
    deliveries = [
        [("a", at(0), 1.0, 2.0), ("a", at(0), 10.0, 20.0), ("b", at(1), 5.0, 5.0)],
        [("a", at(0), 100.0, 200.0), ("b", at(2), 7.0, 8.0), ("b", at(1), 1.0, 1.0)],
        [("c", at(20), 3.0, 3.0)],
        [("c", at(21), 4.0, 4.0)],
    ]
    seen = []
    with K.state_store(spark):
        for rows in deliveries:
            spark.createDataFrame(rows, QUOTE).coalesce(1).write.mode("append").parquet(source)
            out = S.run_into(K.live_quotes(S.read_parquet_stream(spark, source, QUOTE, 1), 15 * 60_000, "2 minutes"), base, ["security"])
            seen.append({r["security"]: (r["bid_size"], r["ask_size"], r["live"]) for r in out.collect()})
    assert seen[0] == {"a": (11.0, 22.0, True), "b": (5.0, 5.0, True)}
    assert seen[1] == {"a": (111.0, 222.0, True), "b": (7.0, 8.0, True)}
    assert seen[3] == {"a": (111.0, 222.0, False), "b": (7.0, 8.0, False), "c": (4.0, 4.0, True)}


def test_positions_of_the_stream_are_those_of_the_ledger(spark, tmp_path):
    tables = [_ledger_bars(7, 260, "s0"), _ledger_bars(8, 150, "s1", tail=6)]
    inputs = _ledger_frame(spark, tables)
    bars = K.strategy_bars(inputs)
    source, base = str(tmp_path / "in"), str(tmp_path / "run")
    folders = S.in_time_order(bars, "ts", str(tmp_path / "deliveries"), 3, files=2)
    end = bars.limit(1).withColumns({"spread_id": F.lit("~"), "ts": F.lit("2100-01-01").cast("timestamp"), "vote": F.lit(0)})
    end.write.parquet(str(tmp_path / "end"))
    with K.state_store(spark):
        for folder in [*folders, str(tmp_path / "end")]:
            K.deliver(spark, folder, source)
            out = S.run_into(K.position_stream(S.read_parquet_stream(spark, source, bars.schema, 100)), base)
    shown = ["spread_id", "strategy_id", "direction", "entry_time", "exit_time", "exit_reason", "holding_bars", "mae_usd", "mfe_usd", "net_pnl_usd"]
    key = lambda rows: sorted(tuple(str(r[c]) if c.endswith("time") else round(r[c], 9) if isinstance(r[c], float) else r[c] for c in shown) for r in rows)
    assert key(L.priced(out).collect()) == key(L.run_ledger(inputs, 64, 3).collect())
