"""Registered queries beside their DuckDB counterparts on the smallest data."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from scripts.check_queries import rows_of
from tests.conftest import SMALL

QUICK = (
    "bars_tumbling", "robust_z", "squeeze", "ema_macd", "rsi_wilder", "jump_score", "ar1_half_life", "same_slot_baselines",
    "session_vwap_obv", "holiday_calendar", "session_offsets", "contract_registry", "package_align", "roll_back_adjust",
    "walk_forward_windows", "phase_tag", "scorecard", "fold_metrics", "entry_budget", "recent_structure_metrics",
    "interpolate_bounded", "weighted_legs", "longest_run", "quarter_half_strips", "var_rolling", "unit_convert", "token_parse",
    "pricing_rows", "upsert_keep_last", "table_difference", "stream_session_vwap",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    ours = [tuple(r) for r in df.collect()]
    cur = duck.execute(entry.oracle_sql()[name])
    theirs = cur.fetchall()
    assert rows_of(df.columns, ours) == rows_of([d[0] for d in cur.description], theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
