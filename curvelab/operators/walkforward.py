"""Walk-forward folds, the lockbox, and the phase of a date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelab.config import STRATEGIES
from curvelab.operators.calendar import TradingDay


@dataclass(frozen=True)
class Folds:
    """Lengths in sessions."""

    # Fixed values.
    train_sessions: int = 180
    validation_sessions: int = 30
    embargo_sessions: int = 5
    test_sessions: int = 15
    lockbox_sessions: int = 30


def session_list(df: DataFrame, day: str = "session_date") -> DataFrame:
    """One row with all sessions in order; bounded by the calendar."""
    return df.select(F.col(day).alias("d")).distinct().agg(F.sort_array(F.collect_list("d")).alias("sessions"))


def _at(i: Column | int) -> Column:
    return F.get(F.col("sessions"), i if isinstance(i, Column) else F.lit(i))


def walk_forward(df: DataFrame, p: Folds = Folds(), day: str = "session_date") -> DataFrame:
    """Expanding folds inside the development sessions: train, validation, embargo, test."""
    span = p.embargo_sessions + p.test_sessions
    first = p.train_sessions + p.validation_sessions
    n = F.size("sessions")
    last_development = n - p.lockbox_sessions
    folds = F.floor((last_development - first) / F.lit(span)).cast("int")
    rows = session_list(df, day).filter((n > p.lockbox_sessions) & (folds >= 1)).withColumn(
        "fold", F.explode(F.sequence(F.lit(1), folds))
    )
    embargo = F.lit(first) + (F.col("fold") - 1) * span
    test = embargo + p.embargo_sessions
    validation = embargo - p.validation_sessions
    return rows.select(
        "fold",
        _at(0).alias("train_start"),
        _at(validation - 1).alias("train_end"),
        _at(validation).alias("validation_start"),
        _at(embargo - 1).alias("validation_end"),
        _at(embargo).alias("embargo_start"),
        _at(test - 1).alias("embargo_end"),
        _at(test).alias("test_start"),
        _at(test + (p.test_sessions - 1)).alias("test_end"),
        validation.alias("train_sessions_in_fold"),
        _at(last_development - 1).alias("development_end"),
        _at(last_development).alias("lockbox_start"),
        _at(n - 1).alias("lockbox_end"),
        n.alias("available_sessions"),
    )


def describe_windows(windows: DataFrame, p: Folds = Folds(), trading: TradingDay = TradingDay()) -> DataFrame:
    """The fold table with its constants, as reported."""
    return windows.withColumns(
        {
            "validation_sessions_in_fold": F.lit(p.validation_sessions),
            "embargo_sessions": F.lit(p.embargo_sessions),
            "oos_test_sessions": F.lit(p.test_sessions),
            "lockbox_sessions": F.lit(p.lockbox_sessions),
            "lockbox_used_for_training": F.lit(False),
            "bar_interval_minutes": F.lit(trading.bar_interval_minutes),
            "strategy_count": F.lit(len(STRATEGIES)),
        }
    )


def lockbox_start(df: DataFrame, p: Folds = Folds(), day: str = "session_date") -> DataFrame:
    """One row with the first lockbox session (null where history is too short)."""
    n = F.size("sessions")
    return session_list(df, day).select(
        F.when(n >= p.lockbox_sessions, _at(n - p.lockbox_sessions)).alias("lockbox_start"), _at(n - 1).alias("lockbox_end")
    )


def phase_days(df: DataFrame, p: Folds = Folds(), day: str = "session_date") -> DataFrame:
    """(day, phase, fold) for test-fold and lockbox days; other days are DEVELOPMENT.

    Intervals are opened into days, so a date finds its phase by an equi-join.
    """
    folds = walk_forward(df, p, day).select(
        F.explode(F.sequence("test_start", "test_end")).alias("day"), F.lit("OOS").alias("phase"), "fold"
    )
    lockbox = (
        lockbox_start(df, p, day)
        .filter(F.col("lockbox_start").isNotNull())
        .select(
            F.explode(F.sequence("lockbox_start", "lockbox_end")).alias("day"),
            F.lit("LOCKBOX").alias("phase"),
            F.lit(None).cast("int").alias("fold"),
        )
    )
    return folds.unionByName(lockbox)


def tag_phase(df: DataFrame, days: DataFrame, day: str, phase: str = "phase", fold: str = "fold") -> DataFrame:
    named = days.select(F.col("day").alias(day), F.col("phase").alias(phase), F.col("fold").alias(fold))
    return df.join(named, day, "left").withColumn(phase, F.coalesce(phase, F.lit("DEVELOPMENT")))


def tag_trades(trades: DataFrame, days: DataFrame) -> DataFrame:
    """Phase of the entry; a trade that leaves its fold or the lockbox is purged."""
    entered = tag_phase(trades, days, "entry_session", "_in", "_in_fold")
    both = tag_phase(entered, days, "exit_session", "_out", "_out_fold")
    leaves = F.col("_in").isin("OOS", "LOCKBOX") & (
        (F.col("_in") != F.col("_out")) | ((F.col("_in") == "OOS") & (F.col("_in_fold") != F.col("_out_fold")))
    )
    return both.withColumns(
        {
            "phase": F.when(leaves, "PURGED").otherwise(F.col("_in")),
            "fold": F.when(~leaves & (F.col("_in") == "OOS"), F.col("_in_fold")),
        }
    ).drop("_in", "_in_fold", "_out", "_out_fold")
