"""The technical pipeline: bars, packages, features.

Stages that several later steps read are stage tables (see ``curvelab.stages``); what
lies between two stages is one lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelab.config import STRATEGIES
from curvelab.operators import calendar as C
from curvelab.operators import experts as X
from curvelab.operators import indicators as I
from curvelab.operators import ledger as L
from curvelab.operators import packages as P
from curvelab.operators import scorecard as SC
from curvelab.operators import seasonal
from curvelab.operators import structures as G
from curvelab.operators import walkforward as W
from curvelab.plans.settings import Settings
from curvelab.stages import write_stage


@dataclass(frozen=True)
class Inputs:
    """Bars of all event types, optional daily rows, contracts with expiry data."""

    bars: DataFrame
    universe: DataFrame
    reference: DataFrame | None = None
    daily: DataFrame | None = None


# Gives the stage table of a label, building it where it does not exist yet.
Store = Callable[[str, Callable[[], DataFrame]], DataFrame]


def write_always(label: str, build: Callable[[], DataFrame]) -> DataFrame:
    return write_stage(build(), label)


@dataclass(frozen=True)
class Market:
    """Prepared bars and the registries they were prepared with."""

    settings: Settings
    structures: tuple[G.Structure, ...]
    structure_table: DataFrame
    legs: DataFrame
    calendar: DataFrame
    contracts: DataFrame
    store: Store = field(repr=False)
    _prepared: Callable[[], DataFrame] = field(repr=False)
    _daily: Callable[[], DataFrame] | None = field(repr=False, default=None)
    # One bar per session: the bars already are the daily history.
    bars_are_daily: bool = False

    @property
    def prepared(self) -> DataFrame:
        return self.store("prepared", self._prepared)

    @property
    def raw_packages(self) -> DataFrame:
        return self.store(
            "packages", lambda: P.build_packages(self.prepared, self.legs, self.structure_table)
        )

    @property
    def packages(self) -> DataFrame:
        """Back-adjusted package bars."""
        return self.store("package-bars", lambda: P.risk_distance(P.back_adjust(self.raw_packages)))

    @property
    def daily_packages(self) -> DataFrame:
        """Packages of the daily settles, the history the seasonal prior is built on."""

        def build() -> DataFrame:
            if self._daily is None:
                return self.packages
            packed = self.store("daily-raw-packages", lambda: P.build_packages(self._daily(), self.legs, self.structure_table))
            return P.risk_distance(P.back_adjust(packed))

        return self.store("daily-packages", build)

    @property
    def seasonality(self) -> DataFrame:
        history = self.packages if self.bars_are_daily else self.daily_packages
        return self.store("seasonality", lambda: seasonal.seasonality(history, self.settings.prior))

    @property
    def features(self) -> DataFrame:
        def build() -> DataFrame:
            indicated = I.add_indicators(self.packages, self.settings.windows)
            return seasonal.attach_seasonality(indicated, self.seasonality).withColumn(
                "session_last_slot", F.lit(self.settings.trading.complete_bars_per_session - 1)
            )

        return self.store("features", build)

    @property
    def voted(self) -> DataFrame:
        """Features with expert votes, ensemble weights and the adaptive vote."""
        return self.store("voted", lambda: learn(self.features, self.settings))

    @property
    def trades(self) -> DataFrame:
        return self.store("trades", lambda: backtest(self.voted, self.structure_table, self.settings))

    @property
    def scorecard(self) -> DataFrame:
        trials = sum(s.model_enabled for s in self.structures) * len(STRATEGIES)

        def build() -> DataFrame:
            score = SC.scorecard(self.trades, trials, self.settings.evidence)
            return SC.complete_scorecard(score, self.structure_table, self.voted, STRATEGIES, self.settings.evidence)

        return self.store("scorecard", build)


def learn(features: DataFrame, settings: Settings) -> DataFrame:
    return X.add_adaptive_ensemble(X.with_expert_votes(features), settings.learner, settings.folds, base=features)


def backtest(voted: DataFrame, structures: DataFrame, settings: Settings) -> DataFrame:
    """Trades of all enabled structures with their walk-forward phase."""
    enabled = voted.join(structures.filter("model_enabled").select("spread_id"), "spread_id", "left_semi")
    inputs = write_stage(L.ledger_inputs(enabled, settings.gate), "ledger-inputs")
    trades = write_stage(L.run_ledger(inputs), "ledger")
    return L.finish_trades(trades, structures, W.phase_days(enabled, settings.folds))


def prepare(
    spark: SparkSession,
    inputs: Inputs,
    structures: tuple[G.Structure, ...],
    settings: Settings = Settings(),
    store: Store = write_always,
    bars_are_daily: bool = False,
) -> Market:
    span = inputs.universe.agg(
        F.min("fallback_expiry").alias("first_day"), F.max("fallback_expiry").alias("last_day")
    )
    calendar = C.session_calendar(span)
    contracts = store(
        "contracts", lambda: C.contract_registry(inputs.universe, inputs.reference, calendar, settings.trading)
    )
    roots = C.root_table(spark, settings.roots)
    return Market(
        settings,
        structures,
        G.structure_table(spark, structures, settings.roots),
        G.leg_table(spark, structures),
        calendar,
        contracts,
        store,
        lambda: P.prepare_bars(inputs.bars, contracts, roots, inputs.daily),
        None
        if inputs.daily is None
        else lambda: P.prepare_bars(P.daily_as_bars(inputs.daily, settings.trading), contracts, roots, inputs.daily),
        bars_are_daily,
    )
