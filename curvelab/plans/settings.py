"""The parameters of all operators of the technical pipeline in one value."""

from __future__ import annotations

from dataclasses import dataclass

from curvelab.config import ROOTS, RootSpec
from curvelab.operators.board import BoardLimits
from curvelab.operators.calendar import TradingDay
from curvelab.operators.experts import Learner
from curvelab.operators.indicators import RiskLimits, Windows
from curvelab.operators.ledger import EntryGate
from curvelab.operators.quality import Coverage
from curvelab.operators.scorecard import Evidence
from curvelab.operators.seasonal import PriorPool
from curvelab.operators.walkforward import Folds


@dataclass(frozen=True)
class Settings:
    trading: TradingDay = TradingDay()
    windows: Windows = Windows()
    risk: RiskLimits = RiskLimits()
    prior: PriorPool = PriorPool()
    learner: Learner = Learner()
    gate: EntryGate = EntryGate()
    folds: Folds = Folds()
    evidence: Evidence = Evidence()
    board: BoardLimits = BoardLimits()
    coverage: Coverage = Coverage()
    roots: tuple[RootSpec, ...] = ROOTS
