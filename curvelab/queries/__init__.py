"""Registered queries, one module per area."""

from __future__ import annotations

import importlib
import pkgutil

_HELPERS = {"ctes"}


def load_all() -> None:
    for module in pkgutil.iter_modules(__path__):
        if module.name not in _HELPERS:
            importlib.import_module(f"{__name__}.{module.name}")
