"""Registered queries: every operator bound to tables, with its SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module
from pathlib import Path

from tidemark.catalog.registry import ORACLES, QUERIES

_HERE = Path(__file__).parent
_MODULES = (
    "sources", "predicates", "scalars", "joining", "aggregating", "windowing", "ranking",
    "quality", "profiles", "evidence", "failures", "comparing", "remediation", "configs",
    "inventory", "knowledge", "streams",
)


def load() -> tuple[dict, dict]:
    for name in _MODULES:
        if (_HERE / f"{name}.py").exists():
            import_module(f"tidemark.catalog.{name}")
    return QUERIES, ORACLES
