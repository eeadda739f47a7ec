"""All queries of the engine's own operators, and their oracle SQL."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "trf_multiclass"
MODULES: tuple[str, ...] = ("vectors", "relational", "graphs", "evaluation", "datasets")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"strandlake.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
