"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("q_repetition", "q_html", "q_mixing", "q_simhash", "q_warc", "q_licences", "q_quality", "q_secrets", "q_hnsw", "q_bpe")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"strandlake.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
