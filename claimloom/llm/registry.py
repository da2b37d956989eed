"""Queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("p01_markup", "p02_concepts", "p03_lookalikes", "p04_copies", "p05_scans", "p06_clusters", "p07_components", "p08_packing", "p09_leaks", "p10_quality")

QUERIES: dict = {}
SQL: dict = {}
for _m in _MODULES:
    _mod = import_module(f"claimloom.llm.{_m}")
    QUERIES |= _mod.QUERIES
    SQL |= _mod.SQL
