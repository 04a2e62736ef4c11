"""Operators for training data. Nothing outside this package imports it."""

from __future__ import annotations

import importlib

#: Modules with their queries and SQL, in the order of the problems.
MODULES = ("percentile_queries", "pairs_queries", "split_queries", "bpe_queries", "mix_queries", "residue_queries")

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__name__}.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
