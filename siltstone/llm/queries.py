"""Queries of the training-text problems (p2, p3, p4, p6, p7, p8) with SQL where SQL can express them."""

from __future__ import annotations

from siltstone.llm import q_boilerplate, q_budget, q_quality, q_scans, q_split

_MODULES = (q_split, q_boilerplate, q_scans, q_budget, q_quality)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
