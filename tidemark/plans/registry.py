"""All registered queries of the library and their SQL."""

from __future__ import annotations

from tidemark.plans import circle_queries, model_queries, move_queries, operator_queries, rule_queries, source_queries, spot_queries, study_queries

_MODULES = (operator_queries, source_queries, study_queries, move_queries, model_queries, spot_queries, circle_queries, rule_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
