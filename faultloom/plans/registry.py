"""All registered queries outside the optional subpackage, with their SQL."""

from __future__ import annotations

from faultloom.plans import history_queries, log_queries, operator_queries, problem_queries, stream_queries

_MODULES = [problem_queries, history_queries, log_queries, operator_queries, stream_queries]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
