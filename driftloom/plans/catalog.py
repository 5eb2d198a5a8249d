"""All registered queries."""

from driftloom.plans import drift_queries, history_queries, quality_queries, registry_queries, run_queries

_MODULES = [drift_queries, quality_queries, history_queries, registry_queries, run_queries]

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
