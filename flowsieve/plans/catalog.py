"""All registered queries and their oracle statements."""

from __future__ import annotations

from flowsieve.plans import decision_queries, graph_queries, integrity_queries, metric_queries, model_queries, source_queries, stream_queries, window_queries

MODULES = [
    window_queries, graph_queries, metric_queries, decision_queries, source_queries, integrity_queries, model_queries, stream_queries,
]

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
