"""Every query over the driver tables, with the SQL that checks it."""

from __future__ import annotations

from shelfmark.plans import flow_queries, graph_queries, report_queries, stat_queries, text_queries

_MODULES = (text_queries, stat_queries, graph_queries, flow_queries, report_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.HERE.queries.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.HERE.oracles.items()}
