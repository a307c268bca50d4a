"""All queries and SQL of the core, by name."""

from __future__ import annotations

from phonoduct.plans import label_queries, problems, series_queries, signal_queries, wave_queries

MODULES = [problems, series_queries, wave_queries, label_queries, signal_queries]

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
