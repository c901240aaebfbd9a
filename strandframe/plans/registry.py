"""All queries over the driver's tables, with the SQL they are held against."""

from __future__ import annotations

from strandframe.plans import diagnostics_queries, mismatch_queries, other_queries, source_queries

_PARTS = (mismatch_queries, diagnostics_queries, other_queries, source_queries)


def queries() -> dict:
    return {name: q for part in _PARTS for name, (q, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
