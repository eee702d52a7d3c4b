"""Named queries over the given tables, each with the SQL that checks it."""

from docpress.catalog import jobs, rows, scans, sinks, stats, windows  # noqa: F401  (register)
from docpress.catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
