"""Every operator as a named query over the given tables, with its SQL twin."""

from glycoflow.catalog.registry import ENTRIES, oracle_sql, queries

__all__ = ["ENTRIES", "oracle_sql", "queries"]
