"""Query catalog, its parameters and the equivalent SQL used as oracle."""

from basketlens.plans.catalog import QUERIES, as_doubles, queries
from basketlens.plans.oracle import ORACLE, oracle_sql

__all__ = ["ORACLE", "QUERIES", "as_doubles", "oracle_sql", "queries"]
