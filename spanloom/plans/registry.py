"""Names of the library's own queries and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.plans import core, texts, upkeep

FLAGSHIP = "analyze_impact"
MODULES = (core, texts, upkeep)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for module in MODULES:
    if twice := QUERIES.keys() & module.QUERIES.keys():
        raise ValueError(f"two queries have the names {sorted(twice)}")
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
