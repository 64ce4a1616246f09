"""All queries of the library by name, and the SQL that says the same for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import commands, indexed, pieces, ranking, scoped, stored, usage, workspace

_MODULES = (ranking, indexed, scoped, stored, usage, workspace, commands, pieces)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}
