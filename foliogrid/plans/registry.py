"""Collects the queries and their DuckDB statements from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliogrid.plans import q_core, q_files, q_ledger, q_masks, q_streams

#: Modules with ``QUERIES`` (name -> callable) and ``ORACLES`` (name -> SQL).
MODULES: tuple = (q_core, q_masks, q_ledger, q_streams, q_files)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
