"""The corpus queries and their DuckDB statements."""

from __future__ import annotations

from foliogrid.llm import conversations, decontaminate, exact_dedup, hard_negatives, licenses, line_dedup, near_dedup, packing, quality, repeats, secrets, sharding, urls

MODULES = (decontaminate, secrets, licenses, repeats, line_dedup, exact_dedup, packing, near_dedup, quality, urls, sharding, conversations, hard_negatives)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
