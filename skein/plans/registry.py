"""All registered queries of the core library and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(key: str, query: Query, oracle: str | None = None) -> None:
    if key in QUERIES:
        raise ValueError(f"{key} is registered twice")
    QUERIES[key] = query
    if oracle is not None:
        ORACLES[key] = oracle


from skein.plans import book_queries, chain_queries, entity_queries, flow_queries, ledger_queries, match_queries, text_queries  # noqa: E402, F401
