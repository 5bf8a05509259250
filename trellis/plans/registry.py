"""All registered queries of the engine and their oracles: one function each, its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "expand_budgeted"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


from . import cleaner_queries, compendium_queries, corpus_queries, edge_write_queries, entry_queries, graph_queries, labelled_case_queries, mention_queries, prescription_queries, publish_queries, record_queries, state_queries, value_queries  # noqa: E402, F401  they register themselves
