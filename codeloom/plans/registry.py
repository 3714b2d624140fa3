"""All registered queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans import assess_queries, graph_queries, source_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**graph_queries.Q, **text_queries.Q, **assess_queries.Q, **source_queries.Q}
ORACLES: dict[str, str] = {**graph_queries.O, **text_queries.O, **assess_queries.O, **source_queries.O}
