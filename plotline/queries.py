"""Registry of the place-register queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plotline.plans import binary_queries, graph_queries, list_queries, map_queries, more_queries, osm_queries, pattern_queries, register_queries, shape_queries, stream_queries  # noqa: F401
from plotline.plans.registry import FOUND, ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
