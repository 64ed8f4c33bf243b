"""Registry of the library's queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cdc, clusters, comparisons, flow, lookups, pixels, reports, scalar, scores, trips, validation

FLAGSHIP = "fcxm_population_readout"
_MODULES = (flow, cdc, validation, scalar, pixels, lookups, reports, clusters, scores, trips, comparisons)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
