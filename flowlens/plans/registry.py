"""All queries over the test tables, by name, with the SQL each one is compared with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    """Adds a query; a name can be given once."""
    if name in _QUERIES:
        raise ValueError(f"query {name} is registered twice")
    _QUERIES[name] = query
    if oracle is not None:
        _ORACLES[name] = oracle


#: Modules that register queries when they are imported.
MODULES = ("cleaning_queries", "aggregate_queries", "graph_queries", "model_queries", "report_queries", "lifecycle_queries", "payload_queries",
    "open_set_queries", "learning_queries", "run_queries")


def _load() -> None:
    for name in MODULES:
        import_module(f"flowlens.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics, hints and rules of every learner."""
    from .graph_queries import qualification_report

    return qualification_report(spark, sf_dir)
