"""All named queries of the package itself, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logloom.plans import curation, datasets, detail, evaluation, inventory, nested, preprocess, training

FLAGSHIP = "agg_05_task_rewards"
_MODULES = [evaluation, curation, datasets, preprocess, inventory, nested, training, detail]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.oracle_sql().items()}
