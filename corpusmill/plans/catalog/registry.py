"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans.catalog import corpus, evaluation, logs, requests, retrieval, roundtrips

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (corpus, retrieval, requests, evaluation, logs, roundtrips)


def queries() -> dict[str, Query]:
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
