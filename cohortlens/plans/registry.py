"""Registry of named queries: a Spark builder and (when SQL can express it)
the DuckDB oracle twin. Plan modules add entries with ``@query``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cohortlens.sources.cdm import Cdm


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    doc: str


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(cdm) -> DataFrame`` under ``name`` with its oracle SQL."""

    def deco(fn: Callable[[Cdm], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Cdm(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, build, oracle, (fn.__doc__ or "").strip())
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # Importing the plan modules fills the registry.
    from cohortlens.plans import (profile_plans, record_plans, dataset_plans,  # noqa: F401
                                  evaluation_plans, quality_plans, run_plans, io_plans, stream_plans)
    return QUERIES
