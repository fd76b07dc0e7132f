"""All registered queries of the engine's families and their DuckDB SQL."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reachable(spark: SparkSession) -> None:
    """Let Python workers find the package where the driver found it; elsewhere it is shipped with the job's files."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def query(name: str, sql: str | None = None):
    """Register ``f(spark, t)``, where ``t("table")`` reads a table of the given folder."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            reachable(spark)
            return f(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__ = run.__qualname__ = name
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


for family in ("usage", "joins", "scalars", "search", "graph", "ingest", "evaluation", "formats", "language", "state", "temporal"):
    importlib.import_module(f"sieveline.plans.{family}_queries")
