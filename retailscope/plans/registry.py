"""Name -> Spark job and name -> check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retailscope.sources.standin import Star

Job = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Job] = {}
CHECKS: dict[str, str] = {}


def add(name: str, job: Callable[[Star], DataFrame], sql: str | None = None) -> None:
    """Register a job over the star schema of a folder, with the SQL that checks it if there is one."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, folder: job(Star(spark, folder))
    if sql is not None:
        CHECKS[name] = sql
