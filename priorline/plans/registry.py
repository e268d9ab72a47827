"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from priorline.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, using: str = ""):
    """Register ``fn(spark, sf_dir)``; ``using`` names the stand-in tables its SQL reads."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @wraps(fn)
        def run(spark, sf_dir):
            tune(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            from priorline.plans.standins import with_tables

            ORACLES[name] = with_tables(sql, using.split())
        return fn

    return register
