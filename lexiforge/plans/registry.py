"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus SQL oracles.

Each query reads the given Parquet tables (or tables Spark derives from them)
in full. Array results are rendered as comma-joined strings and doubles are
rounded to 6 decimals in the *registered* view only, so an independent SQL
engine can be compared value by value; the library operators themselves
return native arrays and full-precision doubles.
"""

from __future__ import annotations

import os
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def load_all() -> None:
    """Import every query module (each registers itself on import)."""
    import importlib
    for mod in MODULES:
        importlib.import_module(f"lexiforge.plans.{mod}")


MODULES = ["corpus_queries", "token_queries", "example_queries", "model_queries", "window_queries", "routing_queries", "vector_queries", "experiment_queries", "generation_queries", "io_queries", "stream_queries"]
