"""Registry of queries and the SQL that must give the same rows."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = ("cleaning", "splits", "encoding", "effects", "metrics", "selection", "reports", "fits")


def query(name: str, sql: str | None = None):
    """Registers a callable (spark, folder) -> DataFrame, with its SQL where SQL can express it."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = shipped(fn)
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def shipped(fn):
    """The query, run after the package was sent to the Python workers."""

    @functools.wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, folder)

    return run


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"{__package__}.{module}")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rnd(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder next to the checkpoints, for queries that write and read back."""
    return new_folder(spark, kind)
