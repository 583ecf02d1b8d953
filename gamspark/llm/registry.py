"""Registry of this subpackage's queries and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.catalog import shipped

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = (
    "decontaminate", "fingerprints", "licences", "lm", "merkle", "mixing", "neardup", "packing", "pages", "repeats", "spellings", "tokens", "toxicity",
)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = shipped(fn)
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"{__package__}.{module}")


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of corpus_pipeline.py, one after the other."""
    return importlib.import_module("corpus_pipeline").run(spark, folder)
