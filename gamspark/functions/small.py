"""Frames for several passes."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame

DEAL_BYTES = 1 << 30
PART_BYTES = 16 << 20
PART_VALUES = 1 << 24
ROW_VALUES = 16


def spread_small(df: DataFrame) -> DataFrame:
    """Inputs below DEAL_BYTES (by the optimizer's estimate) arrive in few splits and are dealt out to all cores, because the
    pass is bound by arithmetic: a part per core, more above PART_BYTES a part. This moves rows only; no result depends on it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    return df.repartition(parts) if size <= DEAL_BYTES else df


def spread_rows(df: DataFrame, width: int) -> DataFrame:
    """Rows that a fit keeps as objects, ``width`` values each besides ROW_VALUES of overhead: dealt out so that the rows of a part
    stay below PART_VALUES whatever their number. They are counted, as bytes in a file say little about objects in memory."""
    parts = -(-df.count() * (ROW_VALUES + width) // PART_VALUES)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, parts))


@contextmanager
def reused(df: DataFrame):
    """A frame for several passes, whatever its size: kept in memory and on disk, so that every pass sees the same rows and the
    plan above the frame runs once. Lost blocks are computed again."""
    rows = spread_small(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()
