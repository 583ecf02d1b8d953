"""Writers for reports and best configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Report rows partitioned by dataset and model, so that readers prune to what they aggregate."""
    writer = df.write.mode(mode).partitionBy("dataset", "model")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def append_best_config(df: DataFrame, path: str) -> None:
    """Appends (fold, dataset, model, params, written_at) rows; nothing is updated in place."""
    df.write.mode("append").parquet(path)


def latest_config(log: DataFrame, order_col: str = "written_at") -> DataFrame:
    """The last appended configuration per (fold, dataset, model): aggregation, not a sort of each group."""
    payload = F.struct(*[F.col(n) for n in [order_col, *[x for x in log.columns if x not in ("fold", "dataset", "model", order_col)]]])
    return log.groupBy("fold", "dataset", "model").agg(F.max(payload).alias("__p")).select(
        "fold", "dataset", "model", "__p.*"
    )


def config_matrix(latest: DataFrame, models: list[str]) -> DataFrame:
    """One row per (fold, dataset), one column per model."""
    return latest.groupBy("fold", "dataset").pivot("model", models).agg(F.max("params"))
