"""Fold reports to model x dataset tables: one lazy plan, no intermediate files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import lookup_join
from ..functions.order import value_prefix
from ..functions.scalars import c
from ..session import cut_lineage

# Metrics where more is better, and the report row behind each averaging mode.
SCORE_METRICS = ("precision", "recall", "f1-score", "ROC_AUC")
ERROR_METRICS = ("RMSE", "MSE", "MAE", "EVS", "R2", "Max Error")
AVERAGE_ROWS = {"micro": "accuracy", "accuracy": "accuracy", "macro": "macro avg", "weighted": "weighted avg"}


def fold_mean_std(reports: DataFrame, by: Sequence[str] = ("dataset", "model", "metric")) -> DataFrame:
    """Mean and sample standard deviation over folds. Add 'row' to ``by`` for classification reports."""
    return reports.groupBy(*[c(b) for b in by]).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def timing_mean_std(timings: DataFrame) -> DataFrame:
    return fold_mean_std(timings, ("model", "metric"))


def format_mean_std(mean: Column, std: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f±%.{digits}f", mean, std)


def metric_rows(means: DataFrame, metric: str, average: str = "micro") -> DataFrame:
    """The report line a table shows for a metric. ROC_AUC is stored on the accuracy line; a report
    without an accuracy line offers 'micro avg' instead."""
    if metric in ERROR_METRICS:
        return means.where(F.col("metric") == metric)
    row = "accuracy" if metric == "ROC_AUC" else AVERAGE_ROWS[average]
    hits = means.where((F.col("metric") == metric) & F.col("row").isin(row, *(["micro avg"] if row == "accuracy" else [])))
    first = F.min(F.struct((F.col("row") != row).alias("k"), "mean")).alias("b")
    return hits.groupBy("dataset", "model").agg(first).select("dataset", "model", F.col("b.mean").alias("mean"))


def model_dataset_table(rows: DataFrame, models: Sequence[str], value: str = "mean") -> DataFrame:
    """One row per dataset, one column per model. The column list is given, so no scan looks for it."""
    return rows.groupBy("dataset").pivot("model", list(models)).agg(F.max(value))


def timing_table(timings: DataFrame, key: str, models: Sequence[str]) -> DataFrame:
    means = timings.where(F.col("metric") == key).groupBy("dataset", "model").agg(F.avg("value").alias("mean"))
    return model_dataset_table(means, models)


def reorder(table: DataFrame, rows: Sequence[str], cols: Sequence[str], index: str = "dataset") -> DataFrame:
    """Given row and column order; a dataset without results stays as an empty line."""
    order = table.sparkSession.createDataFrame(list(enumerate(rows)), f"pos int, `{index}` string")
    return order.join(table, index, "left").select("pos", index, *[c(n) for n in cols]).orderBy("pos")


def rank_models(rows: DataFrame, metric: str | None = None, value: str = "mean", higher_is_better: bool | None = None) -> DataFrame:
    """Adds the average rank per dataset: 1 is best, ties share the mean of their ranks.

    The rank of a value is the number of smaller values plus half of its own copies, so it comes from
    bucketed prefix counts and no dataset is sorted in one task. The table is written out first: it is
    read twice, and both times the same means must come back.
    """
    better = metric in SCORE_METRICS if higher_is_better is None else higher_is_better
    frozen = cut_lineage(rows.withColumn("__key", -c(value).cast("double") if better else c(value).cast("double")))
    counts = value_prefix(frozen, "__key", {"__n": F.count(F.lit(1))}, by=["dataset"])
    ranks = counts.select("dataset", "__key", (F.col("__n_below") + (F.col("__n") + 1) / 2).alias("rank"))
    return lookup_join(frozen, ranks, ["dataset", "__key"]).drop("__key")


def mean_rank(ranks: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(model, mean_rank), optionally weighted per dataset (dataset, weight)."""
    if weights is None:
        return ranks.groupBy("model").agg(F.avg("rank").alias("mean_rank"))
    joined = ranks.join(weights, "dataset")
    return joined.groupBy("model").agg((F.sum(F.col("rank") * F.col("weight")) / F.sum("weight")).alias("mean_rank"))


def tradeoff_points(mean_ranks: DataFrame, interpretability: DataFrame, n_models: int = 14) -> DataFrame:
    """(model, interpretability, performance): performance is the number of models minus the mean rank."""
    return mean_ranks.join(interpretability, "model").select(
        "model", "interpretability", (F.lit(float(n_models)) - F.col("mean_rank")).alias("performance")
    )


def grouped_parameters(cells: DataFrame, models: Sequence[str], sep: str = "\n\n") -> DataFrame:
    """One row per dataset, one column per model with the fold configurations joined in fold order.

    ``cells`` has one params text per (dataset, model, fold), so a group is as long as the fold count.
    """
    joined = cells.groupBy("dataset", "model").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fold", "params"))), lambda s: s["params"]), sep).alias("text")
    )
    return joined.groupBy("dataset").pivot("model", list(models)).agg(F.max("text"))


# Table headings of the models and the task of each dataset block.
MODEL_GROUPS = {
    "PYGAM": ("Interpretable Models", "GAMs"),
    "MGCV_SPLINE": ("Interpretable Models", "GAMs"),
    "EBM": ("Interpretable Models", "GAMs"),
    "NAM": ("Interpretable Models", "GAMs"),
    "GAMINET": ("Interpretable Models", "GAMs"),
    "EXNN": ("Interpretable Models", "GAMs"),
    "LR": ("Interpretable Models", "Traditional"),
    "ELASTICNET": ("Interpretable Models", "Traditional"),
    "DT": ("Interpretable Models", "Traditional"),
    "RF": ("Black-box Models", ""),
    "XGB": ("Black-box Models", ""),
    "CATBOOST": ("Black-box Models", ""),
    "MLP": ("Black-box Models", ""),
    "TABNET": ("Black-box Models", ""),
}
TASK_LABELS = {"regression": "REG", "classification": "CLS"}


def table_labels(rows: DataFrame, groups: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Adds (task_label, model_kind, model_family) as label columns. ``groups`` adds headings for further
    models; a model without heading keeps empty labels."""
    labels = rows.sparkSession.createDataFrame(
        [(m, kind, family) for m, (kind, family) in {**MODEL_GROUPS, **(groups or {})}.items()],
        "model string, model_kind string, model_family string",
    )
    task = F.create_map(*[F.lit(x) for kv in TASK_LABELS.items() for x in kv])
    return rows.join(F.broadcast(labels), "model", "left").withColumn("task_label", F.try_element_at(task, F.col("task")))
