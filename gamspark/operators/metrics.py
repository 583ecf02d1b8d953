"""Exact metrics from aggregates: errors, confusion counts, ROC by distinct score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import value_prefix
from ..functions.scalars import c

LOSS_EPS = 2.0**-52


def regression_report(df: DataFrame, y: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., RMSE, MSE, MAE, EVS, R2, Max Error, n, n_unscored) in one aggregation.

    All figures are over the n rows with a target and a prediction; n_unscored rows have a target only.
    """
    truth = c(y).cast("double")
    e = truth - c(prediction).cast("double")
    known = F.when(e.isNotNull(), truth)
    base = df.groupBy(*[c(b) for b in by]).agg(
        F.avg(e * e).alias("MSE"),
        F.avg(F.abs(e)).alias("MAE"),
        F.max(F.abs(e)).alias("Max Error"),
        F.var_pop(e).alias("__ve"),
        F.var_pop(known).alias("__vy"),
        F.count(e).alias("n"),
        F.count_if(truth.isNotNull() & e.isNull()).alias("n_unscored"),
    )
    return base.select(
        *[c(b) for b in by],
        F.sqrt("MSE").alias("RMSE"),
        "MSE",
        "MAE",
        (1 - F.try_divide(F.col("__ve"), F.col("__vy"))).alias("EVS"),
        (1 - F.try_divide(F.col("MSE"), F.col("__vy"))).alias("R2"),
        "Max Error",
        "n",
        "n_unscored",
    )


def confusion_matrix(df: DataFrame, y: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*[c(b) for b in by], c(y).alias("actual"), c(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_report(df: DataFrame, y: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., row, precision, recall, f1_score, support): one row per class, then accuracy, macro avg
    and weighted avg. Everything after the confusion counts works on classes x classes rows."""
    keys = [c(b) for b in by]
    n = F.col("n")
    cells = confusion_matrix(df, y, prediction, by)
    sides = F.array(
        F.struct(F.col("actual").alias("cls"), F.when(F.col("actual") == F.col("predicted"), n).otherwise(0).alias("tp"),
                 n.alias("sup"), F.lit(0).cast("bigint").alias("pred")),
        F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("sup"),
                 n.alias("pred")),
    )
    per = cells.select(*keys, F.inline(sides)).groupBy(*keys, "cls").agg(
        F.sum("tp").alias("tp"), F.sum("sup").alias("sup"), F.sum("pred").alias("pred")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    per = per.withColumn("p", ratio(F.col("tp"), F.col("pred"))).withColumn("r", ratio(F.col("tp"), F.col("sup")))
    per = per.withColumn("f", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    total = per.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("sup")).alias("acc"),
        F.sum("sup").cast("double").alias("all"),
        *[F.avg(m).alias(f"m{m}") for m in "prf"],
        *[(F.sum(F.col(m) * F.col("sup")) / F.sum("sup")).alias(f"w{m}") for m in "prf"],
    )

    def line(name, *vals):
        names = ("precision", "recall", "f1_score", "support")
        return F.struct(F.lit(name).alias("row"), *[F.col(v).cast("double").alias(k) for k, v in zip(names, vals)])

    summary = total.select(
        *keys,
        F.inline(
            F.array(
                line("accuracy", "acc", "acc", "acc", "acc"),
                line("macro avg", "mp", "mr", "mf", "all"),
                line("weighted avg", "wp", "wr", "wf", "all"),
            )
        ),
    )
    classes = per.select(
        *keys, F.col("cls").cast("string").alias("row"), F.col("p").alias("precision"), F.col("r").alias("recall"),
        F.col("f").alias("f1_score"), F.col("sup").cast("double").alias("support"),
    )
    return classes.unionByName(summary)


def _score_prefix(df: DataFrame, y: str, score: str, by: Sequence[str]) -> DataFrame:
    positive = (c(y) == 1).cast("bigint")
    return value_prefix(df, score, {"p": F.sum(positive), "q": F.sum(1 - positive)}, by)


def roc_auc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., roc_auc): exact, ties count one half. Scores are aggregated first, so a score shared by
    a third of all rows is one row of the ranking."""
    ranked = _score_prefix(df, y, score, by)
    pairs = F.sum(F.col("p") * (F.col("q_below") + F.col("q") / 2))
    return ranked.groupBy(*[c(b) for b in by]).agg(
        F.try_divide(pairs, F.sum("p") * F.sum("q").cast("double")).alias("roc_auc")
    )


def roc_curve(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold, tpr, fpr) when class 1 is predicted above the threshold."""
    ranked = _score_prefix(df, y, score, by)
    total = ranked.groupBy(*[c(b) for b in by]).agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
    ranked = ranked.join(total, list(by)) if by else ranked.withColumns(
        {n: F.lit(v) for n, v in total.first().asDict().items()}
    )
    return ranked.select(
        *[c(b) for b in by],
        c(score).alias("threshold"),
        ((F.col("positives") - F.col("p_below") - F.col("p")) / F.col("positives")).alias("tpr"),
        ((F.col("negatives") - F.col("q_below") - F.col("q")) / F.col("negatives")).alias("fpr"),
    )


def best_threshold(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold, utility): the highest threshold with the best balanced accuracy."""
    curve = roc_curve(df, y, score, by).withColumn("utility", (F.col("tpr") + 1 - F.col("fpr")) / 2)
    best = F.max(F.struct("utility", "threshold")).alias("b")
    return curve.groupBy(*[c(b) for b in by]).agg(best).select(*[c(b) for b in by], "b.threshold", "b.utility")


def apply_threshold(raw: Column, threshold: float = 0.0) -> Column:
    return F.when(raw < threshold, 0).when(raw.isNotNull(), 1)


def _bce(y: Column, p: Column, eps: float) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.when(y == 1, -F.log(q)).otherwise(-F.log(1 - q))


def selection_losses(df: DataFrame, y: str, probability: str, by: Sequence[str] = (), eps: float = LOSS_EPS) -> DataFrame:
    """(by..., logloss, hard_logloss, mse). The hard loss is taken on labels at 0.5 and so orders by error
    rate only; it exists to reproduce selections made that way."""
    truth, p = c(y), c(probability)
    hard = (p >= 0.5).cast("double")
    return df.groupBy(*[c(b) for b in by]).agg(
        F.avg(_bce(truth, p, eps)).alias("logloss"),
        F.avg(_bce(truth, hard, eps)).alias("hard_logloss"),
        F.avg((truth - p) * (truth - p)).alias("mse"),
    )


def raw_logloss(y: Column, raw: Column) -> Column:
    """Cross-entropy of a 0/1 label and a raw score, stable for large scores."""
    return F.greatest(raw, F.lit(0.0)) - raw * y + F.log1p(F.exp(-F.abs(raw)))


