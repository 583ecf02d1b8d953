"""Trees, forests, boosted trees and the perceptron: Spark's own estimators behind one interface.

Boosted trees of depth 1 are additive; their splits are read back as an effect table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml import classification as mlc
from pyspark.ml import regression as mlr
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import c, logit
from ..functions.small import spread_rows
from ..operators import effects as fx
from ..operators import encode
from .additive import Fitted, check_task
from .gram import spread_small
from .histograms import fit_best_first_tree

MAX_DEPTH = 30
STUMP = re.compile(
    r"If \(feature (\d+) <= (\S+)\)\s+Predict: (\S+)\s+Else \(feature \d+ > \S+\)\s+Predict: (\S+)"
)
CONSTANT = re.compile(r"Predict: (\S+)")


@dataclass
class TreeModel(Fitted):
    """A Spark estimator with the encoding it was trained on."""

    model: Model
    encoder: encode.ColumnTransformer
    task: str
    threshold: float = 0.0
    info: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        rows = self.encoder.transform(df, vector="__x")
        added = [n for n in self.encoder.names]
        drop = ["rawPrediction", "probability", "prediction"]
        scored = self.model.transform(rows.drop(*[d for d in drop if d in rows.columns]))
        if self.task == "regression":
            return scored.withColumn("raw", F.col("prediction")).drop(*added, "__x")
        positive = vector_to_array("probability")[1]
        scored = scored.withColumn("probability", positive).withColumn("raw", logit(F.col("probability"), 1e-15))
        return scored.drop(*added, "__x", "rawPrediction")

    def loss(self, df: DataFrame, target: str) -> float:
        y, out = c(target).cast("double"), self.predict(spread_small(df))
        if self.task == "regression":
            return float(out.agg(F.avg((y - F.col("raw")) * (y - F.col("raw")))).first()[0])
        p = F.least(F.greatest(F.col("probability"), F.lit(1e-15)), F.lit(1 - 1e-15))
        return float(out.agg(F.avg(F.when(y == 1, -F.log(p)).otherwise(-F.log(1 - p)))).first()[0])


def _fit(estimator, df, target, numeric, categorical, task, class_weight=None, extra=(), trees=1, **info) -> TreeModel:
    """``trees``: how many are grown at once, as a row keeps a count for each."""
    # trees do not care about scale, so numbers keep their units and split values stay readable
    hot = encode.one_hot(df, categorical)
    encoder = encode.ColumnTransformer(hot, encode.Scaler({n: (0.0, 1.0) for n in numeric}))
    frame = encode.balanced_weights(df, target, "__w") if class_weight == "balanced" else df
    rows = encoder.transform(frame, vector="__x").withColumn("__y", c(target).cast("double"))
    if class_weight == "balanced":
        estimator = estimator.setWeightCol("__w")
    keep = ["__x", "__y", *(["__w"] if class_weight == "balanced" else []), *extra]
    dealt = spread_rows(rows.select(*keep), len(encoder.names) + trees)
    model = estimator.setFeaturesCol("__x").setLabelCol("__y").fit(dealt)
    return TreeModel(model, encoder, task, info=info)


def _depth(max_depth: int | None) -> int:
    if max_depth is None:
        return MAX_DEPTH
    if max_depth > MAX_DEPTH:
        raise ValueError(f"trees are at most {MAX_DEPTH} deep here")
    return max_depth


def fit_tree(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (),
             task: str = "regression", max_depth: int | None = 5, min_rows: int = 1, class_weight: str | None = None,
             max_leaf_nodes: int | None = None, splitter: str = "best", max_bins: int = 32, seed: int = 0) -> Fitted:
    """A tree of Spark's, or, with a limit on its leaves or with random cuts, a best-first one on histograms."""
    if max_leaf_nodes is not None or splitter != "best":
        return fit_best_first_tree(df, target, numeric, categorical, task, max_depth, max_leaf_nodes, min_rows, class_weight, splitter, max_bins, seed)
    kind = mlr.DecisionTreeRegressor if check_task(task) == "regression" else mlc.DecisionTreeClassifier
    est = kind(maxDepth=_depth(max_depth), minInstancesPerNode=min_rows, maxBins=max_bins, seed=seed)
    return _fit(est, df, target, numeric, categorical, task, class_weight)


def fit_forest(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (),
               task: str = "regression", n_estimators: int = 100, max_depth: int | None = 10,
               class_weight: str | None = None, max_bins: int = 32, seed: int = 0) -> TreeModel:
    """Regression forests look at all features per split, classification forests at a square root of them."""
    regression = check_task(task) == "regression"
    kind = mlr.RandomForestRegressor if regression else mlc.RandomForestClassifier
    est = kind(numTrees=n_estimators, maxDepth=_depth(max_depth), maxBins=max_bins, seed=seed,
               featureSubsetStrategy="all" if regression else "sqrt")
    return _fit(est, df, target, numeric, categorical, task, class_weight, trees=n_estimators)


def fit_boosted_trees(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (),
                      task: str = "regression", n_estimators: int = 100, max_depth: int = 3,
                      learning_rate: float = 0.1, subsample: float = 1.0, validation: str | None = None,
                      tol: float = 0.01, max_bins: int = 32, seed: int = 0) -> TreeModel:
    """First-order gradient boosting; ``validation`` names a boolean column for early stopping."""
    kind = mlr.GBTRegressor if check_task(task) == "regression" else mlc.GBTClassifier
    est = kind(maxIter=n_estimators, maxDepth=max_depth, stepSize=learning_rate, subsamplingRate=subsample,
               maxBins=max_bins, seed=seed)
    if validation:
        est = est.setValidationIndicatorCol(validation).setValidationTol(tol)
    return _fit(est, df, target, numeric, categorical, task, extra=[validation] if validation else ())


def fit_perceptron(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (),
                   hidden: Sequence[int] = (16,), max_iter: int = 100, step: float = 0.03, seed: int = 0) -> TreeModel:
    """Two-class multilayer perceptron on standardised inputs."""
    encoder = encode.column_transformer(df, numeric, categorical)
    rows = encoder.transform(df, vector="__x").select("__x", c(target).cast("double").alias("__y"))
    est = mlc.MultilayerPerceptronClassifier(
        layers=[len(encoder.names), *hidden, 2], maxIter=max_iter, stepSize=step, seed=seed, featuresCol="__x", labelCol="__y"
    )
    return TreeModel(est.fit(rows), encoder, "classification")


def stump_splits(model: TreeModel) -> list[tuple[str, float, float, float]]:
    """(column, threshold, left, right) of every depth-1 tree, weighted; a constant tree has no column."""
    out = []
    for tree, weight in zip(model.model.trees, model.model.treeWeights):
        text = tree.toDebugString
        hit = STUMP.search(text)
        if hit:
            out.append((model.encoder.names[int(hit[1])], float(hit[2]), weight * float(hit[3]), weight * float(hit[4])))
        elif tree.depth == 0:
            value = weight * float(CONSTANT.search(text)[1])
            out.append(("", 0.0, value, value))
        else:
            raise ValueError("only trees of depth 1 are additive")
    return out


def stump_effects(model: TreeModel, df: DataFrame) -> DataFrame:
    """Effect table of a depth-1 ensemble over the encoded columns, at the values seen in ``df``.

    The classifier's margin counts twice: its probability is 1/(1+exp(-2 F)). Splits at the same value are
    added up first, so the plan grows with the splits that differ (features x bins), not with the trees.
    """
    factor = 2.0 if model.task == "classification" else 1.0
    splits = stump_splits(model)
    names = list(model.encoder.names)
    values = fx.feature_value_counts(model.encoder.transform(df), names)
    steps: dict[str, dict[float, list[float]]] = {}
    for column, threshold, left, right in splits:
        if column:
            both = steps.setdefault(column, {}).setdefault(threshold, [0.0, 0.0])
            both[0] += factor * left
            both[1] += factor * right
    y = F.lit(0.0)
    for column, at in sorted(steps.items()):
        edges, levels = sorted(at), [sum(left for left, _ in at.values())]
        for edge in edges:
            levels.append(levels[-1] + at[edge][1] - at[edge][0])
        own = F.lit(levels[-1])
        for edge, level in zip(reversed(edges), reversed(levels[:-1])):
            own = F.when(F.col("x_num") <= edge, level).otherwise(own)
        y = F.when(F.col("feat_name") == column, own).otherwise(y)
    constant = factor * sum(left for column, _, left, _ in splits if not column)
    table = values.withColumn("y", y).withColumn("y_std", F.lit(None).cast("double"))
    return fx.offset_row(df.sparkSession, constant).select(fx.COLUMNS).unionByName(table.select(fx.COLUMNS))


def used_features(model: TreeModel) -> list[str]:
    """Encoded columns a single tree splits on, in pre-order, each once."""
    order = re.findall(r"If \(feature (\d+)", model.model.toDebugString)
    return list(dict.fromkeys(model.encoder.names[int(i)] for i in order))
