"""A fitted additive model: a design, its coefficients and a link."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid
from ..operators import effects as fx
from ..operators.metrics import raw_logloss
from .design import Constant, Design, HiddenPair, PairBins
from .gram import arrow_score, score_column, spread_small

TASKS = ("regression", "classification")


def check_task(task: str) -> str:
    if task not in TASKS:
        raise ValueError(f"task must be one of {TASKS}, not {task!r}")
    return task


class Fitted:
    """Uniform face of every fitted model: raw score, prediction and, for classes, probability."""

    task: str
    threshold: float = 0.0

    def raw(self) -> Column:
        raise NotImplementedError

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds raw, prediction and (classification) probability."""
        out = df.withColumn("raw", self.raw())
        if self.task == "regression":
            return out.withColumn("prediction", F.col("raw"))
        out = out.withColumn("probability", sigmoid(F.col("raw")))
        return out.withColumn("prediction", F.when(F.col("raw") < self.threshold, 0.0).otherwise(1.0))

    def loss(self, df: DataFrame, target: str) -> float:
        """Mean squared error or log loss."""
        y, raw = F.col(f"`{target}`").cast("double"), self.raw()
        expr = (y - raw) * (y - raw) if self.task == "regression" else raw_logloss(y, raw)
        return float(spread_small(df).agg(F.avg(expr)).first()[0])


def term_column(terms: dict[str, tuple[Design, np.ndarray]], numeric: set[str]) -> Column:
    """Effect of each row of a value table (feat_name, x_num, x_cat): one batch function for all features."""

    def run(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(batch.num_rows)
        names = batch.column("feat_name")
        for name, (design, beta) in terms.items():
            rows = pc.equal(names, name).to_numpy(zero_copy_only=False).astype(bool)
            if rows.any():
                x = batch.column("x_num" if name in numeric else "x_cat").filter(pa.array(rows))
                out[rows] = design.score(pa.RecordBatch.from_arrays([x], names=[name]), beta)
        return out

    return arrow_score(run, ["feat_name", "x_num", "x_cat"])


@dataclass
class AdditiveModel(Fitted):
    design: Design
    beta: np.ndarray
    task: str = "regression"
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    threshold: float = 0.0
    info: dict = field(default_factory=dict)

    def raw(self) -> Column:
        return score_column(self.design, self.beta)

    @property
    def intercept(self) -> float:
        return float(sum(self.beta[sl].sum() for b, sl in zip(self.design.blocks, self.design.slices) if isinstance(b, Constant)))

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """(feat_name, coef) of single-column blocks and level columns, ordered by value."""
        names, values = [], []
        for block, sl in zip(self.design.blocks, self.design.slices):
            if isinstance(block, Constant):
                continue
            labels = getattr(block, "levels", None)
            for i, v in enumerate(self.beta[sl]):
                names.append(block.name if block.size == 1 and not labels else f"{block.name}_{labels[i] if labels else i}")
                values.append(float(v))
        return fx.coefficient_table(spark, names, values)

    def feature_terms(self, name: str) -> tuple[Design, np.ndarray]:
        blocks, parts = [], []
        for block, sl in zip(self.design.blocks, self.design.slices):
            if block.columns == (name,):
                blocks.append(block)
                parts.append(self.beta[sl])
        return Design(tuple(blocks)), np.concatenate(parts) if parts else np.zeros(0)

    def effects(self, df: DataFrame) -> DataFrame:
        """Raw effect table at the values seen in ``df``; pairs are not part of it (see ``surface``)."""
        return self.effects_at(fx.feature_value_counts(df, self.numeric, self.categorical))

    def effects_at(self, values: DataFrame) -> DataFrame:
        """The same at given value counts."""
        terms = {n: self.feature_terms(n) for n in (*self.numeric, *self.categorical)}
        y = term_column({n: t for n, t in terms.items() if t[0].blocks}, set(self.numeric))
        table = values.withColumn("y", y).withColumn("y_std", F.lit(None).cast("double"))
        return fx.offset_row(values.sparkSession, self.intercept).select(fx.COLUMNS).unionByName(table.select(fx.COLUMNS))

    def surface(self, pairs: DataFrame, first: str, second: str, points: int = 50) -> DataFrame:
        """Pair effect over a grid; ``pairs`` holds the ranges of both features in one row."""
        blocks, parts = [], []
        for block, sl in zip(self.design.blocks, self.design.slices):
            if isinstance(block, (PairBins, HiddenPair)) and block.columns == (first, second):
                blocks.append(block)
                parts.append(self.beta[sl])
        if not blocks:
            raise ValueError(f"the model has no pair {first} x {second}")
        grid = fx.interaction_grid(pairs, lambda a, b: F.lit(0.0), points)
        frame = grid.withColumn(first, F.col("xa")).withColumn(second, F.col("xb"))
        return frame.withColumn("y", score_column(Design(tuple(blocks)), np.concatenate(parts))).select(
            "feat_a", "feat_b", "xa", "xb", "y"
        )
