"""Boosted random-feature networks.

A learner is a ridge regression on random features of each column (and of chosen pairs); the random
weights are fixed by a seed before any data is read. For squared loss many learners share one
Gram and the boosting runs on it; for log loss every learner takes one reweighted pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import c, fast_uniform
from ..operators import effects as fx
from ..operators.encode import ColumnTransformer, column_transformer
from ..operators.metrics import best_threshold
from ..session import cut_lineage
from .additive import Fitted, check_task, term_column
from .design import Constant, Design, Hidden, HiddenPair, Linear
from .gram import arrow_score, gram, reused, spread_small
from .interactions import hidden_weights, pairs_by_lasso, select_features
from .linear import centred, coordinate_descent, fit_logistic, fit_ridge, ridge_solve

RAW_LIMIT = 100.0
BATCH_COLUMNS = 400  # the pass costs rows x columns^2, so fewer learners per pass are cheaper in total


def learner_design(features: Sequence[str], pairs: Sequence[tuple[str, str]], n_hid: int, scale: float, scale_inter: float,
                   act: str, seed: int) -> Design:
    rng = np.random.default_rng(seed)
    blocks = [Hidden(n, hidden_weights(rng, scale, n_hid), act) for n in features]
    blocks += [
        HiddenPair(a, b, hidden_weights(rng, scale_inter, n_hid), hidden_weights(rng, scale_inter, n_hid), act) for a, b in pairs
    ]
    return Design(tuple(blocks))


@dataclass
class HiddenModel(Fitted):
    """Linear start plus scaled learners, clipped after every step as in training."""

    features: tuple[str, ...]
    pairs: tuple[tuple[str, str], ...]
    start: Design
    start_beta: np.ndarray
    learners: list[tuple[Design, np.ndarray]]
    rate: float
    task: str
    clip: bool = False
    threshold: float = 0.0
    info: dict = field(default_factory=dict)

    def batch_raw(self):
        start, beta, learners, rate, clip = self.start, self.start_beta, self.learners, self.rate, self.clip

        def run(batch: pa.RecordBatch) -> np.ndarray:
            score = start.build(batch) @ beta
            for design, coef in learners:
                score = score + rate * (design.build(batch) @ coef)
                if clip:
                    score = np.clip(score, -RAW_LIMIT, RAW_LIMIT)
            return score

        return run

    def raw(self) -> Column:
        return arrow_score(self.batch_raw(), list(self.features))

    def shape_functions(self, df: DataFrame) -> DataFrame:
        """Raw effect table of the main effects at the values seen in ``df``."""
        values = fx.feature_value_counts(df, list(self.features))
        terms = {}
        for name in self.features:
            parts = self._terms((name,))
            joint = Design(tuple(b for d, _ in parts for b in d.blocks))
            terms[name] = joint, np.concatenate([beta for _, beta in parts])
        table = values.withColumn("y", term_column(terms, set(self.features))).withColumn("y_std", F.lit(None).cast("double"))
        start = fx.offset_row(df.sparkSession, float(self.start_beta[0]))
        return start.select(fx.COLUMNS).unionByName(table.select(fx.COLUMNS))

    def _terms(self, columns: tuple[str, ...]):
        parts = []
        for design, coef, rate in [(self.start, self.start_beta, 1.0), *[(d, b, self.rate) for d, b in self.learners]]:
            for block, sl in zip(design.blocks, design.slices):
                if block.columns == columns:
                    parts.append((Design((block,)), rate * coef[sl]))
        return parts

    def surface(self, ranges: DataFrame, pair: tuple[str, str], points: int = 50) -> DataFrame:
        parts = self._terms(pair)
        grid = fx.interaction_grid(ranges, lambda a, b: F.lit(0.0), points)
        frame = grid.withColumn(pair[0], F.col("xa")).withColumn(pair[1], F.col("xb"))
        score = arrow_score(lambda batch: sum((d.build(batch) @ b for d, b in parts), np.zeros(batch.num_rows)), list(pair))
        return frame.withColumn("y", score).select("feat_a", "feat_b", "xa", "xb", "y")


class _Stopping:
    """Counts rounds without improvement; more than ``patience`` of them end the training."""

    def __init__(self, first_loss: float, patience: int):
        self.best, self.patience, self.best_round, self.since, self.path = first_loss, patience, 0, 0, [first_loss]

    def add(self, loss: float) -> bool:
        self.path.append(loss)
        self.since += 1
        if loss < self.best:
            self.best, self.best_round, self.since = loss, len(self.path) - 1, 0
        return 0 < self.patience < self.since


def boosting_working(y: np.ndarray, score: np.ndarray):
    """Half-weights and response of the log-loss step for labels -1/1, as a weighted least-squares problem."""
    half = 0.5 * y * score
    w = (0.5 / np.cosh(half)) ** 2
    z = y * (1 + np.exp(-2 * half))
    return w, z, np.logaddexp(0, -y * score)


def boost_on_gram(train, val, sizes: Sequence[int], rate: float, alpha: float, stop: _Stopping):
    """Ridge learners one after the other on shared cross-products; returns their coefficients.

    The residual of learner k is the start residual minus what the learners before it predicted, so its
    right-hand side is b_k - G_k v with v the scaled coefficients so far.
    """
    v, out, at = np.zeros(len(train.b)), [], 0
    for size in sizes:
        sl = slice(at, at + size)
        rhs = train.b[sl] - train.g[sl] @ v
        coef = ridge_solve(rate * rate * train.g[sl, sl], rate * rhs, alpha)
        v[sl] = rate * coef
        out.append(coef)
        at += size
        if stop.add(val.squared_error(v) / max(val.weight, 1.0)):
            return out, True
    return out, False


def fit_hidden_boosting(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    val: Column,
    task: str = "regression",
    n_hid: int = 10,
    n_estimators: int = 200,
    boost_rate: float = 0.1,
    init_reg: float = 1.0,
    elm_scale: float = 1.0,
    elm_scale_inter: float = 0.5,
    elm_alpha: float = 1.0,
    act: str = "elu",
    early_stopping: int = 50,
    pairs: Sequence[tuple[str, str]] = (),
    optimize_threshold: bool = False,
    cut_every: int = 20,
) -> HiddenModel:
    """``features`` are encoded and scaled columns, ``val`` marks the validation rows.

    Regression: Lasso start, then as many learners per pass as BATCH_COLUMNS basis columns allow.
    Classification (0/1 labels): L1 logistic start, one pass per learner; every ``cut_every`` learners
    the score is written out, so that a pass never replays more than that many learners.
    """
    features, pairs = list(features), [tuple(p) for p in pairs]
    group = val.cast("int")
    make = lambda seed: learner_design(features, pairs, n_hid, elm_scale, elm_scale_inter, act, seed)
    if check_task(task) == "regression":
        narrow = df.select(*[c(n) for n in dict.fromkeys([*features, target])], group.alias("__val"))
        with reused(narrow) as rows:
            start = Design((Constant(), *[Linear(n) for n in features]))
            stats = gram(rows, start, target, group="__val", spread=False)
            whole = stats[0] + stats[1] if 1 in stats else stats[0]
            g, b, means, y_mean = centred(whole)
            slopes = coordinate_descent(g, b, whole.g[0, 0], init_reg, 1.0)
            beta = np.r_[y_mean - slopes @ means, slopes]
            held = stats.get(1, stats[0])
            stop = _Stopping(held.squared_error(beta) / held.weight, early_stopping)
            model = HiddenModel(tuple(features), tuple(pairs), start, beta, [], boost_rate, task)
            per_pass = max(1, BATCH_COLUMNS // make(0).size)
            done, ended = 0, False
            while done < n_estimators and not ended:
                designs = [make(done + i) for i in range(min(per_pass, n_estimators - done))]
                joint = Design(tuple(bl for d in designs for bl in d.blocks))
                stats = gram(rows, joint, target, group="__val", offset=model.batch_raw(), offset_columns=features, spread=False)
                coefs, ended = boost_on_gram(stats[0], stats.get(1, stats[0]), [d.size for d in designs], boost_rate, elm_alpha, stop)
                model.learners = [*model.learners, *zip(designs, coefs)]
                done += len(designs)
    else:
        linear = fit_logistic(df, target, features, C=1.0 / init_reg, penalty="l1", scale=False)
        model = HiddenModel(tuple(features), tuple(pairs), linear.design, linear.beta, [], boost_rate, task, clip=True)
        rows = df.select(
            *[c(n).cast("double").alias(n) for n in features], (c(target).cast("double") * 2 - 1).alias("__label"),
            group.alias("__val"), model.raw().alias("__score"),
        )
        rows, fresh, stop = cut_lineage(spread_small(rows)), [], None
        for step in range(n_estimators + 1):
            design = make(step)

            def offset(batch, fresh=tuple(fresh)):
                score = batch.column("__score").to_numpy(zero_copy_only=False)
                for d, coef in fresh:
                    score = np.clip(score + boost_rate * (d.build(batch) @ coef), -RAW_LIMIT, RAW_LIMIT)
                return score

            stats = gram(rows, design, "__label", group="__val", working=boosting_working, offset=offset,
                         offset_columns=[*features, "__score"], spread=False)
            held = stats.get(1, stats[0])
            loss = held.loss / max(held.rows, 1.0)
            # the pass reports the loss before its learner, so stopping is checked one pass later
            if stop is None:
                stop = _Stopping(loss, early_stopping)
            elif stop.add(loss):
                break
            if step == n_estimators:
                break
            half = 0.5 * boost_rate
            coef = ridge_solve(half * boost_rate * stats[0].g, half * stats[0].b, elm_alpha)
            model.learners.append((design, coef))
            fresh.append((design, coef))
            if len(fresh) == cut_every:
                score = arrow_score(lambda b, f=tuple(fresh): offset(b, f), [*features, "__score"])
                rows, fresh = cut_lineage(rows.withColumn("__score", score)), []
    if early_stopping > 0:
        model.learners = model.learners[: stop.best_round]
    model.info = {"val_losses": stop.path, "best_round": stop.best_round}
    if task == "classification" and optimize_threshold:
        scored = df.where(~val).select(c(target).cast("int").alias("y"), model.raw().alias("s"))
        # the curve predicts class 1 above its threshold, the model from its threshold on
        model.threshold = float(np.nextafter(best_threshold(cut_lineage(scored), "y", "s").first()["threshold"], np.inf))
    return model


@dataclass
class EncodedHidden(Fitted):
    """Boosted random features behind the encoding they were trained on."""

    inner: HiddenModel
    encoder: ColumnTransformer
    task: str
    threshold: float = 0.0
    info: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.inner.predict(self.encoder.transform(df)).drop(*self.encoder.names)

    def loss(self, df: DataFrame, target: str) -> float:
        return self.inner.loss(self.encoder.transform(df), target)


def fit_hidden_gam(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (), task: str = "regression",
                   interactions: int = 0, feat_select: int | None = None, fixed: Sequence[str] = (), val_share: float = 0.15,
                   n_hid: int = 10, seed: int = 0, **options) -> EncodedHidden:
    """The whole fit: encode, choose features, search pairs, boost, and the threshold of classes.

    ``feat_select`` keeps so many encoded features by the Lasso on their random features, next to those that
    ``fixed`` names; ``interactions`` asks for so many pairs, searched on what the linear start leaves over.
    The validation rows are a hash of all feature columns.
    """
    encoder = column_transformer(df, numeric, categorical)
    rows = encoder.transform(df)
    features = list(encoder.names)
    keep = [n for n in features if n in fixed or any(n.endswith(f"__{f}") for f in fixed)]
    if feat_select is not None and feat_select < len(features):
        chosen = select_features(rows, target, [n for n in features if n not in keep], feat_select, n_hid=n_hid, seed=seed)
        features = [n for n in features if n in keep or n in chosen]
    pairs: list[tuple[str, str]] = []
    if interactions and len(features) > 1:
        start = fit_ridge(rows, target, features, alpha=1.0)
        left = rows.withColumn("__left", c(target).cast("double") - start.raw())
        pairs = pairs_by_lasso(left, "__left", features, min(interactions, len(features) * (len(features) - 1) // 2), [], seed=seed)
    val = fast_uniform(f"val{seed}", *[c(n) for n in (*numeric, *categorical)]) < val_share
    inner = fit_hidden_boosting(rows, target, features, val, task, n_hid=n_hid, pairs=pairs,
                                optimize_threshold=task == "classification", **options)
    return EncodedHidden(inner, encoder, task, inner.threshold, {**inner.info, "features": features, "pairs": pairs})
