"""Penalised spline models: one Gram serves every penalty of the search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import c
from ..operators.clean import column_ranges, feature_values
from ..operators.encode import sorted_levels
from .additive import AdditiveModel, check_task
from .design import Constant, Design, Levels, Linear, Spline
from .gram import Gram, Member, batch_score, gram, gram_many, logistic_working, reused, run_alone, run_together
from .smooth import Smooth, fit_smooth_gam

LAMBDAS = tuple(np.logspace(-3, 3, 15))
NULL_RIDGE = 1e-6


def capped_unique_counts(df: DataFrame, cols: Sequence[str], cap: int) -> dict[str, int]:
    """Distinct values per column, exact up to ``cap`` (a larger count is only known to exceed it)."""
    if not cols:
        return {}
    guess = df.agg(*[F.approx_count_distinct(c(n), 0.02).alias(f"a{i}") for i, n in enumerate(cols)]).first()
    near = [n for i, n in enumerate(cols) if guess[f"a{i}"] <= 2 * cap + 100]
    out = {n: guess[f"a{i}"] for i, n in enumerate(cols)}
    if near:
        rows = feature_values(df, near).where(F.col("x").isNotNull()).groupBy("feat_name").agg(
            F.count_distinct("x").alias("n")
        )
        out.update({r["feat_name"]: r["n"] for r in rows.collect()})
    return {n: out.get(n, 0) for n in cols}


def spline_design(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], n_splines: int = 20) -> Design:
    """A spline per numeric feature (a factor-like line for two values) and a factor per category."""
    counts = capped_unique_counts(df, numeric, n_splines)
    ranges = column_ranges(df, numeric) if numeric else {}
    blocks: list = [Constant()]
    for n in numeric:
        if counts[n] >= 3:
            blocks.append(Spline(n, *ranges[n], n_splines=max(4, n_splines)))
        elif counts[n] == 2:
            blocks.append(Linear(n, ranges[n][0], ranges[n][1] - ranges[n][0]))
    levels = sorted_levels(df, categorical)
    return Design(tuple([*blocks, *[Levels(n, tuple(levels[n])) for n in categorical if levels[n]]]))


def regression_spline_design(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], max_k: int = 10) -> Design:
    """Basis size by the number of values: fewer than 2 none, 2 or 3 a line, else min(max_k, values) splines."""
    counts = capped_unique_counts(df, numeric, max_k)
    ranges = column_ranges(df, numeric) if numeric else {}
    blocks: list = [Constant()]
    for n in numeric:
        k = min(max_k, counts[n])
        if counts[n] in (2, 3):
            blocks.append(Linear(n, ranges[n][0], ranges[n][1] - ranges[n][0]))
        elif counts[n] > 3:
            blocks.append(Spline(n, *ranges[n], n_splines=k, degree=min(3, k - 1)))
    levels = sorted_levels(df, categorical)
    for n in categorical:
        if len(levels[n]) > 1:
            blocks.append(Levels(n, tuple(levels[n][1:])))
    return Design(tuple(blocks))


def penalty_matrix(design: Design, order: int = 2) -> np.ndarray:
    p = np.zeros((design.size, design.size))
    for block, sl in zip(design.blocks, design.slices):
        if isinstance(block, Spline):
            p[sl, sl] = block.penalty(order)
        elif isinstance(block, Levels):
            p[sl, sl] = np.eye(block.size)
    return p


def _null_ridge(design: Design) -> np.ndarray:
    """A tiny ridge that separates the constant from the splines, which also sum to one."""
    ridge = np.full(design.size, NULL_RIDGE)
    ridge[0] = 0.0
    return ridge


def solve_penalised(stats: Gram, penalty: np.ndarray, lam: float, ridge: np.ndarray, gamma: float = 1.0):
    """Coefficients, effective degrees of freedom and generalised cross-validation score for one penalty."""
    scale = max(1.0, np.trace(stats.g) / len(stats.b))
    a = stats.g + lam * penalty + np.diag(ridge * scale)
    inverse = np.linalg.inv(a)
    if not np.all(np.isfinite(inverse)):
        raise np.linalg.LinAlgError("singular")
    beta = inverse @ stats.b
    edf = float(np.sum(inverse * stats.g))
    n = stats.rows
    left = n - gamma * edf
    gcv = n * max(stats.squared_error(beta), 0.0) / (left * left) if left > 0 else np.inf
    return beta, edf, gcv, inverse


def search_lambda(stats: Gram, penalty: np.ndarray, lambdas: Sequence[float], ridge: np.ndarray, gamma: float = 1.0):
    """Best (lam, beta, edf, gcv, inverse) over the grid. A singular system drops that penalty."""
    best, path = None, []
    for lam in sorted(lambdas):
        try:
            beta, edf, gcv, inverse = solve_penalised(stats, penalty, lam, ridge, gamma)
        except np.linalg.LinAlgError:
            continue
        path.append((float(lam), edf, float(gcv)))
        if np.isfinite(gcv) and (best is None or gcv < best[3]):
            best = (float(lam), beta, edf, float(gcv), inverse)
    if best is None:
        raise np.linalg.LinAlgError("no penalty of the grid gives a regular system")
    return best, path


def _fit(df, target, design, numeric, categorical, task, lambdas, order, gamma, max_iter, tol, weight=None):
    weights = [weight] if weight else []
    penalty, ridge = penalty_matrix(design, order), _null_ridge(design)
    if check_task(task) == "regression":
        stats = gram(df, design, target, weights)[0]
        best, path = search_lambda(stats, penalty, lambdas, ridge, gamma)
        passes = 1
    else:
        narrow = df.select(*[c(n) for n in dict.fromkeys([*design.columns, target, *weights])])
        with reused(narrow) as rows:
            best, path, passes, stats = run_alone(
                spline_steps(design, lambdas, order, gamma, max_iter, tol),
                lambda at: gram(rows, design, target, weights, working=logistic_working, offset=batch_score(design, at), spread=False)[0],
            )
    return _fitted(design, best, path, passes, stats, task, numeric, categorical)


def spline_steps(design: Design, lambdas: Sequence[float], order: int, gamma: float, max_iter: int, tol: float):
    """Newton steps of a penalised model for classes (see ``run_together``); returns what ``_fitted`` takes."""
    penalty, ridge = penalty_matrix(design, order), _null_ridge(design)
    beta, last = np.zeros(design.size), np.inf
    for passes in range(1, max_iter + 1):
        stats = yield beta
        # the penalty is chosen again on every weighted pass, so the search costs no extra passes
        best, path = search_lambda(stats, penalty, lambdas, ridge, gamma)
        if abs(last - stats.loss) <= tol * (abs(last) if np.isfinite(last) else 1.0) and passes > 2:
            break
        last, beta = stats.loss, best[1]
    return best, path, passes, stats


def _fitted(design, best, path, passes, stats, task, numeric, categorical) -> AdditiveModel:
    lam, beta, edf, gcv, inverse = best
    residual = max(stats.squared_error(beta), 0.0) / max(stats.rows - edf, 1.0)
    scale = residual if task == "regression" else 1.0
    info = {"lam": lam, "edf": edf, "gcv": gcv, "path": path, "passes": passes, "covariance": inverse * scale}
    return AdditiveModel(design, beta, task, tuple(numeric), tuple(categorical), info=info)


def fit_spline_gam(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (),
                   task: str = "regression", n_splines: int = 20, lam: float | None = None,
                   lambdas: Sequence[float] = LAMBDAS, order: int = 2, max_iter: int = 25, tol: float = 1e-5,
                   weight: str | None = None) -> AdditiveModel:
    """P-spline model. ``lam`` fixes the penalty, otherwise the grid is searched by GCV."""
    design = spline_design(df, numeric, categorical, n_splines)
    grid = [lam] if lam is not None else lambdas
    return _fit(df, target, design, numeric, categorical, task, grid, order, 1.0, max_iter, tol, weight)


def fit_by_validation(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], val: Column,
                      task: str = "regression", n_splines: int = 20, lambdas: Sequence[float] = LAMBDAS,
                      order: int = 2) -> AdditiveModel:
    """Penalty by the loss on the rows marked ``val``, first minimum from the largest penalty down, then a
    fit on all rows.

    Squared loss: the cross-products of both parts come from one pass, and so do the losses of the whole
    path and the final fit. Log loss fits all penalties in step: the passes are those of the longest fit.
    """
    design = spline_design(df, numeric, categorical, n_splines)
    path, ordered = [], sorted(lambdas, reverse=True)
    if check_task(task) == "classification":
        # all penalties in step: first on the other rows, then their losses on the held ones, last the best on all rows
        narrow = df.select(*[c(n) for n in dict.fromkeys([*design.columns, target])], val.cast("int").alias("__val"))
        with reused(narrow) as rows:
            member = Member(design, cells=frozenset([0]), working=logistic_working)
            fits, _ = run_together(rows, target, [(member, spline_steps(design, [lam], order, 1.0, 25, 1e-5)) for lam in ordered], "__val")
            good = [(lam, f[0][1]) for lam, f in zip(ordered, fits) if not isinstance(f, Exception)]
            held = gram_many(rows, target, [Member(design, beta, cells=frozenset([1]), working=logistic_working) for _, beta in good], "__val")
            path = [(float(lam), h.loss / h.rows) for (lam, _), h in zip(good, held)]
            best = min(path, key=lambda p: p[1])[0]
            out = _fit(rows, target, design, numeric, categorical, task, [best], order, 1.0, 25, 1e-5)
    else:
        penalty, ridge = penalty_matrix(design, order), _null_ridge(design)
        parts = gram(df, design, target, group=val.cast("int"))
        for lam in ordered:
            try:
                beta = solve_penalised(parts[0], penalty, lam, ridge)[0]
            except np.linalg.LinAlgError:
                continue
            path.append((float(lam), parts[1].squared_error(beta) / parts[1].weight))
        best = min(path, key=lambda p: p[1])[0]
        whole = parts[0] + parts[1]
        beta, edf, gcv, inverse = solve_penalised(whole, penalty, best, ridge)
        scale = max(whole.squared_error(beta), 0.0) / max(whole.rows - edf, 1.0)
        info = {"lam": best, "edf": edf, "gcv": gcv, "covariance": inverse * scale}
        out = AdditiveModel(design, beta, task, tuple(numeric), tuple(categorical), info=info)
    out.info["validation_path"] = path
    return out


def fit_regression_spline(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (),
                          task: str = "regression", max_k: int = 10, order: int = 2, gamma: float = 1.4,
                          lambdas: Sequence[float] | None = None, max_iter: int = 25, tol: float = 1e-5,
                          spline_type: str = "tp", select: bool = False) -> AdditiveModel:
    """Basis sizes from the data, penalty order ``order``, rows counted as rows / ``gamma``.

    Every term has its own penalty (``smooth.fit_smooth_gam``). With ``lambdas``, one penalty of that grid serves all terms of a
    P-spline model, chosen by GCV.
    """
    if lambdas is None:
        return fit_smooth_gam(df, target, numeric, categorical, task, max_k, order, gamma, spline_type, select, max_iter=max_iter, tol=tol)
    design = regression_spline_design(df, numeric, categorical, max_k)
    return _fit(df, target, design, numeric, categorical, task, lambdas, order, gamma, max_iter, tol)


def partial_dependence(spark: SparkSession, model: AdditiveModel, points: int = 100, z: float = 1.96) -> DataFrame:
    """(feat_name, x, y, lower, upper) on an even grid per spline, with a pointwise band.

    The grid is evaluated where the coefficients are; its size is features x points.
    """
    cov, rows = model.info["covariance"], []
    for block, sl in zip(model.design.blocks, model.design.slices):
        if not isinstance(block, (Spline, Smooth)):
            continue
        x = np.linspace(block.lo, block.hi, points)
        basis = block.evaluate(x)
        y = basis @ model.beta[sl]
        half = z * np.sqrt(np.maximum(np.sum((basis @ cov[sl, sl]) * basis, axis=1), 0.0))
        rows += [(block.name, float(a), float(b), float(b - h), float(b + h)) for a, b, h in zip(x, y, half)]
    return spark.createDataFrame(rows, "feat_name string, x double, y double, lower double, upper double")
