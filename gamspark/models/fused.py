"""Piecewise constant additive models: total-variation penalties on binned terms, and a penalty chosen on validation rows.

Terms are indicators of bins, so a term's own cross-products are a diagonal and the best term for given others is a weighted
one-dimensional problem, which a taut string solves exactly. All of the path needs cross-products only: one pass for squared loss;
for classes the whole path goes on in step, a pass for each Newton round.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import c
from .additive import AdditiveModel, check_task
from .boosting import binned_design
from .design import Constant, Design, Levels
from .gram import Gram, Member, gram_many, logistic_working, reused, run_together

PATH_LENGTH, PATH_END = 50, 1e-4


def taut_string(weights: np.ndarray, sums: np.ndarray, lam: float) -> np.ndarray:
    """argmin of sum w/2 (f - s/w)^2 + lam * sum |f[k+1] - f[k]|: slopes of the shortest line through a tube of radius ``lam`` around
    the running sums. A place without weight gets the value of the one before (the first ones that of the one after)."""
    filled = np.flatnonzero(weights > 0)
    if not len(filled):
        return np.zeros(len(weights))
    x, y = np.r_[0.0, np.cumsum(weights[filled])], np.r_[0.0, np.cumsum(sums[filled])]
    low, high = y - lam, y + lam
    low[[0, -1]] = high[[0, -1]] = y[[0, -1]]
    slopes, start, at, n = np.zeros(len(filled)), 0, 0.0, len(filled)
    while start < n:
        run = np.arange(start + 1, n + 1)
        above = np.maximum.accumulate((low[run] - at) / (x[run] - x[start]))  # the line must be at least that steep so far
        below = np.minimum.accumulate((high[run] - at) / (x[run] - x[start]))
        crossed = np.flatnonzero(above > below)
        if not len(crossed):
            end, value = n, y[-1]
        else:
            k = crossed[0]
            lower = (low[run[k]] - at) / (x[run[k]] - x[start]) > (below[k - 1] if k else np.inf)  # the tube rises too steeply here
            bound = (high if lower else low)[run[:k]]
            ways = (bound - at) / (x[run[:k]] - x[start])
            j = int(len(ways) - 1 - np.argmin(ways[::-1])) if lower else int(len(ways) - 1 - np.argmax(ways[::-1]))
            end, value = int(run[j]), float(bound[j])
        slopes[start:end] = (value - at) / (x[end] - x[start])
        start, at = end, value
    out = np.zeros(len(weights))
    out[:] = slopes[np.clip(np.searchsorted(filled, np.arange(len(weights)), side="right") - 1, 0, None)]
    return out


def _blocks(design: Design):
    return [(b, sl) for b, sl in zip(design.blocks, design.slices) if not isinstance(b, Constant)]


def fused_solve(stats: Gram, design: Design, lam: float, start: np.ndarray | None = None, sweeps: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """Block steps to the minimum of 1/2 |y - f|^2 + lam * (variation of the numeric terms + size of the levels' effects). Terms have
    weighted mean 0 but for levels, whose penalty says where 0 is."""
    f = np.zeros(design.size) if start is None else start.copy()
    counts, grad = np.diag(stats.g), stats.b - stats.g @ f
    n = max(counts[0], 1e-300)
    spread = np.sqrt(max(stats.yy / n, 1e-300))
    for _ in range(sweeps):
        moved = 0.0
        for block, sl in _blocks(design):
            own = grad[sl] + counts[sl] * f[sl]
            if isinstance(block, Levels):
                new = np.sign(own) * np.maximum(np.abs(own) - lam, 0.0) / np.where(counts[sl] > 0, counts[sl], 1.0)
            else:
                new = taut_string(counts[sl], own, lam)
                new = new - (new @ counts[sl]) / max(counts[sl].sum(), 1e-300)
            step = new - f[sl]
            if np.any(step):
                grad -= stats.g[:, sl] @ step
                f[sl] = new
                moved = max(moved, float(np.max(np.abs(step) * np.sqrt(counts[sl] / n))))
            shift = grad[0] / n  # the constant
            f[0] += shift
            grad -= stats.g[:, 0] * shift
            moved = max(moved, abs(shift))
        if moved <= tol * spread:
            break
    return f


def largest_penalty(stats: Gram, design: Design) -> float:
    """The least penalty at which all terms are flat."""
    mean = stats.b[0] / max(stats.g[0, 0], 1e-300)
    grad, most = stats.b - stats.g[:, 0] * mean, 0.0
    for block, sl in _blocks(design):
        most = max(most, float(np.max(np.abs(grad[sl] if isinstance(block, Levels) else np.cumsum(grad[sl])), initial=0.0)))
    return most


def penalty_path(stats: Gram, design: Design, length: int = PATH_LENGTH, end: float = PATH_END) -> np.ndarray:
    return max(largest_penalty(stats, design), 1e-300) * np.logspace(0, np.log10(end), length)


def fused_steps(design: Design, lam: float, max_iter: int = 30, tol: float = 1e-7):
    """Newton steps of the model for classes at one penalty (see ``gram.run_together``)."""
    beta, before, last = np.zeros(design.size), None, np.inf
    for _ in range(max_iter):
        stats = yield beta
        cost = stats.loss + lam * variation(design, beta)
        if before is not None and cost > last * (1 + 1e-12):
            beta = (beta + before) / 2
            if np.max(np.abs(beta - before), initial=0.0) < 1e-10:
                break
            continue
        if last - cost <= tol * max(abs(cost), 1e-12):
            break
        last, before = cost, beta
        beta = fused_solve(stats, design, lam, beta)
    return beta


def variation(design: Design, beta: np.ndarray) -> float:
    """Sum of the jumps of numeric terms and of the sizes of the levels' effects."""
    return float(sum(np.abs(beta[sl]).sum() if isinstance(b, Levels) else np.abs(np.diff(beta[sl])).sum() for b, sl in _blocks(design)))


def fit_fused(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (), task: str = "regression", lam: float = 1.0,
              max_bins: int = 64) -> AdditiveModel:
    """The model at one penalty (on the sum over rows, not the mean)."""
    return fit_fused_path(df, target, numeric, categorical, None, task, [lam], max_bins)


def fit_fused_path(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (), val: Column | None = None,
                   task: str = "regression", lambdas: Sequence[float] | None = None, max_bins: int = 64) -> AdditiveModel:
    """Penalties from the largest down (by default from the one at which nothing is left), fitted on the rows not marked ``val``; the first
    with the least loss on the others is fitted again on all rows. Without ``val`` the last penalty is taken.

    ``info``: ``path`` (penalty, variation, jumps) and ``validation_path`` (penalty, loss). A missing number or unseen level has effect 0.
    """
    check_task(task)
    narrow = df.select(*[c(n) for n in dict.fromkeys([*numeric, *categorical, target])],
                       (F.coalesce(val, F.lit(False)) if val is not None else F.lit(False)).cast("int").alias("__val"))
    with reused(narrow) as rows:
        design = binned_design(rows, numeric, categorical, max_bins)
        train, held = gram_many(rows, target, [Member(design, cells=frozenset([k])) for k in (0, 1)], "__val")
        if lambdas is None:
            start = train if task == "regression" else _at_constant(train)
            lambdas = penalty_path(start, design)
        ordered = sorted(map(float, lambdas), reverse=True)
        if task == "regression":
            betas, beta = [], None
            for lam in ordered:
                beta = fused_solve(train, design, lam, beta)
                betas.append(beta)
            losses = [held.squared_error(b) / held.weight if held.weight else None for b in betas]
        else:
            member = Member(design, cells=frozenset([0]), working=logistic_working)
            betas, _ = run_together(rows, target, [(member, fused_steps(design, lam)) for lam in ordered], "__val")
            scored = gram_many(rows, target, [Member(design, b, cells=frozenset([1]), working=logistic_working) for b in betas], "__val") if held.weight else []
            losses = [s.loss / s.rows for s in scored] or [None] * len(betas)
        best = int(np.argmin(losses)) if held.weight else len(ordered) - 1
        beta = betas[best]
        if held.weight and task == "regression":
            beta = fused_solve(train + held, design, ordered[best], beta)
        elif held.weight:
            whole = Member(design, working=logistic_working)
            beta = run_together(rows, target, [(whole, fused_steps(design, ordered[best]))])[0][0]
    jumps = [int(sum(np.sum(np.abs(np.diff(b[sl])) > 1e-9) for t, sl in _blocks(design) if not isinstance(t, Levels))) for b in betas]
    info = {"lam": ordered[best], "path": [(lam, variation(design, b), j) for lam, b, j in zip(ordered, betas, jumps)], "coefficients": betas}
    if held.weight:
        info["validation_path"] = list(zip(ordered, losses))
    return AdditiveModel(design, beta, task, tuple(numeric), tuple(categorical), info=info)


def _at_constant(stats: Gram) -> Gram:
    """Cross-products of the labels seen from the model without terms: what the penalty weighs there is label less share."""
    share = stats.b[0] / max(stats.g[0, 0], 1e-300)
    return Gram(stats.g, stats.b - stats.g[:, 0] * share, stats.yy, stats.weight, stats.rows)
