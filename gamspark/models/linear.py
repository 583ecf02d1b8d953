"""Ridge, elastic net and logistic regression."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import c
from ..operators import encode
from .additive import AdditiveModel
from .design import Constant, Design, Levels, Linear
from .gram import Gram, Member, batch_score, gram, logistic_working, reused, run_alone, run_together

RANK_CUT = 1e-11


def ridge_solve(g: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    """(G + alpha I)^-1 b; of a system without full rank (an intercept next to all levels of a factor, equal or constant
    columns) the solution of least norm, in units in which every column has the same length. The cut is relative: what is
    below RANK_CUT of the largest eigenvalue is rounding."""
    a = g + alpha * np.eye(len(b))
    scale = np.sqrt(np.maximum(np.diag(a), 0.0))
    unit = np.divide(1.0, scale, out=np.zeros(len(b)), where=scale > 0)
    values, vectors = np.linalg.eigh(a * np.outer(unit, unit))
    kept = values > RANK_CUT * np.max(values, initial=0.0)
    inverse = np.divide(1.0, values, out=np.zeros(len(b)), where=kept)
    return unit * (vectors @ (inverse * (vectors.T @ (unit * b))))


def linear_design(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], scale: bool = False,
                  drop: str | None = "if_binary") -> Design:
    """Constant, numeric terms (optionally standardised) and level columns."""
    params = encode.standard_scale(df, numeric).params if scale and numeric else {}
    hot = encode.one_hot(df, categorical, drop) if categorical else None
    blocks = [Constant(), *[Linear(n, *params.get(n, (0.0, 1.0))) for n in numeric]]
    blocks += [Levels(n, tuple(hot.kept(n))) for n in categorical]
    return Design(tuple(b for b in blocks if b.size))


def _additive(design, beta, task, numeric, categorical, **info):
    return AdditiveModel(design, np.asarray(beta), task, tuple(numeric), tuple(categorical), info=info)


def centred(stats: Gram) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Cross-products around the means when column 0 of the Gram is the constant."""
    n = stats.g[0, 0]
    means, y_mean = stats.g[0, 1:] / n, stats.b[0] / n
    return stats.g[1:, 1:] - n * np.outer(means, means), stats.b[1:] - n * means * y_mean, means, y_mean


def fit_ridge(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (), alpha: float = 1.0,
              intercept: bool = True, scale: bool = False, weight: str | None = None) -> AdditiveModel:
    """Ridge on one Gram; an intercept is not penalised."""
    design = linear_design(df, numeric, categorical, scale)
    if not intercept:
        design = Design(design.blocks[1:])
    stats = next(iter(gram(df, design, target, [weight] if weight else []).values()))
    if not intercept:
        return _additive(design, ridge_solve(stats.g, stats.b, alpha), "regression", numeric, categorical)
    g, b, means, y_mean = centred(stats)
    slopes = ridge_solve(g, b, alpha)
    return _additive(design, np.r_[y_mean - slopes @ means, slopes], "regression", numeric, categorical)


def coordinate_descent(g: np.ndarray, b: np.ndarray, n: float, alpha: float, l1_ratio: float, max_iter: int = 2000,
                       tol: float = 1e-10, start: np.ndarray | None = None) -> np.ndarray:
    """argmin 1/(2n)(w'Gw - 2w'b) + alpha*l1*|w|_1 + alpha*(1-l1)/2*|w|_2^2 from cross-products only."""
    w = np.zeros(len(b)) if start is None else start.copy()
    grad = b - g @ w
    diag = np.diag(g)
    l1, l2 = n * alpha * l1_ratio, n * alpha * (1 - l1_ratio)
    for _ in range(max_iter):
        largest = 0.0
        for j in np.flatnonzero(diag > 0):
            rho = grad[j] + diag[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (diag[j] + l2)
            step = new - w[j]
            if step:
                grad -= g[:, j] * step
                w[j] = new
                largest = max(largest, abs(step) * np.sqrt(diag[j] / n))
        if largest <= tol * max(1.0, np.sqrt(np.max(np.abs(w) ** 2 * diag / n, initial=0.0))):
            break
    return w


def fit_elastic_net(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (),
                    alpha: float = 1.0, l1_ratio: float = 0.5, max_iter: int = 2000, scale: bool = False) -> AdditiveModel:
    """Elastic net with an intercept: one Gram pass, coordinate descent on the driver."""
    return fit_elastic_net_path(df, target, numeric, categorical, [(alpha, l1_ratio)], max_iter, scale)[0]


def fit_elastic_net_path(df, target, numeric, categorical, settings: Sequence[tuple[float, float]], max_iter: int = 2000,
                         scale: bool = False) -> list[AdditiveModel]:
    """Every (alpha, l1_ratio) of a grid from the same Gram."""
    design = linear_design(df, numeric, categorical, scale)
    stats = gram(df, design, target)[0]
    g, b, means, y_mean = centred(stats)
    out = []
    for alpha, ratio in settings:
        w = coordinate_descent(g, b, stats.g[0, 0], alpha, ratio, max_iter)
        out.append(_additive(design, np.r_[y_mean - w @ means, w], "regression", numeric, categorical,
                             alpha=alpha, l1_ratio=ratio))
    return out


#: Solver names and the penalties that each allows.
SOLVERS = {
    "lbfgs": ("l2", "none"),
    "liblinear": ("l1", "l2"),
    "newton-cg": ("l2", "none"),
    "newton-cholesky": ("l2", "none"),
    "sag": ("l2", "none"),
    "saga": ("l1", "l2", "elasticnet", "none"),
}


def fit_logistic(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (), C: float = 1.0,
                 penalty: str | None = "l2", l1_ratio: float | None = None, class_weight: str | None = None,
                 max_iter: int = 100, scale: bool = True, tol: float = 1e-8, solver: str | None = None) -> AdditiveModel:
    """Logistic regression on 0/1 labels with l1, l2, elastic net or no penalty.

    ``solver`` is accepted so that grids written for other libraries run: the name is checked, and that it
    allows the penalty. All give the same optimum; the steps are those below.

    C multiplies the summed loss, so the penalty per unit of weight is 1 / (C * weight sum). Every
    Newton pass reads the rows once and solves the penalised quadratic from its Gram, which takes
    far fewer passes than a first-order solver; a step that does not lower the objective is halved.
    """
    if solver is not None and (penalty or "none") not in SOLVERS.get(solver, ()):
        raise ValueError(f"solver {solver!r} does not fit with penalty {penalty!r}")
    mix = penalty_mix(penalty, l1_ratio)
    design = linear_design(df, numeric, categorical, scale)
    weights = ["weight"] if class_weight == "balanced" else []
    frame = encode.balanced_weights(df, target) if weights else df
    narrow = frame.select(*[c(n) for n in dict.fromkeys([*design.columns, target, *weights])])
    with reused(narrow) as rows:
        beta = run_alone(
            logistic_steps(design, C, penalty, mix, max_iter, tol),
            lambda at: gram(rows, design, target, weights, working=logistic_working, offset=batch_score(design, at), spread=False)[0],
        )
    return _additive(design, beta, "classification", numeric, categorical, C=C, penalty=penalty)


def logistic_steps(design: Design, C: float, penalty: str | None, mix: float, max_iter: int, tol: float):
    """Newton steps of a penalised logistic regression (see ``run_together``); returns the coefficients."""
    beta, before, last = np.zeros(design.size), None, np.inf
    for _ in range(max_iter):
        stats = yield beta
        lam = 0.0 if penalty in (None, "none") else 1.0 / (C * stats.rows)
        cost = stats.loss / stats.rows + lam * (mix * np.abs(beta[1:]).sum() + (1 - mix) / 2 * beta[1:] @ beta[1:])
        if before is not None and cost > last + 1e-12:
            beta = (beta + before) / 2
            if np.max(np.abs(beta - before), initial=0.0) < 1e-10:
                break
            continue
        if last - cost <= tol * max(abs(cost), 1e-12):
            break
        last, before = cost, beta
        g, b, means, centre = centred(stats)
        # the quadratic is per weight of the iteration, the penalty per row
        slopes = coordinate_descent(g, b, stats.rows, lam, mix, start=beta[1:])
        beta = np.r_[centre - slopes @ means, slopes]
    return beta


def penalty_mix(penalty: str | None, l1_ratio: float | None) -> float:
    mix = {"l1": 1.0, "l2": 0.0, "elasticnet": l1_ratio, None: 0.0, "none": 0.0}[penalty]
    if mix is None:
        raise ValueError("elastic net needs l1_ratio")
    return mix


def fit_logistic_path(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], settings: Sequence[dict],
                      max_iter: int = 100, scale: bool = True, tol: float = 1e-8) -> list[AdditiveModel]:
    """``fit_logistic`` for every setting (C, penalty, l1_ratio), in step: as many passes as the longest of the fits takes."""
    design = linear_design(df, numeric, categorical, scale)
    jobs = []
    for s in settings:
        penalty = s.get("penalty", "l2")
        steps = logistic_steps(design, s.get("C", 1.0), penalty, penalty_mix(penalty, s.get("l1_ratio")), max_iter, tol)
        jobs.append((Member(design, working=logistic_working), steps))
    with reused(df.select(*[c(n) for n in dict.fromkeys([*design.columns, target])])) as rows:
        betas, rounds = run_together(rows, target, jobs)
    return [_additive(design, beta, "classification", numeric, categorical, passes=rounds, **s) for beta, s in zip(betas, settings)]


def raw_linear(coefs: dict[str, float], intercept: float = 0.0) -> Column:
    total = F.lit(float(intercept))
    for name, v in coefs.items():
        total = total + F.col(f"`{name}`") * F.lit(float(v))
    return total
