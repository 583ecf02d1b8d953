"""Smooth additive models with a penalty of their own for every term, chosen by restricted likelihood on one Gram.

Each smooth is written as its unpenalised part (a polynomial without the constant) and columns whose penalty is the identity, so a
penalty is a number per term and its rank the number of columns. The penalties of all terms come from fixed-point steps that need
only cross-products: the rows are read once, and once a pass for classes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import c
from ..operators.clean import column_ranges, feature_values
from ..operators.encode import sorted_levels
from .additive import AdditiveModel, check_task
from .design import Constant, Design, Levels, Linear, Spline, numbers
from .gram import Gram, batch_score, gram, logistic_working, reused

MAX_KNOTS = 100
LAM_RANGE = (1e-9, 1e12)
KINDS = ("tp", "ps")


@dataclass(frozen=True)
class Smooth:
    """Columns of one smooth term: ``n_null`` unpenalised ones, then columns with the identity as penalty.

    tp: radial functions at ``knots`` and polynomials, mapped by ``matrix`` (knots + polynomials x columns).
    ps: B-splines between the first and the last knot, mapped likewise.
    """

    name: str
    kind: str
    knots: tuple[float, ...]
    order: int
    matrix: tuple[tuple[float, ...], ...]
    n_null: int

    @property
    def columns(self):
        return (self.name,)

    @property
    def size(self):
        return len(self.matrix[0])

    @property
    def lo(self):
        return self.knots[0]

    @property
    def hi(self):
        return self.knots[-1]

    def evaluate(self, x: np.ndarray) -> np.ndarray:
        return self.raw(np.asarray(x, dtype=np.float64)) @ np.asarray(self.matrix)

    def raw(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "ps":
            return Spline(self.name, self.lo, self.hi, len(self.matrix)).evaluate(x)
        return _radial_basis(self._unit(x), self._unit(np.asarray(self.knots)), self.order)

    def _unit(self, x: np.ndarray) -> np.ndarray:
        return (x - self.lo) / (self.hi - self.lo)

    def build(self, batch):
        return self.evaluate(numbers(batch, self.name))


def _radial_basis(x: np.ndarray, knots: np.ndarray, order: int) -> np.ndarray:
    """Radial functions of a penalty on derivative ``order`` at the knots, then 1, x, ..., x^(order - 1)."""
    sign = -1.0 if order % 2 else 1.0
    radial = sign * np.abs(x[:, None] - knots[None, :]) ** (2 * order - 1) / (2 * math.factorial(2 * order - 1))
    return np.hstack([radial, x[:, None] ** np.arange(order)])


def thin_plate(name: str, knots: Sequence[float], size: int, order: int = 2) -> Smooth:
    """Thin-plate smooth of ``size`` functions with the constant (which is left out): the eigenvectors of the radial kernel at the
    knots that belong to the largest eigenvalues, made orthogonal to polynomials."""
    knots = np.unique(np.asarray(knots, dtype=np.float64))
    size = min(size, len(knots))
    order = max(1, min(order, size - 1))
    unit = (knots - knots[0]) / (knots[-1] - knots[0])
    basis = _radial_basis(unit, unit, order)
    kernel, poly = basis[:, : len(knots)], basis[:, len(knots) :]
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    top = np.argsort(-np.abs(values), kind="stable")[:size]
    values, vectors = values[top], vectors[:, top]
    free = _null_space(poly.T @ vectors)  # combinations that are orthogonal to polynomials
    penalty = free.T @ (values[:, None] * free)
    roots, turn = np.linalg.eigh((penalty + penalty.T) / 2)
    keep = roots > 1e-10 * max(roots.max(initial=0.0), 1e-300)
    matrix = np.zeros((len(knots) + order, order - 1 + int(keep.sum())))
    for k in range(1, order):
        matrix[len(knots) + k, k - 1] = 1.0
    matrix[: len(knots), order - 1 :] = vectors @ free @ (turn[:, keep] / np.sqrt(roots[keep]))
    return Smooth(name, "tp", tuple(map(float, knots)), order, tuple(map(tuple, matrix.tolist())), order - 1)


def p_spline(name: str, lo: float, hi: float, size: int, order: int = 2) -> Smooth:
    """P-spline of ``size`` B-splines with a penalty on differences, without the constant."""
    spline = Spline(name, float(lo), float(hi), n_splines=max(4, size))
    values, vectors = np.linalg.eigh(spline.penalty(order))
    null, rest = vectors[:, :order], vectors[:, order:]
    ones = null.T @ np.ones(spline.size)  # the B-splines sum to one
    matrix = np.hstack([null @ _null_space(ones[None, :]), rest / np.sqrt(values[order:])])
    return Smooth(name, "ps", (float(lo), float(hi)), order, tuple(map(tuple, matrix.tolist())), order - 1)


def _null_space(a: np.ndarray) -> np.ndarray:
    _, s, vt = np.linalg.svd(a)
    rank = int(np.sum(s > 1e-10 * max(s.max(initial=0.0), 1e-300)))
    return vt[rank:].T


def sampled_knots(df: DataFrame, cols: Sequence[str], most: int = MAX_KNOTS) -> dict[str, tuple[list[float], int]]:
    """Knots per column: its values if there are at most ``most``, else sketched quantiles; and the number of values, up to ``most`` + 1."""
    if not cols:
        return {}
    guess = df.agg(*[F.approx_count_distinct(c(n), 0.02).alias(f"a{i}") for i, n in enumerate(cols)]).first()
    few = [n for i, n in enumerate(cols) if guess[f"a{i}"] <= 2 * most]
    out: dict[str, tuple[list[float], int]] = {}
    if few:
        values = feature_values(df, few, cast="double").where(F.col("x").isNotNull() & ~F.isnan("x")).distinct()
        found: dict[str, list[float]] = {n: [] for n in few}
        for r in values.collect():  # about 2 * most values a column
            found[r["feat_name"]].append(r["x"])
        out.update({n: (sorted(v), len(v)) for n, v in found.items() if len(v) <= most})
    many = [n for n in cols if n not in out]
    if many:
        probs = [i / (most - 1) for i in range(most)]
        exprs = [F.percentile_approx(F.when(~F.isnan(c(n).cast("double")), c(n).cast("double")), probs, 20 * most).alias(f"q{i}") for i, n in enumerate(many)]
        row = df.agg(*exprs).first()
        ranges = column_ranges(df, many)
        out.update({n: (sorted({*row[f"q{i}"], *ranges[n]}), most + 1) for i, n in enumerate(many)})
    return out


def smooth_design(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], max_k: int = 10, order: int = 2,
                  kind: str = "tp", max_knots: int = MAX_KNOTS) -> Design:
    """Fewer than 2 values: no term; 2 or 3: a line; else a smooth of min(max_k, values) functions. Levels but the first are columns."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
    knots = sampled_knots(df, numeric, max(max_knots, max_k))
    blocks: list = [Constant()]
    for n in numeric:
        at, count = knots[n]
        if count in (2, 3):
            blocks.append(Linear(n, at[0], at[-1] - at[0]))
        elif count > 3:
            k = min(max_k, count)
            blocks.append(thin_plate(n, at, k, order) if kind == "tp" else p_spline(n, at[0], at[-1], k, order))
    levels = sorted_levels(df, categorical)
    return Design(tuple([*blocks, *[Levels(n, tuple(levels[n][1:])) for n in categorical if len(levels[n]) > 1]]))


def penalty_groups(design: Design, select: bool = False) -> list[tuple[str, np.ndarray]]:
    """(term, columns) of every penalty. ``select`` also penalises the unpenalised part, so that a term can vanish."""
    out = []
    for block, sl in zip(design.blocks, design.slices):
        if isinstance(block, Smooth):
            out.append((block.name, np.arange(sl.start + block.n_null, sl.stop)))
            if select and block.n_null:
                out.append((block.name, np.arange(sl.start, sl.start + block.n_null)))
    return out


@dataclass
class TermFit:
    """Coefficients at the chosen penalties."""

    beta: np.ndarray
    lams: np.ndarray
    edf: np.ndarray  # per column
    inverse: np.ndarray  # of B'WB plus penalties
    scale: float
    steps: int
    criterion: float


def _solve(stats: Gram, diagonal: np.ndarray):
    a = stats.g + np.diag(diagonal)
    unit = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    values, vectors = np.linalg.eigh(a * np.outer(unit, unit))
    kept = values > 1e-12 * values.max()
    half = (unit[:, None] * vectors[:, kept]) / np.sqrt(values[kept])
    inverse = half @ half.T
    return inverse @ stats.b, inverse, float(np.sum(np.log(values[kept])) - 2 * np.sum(np.log(unit)))


def restricted_likelihood(stats: Gram, groups, lams: np.ndarray, scale: float | None = None, gamma: float = 1.0):
    """-2 log restricted likelihood at given penalties, up to a constant, and what it is made of. Without ``scale``, the residual
    variance is the one that maximises it. ``gamma`` above 1 counts the rows as rows / gamma."""
    diagonal = np.zeros(len(stats.b))
    for (_, at), lam in zip(groups, lams):
        diagonal[at] += lam
    beta, inverse, logdet = _solve(stats, diagonal)
    deviance = max(stats.squared_error(beta), 0.0) + float(np.sum(diagonal * beta * beta))
    free = len(stats.b) - sum(len(at) for _, at in groups)
    n = stats.rows / gamma - free
    phi = scale if scale is not None else max(deviance / gamma / max(n, 1.0), 1e-300)
    penalty = sum(len(at) * math.log(lam) for (_, at), lam in zip(groups, lams))
    return deviance / (gamma * phi) + logdet - penalty + n * math.log(phi), beta, inverse, phi


def choose_penalties(stats: Gram, groups, scale: float | None = None, gamma: float = 1.0, start: np.ndarray | None = None,
                     max_steps: int = 500, tol: float = 1e-7) -> TermFit:
    """Fixed-point steps on all penalties at once, each towards the stationary point of the restricted likelihood; a step that
    gets better when doubled is doubled."""
    lams = np.full(len(groups), 1.0) * max(np.trace(stats.g) / len(stats.b), 1e-12) if start is None else start.copy()
    value, beta, inverse, phi = restricted_likelihood(stats, groups, lams, scale, gamma)
    steps, stretch = 0, 1.0
    for steps in range(1, max_steps + 1):
        ratio = np.ones(len(groups))
        for j, (_, at) in enumerate(groups):
            room = max(len(at) - lams[j] * float(np.sum(np.diag(inverse)[at])), 1e-12)
            ratio[j] = gamma * phi * room / max(lams[j] * float(beta[at] @ beta[at]), 1e-300)
        ratio = np.clip(ratio, 1e-3, 1e3)
        step = np.clip(lams * ratio**stretch, *LAM_RANGE)
        tried = restricted_likelihood(stats, groups, step, scale, gamma)
        while tried[0] > value + 1e-10 * abs(value) and stretch > 1e-3:
            stretch /= 2
            step = np.clip(lams * ratio**stretch, *LAM_RANGE)
            tried = restricted_likelihood(stats, groups, step, scale, gamma)
        moved = np.max(np.abs(np.log(step / lams)), initial=0.0)
        gained = value - tried[0]
        lams, (value, beta, inverse, phi) = step, tried
        stretch = min(2 * stretch, 16.0)
        if moved < tol or (gained < tol * 1e-3 * max(1.0, abs(value)) and steps > 3):
            break
    edf = np.sum(inverse * stats.g, axis=1)
    return TermFit(beta, lams, edf, inverse, phi, steps, value)


def fit_smooth_gam(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (), task: str = "regression",
                   max_k: int = 10, order: int = 2, gamma: float = 1.0, kind: str = "tp", select: bool = False,
                   max_knots: int = MAX_KNOTS, max_iter: int = 25, tol: float = 1e-6, weight: str | None = None) -> AdditiveModel:
    """Smooth terms with a penalty each. ``kind``: thin-plate ("tp") or P-spline ("ps") bases; ``gamma`` above 1 smooths more.

    ``info`` holds the penalties, the effective degrees of freedom per term (the constant is not part of a term) and the covariance
    of the coefficients. Rows with a missing number are left out; a missing or unseen level has effect 0.
    """
    design = smooth_design(df, numeric, categorical, max_k, order, kind, max_knots)
    groups, weights = penalty_groups(design, select), [weight] if weight else []
    if check_task(task) == "regression":
        fit = choose_penalties(gram(df, design, target, weights)[0], groups, None, gamma)
        passes = 1
    else:
        beta, last, lams = np.zeros(design.size), np.inf, None
        narrow = df.select(*[c(n) for n in dict.fromkeys([*design.columns, target, *weights])])
        with reused(narrow) as rows:
            for passes in range(1, max_iter + 1):
                stats = gram(rows, design, target, weights, working=logistic_working, offset=batch_score(design, beta), spread=False)[0]
                fit = choose_penalties(stats, groups, 1.0, gamma, lams)
                moved = np.max(np.abs(fit.beta - beta), initial=0.0) <= tol * max(1.0, np.max(np.abs(fit.beta), initial=0.0))
                if moved or (abs(last - stats.loss) <= tol * abs(stats.loss) and passes > 2):
                    break
                beta, last, lams = fit.beta, stats.loss, fit.lams
    edf = {b.name: float(fit.edf[sl].sum()) for b, sl in zip(design.blocks, design.slices) if not isinstance(b, Constant)}
    lam = [(name, float(v)) for (name, _), v in zip(groups, fit.lams)]
    info = {"lam": lam, "edf": edf, "criterion": fit.criterion, "passes": passes, "steps": fit.steps, "covariance": fit.inverse * fit.scale}
    return AdditiveModel(design, fit.beta, task, tuple(numeric), tuple(categorical), info=info)
