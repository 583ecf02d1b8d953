"""All folds and candidates of a nested evaluation from shared passes.

Cross-products are additive over rows: they are added up per cell (fold, inner part), and those of any training part are sums of
cells. So for squared loss one pass serves every fold, every candidate and every refit; for classes all fits of all folds go on in
step, a pass for each Newton round. One more pass scores the test rows of all folds, each by the models of its fold.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import c, fast_uniform, hash_uniform, sigmoid
from ..operators import metrics, split
from .additive import AdditiveModel, check_task
from .boosting import VALIDATION_SHARE, _centre, binned_design, cyclic_boost
from .design import Design
from .evaluate import REPORT_SCHEMA, TRIAL_SCHEMA, Trial, best_trial
from .gram import Gram, Member, arrow_score, gram_many, logistic_working, reused, run_together
from .linear import centred, coordinate_descent, linear_design, logistic_steps, penalty_mix, ridge_solve
from .spline import LAMBDAS, _null_ridge, penalty_matrix, search_lambda, spline_design, spline_steps

#: Parameters that each family knows; the first ones say which columns a candidate needs.
PARAMS = {
    "ridge": {"alpha"},
    "elastic_net": {"alpha", "l1_ratio", "max_iter"},
    "logistic": {"C", "penalty", "l1_ratio", "max_iter", "tol"},
    "spline_gam": {"n_splines", "lam", "lambdas", "order"},
    "binned_boosting": {"max_bins", "learning_rate", "rounds", "max_leaves", "early_stopping"},
}
TASK_OF = {"ridge": ("regression",), "elastic_net": ("regression",), "logistic": ("classification",), "binned_boosting": ("regression",)}


def _design_key(family: str, params: dict) -> tuple:
    if family == "spline_gam":
        return family, params.get("n_splines", 20)
    if family == "binned_boosting":
        return family, params.get("max_bins", 64)
    return ("linear",)


def _design(key: tuple, df: DataFrame, numeric, categorical) -> Design:
    if key[0] == "spline_gam":
        return spline_design(df, numeric, categorical, key[1])
    if key[0] == "binned_boosting":
        return binned_design(df, numeric, categorical, key[1])
    return linear_design(df, numeric, categorical)


def _solve(family: str, design: Design, params: dict, parts: tuple[Gram, Gram]) -> np.ndarray:
    """Coefficients for squared loss; ``parts`` are the training rows without and with those that boosting holds back."""
    if family == "binned_boosting":
        beta, _ = cyclic_boost(design, [parts[0]], parts[1], params.get("learning_rate", 0.1), params.get("rounds", 1000),
                               params.get("max_leaves", 3), params.get("early_stopping", 50))
        return _centre(design, beta, np.diag(parts[0].g) + np.diag(parts[1].g))
    stats = parts[0] + parts[1]
    if family == "spline_gam":
        grid = [params["lam"]] if params.get("lam") is not None else params.get("lambdas", LAMBDAS)
        return search_lambda(stats, penalty_matrix(design, params.get("order", 2)), grid, _null_ridge(design))[0][1]
    g, b, means, mean = centred(stats)
    if family == "ridge":
        slopes = ridge_solve(g, b, params.get("alpha", 1.0))
    else:
        slopes = coordinate_descent(g, b, stats.g[0, 0], params.get("alpha", 1.0), params.get("l1_ratio", 0.5), params.get("max_iter", 2000))
    return np.r_[mean - slopes @ means, slopes]


def _steps(family: str, design: Design, params: dict):
    if family == "spline_gam":
        grid = [params["lam"]] if params.get("lam") is not None else params.get("lambdas", LAMBDAS)
        return spline_steps(design, grid, params.get("order", 2), 1.0, 25, 1e-5)
    penalty = params.get("penalty", "l2")
    return logistic_steps(design, params.get("C", 1.0), penalty, penalty_mix(penalty, params.get("l1_ratio")), params.get("max_iter", 100), params.get("tol", 1e-8))


def rescaled(stats: Gram, mean: float, scale: float) -> Gram:
    """The cross-products with (y - mean) / scale as the response; column 0 is the constant."""
    yy = (stats.yy - 2 * mean * stats.b[0] + mean * mean * stats.weight) / scale**2
    return Gram(stats.g, (stats.b - mean * stats.g[:, 0]) / scale, yy, stats.weight, stats.rows, stats.loss)


def _sum(parts: Sequence[Gram]) -> Gram:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


@dataclass
class _Job:
    family: str
    config_id: int
    params: dict
    fold: int
    design: Design
    error: str = ""
    beta: np.ndarray | None = None
    loss: float | None = None
    seconds: float = 0.0


def _problem(family: str, params: dict, task: str) -> str:
    if family not in PARAMS:
        raise ValueError(f"{family} has no shared passes; use nested_evaluation")
    if task not in TASK_OF.get(family, (task,)):
        return f"ValueError: {family} does not fit {task}"
    unknown = sorted(set(params) - PARAMS[family])
    if unknown:
        return f"TypeError: unknown parameters {unknown}"
    if family == "logistic" and params.get("penalty") == "elasticnet" and params.get("l1_ratio") is None:
        return "ValueError: elastic net needs l1_ratio"
    return ""


def shared_evaluation(df: DataFrame, dataset: str, key: Sequence[str], target: str, numeric: Sequence[str], categorical: Sequence[str], task: str,
                      grids: dict[str, Sequence[dict]], folds: int = 5, val_share: float = 0.25, seed: int = 42, fold: Column | None = None,
                      val: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(trials, reports) like ``evaluate.nested_evaluation``, for families whose fits need cross-products only.

    Per outer fold, candidates are compared on inner validation rows, the best of each family is fitted again on all training rows and
    tested on the fold. For regression the target is standardised by the fold's training rows. Levels, knots and cuts (which do not
    look at the target) are those of all rows. ``fold`` (0 to folds - 1) and ``val`` may be given; else they are hashes of ``key``.
    Rows with a missing number are left out of the fits that use it; clean them before. ``seconds`` is the time of the solution,
    without the shared passes.
    """
    spark, names = df.sparkSession, [f for f, g in grids.items() if len(g)]
    problems = {(f, i): _problem(f, p, check_task(task)) for f in names for i, p in enumerate(grids[f])}
    if fold is None:
        frame = split.kfold(df, key, folds, seed, "__fold") if task == "regression" else split.stratified_kfold(df, key, target, folds, seed, "__fold")
    else:
        frame = df.withColumn("__fold", fold.cast("int"))
    inner = val if val is not None else hash_uniform(f"{seed}-inner", *[c(k) for k in key]) < val_share
    drawn = fast_uniform("42v0", *[c(k) for k in key]) < VALIDATION_SHARE  # the rows that boosting holds back
    frame = frame.withColumn("__val", inner.cast("int")).withColumn("__cell", (F.col("__fold") * 2 + F.col("__val")) * 2 + drawn.cast("int"))
    keep = dict.fromkeys([*numeric, *categorical, target])
    with reused(frame.select(*[c(n) for n in keep], "__fold", "__val", "__cell")) as rows:
        keys = dict.fromkeys(_design_key(f, p) for f in names for i, p in enumerate(grids[f]) if not problems[f, i])
        designs = {k: _design(k, rows, list(numeric), list(categorical)) for k in keys}
        jobs = [
            _Job(f, i, p, k, designs.get(_design_key(f, p)), problems[f, i]) for k in range(folds) for f in names for i, p in enumerate(grids[f])
        ]
        scale = {k: (0.0, 1.0) for k in range(folds)}
        if task == "regression":
            best = _regression(rows, target, jobs, list(designs.values()), folds, scale)
        else:
            best = _classification(rows, target, jobs, folds)
        trials = [Trial(j.config_id, j.params, j.loss, j.seconds, bool(j.error), j.error).row(dataset, j.family, j.fold) for j in jobs]
        reports = _reports(rows, dataset, target, task, best, scale)
    for k in range(folds):
        for f in names:
            mine = [j for j in jobs if (j.fold, j.family) == (k, f) and not j.error]
            if mine:
                top = min(mine, key=lambda j: (j.loss, j.config_id))
                reports.append((dataset, f, k, "timing", "timing_best_model", top.seconds))
                reports.append((dataset, f, k, "timing", "mean_timing_all_hpo_configs", sum(j.seconds for j in mine) / len(mine)))
    return spark.createDataFrame(trials, TRIAL_SCHEMA), spark.createDataFrame(reports, REPORT_SCHEMA)


def _choose(jobs: Sequence[_Job]) -> list[_Job]:
    """The best candidate of every fold and family, the first of equals; families that failed everywhere in a fold are left out."""
    best = []
    for fold, family in dict.fromkeys((j.fold, j.family) for j in jobs):
        mine = [j for j in jobs if (j.fold, j.family) == (fold, family)]
        good = [Trial(j.config_id, j.params, j.loss, j.seconds, False) for j in mine if not j.error and j.loss == j.loss]
        if good:
            top = best_trial(good)
            best.append(next(j for j in mine if j.config_id == top.config_id))
    return best


def _regression(rows, target, jobs, designs, folds, scale) -> list[tuple[_Job, np.ndarray]]:
    cells = range(4 * folds)
    found = gram_many(rows, target, [Member(d, cells=frozenset([k])) for d in designs for k in cells], "__cell")
    at = {(id(d), k): found[i * len(cells) + k] for i, d in enumerate(designs) for k in cells}

    def part(design, fold, inner):
        """Training rows of a fold (``inner``: 0 without its validation rows, 1 these, None all), by what boosting holds back."""
        keep = [[at[id(design), k] for k in cells if k // 4 != fold and k % 2 == held and inner in (None, k // 2 % 2)] for held in (0, 1)]
        return tuple(rescaled(_sum(x), *scale[fold]) for x in keep)

    for fold in range(folds):
        for d in designs[:1]:  # mean and deviation of the training target
            whole = _sum([at[id(d), k] for k in cells if k // 4 != fold])
            mean = whole.b[0] / max(whole.weight, 1.0)
            scale[fold] = (float(mean), float(np.sqrt(max(whole.yy / max(whole.weight, 1.0) - mean * mean, 0.0))) or 1.0)
    for j in jobs:
        if j.error:
            continue
        start = time.perf_counter()
        try:
            j.beta = _solve(j.family, j.design, j.params, part(j.design, j.fold, 0))
            held = _sum(part(j.design, j.fold, 1))
            j.loss = held.squared_error(j.beta) / held.weight if held.weight else float("nan")
        except np.linalg.LinAlgError as error:
            j.error = f"LinAlgError: {error}"
        j.seconds = time.perf_counter() - start
    return [(j, _solve(j.family, j.design, j.params, part(j.design, j.fold, None))) for j in _choose(jobs)]


def _classification(rows, target, jobs, folds, refit: bool = True) -> list[tuple[_Job, np.ndarray]]:
    def cells(fold, inner):
        return frozenset(k for k in range(4 * folds) if k // 4 != fold and inner in (None, k // 2 % 2))

    def fit(some, inner):
        members = [Member(j.design, cells=cells(j.fold, inner), working=logistic_working) for j in some]
        start = time.perf_counter()
        results, _ = run_together(rows, target, [(m, _steps(j.family, j.design, j.params)) for m, j in zip(members, some)], "__cell")
        seconds = (time.perf_counter() - start) / max(len(some), 1)
        return [r if isinstance(r, Exception) else (r[0][1] if j.family == "spline_gam" else r) for j, r in zip(some, results)], seconds

    live = [j for j in jobs if not j.error]
    betas, seconds = fit(live, 0)
    for j, beta in zip(live, betas):
        j.seconds = seconds
        if isinstance(beta, Exception):
            j.error = f"{type(beta).__name__}: {beta}"
        else:
            j.beta = beta
    live = [j for j in live if not j.error]
    for j, held in zip(live, gram_many(rows, target, [Member(j.design, j.beta, cells=cells(j.fold, 1), working=logistic_working) for j in live], "__cell")):
        j.loss = held.loss / held.rows if held.rows else float("nan")
    best = _choose(jobs) if refit else []
    return [(j, beta) for j, beta in zip(best, fit(best, None)[0]) if not isinstance(beta, Exception)]


def _reports(rows, dataset, target, task, best, scale) -> list[tuple]:
    """Reports of all folds and families, each row scored by the models of its fold."""
    families = list(dict.fromkeys(j.family for j, _ in best))
    if not families:
        return []
    scored = rows
    for i, family in enumerate(families):
        mine = {j.fold: (j.design, beta) for j, beta in best if j.family == family}
        columns = list(dict.fromkeys(n for d, _ in mine.values() for n in d.columns))

        def run(batch: pa.RecordBatch, mine=mine) -> np.ndarray:
            fold, out = batch.column("__fold").to_numpy(zero_copy_only=False), np.full(batch.num_rows, np.nan)
            for k, (design, beta) in mine.items():
                at = np.flatnonzero(fold == k)
                out[at] = design.score(batch.take(pa.array(at)), beta)
            return out

        scored = scored.withColumn(f"__raw{i}", F.nanvl(arrow_score(run, [*columns, "__fold"]), F.lit(None).cast("double")))
    lines = F.array(*[F.struct(F.lit(f).alias("model"), F.col(f"__raw{i}").alias("raw")) for i, f in enumerate(families)])
    y = c(target).cast("double")
    if task == "regression":
        shift = F.create_map(*[x for k, (m, s) in scale.items() for x in (F.lit(k), F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")))])
        own = shift[F.col("__fold")]
        y = (y - own["m"]) / own["s"]
    long = scored.select(F.col("__fold").alias("fold"), y.alias("y"), F.inline(lines))
    out = []
    if task == "regression":
        for r in metrics.regression_report(long, "y", "raw", ["model", "fold"]).collect():
            out += [(dataset, r["model"], r["fold"], "0", k, float(v)) for k, v in r.asDict().items() if k not in ("model", "fold", "n", "n_unscored") and v is not None]
        return out
    long = long.where(F.col("raw").isNotNull() & F.col("y").isNotNull())
    classes = long.withColumn("y", F.col("y").cast("int")).withColumn("p", (F.col("raw") >= 0).cast("int")).withColumn("probability", sigmoid(F.col("raw")))
    for r in metrics.classification_report(classes, "y", "p", ["model", "fold"]).collect():
        values = (("precision", "precision"), ("recall", "recall"), ("f1-score", "f1_score"), ("support", "support"))
        out += [(dataset, r["model"], r["fold"], r["row"], k, float(r[n])) for k, n in values]
    for r in metrics.roc_auc(classes, "y", "probability", ["model", "fold"]).collect():
        if r["roc_auc"] is not None:
            out.append((dataset, r["model"], r["fold"], "accuracy", "ROC_AUC", float(r["roc_auc"])))
    return out


def shared_grid_search(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], task: str, family: str,
                       candidates: Sequence[dict], val: Column) -> list[Trial]:
    """``evaluate.grid_search`` of one family on the rows not marked ``val`` with losses on the others, from shared passes."""
    problems = [_problem(family, p, check_task(task)) for p in candidates]
    frame = df.withColumn("__val", F.coalesce(val, F.lit(False)).cast("int"))
    drawn = fast_uniform("42v0", *[c(k) for k in [*numeric, *categorical]]) < VALIDATION_SHARE
    frame = frame.withColumn("__cell", F.lit(4) + F.col("__val") * 2 + drawn.cast("int"))  # fold 1: fold 0 trains on it
    with reused(frame.select(*[c(n) for n in dict.fromkeys([*numeric, *categorical, target])], "__val", "__cell")) as rows:
        designs = {k: _design(k, rows, list(numeric), list(categorical)) for k in dict.fromkeys(_design_key(family, p) for p, e in zip(candidates, problems) if not e)}
        jobs = [_Job(family, i, p, 0, designs.get(_design_key(family, p)), e) for i, (p, e) in enumerate(zip(candidates, problems))]
        if task == "regression" and designs:
            _grid_regression(rows, target, jobs, list(designs.values()))
        elif designs:
            _classification(rows, target, jobs, 2, refit=False)
    models = [AdditiveModel(j.design, j.beta, task, tuple(numeric), tuple(categorical)) if j.beta is not None else None for j in jobs]
    return [Trial(j.config_id, j.params, j.loss, j.seconds, bool(j.error), j.error, m) for j, m in zip(jobs, models)]


def _grid_regression(rows, target, jobs, designs) -> None:
    cells = [4, 5, 6, 7]
    found = gram_many(rows, target, [Member(d, cells=frozenset([k])) for d in designs for k in cells], "__cell")
    at = {id(d): found[4 * i : 4 * i + 4] for i, d in enumerate(designs)}
    for j in jobs:
        if j.error:
            continue
        start, parts = time.perf_counter(), at[id(j.design)]
        try:
            j.beta = _solve(j.family, j.design, j.params, (parts[0], parts[1]))
            held = parts[2] + parts[3]
            j.loss = held.squared_error(j.beta) / held.weight if held.weight else float("nan")
        except np.linalg.LinAlgError as error:
            j.error = f"LinAlgError: {error}"
        j.seconds = time.perf_counter() - start
