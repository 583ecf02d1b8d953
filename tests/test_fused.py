"""Total-variation terms: the taut string and the whole model against plain optimality conditions."""

import numpy as np
import pytest
from gamspark.models import evaluate, fused
from gamspark.models.design import Bins, Constant, Design, Levels
from gamspark.models.gram import Gram
from pyspark.sql import functions as F

N = 1500


def plain_variation(weights, sums, lam):
    """The same by the dual: a box-constrained quadratic problem in the jumps, solved by coordinate steps."""
    d = np.diff(np.eye(len(weights)), axis=0)
    q = d @ np.diag(1 / weights) @ d.T
    u, target = np.zeros(len(weights) - 1), d @ (sums / weights)
    for _ in range(20000):
        before = u.copy()
        for k in range(len(u)):
            u[k] = np.clip(u[k] + (target[k] - q[k] @ u) / q[k, k], -lam, lam)
        if np.max(np.abs(u - before)) < 1e-13:
            break
    return (sums - d.T @ u) / weights


@pytest.mark.parametrize("seed", range(12))
def test_taut_string_is_exact(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 14))
    weights = rng.integers(1, 9, n).astype(float)
    sums = weights * (rng.normal(size=n) + 3 * (np.arange(n) > n // 2)) if seed % 3 else weights * np.ones(n)
    for lam in (0.0, 0.1, 1.0, 5.0, 1e6):
        assert np.allclose(fused.taut_string(weights, sums, lam), plain_variation(weights, sums, lam), atol=1e-6)
    empty = fused.taut_string(np.r_[0.0, weights, 0.0], np.r_[0.0, sums, 0.0], 0.5)
    assert np.allclose(empty[1:-1], plain_variation(weights, sums, 0.5), atol=1e-6) and empty[0] == empty[1] and empty[-1] == empty[-2]


def model_parts(seed=0):
    rng = np.random.default_rng(seed)
    a, b, g = rng.integers(0, 10, N), rng.integers(0, 8, N), rng.integers(0, 3, N)
    y = 2.0 * (a > 4) - 1.0 * (b > 2) + 1.5 * (b > 5) + 0.8 * (g == 1) + rng.normal(0, 0.5, N)
    return a, b, g, y


def test_block_steps_reach_the_minimum():
    a, b, g, y = model_parts()
    design = Design((Constant(), Bins("a", tuple(np.arange(9) + 0.5)), Bins("b", tuple(np.arange(7) + 0.5)), Levels("g", ("0", "1", "2"))))
    basis = np.hstack([np.ones((N, 1)), np.eye(10)[a], np.eye(8)[b], np.eye(3)[g]])
    stats = Gram(basis.T @ basis, basis.T @ y, float(y @ y), N, N)
    cost = lambda f, lam: 0.5 * np.sum((y - basis @ f) ** 2) + lam * fused.variation(design, f)
    rng = np.random.default_rng(1)
    for lam in (0.5, 20.0, 100.0):
        f = fused.fused_solve(stats, design, lam)
        here = cost(f, lam)
        for _ in range(300):
            step = rng.normal(size=len(f)) * 10.0 ** rng.uniform(-4, 0) * (rng.random(len(f)) < 0.3)
            assert cost(f + step, lam) >= here - 1e-7
        for sl in design.slices[1:3]:  # joint moves of neighbouring bins
            for i in range(sl.start, sl.stop):
                for j in range(i + 1, sl.stop + 1):
                    for size in (-1e-3, 1e-3):
                        step = np.zeros(len(f))
                        step[i:j] = size
                        assert cost(f + step, lam) >= here - 1e-7
    top = fused.largest_penalty(stats, design)
    assert np.allclose(fused.fused_solve(stats, design, top * 1.0001)[1:], 0) and np.abs(fused.fused_solve(stats, design, top * 0.99)[1:]).max() > 1e-6


@pytest.fixture(scope="module")
def df(spark):
    a, b, g, y = model_parts()
    label = (np.random.default_rng(2).random(N) < 1 / (1 + np.exp(-2 * (y - 0.5)))).astype(int)
    rows = [(i, float(p), float(q), f"l{r}", float(s), int(t)) for i, (p, q, r, s, t) in enumerate(zip(a, b, g, y, label))]
    return spark.createDataFrame(rows, "id int, a double, b double, g string, y double, label int").repartition(4).cache()


def test_path_finds_the_planted_jumps(df):
    val = F.col("id") % 4 == 0
    model = fused.fit_fused_path(df, "y", ["a", "b"], ["g"], val)
    path, losses = model.info["path"], model.info["validation_path"]
    assert path[0][2] == 0 and all(x[1] <= y[1] + 1e-9 for x, y in zip(path, path[1:])) and len(path) == 50
    assert model.info["lam"] == min(losses, key=lambda p: p[1])[0] and model.loss(df, "y") < 0.27
    design, beta = model.feature_terms("a")
    steps = np.abs(np.diff(beta))
    assert np.argmax(steps) == 4 and abs(steps[4] - 2) < 0.25 and np.delete(steps, 4).sum() < 0.3
    alone = fused.fit_fused(df.where(~val), "y", ["a", "b"], ["g"], lam=losses[10][0])
    assert np.isclose(alone.loss(df.where(val), "y"), losses[10][1], rtol=1e-6)


def test_path_of_classes(df):
    val = F.col("id") % 4 == 0
    model = fused.fit_fused_path(df, "label", ["a", "b"], ["g"], val, "classification", lambdas=[1e4, 30.0, 10.0, 3.0, 0.5])
    losses = dict(model.info["validation_path"])
    assert losses[model.info["lam"]] == min(losses.values()) < losses[1e4] - 0.05 and model.info["path"][0][2] == 0
    top = fused.penalty_path(fused._at_constant(_label_stats(df, model.design)), model.design)[0]
    assert fused.fit_fused(df, "label", ["a", "b"], ["g"], "classification", top * 1.001).info["path"][0][1] < 1e-6
    assert fused.fit_fused(df, "label", ["a", "b"], ["g"], "classification", top * 0.98).info["path"][0][1] > 1e-6
    trial = evaluate.run_trial(evaluate.FITS["fused"], df.where(~val), df.where(val), "label", ["a", "b"], ["g"], "classification", 0, {"lam": 3.0})
    assert not trial.failed and np.isclose(trial.loss, losses[3.0], rtol=1e-4)


def _label_stats(df, design):
    from gamspark.models.gram import gram

    return gram(df, design, "label")[0]
