"""Smooth terms: the thin-plate basis, penalties by restricted likelihood, and fits against plain solutions."""

import numpy as np
import pytest
from gamspark.models import smooth, spline
from gamspark.models.design import Constant, Design, Linear
from gamspark.models.gram import Gram
from pyspark.sql import functions as F

N = 1500


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    a, b, z = rng.uniform(-2, 5, N), rng.uniform(0, 1, N), rng.uniform(0, 1, N)
    y = np.sin(3 * a) + 2 * b + rng.normal(0, 0.3, N)
    label = (rng.random(N) < 1 / (1 + np.exp(-(2 * np.sin(2 * a) + 2 * b - 1)))).astype(int)
    return a, b, z, y, label


@pytest.fixture(scope="module")
def df(spark, sample):
    rows = [(i, *map(float, r[:4]), int(r[4]), "uvw"[i % 3]) for i, r in enumerate(zip(*sample))]
    return spark.createDataFrame(rows, "id int, a double, b double, z double, y double, label int, g string").repartition(4).cache()


def stats_of(basis, y):
    return Gram(basis.T @ basis, basis.T @ y, float(y @ y), len(y), len(y))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_whole_thin_plate_basis_is_the_smoothing_spline(order):
    rng = np.random.default_rng(order)
    x = np.sort(rng.uniform(3, 9, 25))
    y, lam = np.sin(x) + rng.normal(0, 0.2, 25), 1e-4
    term = smooth.thin_plate("x", x, 25, order)
    design = Design((Constant(), term))
    basis = np.hstack([np.ones((25, 1)), term.evaluate(x)])
    fit = smooth.restricted_likelihood(stats_of(basis, y), smooth.penalty_groups(design), np.array([lam]))[1]
    raw = term.raw(x)  # the plain system: (E + lam I) d + T a = y, T'd = 0
    kernel, poly = raw[:, :25], raw[:, 25:]
    whole = np.block([[kernel + lam * np.eye(25), poly], [poly.T, np.zeros((order, order))]])
    solution = np.linalg.solve(whole, np.r_[y, np.zeros(order)])
    assert np.allclose(basis @ fit, raw @ solution, atol=1e-6)


@pytest.mark.parametrize("kind", ["tp", "ps"])
def test_penalties_are_the_best_of_a_grid(sample, kind):
    a, b, _, y, _ = sample
    make = (lambda n, x: smooth.thin_plate(n, np.quantile(x, np.linspace(0, 1, 40)), 12)) if kind == "tp" else (lambda n, x: smooth.p_spline(n, x.min(), x.max(), 12))
    design = Design((Constant(), make("a", a), make("b", b)))
    basis = np.hstack([np.ones((N, 1)), *[t.evaluate(x) for t, x in zip(design.blocks[1:], (a, b))]])
    stats, groups = stats_of(basis, y), smooth.penalty_groups(design)
    fit = smooth.choose_penalties(stats, groups)
    grid = np.logspace(-8, 12, 41)
    best = min(smooth.restricted_likelihood(stats, groups, np.array([p, q]))[0] for p in grid for q in grid)
    assert fit.criterion <= best + 1e-3
    for j in range(2):  # no slope, or the end of the range
        up, down = fit.lams.copy(), fit.lams.copy()
        up[j] *= 1.01
        down[j] /= 1.01
        slope = smooth.restricted_likelihood(stats, groups, up)[0] - smooth.restricted_likelihood(stats, groups, down)[0]
        assert abs(slope) < 2e-3


@pytest.mark.parametrize("kind", ["tp", "ps"])
def test_wiggly_and_straight_terms(spark, df, sample, kind):
    model = smooth.fit_smooth_gam(df, "y", ["a", "b"], max_k=15, kind=kind)
    assert model.info["edf"]["a"] > 9 and 0.99 < model.info["edf"]["b"] < 1.6  # a line counts one beside the constant
    assert model.loss(df, "y") < 0.11
    one = spline.fit_spline_gam(df, "y", ["a", "b"], n_splines=15)
    assert model.info["edf"]["b"] < 0.5 * (one.info["edf"] - model.info["edf"]["a"])  # one penalty for both cannot do that
    band = spline.partial_dependence(spark, model, 30).where("feat_name = 'b'").orderBy("x").collect()
    slopes = np.diff([r["y"] for r in band]) / np.diff([r["x"] for r in band])
    assert np.allclose(slopes, 2, atol=0.35) and all(r["lower"] < r["y"] < r["upper"] for r in band)


def test_select_removes_a_term_and_gamma_smooths(df):
    plain = smooth.fit_smooth_gam(df, "y", ["a", "b", "z"], max_k=10)
    chosen = smooth.fit_smooth_gam(df, "y", ["a", "b", "z"], max_k=10, select=True)
    assert chosen.info["edf"]["z"] < 0.6 < plain.info["edf"]["z"] + 0.01 and chosen.info["edf"]["b"] > 0.9
    smoother = smooth.fit_smooth_gam(df, "y", ["a", "b", "z"], max_k=10, gamma=20.0)
    assert smoother.info["edf"]["a"] < plain.info["edf"]["a"]


def test_classes_levels_and_few_values(df, sample):
    rows = df.withColumn("two", (F.col("a") > 0).cast("double")).withColumn("one", F.lit(1.0)).withColumn("b5", F.floor(F.col("b") * 5).cast("double"))
    kinds = {b.name: b for b in smooth.smooth_design(rows, ["one", "two", "b5", "a"], ["g"], 8).blocks}
    assert "one" not in kinds and isinstance(kinds["two"], Linear) and kinds["b5"].size == 4 and kinds["a"].size == 7 and kinds["g"].levels == ("v", "w")
    model = smooth.fit_smooth_gam(rows, "label", ["a", "b"], ["g"], "classification", max_k=12)
    a, b, _, _, label = sample
    score = 2 * np.sin(2 * a) + 2 * b - 1
    truth = np.mean(np.logaddexp(0, score) - label * score)
    assert model.loss(rows, "label") < truth + 0.01 and model.info["passes"] < 20
    assert model.info["edf"]["b"] < 2.5 < model.info["edf"]["a"]


def test_regression_spline_has_penalties_of_its_own(df):
    model = spline.fit_regression_spline(df, "y", ["a", "b"], ["g"], max_k=12)
    assert len(model.info["lam"]) == 2 and model.info["edf"]["a"] > 7 and model.info["edf"]["b"] < 1.6
    missing = df.withColumn("a", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("a")))
    assert abs(spline.fit_regression_spline(missing, "y", ["a", "b"], max_k=12).info["edf"]["b"] - 1) < 0.6
    with pytest.raises(ValueError):
        smooth.fit_smooth_gam(df, "y", ["a"], kind="cr")
