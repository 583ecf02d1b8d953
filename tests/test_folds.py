"""Folds and candidates from shared passes equal separate fits, and the passes do not grow with them."""

import numpy as np
import pytest
from gamspark.models import evaluate, folds, linear, spline
from gamspark.models import gram as gm
from gamspark.operators import encode, metrics
from pyspark.sql import functions as F

N = 1600


def fold_of():
    return F.col("id") % 3


def held():
    return (F.col("id") % 7) < 2



@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(11)
    a, b = rng.integers(-8, 9, N) / 4.0, rng.integers(0, 13, N) / 3.0
    g = rng.choice(["u", "v", "w"], N)
    y = 5 + 3 * a + 2 * np.sin(2 * b) + (g == "v") + rng.normal(0, 0.5, N)
    label = (rng.random(N) < 1 / (1 + np.exp(-(2 * a - np.sin(2 * b))))).astype(int)
    rows = [(i, float(p), float(q), str(r), float(s), int(t)) for i, (p, q, r, s, t) in enumerate(zip(a, b, g, y, label))]
    return spark.createDataFrame(rows, "id int, a double, b double, g string, y double, label int").repartition(4).cache()


def part(df, k, target=None):
    """Train, validation, whole training and test rows of a fold."""
    rows = df
    if target:
        rows = encode.standard_scale(df.where(fold_of() != k), [target]).transform(df)
    return rows.where((fold_of() != k) & ~held()), rows.where((fold_of() != k) & held()), rows.where(fold_of() != k), rows.where(fold_of() == k)


GRIDS = {
    "ridge": [{"alpha": 1.0}, {"alpha": 3000.0}],
    "elastic_net": [{"alpha": 0.01, "l1_ratio": 1.0}, {"alpha": 0.5, "l1_ratio": 0.5}, {"beta": 3}],
    "spline_gam": [{"n_splines": 8, "lam": 0.5}, {"n_splines": 12}],
}


def test_regression_equals_separate_fits(spark, df):
    trials, reports = folds.shared_evaluation(df, "toy", ["id"], "y", ["a", "b"], ["g"], "regression", GRIDS, 3, fold=fold_of(), val=held())
    got = {(r["model"], r["fold"], r["config_id"]): r for r in trials.collect()}
    assert len(got) == 3 * 7 and all(r["failed"] == (k[0] == "elastic_net" and k[2] == 2) for k, r in got.items())
    found = {(r["model"], r["fold"], r["metric"]): r["value"] for r in reports.collect()}
    for k in range(3):
        train, val, whole, test = part(df, k, "y")
        for name, grid in GRIDS.items():
            losses = []
            for i, params in enumerate(grid):
                if got[name, k, i]["failed"]:
                    continue
                model = evaluate.FITS[name](train, "y", ["a", "b"], ["g"], "regression", **params)
                losses.append((model.loss(val, "y"), i))
                assert np.isclose(losses[-1][0], got[name, k, i]["loss"], rtol=1e-6)
            refit = evaluate.FITS[name](whole, "y", ["a", "b"], ["g"], "regression", **grid[min(losses)[1]])
            line = metrics.regression_report(refit.predict(test), "y", "prediction").first()
            assert np.isclose(line["RMSE"], found[name, k, "RMSE"], rtol=1e-6) and np.isclose(line["MAE"], found[name, k, "MAE"], rtol=1e-6)
    table = evaluate.report_tables(spark, reports, "RMSE", ["ridge", "spline_gam"]).first()
    assert table["spline_gam"] < table["ridge"]


def test_boosting_candidates_share_the_pass(df):
    grid = [{"max_bins": 16, "rounds": 60}, {"max_bins": 16, "rounds": 60, "learning_rate": 0.02}]
    trials, reports = folds.shared_evaluation(df, "toy", ["id"], "y", ["a", "b"], ["g"], "regression", {"binned_boosting": grid}, 3, fold=fold_of(), val=held())
    got = {(r["fold"], r["config_id"]): r["loss"] for r in trials.collect()}
    train, val, _, _ = part(df, 0, "y")
    for i, params in enumerate(grid):
        model = evaluate.FITS["binned_boosting"](train, "y", ["a", "b"], ["g"], "regression", key=["id"], **params)
        assert np.isclose(model.loss(val, "y"), got[0, i], rtol=1e-6)
    assert reports.where("metric = 'R2'").agg(F.min("value")).first()[0] > 0.8


def test_classes_equal_separate_fits(df):
    grids = {"logistic": [{"C": 0.01}, {"C": 1.0}, {"penalty": "l1", "C": 0.1}], "spline_gam": [{"n_splines": 8, "lam": 1.0}]}
    trials, reports = folds.shared_evaluation(df, "toy", ["id"], "label", ["a", "b"], ["g"], "classification", grids, 3, fold=fold_of(), val=held())
    got = {(r["model"], r["fold"], r["config_id"]): r["loss"] for r in trials.collect()}
    train, val, whole, test = part(df, 1)
    for i, params in enumerate(grids["logistic"]):
        model = linear.fit_logistic(train, "label", ["a", "b"], ["g"], scale=False, **params)
        assert np.isclose(model.loss(val, "label"), got["logistic", 1, i], rtol=1e-6)
    smooth = spline.fit_spline_gam(train, "label", ["a", "b"], ["g"], "classification", n_splines=8, lam=1.0)
    assert np.isclose(smooth.loss(val, "label"), got["spline_gam", 1, 0], rtol=1e-6)
    refit = spline.fit_spline_gam(whole, "label", ["a", "b"], ["g"], "classification", n_splines=8, lam=1.0)
    want = {(r, m): v for r, m, v in evaluate.fold_report(refit.predict(test), "label", "classification")}
    found = {(r["row"], r["metric"]): r["value"] for r in reports.where("model = 'spline_gam' AND fold = 1 AND row <> 'timing'").collect()}
    assert found.keys() == want.keys() and all(np.isclose(found[k], want[k]) for k in want)


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    for frame in run():
        frame.count()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_passes_do_not_grow_with_folds_and_candidates(spark, df, monkeypatch):
    passes, plain = [0], gm.block_sums

    def counted(partial):
        passes[0] += 1
        return plain(partial)

    monkeypatch.setattr(gm, "block_sums", counted)

    def run(k, n, task, family):
        grid = [{"alpha" if task == "regression" else "C": 0.1 * 2**i} for i in range(n)]
        passes[0] = 0
        target = "y" if task == "regression" else "label"
        jobs = jobs_of(spark, f"{task}{k}{n}", lambda: folds.shared_evaluation(df, "toy", ["id"], target, ["a", "b"], ["g"], task, {family: grid}, k, fold=F.col("id") % k, val=held()))
        return passes[0], jobs

    few, many = run(2, 1, "regression", "ridge"), run(5, 8, "regression", "ridge")
    assert few == many and few[0] == 1
    few, many = run(2, 1, "classification", "logistic"), run(5, 8, "classification", "logistic")
    assert many[0] <= few[0] + 4  # the longest of the fits, not their sum


def test_grid_search_in_one_pass(df):
    trials = folds.shared_grid_search(df, "y", ["a", "b"], ["g"], "regression", "ridge", [{"alpha": 1e6}, {"nonsense": 1}, {"alpha": 0.0}], held())
    other = evaluate.grid_search(evaluate.FITS["ridge"], df.where(~held()), df.where(held()), "y", ["a", "b"], ["g"], "regression", [t.params for t in trials])
    assert [t.failed for t in trials] == [t.failed for t in other] == [False, True, False]
    assert all(np.isclose(t.loss, o.loss) for t, o in zip(trials, other) if not t.failed) and evaluate.best_trial(trials).config_id == 2
    assert np.isclose(trials[2].model.loss(df.where(held()), "y"), trials[2].loss)
    classes = folds.shared_grid_search(df, "label", ["a", "b"], [], "classification", "logistic", [{"C": 1.0}, {"C": 0.001}], held())
    alone = linear.fit_logistic(df.where(~held()), "label", ["a", "b"], scale=False, C=1.0)
    assert np.isclose(classes[0].loss, alone.loss(df.where(held()), "label"))
    with pytest.raises(ValueError):
        folds.shared_grid_search(df, "y", ["a"], [], "regression", "forest", [{}], held())


def test_folds_of_their_own(df):
    trials, reports = folds.shared_evaluation(df, "toy", ["id"], "y", ["a"], [], "regression", {"ridge": [{}]}, 4)
    assert trials.count() == 4 and reports.where("metric = 'RMSE'").count() == 4
    trials, reports = folds.shared_evaluation(df, "toy", ["id"], "y", ["a"], [], "regression", {"logistic": [{}]}, 2)
    assert trials.where("failed").count() == 2 and reports.count() == 0
