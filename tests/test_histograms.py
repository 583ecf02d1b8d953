"""Trees on histograms against plain greedy trees over the rows."""

import numpy as np
import pytest
from gamspark.models import histograms as hg
from gamspark.models import trees
from gamspark.operators import effects as fx
from pyspark.sql import functions as F

N = 1200


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 12, N) / 2.0, rng.integers(0, 9, N) / 10.0
    g = rng.choice(["u", "v", "w"], N, p=[0.6, 0.3, 0.1])
    y = 2 * (a > 2) * (b > 0.35) + np.sin(a) + (g == "v") * 0.8 + rng.normal(0, 0.2, N)
    label = (rng.random(N) < 1 / (1 + np.exp(-(y - 1) * 2))).astype(int)
    return a, b, g, y, label


@pytest.fixture(scope="module")
def df(spark, sample):
    rows = [(i, float(a), float(b), str(g), float(y), int(lab)) for i, (a, b, g, y, lab) in enumerate(zip(*sample))]
    return spark.createDataFrame(rows, "id int, a double, b double, g string, y double, label int").repartition(5).cache()


def columns(sample):
    a, b, g = sample[:3]
    return [a, b, *[(g == lv).astype(float) for lv in "uvw"]]


def plain_tree(x, grad, curv, leaves=None, depth=None, lam=0.0, weight=0.0):
    """Leaves (row masks) of a best-first tree over all cuts, and their Newton steps."""

    def split(mask, level):
        if depth is not None and level >= depth:
            return None
        best = None
        score = lambda m: grad[m].sum() ** 2 / (curv[m].sum() + lam)
        for f, values in enumerate(x):
            for cut in np.unique(values[mask])[:-1]:
                left, right = mask & (values <= cut), mask & (values > cut)
                if min(curv[left].sum(), curv[right].sum()) < weight:
                    continue
                gain = (score(left) + score(right) - score(mask)) / 2
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, left, right)
        return best

    whole = np.ones(len(grad), dtype=bool)
    open_ = [(split(whole, 0), whole, 0)]
    while leaves is None or len(open_) < leaves:
        known = [o for o in open_ if o[0]]
        if not known:
            break
        top = max(known, key=lambda o: o[0][0])
        open_ = [o for o in open_ if o is not top]
        open_ += [(split(m, top[2] + 1), m, top[2] + 1) for m in top[0][1:]]
    out = np.zeros(len(grad))
    for _, mask, _ in open_:
        out[mask] = -grad[mask].sum() / (curv[mask].sum() + lam)
    return out, len(open_)


def scores(model, df, column="raw"):
    return np.array([r[0] for r in model.predict(df).orderBy("id").select(column).collect()])


@pytest.mark.parametrize("leaves,depth", [(2, None), (5, None), (9, None), (None, 2), (7, 3)])
def test_best_first_tree_equals_greedy_splits(df, sample, leaves, depth):
    y = sample[3]
    model = hg.fit_best_first_tree(df, "y", ["a", "b"], ["g"], max_leaf_nodes=leaves, max_depth=depth)
    want, count = plain_tree(columns(sample), -y, np.ones(N), leaves, depth)
    assert model.info["leaves"] == count and np.allclose(scores(model, df), want)
    assert model.info["passes"] <= model.info["depth"] + 3


def test_tree_of_classes_and_weights(df, sample):
    label = sample[4]
    model = trees.fit_tree(df, "label", ["a", "b"], ["g"], "classification", max_depth=None, max_leaf_nodes=6, max_bins=64)
    want, _ = plain_tree(columns(sample), -label.astype(float), np.ones(N), 6)
    assert np.allclose(scores(model, df, "probability"), want, atol=1e-6)
    balanced = trees.fit_tree(df, "label", ["a", "b"], ["g"], "classification", max_depth=None, max_leaf_nodes=6, class_weight="balanced", max_bins=64)
    w = np.where(label == 1, N / 2 / label.sum(), N / 2 / (N - label.sum()))
    want, _ = plain_tree(columns(sample), -label * w, w, 6)
    assert np.allclose(scores(balanced, df, "probability"), want, atol=1e-6)


def test_random_cuts_repeat_and_differ_by_seed(df):
    fit = lambda seed, rows: scores(trees.fit_tree(rows, "y", ["a", "b"], ["g"], max_leaf_nodes=8, splitter="random", seed=seed, max_bins=64), rows)
    first = fit(1, df)
    assert np.allclose(first, fit(1, df.repartition(3))) and not np.allclose(first, fit(2, df))
    assert len(np.unique(first.round(9))) == 8


@pytest.mark.parametrize("task,target", [("regression", "y"), ("classification", "label")])
def test_boosting_equals_plain_newton_steps(df, sample, task, target):
    truth = sample[3] if task == "regression" else sample[4].astype(float)
    model = hg.fit_newton_boosting(df, target, ["a", "b"], ["g"], task, n_estimators=11, max_depth=2, learning_rate=0.4, reg_lambda=2.0, min_child_weight=5.0)
    score = np.full(N, truth.mean() if task == "regression" else np.log(truth.mean() / (1 - truth.mean())))
    for _ in range(11):
        p = 1 / (1 + np.exp(-score))
        grad, curv = (score - truth, np.ones(N)) if task == "regression" else (p - truth, p * (1 - p))
        score = score + 0.4 * plain_tree(columns(sample), grad, curv, None, 2, 2.0, 5.0)[0]
    assert np.allclose(scores(model, df), score, atol=1e-7)
    assert model.info["passes"] == 22
    other = hg.fit_newton_boosting(df.repartition(2), target, ["a", "b"], ["g"], task, n_estimators=11, max_depth=2, learning_rate=0.4, reg_lambda=2.0, min_child_weight=5.0)
    assert np.allclose(scores(other, df), score, atol=1e-7)


def test_subsamples_do_not_depend_on_partitions(df):
    fit = lambda rows: hg.fit_newton_boosting(rows, "y", ["a", "b"], ["g"], n_estimators=4, max_depth=3, subsample=0.5, key=["id"])
    one, many = fit(df.coalesce(1)), fit(df.repartition(7))
    assert np.allclose(scores(one, df), scores(many, df))
    assert not np.allclose(scores(one, df), scores(hg.fit_newton_boosting(df, "y", ["a", "b"], ["g"], n_estimators=4, max_depth=3), df))


def test_validation_rows_stop_the_fit(df, sample):
    held = df.withColumn("val", F.col("id") % 4 == 0)
    model = hg.fit_newton_boosting(held, "y", ["a", "b"], ["g"], n_estimators=60, max_depth=4, learning_rate=0.5, validation="val", early_stopping=3)
    losses = model.info["validation_losses"]
    assert len(model.trees) == int(np.argmin(losses)) < 60
    val = np.arange(N) % 4 == 0
    assert np.isclose(np.mean((scores(model, df) - sample[3])[val] ** 2), min(losses))


@pytest.mark.parametrize("task,target", [("regression", "y"), ("classification", "label")])
def test_stumps_are_an_additive_model(df, task, target):
    rows = df.withColumn("a", F.when(F.col("id") % 9 == 0, F.lit(None)).otherwise(F.col("a"))).withColumn("g", F.when(F.col("id") % 7 > 0, F.col("g")))
    model = hg.fit_newton_boosting(rows, target, ["a", "b"], ["g"], task, n_estimators=15, max_depth=1)
    same = model.additive()
    assert np.allclose(scores(model, rows), scores(same, rows))
    table = fx.center_effects(same.effects(rows.where("a IS NOT NULL AND g IS NOT NULL")))
    assert table.where("feat_idx >= 0").select("feat_name").distinct().count() == 3
    with pytest.raises(ValueError):
        hg.fit_newton_boosting(rows, target, ["a"], [], task, n_estimators=1, max_depth=2).additive()


def test_odd_inputs(spark, df):
    none = hg.fit_best_first_tree(df, "y", [], [], max_leaf_nodes=4)
    assert np.allclose(scores(none, df), df.agg(F.avg("y")).first()[0])
    flat = hg.fit_best_first_tree(df.withColumn("y", F.lit(2.0)), "y", ["a"], [], max_leaf_nodes=4)
    assert flat.info["leaves"] == 1 and np.allclose(scores(flat, df), 2.0)
    holes = df.withColumn("y", F.when(F.col("id") % 2 == 0, F.col("y")))
    assert hg.fit_best_first_tree(holes, "y", ["a"], [], max_leaf_nodes=3).info["leaves"] == 3
    for bad in ({"max_leaf_nodes": 1}, {"splitter": "worst"}):
        with pytest.raises(ValueError):
            hg.fit_best_first_tree(df, "y", ["a"], **bad)


def test_passes_send_only_what_they_add_up(spark, monkeypatch):
    """Keys of a draw, the draw and the validation mark travel to the workers only where a fit uses them."""
    df = spark.createDataFrame([(i, float(i % 9), "uvw"[i % 3], float(i % 9 > 4) + (i % 3), i % 5 == 0) for i in range(300)], "id int, a double, g string, y double, v boolean")
    sent, inner = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: sent.append(set(self.columns)) or inner(self, *a, **k))
    model = hg.fit_newton_boosting(df, "y", ["a"], ["g"], n_estimators=3, max_depth=1, key=["id"])
    passes = [s for s in sent if "__score" in s]
    codes = {f"__c{i}" for i in range(len(model.bins.widths))}
    assert passes and all(s == codes | {"__y", "__w", "__score"} for s in passes) and not any(n.startswith("__k") for s in sent for n in s)
    sent.clear()
    hg.fit_newton_boosting(df, "y", ["a"], ["g"], n_estimators=2, max_depth=1, key=["id"], subsample=0.5, validation="v")
    assert all(s == codes | {"__y", "__w", "__score", "__d", "__h"} for s in sent if "__score" in s)
