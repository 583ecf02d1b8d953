import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from gamspark.models import bagging, boosting, evaluate, hidden, interactions, linear, spline, trees
from gamspark.models import gram as gm
from gamspark.models.design import Bins, Constant, Design, Hidden, Levels, Linear, PairBins, Spline
from gamspark.operators import effects as fx

N = 3000


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=N), rng.uniform(-2, 2, N)
    g = rng.choice(["u", "v", "w"], N, p=[0.6, 0.3, 0.1])
    y = 1.5 * a + np.sin(2 * b) + np.where(g == "v", 0.7, 0.0) + 0.6 * a * (b > 0) + rng.normal(0, 0.3, N)
    label = (rng.random(N) < 1 / (1 + np.exp(-(2 * a - b + (g == "v"))))).astype(int)
    return a, b, g, y, label


@pytest.fixture(scope="module")
def df(spark, sample):
    rows = [(i, float(a), float(b), str(g), float(y), int(lab)) for i, (a, b, g, y, lab) in enumerate(zip(*sample))]
    out = spark.createDataFrame(rows, "id int, a double, b double, g string, y double, label int").repartition(5).cache()
    out.count()
    return out


def batch(sample, **extra):
    a, b, g, y, label = sample
    return pa.RecordBatch.from_pydict({"a": a, "b": b, "g": [str(x) for x in g], **extra})


DESIGN = Design((Constant(), Linear("a"), Levels("g", ("u", "w")), Spline("b", -2.0, 2.0, 7)))


def test_gram_equals_numpy(df, sample, monkeypatch):
    basis, y = DESIGN.build(batch(sample)), sample[3]
    for block in (8192, 7, 50):
        monkeypatch.setattr(gm, "BLOCK", block)
        stats = gm.gram(df, DESIGN, "y")[0]
        assert np.allclose(stats.g, basis.T @ basis) and np.allclose(stats.b, basis.T @ y)
        assert np.isclose(stats.yy, y @ y) and stats.rows == N


def test_groups_and_weights(df, sample):
    basis, y, a = DESIGN.build(batch(sample)), sample[3], sample[0]
    groups = gm.gram(df, DESIGN, "y", group=(F.col("a") > 0).cast("int"))
    assert np.allclose(groups[1].g, basis[a > 0].T @ basis[a > 0]) and np.allclose((groups[0] + groups[1]).b, basis.T @ y)
    weighted = gm.gram(df.withColumn("w", F.abs("a")).withColumn("z", (F.col("a") > 1).cast("int")), DESIGN, "y", ["w", "z"])
    assert np.allclose(weighted[0].g, basis.T @ (basis * np.abs(a)[:, None]))
    assert np.allclose(weighted[1].b, basis[a > 1].T @ y[a > 1]) and weighted[1].rows == np.sum(a > 1)


def test_counted_products_equal_dense_products(df, sample):
    design = Design((Constant(), Bins("a", (-1.0, 0.0, 1.0)), Levels("g", ("u", "w")), PairBins(Bins("a", (0.0,)), Bins("b", (-1.0, 1.0)))))
    assert design.indicators
    basis, y = design.build(batch(sample)), sample[3]
    stats = gm.gram(df, design, "y")[0]
    assert np.allclose(stats.g, basis.T @ basis) and np.allclose(stats.b, basis.T @ y)
    beta = np.arange(design.size, dtype=float)
    assert np.allclose(design.score(batch(sample), beta), basis @ beta)
    got = np.array([r[0] for r in df.orderBy("id").select(gm.score_column(design, beta)).collect()])
    assert np.allclose(got, basis @ beta)


def test_too_wide_a_basis_is_refused(df):
    with pytest.raises(ValueError):
        gm.gram(df, Design((Bins("a", tuple(np.linspace(-3, 3, 4000))),)), "y")


def test_ridge_closed_form(df, sample):
    a, b, g, y, _ = sample
    x = np.column_stack([a, b])
    model = linear.fit_ridge(df, "y", ["a", "b"], alpha=3.0, intercept=False)
    assert np.allclose(model.beta, np.linalg.solve(x.T @ x + 3 * np.eye(2), x.T @ y))
    xc, yc = x - x.mean(0), y - y.mean()
    free = linear.fit_ridge(df, "y", ["a", "b"], alpha=3.0)
    assert np.allclose(free.beta[1:], np.linalg.solve(xc.T @ xc + 3 * np.eye(2), xc.T @ yc))


@pytest.mark.parametrize("alpha,ratio", [(0.1, 1.0), (0.3, 0.5), (0.2, 0.0)])
def test_elastic_net_optimality(df, sample, alpha, ratio):
    a, b, g, y, _ = sample
    model = linear.fit_elastic_net(df, "y", ["a", "b"], ["g"], alpha, ratio)
    basis = model.design.build(batch(sample))[:, 1:]
    w = model.beta[1:]
    grad = (basis - basis.mean(0)).T @ (y - basis @ w - model.beta[0]) / N - alpha * (1 - ratio) * w
    for gj, wj in zip(grad, w):
        assert abs(gj - alpha * ratio * np.sign(wj)) < 1e-6 if wj else abs(gj) <= alpha * ratio + 1e-6
    assert abs(np.mean(y - basis @ w) - model.beta[0]) < 1e-9


@pytest.mark.parametrize("penalty,ratio", [("l2", None), ("l1", None), ("elasticnet", 0.4), ("none", None)])
@pytest.mark.parametrize("balanced", [None, "balanced"])
def test_logistic_equals_the_library(df, penalty, ratio, balanced):
    model = linear.fit_logistic(df, "label", ["a", "b"], C=0.05, penalty=penalty, l1_ratio=ratio, class_weight=balanced, scale=False)
    from gamspark.operators.encode import balanced_weights

    rows = balanced_weights(df, "label") if balanced else df.withColumn("weight", F.lit(1.0))
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(rows)
    reg = 0.0 if penalty == "none" else 1 / (0.05 * N)
    other = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=reg, standardization=False, tol=1e-10,
                               elasticNetParam={"l1": 1.0, "l2": 0.0, "none": 0.0}.get(penalty, ratio), maxIter=500).fit(rows)
    assert np.allclose(model.beta, [other.intercept, *other.coefficients], atol=2e-4)


def test_spline_basis():
    x = np.linspace(-1, 3, 200)
    for degree, k in ((3, 8), (2, 5), (1, 4), (3, 4)):
        basis = Spline("x", -1.0, 3.0, k, degree).evaluate(x)
        assert np.allclose(basis.sum(1), 1) and basis.min() >= 0
        coef = np.linalg.lstsq(basis, 2 * x - 1, rcond=None)[0]
        assert np.allclose(basis @ coef, 2 * x - 1)


def test_spline_gam_finds_the_curve(spark, df, sample):
    model = spline.fit_spline_gam(df, "y", ["a", "b"], ["g"])
    linear_loss = linear.fit_ridge(df, "y", ["a", "b"], ["g"], 0.0).loss(df, "y")
    assert model.loss(df, "y") < 0.6 * linear_loss
    edfs = [e for _, e, _ in model.info["path"]]
    assert edfs == sorted(edfs, reverse=True)
    band = spline.partial_dependence(spark, model, 20).where("feat_name = 'b'").orderBy("x").collect()
    assert all(r["lower"] <= r["y"] <= r["upper"] for r in band)
    curve = np.array([r["y"] for r in band])
    truth = np.sin(2 * np.linspace(-2, 2, 20))
    assert np.corrcoef(curve, truth)[0, 1] > 0.9


def test_effects_reproduce_the_model(df):
    model = spline.fit_spline_gam(df.withColumn("b", F.round("b", 1)), "y", ["b"], ["g"], n_splines=8)
    rows = df.withColumn("b", F.round("b", 1))
    scored = fx.score_by_effects(rows, fx.center_effects(model.effects(rows)), ["b"], ["g"]).withColumn("raw", model.raw())
    assert scored.agg(F.max(F.abs(F.col("score") - F.col("raw")))).first()[0] < 1e-9


def test_logit_spline_and_basis_rule(df):
    model = spline.fit_spline_gam(df, "label", ["a", "b"], ["g"], "classification", n_splines=8)
    logit = linear.fit_logistic(df, "label", ["a", "b"], ["g"], penalty="none")
    assert model.loss(df, "label") < logit.loss(df, "label") + 0.01 and model.info["passes"] <= 25
    few = df.withColumn("one", F.lit(1.0)).withColumn("two", (F.col("a") > 0).cast("double")).withColumn("five", F.floor((F.col("b") + 2) * 1.2))
    kinds = {b.name: b for b in spline.regression_spline_design(few, ["one", "two", "five", "b"], ["g"], 6).blocks}
    assert "one" not in kinds and isinstance(kinds["two"], Linear) and kinds["five"].size == 5 and kinds["b"].size == 6


def test_singular_penalties_are_skipped():
    zero = gm.Gram(np.zeros((2, 2)), np.ones(2), 5.0, 10.0, 10.0)
    best, path = spline.search_lambda(zero, np.eye(2), [0.0, 1.0], np.zeros(2))
    assert best[0] == 1.0 and len(path) == 1


def test_boosting_on_the_gram_equals_boosting_on_rows(sample):
    a, b, g, y, _ = sample
    design = Design((Bins("a", (-1.0, 0.0, 1.0)), Bins("b", (-1.0, 0.5))))
    basis = design.build(batch(sample))
    stats = gm.Gram(basis.T @ basis, basis.T @ y, float(y @ y), N, N)
    f, _ = boosting.cyclic_boost(design, [stats], None, 0.1, 30, 3, 50)
    score, want = np.zeros(N), np.zeros(design.size)
    for _ in range(30):
        for sl in design.slices:
            codes = basis[:, sl].argmax(1)
            sums = np.bincount(codes, y - score, sl.stop - sl.start)
            step = 0.1 * boosting.tree_step(np.bincount(codes, minlength=sl.stop - sl.start).astype(float), sums, 3)
            want[sl] += step
            score += step[codes]
    assert np.allclose(f, want, atol=1e-8)


def test_tree_step_finds_the_best_cuts():
    counts, means = np.array([5.0, 5, 5, 5, 0, 5]), np.array([0.0, 0, 3, 3, 9, -2])
    filled = counts > 0  # an empty bin may go with either neighbour
    assert np.allclose(boosting.tree_step(counts, counts * means, 3)[filled], [0, 0, 3, 3, -2])
    nominal = boosting.tree_step(np.ones(5), np.array([4.0, 0, 4, 0, 4]), 2, ordered=False)
    assert np.allclose(nominal, [4, 0, 4, 0, 4])


def test_binned_boosting(df):
    plain = boosting.fit_binned_boosting(df, "y", ["a", "b"], ["g"], key=["id"], max_bins=32)
    paired = boosting.fit_binned_boosting(df, "y", ["a", "b"], ["g"], key=["id"], max_bins=32, interactions=1, outer_bags=2, inner_bags=2)
    base = linear.fit_ridge(df, "y", ["a", "b"], ["g"], 0.0).loss(df, "y")
    assert plain.loss(df, "y") < 0.65 * base
    assert paired.info["pairs"] == [("a", "b")] and paired.loss(df, "y") < plain.loss(df, "y")
    table = plain.effects(df)
    assert all(abs(r["m"]) < 1e-6 for r in table.where("feat_idx >= 0").groupBy("feat_name").agg(
        (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("m")).collect())
    ranges = df.agg(F.min("a").alias("lo_a"), F.max("a").alias("hi_a"), F.min("b").alias("lo_b"), F.max("b").alias("hi_b"))
    pair = next(i for i, b in enumerate(paired.design.blocks) if isinstance(b, PairBins))
    n = np.diag(gm.gram(df, Design((paired.design.blocks[pair],)), "y")[0].g).reshape(paired.design.blocks[pair].first.size, -1)
    cells = paired.beta[paired.design.slices[pair]].reshape(n.shape)
    assert np.allclose((cells * n).sum(0), 0, atol=1e-6) and np.allclose((cells * n).sum(1), 0, atol=1e-6)
    surface = paired.surface(ranges.select("*", F.lit("a").alias("feat_a"), F.lit("b").alias("feat_b")), "a", "b", 5)
    assert surface.count() == 25


def test_purified_pairs(df):
    rng = np.random.default_rng(4)
    first, second = Bins("a", (-1.0, 0.0, 1.0)), Bins("b", (-0.5, 0.5))
    design = Design((Constant(), Bins("a", (0.3,)), PairBins(first, second)))
    beta = rng.normal(size=design.size)
    counts = np.diag(gm.gram(df, design, "y")[0].g)
    pure, moved = boosting.purify(design, beta, counts)
    assert [b.name for b in pure.blocks] == ["intercept", "a", "a x b", "a", "b"]
    found = df.select("id", gm.score_column(design, beta).alias("x"), gm.score_column(pure, moved).alias("y"))
    assert found.agg(F.max(F.abs(F.col("x") - F.col("y")))).first()[0] < 1e-12
    surface, n = moved[pure.slices[2]].reshape(4, 3), counts[design.slices[2]].reshape(4, 3)
    assert np.allclose((surface * n).sum(0), 0, atol=1e-8) and np.allclose((surface * n).sum(1), 0, atol=1e-8)
    assert abs(moved[pure.slices[3]] @ n.sum(1)) < 1e-8 and abs(moved[pure.slices[4]] @ n.sum(0)) < 1e-8
    empty = counts.copy()
    empty[design.slices[2].start + 1] = 0.0
    pure, moved = boosting.purify(design, beta, empty)
    again = df.select("id", gm.score_column(design, beta).alias("x"), gm.score_column(pure, moved).alias("y"))
    assert again.agg(F.max(F.abs(F.col("x") - F.col("y")))).first()[0] < 1e-12


def test_binned_boosting_of_classes(df):
    model = boosting.fit_binned_boosting(df, "label", ["a", "b"], ["g"], "classification", key=["id"], max_bins=16, rounds=200)
    best = linear.fit_logistic(df, "label", ["a", "b"], ["g"], penalty="none").loss(df, "label")
    assert model.loss(df, "label") < best + 0.03
    out = model.predict(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert out > 0.75


def test_hidden_boosting_equals_row_boosting(df, sample, monkeypatch):
    a, b, g, y, _ = sample
    monkeypatch.setattr(hidden, "BATCH_COLUMNS", 24)  # three learners per pass
    val = F.col("id") % 5 == 0
    model = hidden.fit_hidden_boosting(df, "y", ["a", "b"], val, n_hid=4, n_estimators=7, init_reg=0.05, early_stopping=0)
    assert len(model.learners) == 7
    train = np.arange(N) % 5 != 0
    score = model.start.build(batch(sample)) @ model.start_beta
    for k in range(7):
        h = hidden.learner_design(["a", "b"], [], 4, 1.0, 0.5, "elu", k).build(batch(sample))
        x = 0.1 * h[train]
        coef = np.linalg.solve(x.T @ x + np.eye(8), x.T @ (y - score)[train])
        score = score + 0.1 * h @ coef
    got = np.array([r[0] for r in df.orderBy("id").select(model.raw()).collect()])
    assert np.allclose(got, score, atol=1e-8)
    assert np.isclose(model.info["val_losses"][-1], np.mean((y - score)[~train] ** 2))


def test_hidden_boosting_of_classes_equals_row_boosting(df, sample):
    a, b, g, _, label = sample
    val = F.col("id") % 5 == 0
    model = hidden.fit_hidden_boosting(df, "label", ["a", "b"], val, "classification", n_hid=3, n_estimators=4, boost_rate=0.5,
                                       early_stopping=0, cut_every=2)
    train, y = np.arange(N) % 5 != 0, 2.0 * label - 1
    score = model.start.build(batch(sample)) @ model.start_beta
    for k in range(4):
        h = hidden.learner_design(["a", "b"], [], 3, 1.0, 0.5, "elu", k).build(batch(sample))
        w, z = 0.5 / np.cosh(0.5 * y * score), y / np.exp(0.5 * y * score)
        x = np.sqrt(0.5) * 0.5 * (w[:, None] * h)[train]
        coef = np.linalg.solve(x.T @ x + np.eye(6), x.T @ (np.sqrt(0.5) * z)[train])
        score = np.clip(score + 0.5 * h @ coef, -100, 100)
    got = np.array([r[0] for r in df.orderBy("id").select(model.raw()).collect()])
    assert np.allclose(got, score, atol=1e-7)


def test_early_stopping_cuts_back(df):
    stop = hidden._Stopping(5.0, 2)
    assert [stop.add(v) for v in (4.0, 4.1, 4.2, 4.3)] == [False, False, False, True] and stop.best_round == 1


def test_shape_functions_sum_to_the_raw_score(df):
    rows = df.withColumn("b", F.round("b", 1)).withColumn("a", F.round("a", 1))
    model = hidden.fit_hidden_boosting(rows, "y", ["a", "b"], F.col("id") % 4 == 0, n_hid=3, n_estimators=5, init_reg=0.05)
    scored = fx.score_by_effects(rows, model.shape_functions(rows), ["a", "b"]).withColumn("raw", model.raw())
    assert scored.agg(F.max(F.abs(F.col("score") - F.col("raw")))).first()[0] < 1e-9


@pytest.mark.parametrize("task,target", [("regression", "y"), ("classification", "label")])
def test_stump_effects_reproduce_the_model(df, task, target):
    rows = df.withColumn("b", F.round("b", 1)).withColumn("a", F.round("a", 1))
    model = trees.fit_boosted_trees(rows, target, ["a", "b"], ["g"], task, n_estimators=8, max_depth=1, learning_rate=0.4)
    table = trees.stump_effects(model, rows)
    wide = model.encoder.transform(model.predict(rows))
    scored = fx.score_by_effects(wide, table, model.encoder.names)
    assert scored.agg(F.max(F.abs(F.col("score") - F.col("raw")))).first()[0] < 1e-6


def test_tree_limits_are_explicit(df):
    for bad in ({"max_depth": 99}, {"max_leaf_nodes": 1}, {"splitter": "worst"}):
        with pytest.raises(ValueError):
            trees.fit_tree(df, "y", ["a"], **bad)


def test_last_correction_of_classes_counts(df):
    fit = lambda passes: boosting.fit_binned_boosting(df, "label", ["a", "b"], [], "classification", key=["id"], max_bins=8, rounds=30, passes=passes)
    one = fit(1)
    assert len(one.info["paths"][0]) == 2 and one.info["paths"][0][1] < one.info["paths"][0][0] and np.any(one.beta[1:] != 0)


def test_interaction_searches(df):
    rows = df.withColumn("c", F.rand(1)).withColumn("xor", (F.col("a") * F.col("b") > 0).cast("double"))
    cuts = {n: (-0.5, 0.0, 0.5) for n in ("a", "b", "c")}
    top = interactions.pair_strength(rows.withColumn("r", F.col("xor") - 0.5), "r", cuts).orderBy(F.desc("strength")).first()
    assert (top["feat_a"], top["feat_b"]) == ("a", "b")
    assert interactions.pairs_by_lasso(rows, "xor", ["a", "b", "c"], 1, ["id"], n_hid=8) == [("a", "b")]
    assert len(interactions.pairs_by_tree(rows, "xor", ["a", "b", "c"], 1)) == 1
    assert interactions.select_features(df.withColumn("c", F.rand(2)), "y", ["a", "b", "c"], 1) == ["a"]


def test_bagged_model(df):
    model = bagging.fit_bagged_ridge(df, "y", ["a", "b"], ["g"], bags=4, key=["id"])
    single = linear.fit_ridge(df, "y", ["a", "b"], ["g"])
    assert abs(model.loss(df, "y") / single.loss(df, "y") - 1) < 0.02
    bagged = bagging.fit_bagged(df, ["id"], lambda d: linear.fit_logistic(d, "label", ["a", "b"]), 2)
    assert bagged.task == "classification" and bagged.loss(df, "label") < 0.6


def test_trials_failures_and_retries(spark, df):
    done = evaluate.grid_search(evaluate.FITS["ridge"], df, df, "y", ["a", "b"], ["g"], "regression",
                                [{"alpha": 1e6}, {"nonsense": 1}, {"alpha": 0.0}])
    assert [t.failed for t in done] == [False, True, False] and evaluate.best_trial(done).config_id == 2
    with pytest.raises(RuntimeError):
        evaluate.best_trial([done[1]])
    tried = []

    def flaky(seed):
        tried.append(seed)
        if len(tried) < 3:
            raise ValueError("no")
        return "ok"

    assert evaluate.retry_next_seed(flaky, 7) == ("ok", 27) and tried == [7, 17, 27]


def test_nested_evaluation(spark, df):
    trials, reports = evaluate.nested_evaluation(df, "toy", ["id"], "y", ["a", "b"], ["g"], "regression",
                                                 {"ridge": [{"alpha": 1.0}, {"alpha": 1e9}], "spline_gam": [{"n_splines": 8}]}, folds=2)
    best = evaluate.best_configs(trials).where("model = 'ridge'").collect()
    assert len(best) == 2 and all(r["config_id"] == 0 for r in best)
    table = evaluate.report_tables(spark, reports, "RMSE", ["ridge", "spline_gam"]).first()
    assert table["spline_gam"] < table["ridge"] < 1.0


def test_validation_path(df):
    val = F.col("id") % 4 == 0
    model = spline.fit_by_validation(df, "y", ["a", "b"], ["g"], val, n_splines=10)
    losses = dict(model.info["validation_path"])
    assert losses[model.info["lam"]] == min(losses.values())
    lone = spline.fit_spline_gam(df.where(~val), "y", ["a", "b"], ["g"], n_splines=10, lam=model.info["lam"])
    assert abs(lone.loss(df.where(val), "y") - min(losses.values())) < 0.01
    both = spline.fit_spline_gam(df, "y", ["a", "b"], ["g"], n_splines=10, lam=model.info["lam"])
    assert np.allclose(both.beta, model.beta, atol=1e-6)


@pytest.mark.parametrize("fusion", ["avgagg", "w.majvote"])
def test_subspace_ensemble(df, fusion):
    model = bagging.fit_subspace_ensemble(df, "label", ["a", "b"], ["g"], members=3, key=["id"], fusion=fusion)
    assert all(len(m.numeric) + len(m.categorical) == 2 for m in model.members)
    right = model.predict(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.7
    with pytest.raises(ValueError):
        bagging.fit_subspace_ensemble(df, "label", ["a"], fusion="best")


@pytest.mark.parametrize("fit", [trees.fit_tree, trees.fit_forest, trees.fit_boosted_trees])
def test_parts_of_tree_fits_stay_below_a_number_of_values(df, monkeypatch, fit):
    """More rows give more parts, not larger ones: a task keeps its part as objects."""
    from pyspark.ml import Estimator

    from gamspark.functions import small

    monkeypatch.setattr(small, "PART_VALUES", 2000, raising=False)
    seen, inner = [], Estimator.fit
    monkeypatch.setattr(Estimator, "fit", lambda self, rows, *a: seen.append(rows.rdd.glom().map(len).collect()) or inner(self, rows, *a))
    kind = {} if fit is trees.fit_tree else {"n_estimators": 2}
    fit(df, "y", ["a", "b"], max_depth=1, **kind)
    assert sum(seen[0]) == N and max(seen[0]) * (small.ROW_VALUES + 2) <= 2 * small.PART_VALUES


def test_random_features_read_each_input_once(sample, monkeypatch):
    """Many learners in one design: each column is read once a batch, and the features are those of their formula."""
    from gamspark.models import design as ds

    calls, inner = [], ds.numbers
    monkeypatch.setattr(ds, "numbers", lambda rows, name: calls.append(name) or inner(rows, name))
    joint = Design((Constant(), *[b for seed in range(9) for b in hidden.learner_design(["a", "b"], [("a", "b")], 4, 1.0, 0.5, "elu", seed).blocks]))
    basis = joint.build(batch(sample))
    assert sorted(calls) == ["a", "b"]
    for block, sl in zip(joint.blocks[1:], joint.slices[1:]):
        z = np.outer(sample[0 if block.columns[0] == "a" else 1], block.weights)
        if len(block.columns) == 2:
            z = z + np.outer(sample[1], block.other)
        assert np.allclose(basis[:, sl], np.where(z < 0, np.expm1(np.minimum(z, 0)), z), rtol=0, atol=1e-14)
        assert np.allclose(basis[:, sl], block.build(batch(sample)), rtol=0, atol=0)


def test_splines_are_built_column_by_column():
    """The values of the recursion on whole matrices, in less time than it takes."""
    from time import perf_counter

    def whole(s, x):
        inner = s.n_splines - s.degree
        u = np.clip((x - s.lo) / ((s.hi - s.lo) / inner), 0.0, inner * (1 - 1e-12))
        cell = np.minimum(np.floor(u).astype(np.int64), inner - 1)
        t, local = u - cell, np.ones((len(u), 1))
        for d in range(1, s.degree + 1):
            j = np.arange(d + 1)
            local = np.pad(local, ((0, 0), (1, 0))) * (t[:, None] + d - j) / d + np.pad(local, ((0, 0), (0, 1))) * (j + 1 - t[:, None]) / d
        out = np.zeros((len(u), s.n_splines))
        np.put_along_axis(out, cell[:, None] + np.arange(s.degree + 1), local, axis=1)
        return out

    x = np.r_[np.random.default_rng(0).uniform(-3, 9, 40_000), -2.0, 7.0, 0.0, 1e300, -1e300]
    for spline_block in (Spline("b", -2.0, 7.0, 6), Spline("b", -2.0, 7.0, 9, 2)):
        assert np.array_equal(spline_block.evaluate(x), whole(spline_block, x))

    def seconds(f):
        took = []
        for _ in range(9):
            begin = perf_counter()
            f(x)
            took.append(perf_counter() - begin)
        return min(took)

    block = Spline("b", -2.0, 7.0, 6)
    assert seconds(block.evaluate) < 0.7 * seconds(lambda v: whole(block, v))
