"""Families as Spark estimators, and searches that go on after they broke off."""

import numpy as np
import pytest
from gamspark.models import bagging, evaluate, linear
from gamspark.models.ml import GamEstimator, GamModel, load_fitted, save_fitted
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

N = 600


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=N), rng.uniform(-2, 2, N)
    g = rng.choice(["u", "v", "w"], N)
    y = a + np.sin(2 * b) + (g == "v") + rng.normal(0, 0.3, N)
    rows = [(i, float(p), float(q), str(r), float(s), int(s > 0.3)) for i, (p, q, r, s) in enumerate(zip(a, b, g, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, g string, y double, label int").repartition(3).cache()


def rows_of(model, df):
    out = model.transform(df) if hasattr(model, "transform") else model.predict(df)
    return [tuple(r) for r in out.select("id", "raw", "prediction").orderBy("id").collect()]


CASES = [
    ("ridge", "regression", {"alpha": 2.0}), ("elastic_net", "regression", {"alpha": 0.1}), ("spline_gam", "classification", {"lam": 1.0}),
    ("regression_spline", "regression", {"max_k": 8}), ("binned_boosting", "regression", {"max_bins": 16, "interactions": 1, "rounds": 50}),
    ("fused", "regression", {"lam": 5.0, "max_bins": 16}), ("newton_boosting", "classification", {"n_estimators": 2, "max_depth": 2}),
    ("tree", "classification", {"max_depth": 3}), ("tree", "regression", {"max_leaf_nodes": 4, "max_depth": None}),
    ("hidden_boosting", "regression", {"n_hid": 3, "n_estimators": 3}),
]


@pytest.mark.parametrize("family,task,options", CASES)
def test_saved_models_score_the_same(spark, df, tmp_path, family, task, options):
    target = "y" if task == "regression" else "label"
    model = GamEstimator(family=family, target=target, numeric=["a", "b"], categorical=["g"], task=task, options=options).fit(df)
    want = rows_of(model, df)
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = GamModel.load(str(tmp_path / "model"))
    assert rows_of(loaded, df) == want and loaded.uid == model.uid and loaded.getOrDefault("options") == options
    assert loaded.getOrDefault("numeric") == ["a", "b"] and len(want) == N


def test_pipeline_saves_and_loads(spark, df, tmp_path):
    double = SQLTransformer(statement="SELECT *, b * b AS b2 FROM __THIS__")
    estimator = GamEstimator(family="ridge", target="y", numeric=["a", "b2"], options={"alpha": 0.5})
    pipeline = Pipeline(stages=[double, estimator])
    pipeline.save(str(tmp_path / "pipeline"))
    model = Pipeline.load(str(tmp_path / "pipeline")).fit(df)
    model.save(str(tmp_path / "fitted"))
    other = spark.newSession()
    again = PipelineModel.load(str(tmp_path / "fitted"))
    assert rows_of(again, df) == rows_of(model, df)
    assert other.read.parquet(str(tmp_path / "fitted" / "stages" / f"1_{model.stages[1].uid}" / "data")).count() == 1


def test_cross_validation_over_options(df):
    estimator = GamEstimator(family="ridge", target="y", numeric=["a", "b"], categorical=["g"])
    grid = ParamGridBuilder().addGrid(estimator.options, [{"alpha": 1e7}, {"alpha": 1.0}]).build()
    found = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="y"), numFolds=2, seed=1).fit(df)
    assert found.avgMetrics[1] < found.avgMetrics[0] and found.bestModel.getOrDefault("options") == {"alpha": 1.0}
    classes = GamEstimator(family="logistic", target="label", numeric=["a", "b"], categorical=["g"], task="classification").fit(df)
    assert BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="raw").evaluate(classes.transform(df)) > 0.8


def test_ensembles_and_errors(spark, df, tmp_path):
    model = bagging.fit_subspace_ensemble(df, "label", ["a", "b"], ["g"], members=2, key=["id"])
    save_fitted(spark, model, str(tmp_path / "ensemble"))
    assert rows_of(load_fitted(spark, str(tmp_path / "ensemble")), df) == rows_of(model, df)
    for bad in ({"family": "none"}, {"task": "ranking"}):
        with pytest.raises(ValueError):
            GamEstimator(target="y", numeric=["a"], **bad).fit(df)
    with pytest.raises(TypeError):
        save_fitted(spark, linear.fit_ridge(df, "y", ["a"]).__class__(None, object()), str(tmp_path / "bad"))


class Broken(BaseException):
    """Not an error of a fit: the driver goes."""


def evaluated(df, store):
    grids = {"counting": [{"alpha": 1.0}, {"alpha": 50.0}, {"alpha": 1e5}], "ridge": [{"alpha": 1.0}]}
    return evaluate.nested_evaluation(df, "toy", ["id"], "y", ["a", "b"], ["g"], "regression", grids, folds=2, parallelism=1, store=store)


def test_a_broken_evaluation_goes_on(spark, df, tmp_path, monkeypatch):
    calls, limit = [], [10**9]

    def counting(df, target, numeric, categorical, task, **params):
        if len(calls) >= limit[0]:
            raise Broken
        calls.append(params)
        return linear.fit_ridge(df, target, numeric, categorical, **params)

    monkeypatch.setitem(evaluate.FITS, "counting", counting)
    compared = ["model", "fold", "config_id", "loss", "failed"]
    want, reports = evaluated(df, None)
    lines = lambda r: r.where("row <> 'timing'").withColumn("value", F.round("value", 9)).orderBy("model", "fold", "metric").collect()
    table = lambda t: t.withColumn("loss", F.round("loss", 9)).select(compared).orderBy(compared).collect()
    want, reports = table(want), lines(reports)
    whole = len(calls)  # three candidates and a refit on each of two folds
    assert whole == 8
    calls.clear()
    limit[0] = 6
    with pytest.raises(Broken):
        evaluated(df, evaluate.TrialStore(spark, str(tmp_path)))
    assert evaluate.TrialStore(spark, str(tmp_path)).trials().count() == 6  # and one of the other model
    limit[0] = 10**9
    trials, found = evaluated(df, evaluate.TrialStore(spark, str(tmp_path)))
    assert len(calls) == whole
    assert lines(found) == reports and table(trials) == want
    calls.clear()
    evaluated(df, evaluate.TrialStore(spark, str(tmp_path)))
    assert not calls


def test_errors_of_scoring_are_not_failed_trials(df):
    class Bad:
        def loss(self, frame, target):
            raise KeyError("a bug")

    with pytest.raises(KeyError):
        evaluate.run_trial(lambda *a: Bad(), df, df, "y", ["a"], [], "regression", 0, {})
    assert df.select(F.lit(1)).count() == N
