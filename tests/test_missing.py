"""Missing values in fits and reports, grids as files write them, and the whole fit of boosted nets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gamspark.models import boosting, evaluate, hidden, linear
from gamspark.operators import clean, hpo
from gamspark.sources import readers


def test_missing_features_leave_the_row_out(spark):
    rows = [(float(i), float(i % 5), 2.0 * i + 1) for i in range(50)] + [(None, 1.0, 9.0), (float("nan"), 1.0, 9.0), (3.0, None, 7.0)]
    df = spark.createDataFrame(rows, "x double, z double, y double")
    model = linear.fit_ridge(df, "y", ["x"], alpha=0.0)
    assert np.allclose(model.beta[1:], [2.0]) or np.allclose(model.coefficients(spark).first()["coef"], 2.0)
    binned = boosting.fit_binned_boosting(df, "y", ["z"], rounds=50)
    got = {r["z"]: r["prediction"] for r in binned.predict(df).select("z", "prediction").distinct().collect()}
    assert all(v is not None and np.isfinite(v) for v in got.values())


def test_histogram_of_nothing(spark):
    out = clean.histogram(spark.createDataFrame([(None,)], "x double"), "x", 4).collect()
    assert [(r["bin"], r["low"], r["n"]) for r in out] == [(i, None, 0) for i in range(4)]


def test_missing_texts_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\nNA,1\nx,N/A\nnull,\n")
    rows = readers.read_delimited(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [(None, "1"), ("x", None), (None, None)]


def test_grid_text_becomes_candidates(spark):
    text = '{"logistic": {"C": [0.1, 1], "solver": ["lbfgs", "saga"], "penalty": ["l1", "l2"], "l1_ratio": [null]}}'
    grid = readers.read_param_grid(spark.createDataFrame([(text,)], "g string"), "g")
    assert hpo.typed_params({"a": "1", "b": "0.5", "c": "None", "d": "true", "e": "l2", "f": "[1, 2]"}) == {
        "a": 1, "b": 0.5, "c": None, "d": True, "e": "l2", "f": [1, 2]
    }
    candidates = evaluate.grid_candidates(grid.where("param <> 'l1_ratio'"), "logistic", "classification")
    assert len(candidates) == 6 and all((x["solver"], x["penalty"]) != ("lbfgs", "l1") for x in candidates)
    assert {type(x["C"]) for x in candidates} <= {int, float}
    rows = spark.range(300).select((F.col("id") % 7).cast("double").alias("x"), ((F.col("id") % 7) > F.col("id") % 3 + 1).cast("int").alias("y"))
    done = evaluate.grid_search(evaluate.FITS["logistic"], rows, rows, "y", ["x"], [], "classification", candidates[:2])
    assert not any(t.failed for t in done)
    with pytest.raises(ValueError, match="solver"):
        linear.fit_logistic(rows, "y", ["x"], solver="lbfgs", penalty="l1")


def test_whole_fit_of_boosted_nets_finds_feature_and_pair(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = np.sin(2 * x[:, 0]) + x[:, 0] * x[:, 1]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, z double, y double")
    model = hidden.fit_hidden_gam(df, "y", ["a", "b", "z"], interactions=1, n_estimators=60, init_reg=0.01)
    assert [tuple(sorted(p)) for p in model.info["pairs"]] == [("num__a", "num__b")]
    assert model.loss(df, "y") < 0.6 * float(np.var(y))
    kept = hidden.fit_hidden_gam(df.withColumn("w", F.sin(2 * F.col("a"))), "w", ["a", "b", "z"], feat_select=1, fixed=["z"], n_estimators=5, init_reg=0.01)
    assert set(kept.info["features"]) == {"num__a", "num__z"}
