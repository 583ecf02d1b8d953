"""Several fits from the same passes equal the fits alone."""

import numpy as np
import pytest
from gamspark.models import bagging, linear, spline
from gamspark.models import gram as gm
from gamspark.models.design import Bins, Constant, Design, Levels, Linear, Spline
from gamspark.operators.split import bag_weights
from pyspark.sql import functions as F

N = 1500


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=N), rng.uniform(-2, 2, N)
    g = rng.choice(["u", "v", "w"], N)
    y = a + np.sin(2 * b) + rng.normal(0, 0.3, N)
    label = (rng.random(N) < 1 / (1 + np.exp(-(2 * a - b + (g == "v"))))).astype(int)
    rows = [(i, float(p), float(q), str(r), float(s), int(t)) for i, (p, q, r, s, t) in enumerate(zip(a, b, g, y, label))]
    return spark.createDataFrame(rows, "id int, a double, b double, g string, y double, label int").repartition(4).cache()


@pytest.fixture
def passes(monkeypatch):
    """Counts passes over the rows."""
    count = [0]
    plain = gm.block_sums

    def counted(partial):
        count[0] += 1
        return plain(partial)

    monkeypatch.setattr(gm, "block_sums", counted)
    return count


def test_members_of_one_pass_equal_passes_alone(df, passes):
    term = Spline("b", -2.0, 2.0, 6)
    rows = df.withColumn("w", F.abs("a")).withColumn("cell", F.col("id") % 3).withColumn("h", F.when(F.col("id") % 5 > 0, F.col("a")))
    designs = [Design((Constant(), Linear("a"), term)), Design((Constant(), Levels("g", ("u", "v")), Bins("b", (-1.0, 0.5)))), Design((Constant(), term, Linear("h")))]
    beta = np.linspace(-1, 1, designs[0].size)
    members = [gm.Member(designs[0]), gm.Member(designs[1], weight="w"), gm.Member(designs[2], cells=frozenset([0, 2])),
               gm.Member(designs[0], beta, "w", frozenset([1]), gm.logistic_working), gm.Member(designs[1], np.ones(6), working=gm.logistic_working)]
    found = gm.gram_many(rows, "label", members, "cell")
    assert passes[0] == 1
    for m, got in zip(members, found):
        own = rows.where(F.col("cell").isin(list(m.cells))) if m.cells else rows
        want = gm.gram(own, m.design, "label", [m.weight] if m.weight else [], working=m.working,
                       offset=gm.batch_score(m.design, m.beta) if m.beta is not None else None)[0]
        assert np.allclose(got.g, want.g) and np.allclose(got.b, want.b)
        assert np.allclose([got.yy, got.weight, got.rows, got.loss], [want.yy, want.weight, want.rows, want.loss])


def test_too_many_matrices_take_several_passes(df, passes, monkeypatch):
    design = Design((Constant(), Spline("b", -2.0, 2.0, 9)))
    monkeypatch.setattr(gm, "DRIVER_VALUES", 250)
    found = gm.gram_many(df, "y", [gm.Member(design, cells=frozenset([k])) for k in range(5)], F.col("id") % 5)
    assert passes[0] == 3 and np.isclose(sum(s.rows for s in found), N)


def test_logistic_path_equals_fits_alone(df, passes):
    settings = [{"C": 0.01}, {"C": 1.0}, {"C": 0.05, "penalty": "l1"}, {"C": 0.1, "penalty": "elasticnet", "l1_ratio": 0.5}, {"penalty": None}]
    models = linear.fit_logistic_path(df, "label", ["a", "b"], ["g"], settings)
    together, counts = passes[0], []
    for m, s in zip(models, settings):
        passes[0] = 0
        alone = linear.fit_logistic(df, "label", ["a", "b"], ["g"], **s)
        counts.append(passes[0])
        assert np.allclose(m.beta, alone.beta, atol=1e-8)
    assert together == max(counts) < sum(counts)
    with pytest.raises(ValueError):
        linear.fit_logistic_path(df, "label", ["a"], [], [{"penalty": "elasticnet"}])


def test_subspace_members_equal_fits_alone(df, passes):
    model = bagging.fit_subspace_ensemble(df, "label", ["a", "b"], ["g"], members=4, key=["id"])
    together = passes[0]
    assert together == model.passes <= 8
    rows = bag_weights(df, ["id"], 4, 1.0, 0)
    for b, m in enumerate(model.members):
        alone = spline.fit_spline_gam(rows, "label", list(m.numeric), list(m.categorical), "classification", n_splines=6, lam=1.0, max_iter=8, weight=f"bag_{b}")
        assert alone.info["passes"] <= together
        assert np.allclose(m.beta, alone.beta, atol=1e-8)


def test_validation_path_of_classes(df, passes):
    val = F.col("id") % 4 == 0
    lambdas = (0.01, 1.0, 100.0)
    model = spline.fit_by_validation(df, "label", ["a", "b"], ["g"], val, "classification", n_splines=8, lambdas=lambdas)
    assert passes[0] <= 25
    for lam, loss in model.info["validation_path"]:
        alone = spline.fit_spline_gam(df.where(~val), "label", ["a", "b"], ["g"], "classification", n_splines=8, lam=lam)
        assert abs(alone.loss(df.where(val), "label") - loss) < 0.003  # knots lie on all rows there
    assert len(model.info["validation_path"]) == 3


def test_one_failing_fit_does_not_stop_the_others(df):
    design = Design((Constant(), Linear("a")))

    def bad():
        yield np.zeros(2)
        raise np.linalg.LinAlgError("singular")

    def good():
        stats = yield np.zeros(2)
        return stats.rows

    found, rounds = gm.run_together(df, "y", [(gm.Member(design), bad()), (gm.Member(design), good())])
    assert isinstance(found[0], np.linalg.LinAlgError) and found[1] == N and rounds == 1
