"""Model fits on the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..models import bagging, boosting, evaluate, folds, fused, hidden, histograms, interactions, linear, smooth, spline, trees
from ..models.additive import AdditiveModel
from ..models.design import Constant, Design, Levels, Linear
from ..models.gram import gram
from ..operators import effects as fx
from ..operators import clean, encode
from .catalog import query, rnd, shared_path, table

NUM, CAT, TARGET = ["l_quantity", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"], "l_extendedprice"
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def items(spark, folder):
    return table(spark, folder, "lineitem")


def classes(spark, folder):
    """Large quantity as a label that depends on price, so that classifiers have something to find."""
    price = F.col("l_extendedprice") / 10000
    noise = F.col("l_partkey") % 7
    return items(spark, folder).withColumn("label", (price + noise + F.col("l_discount") * 20 > 9).cast("int")).withColumn(
        "price", price
    )


#: Large quantity as a label, as ``classes`` makes it.
CLASSES = (
    "c AS (SELECT *, l_extendedprice / 10000 AS price, CAST(l_extendedprice / 10000 + l_partkey % 7 + l_discount * 20 > 9 AS INTEGER) AS label "
    "FROM lineitem) "
)


def _level_means(by: str, value: str, name: str, digits: int = 4) -> str:
    return f"WITH {CLASSES} SELECT {by}, round({value}, {digits}) AS {name}, count(*) AS n FROM c GROUP BY {by}"


def _by(model, frame, by, digits=4, name="prediction", column="prediction"):
    """Mean prediction and number of rows at each value of a column."""
    found = model.predict(frame).groupBy(by).agg(F.avg(column).alias(name), F.count(F.lit(1)).alias("n"))
    return found.withColumn(name, rnd(name, digits))


@query("flagship")
def flagship(spark, folder):
    """Clean, encode, fit an additive model on one Gram, and return its centred effects with importance."""
    raw = items(spark, folder).withColumn("l_tax", F.expr("CASE WHEN l_tax > 0.06 THEN NULL ELSE l_tax END"))
    cleaner = clean.fit_cleaner(raw, NUM, CAT)
    frame = cleaner.transform(raw, keep=[TARGET])
    model = linear.fit_ridge(frame, TARGET, cleaner.numeric, cleaner.categorical, alpha=1.0, scale=True)
    effects = model.effects(frame)
    centred = fx.center_effects(effects)
    imp = fx.importance(effects).select("feat_name", "importance")
    return centred.join(imp, "feat_name", "left").select(
        "feat_name", "feat_idx", "x_num", "x_cat", rnd("y").alias("y"), "n", rnd("importance").alias("importance")
    )


GRAM_TERMS = {
    "1": "1.0", "q": "l_quantity", "d": "l_discount",
    "A": "CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END", "N": "CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END",
}


@query(
    "gram",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(CAST(sum(({x}) * ({y})) AS DOUBLE), 3) AS value FROM lineitem"
        for a, x in GRAM_TERMS.items()
        for b, y in {**GRAM_TERMS, "y": "l_extendedprice / 1000"}.items()
    ),
)
def cross_products(spark, folder):
    design = Design((Constant(), Linear("l_quantity"), Linear("l_discount"), Levels("l_returnflag", ("A", "N"))))
    stats = gram(items(spark, folder), design, F.col("l_extendedprice") / 1000)[0]
    names = list(GRAM_TERMS)
    rows = [(a, b, float(stats.g[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    rows += [(a, "y", float(stats.b[i])) for i, a in enumerate(names)]
    return spark.createDataFrame(rows, "a string, b string, value double").withColumn("value", rnd("value", 3))


@query(
    "ridge_solve",
    """WITH s AS (SELECT sum(l_quantity * l_quantity) + 10 AS aa, sum(l_quantity * l_discount) AS ab, sum(l_discount * l_discount) + 10 AS bb,
                         sum(l_quantity * l_extendedprice) AS ay, sum(l_discount * l_extendedprice) AS b_y FROM lineitem)
       SELECT 'l_quantity' AS feat_name, round((bb * ay - ab * b_y) / (aa * bb - ab * ab), 4) AS coef FROM s
       UNION ALL SELECT 'l_discount', round((aa * b_y - ab * ay) / (aa * bb - ab * ab), 4) FROM s""",
)
def ridge_solve(spark, folder):
    model = linear.fit_ridge(items(spark, folder), TARGET, ["l_quantity", "l_discount"], alpha=10.0, intercept=False)
    return model.coefficients(spark).withColumn("coef", rnd("coef", 4))


@query(
    "coefficient_table",
    """WITH s AS (SELECT var_pop(l_quantity) AS aa, covar_pop(l_quantity, l_discount) AS ab, var_pop(l_discount) AS bb,
                         covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS b_y FROM lineitem)
       SELECT 'l_quantity' AS feat_name, round((bb * ay - ab * b_y) / (aa * bb - ab * ab), 5) AS coef FROM s
       UNION ALL SELECT 'l_discount', round((aa * b_y - ab * ay) / (aa * bb - ab * ab), 3) FROM s""",
)
def coefficient_table(spark, folder):
    model = linear.fit_ridge(items(spark, folder), TARGET, ["l_quantity", "l_discount"], alpha=0.0)
    digits = F.when(F.col("feat_name") == "l_quantity", rnd("coef", 5)).otherwise(rnd("coef", 3))
    return model.coefficients(spark).withColumn("coef", digits)


@query(
    "ols_factor",
    """WITH m AS (SELECT l_returnflag, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem GROUP BY ALL),
            s AS (SELECT sum((l_quantity - mx) * (l_extendedprice - my)) / sum(pow(l_quantity - mx, 2)) AS slope FROM lineitem JOIN m USING (l_returnflag))
       SELECT l_returnflag, round(slope, 4) AS slope, round(avg(my + slope * (l_quantity - mx)), 2) AS prediction, round(sqrt(avg(pow(l_extendedprice - my - slope * (l_quantity - mx), 2))), 3) AS rmse
       FROM lineitem JOIN m USING (l_returnflag), s GROUP BY l_returnflag, slope""",
)
def ols_factor(spark, folder):
    """Least squares on a number and all levels of a factor next to an intercept: the slope within levels, and residuals per level."""
    frame = items(spark, folder)
    model = linear.fit_ridge(frame, TARGET, ["l_quantity"], ["l_returnflag"], alpha=0.0)
    error = F.col(TARGET) - F.col("raw")
    found = model.predict(frame).groupBy("l_returnflag").agg(F.avg("raw").alias("prediction"), F.sqrt(F.avg(error * error)).alias("rmse"))
    return found.select("l_returnflag", F.lit(round(float(model.beta[1]), 4)).alias("slope"), rnd("prediction", 2).alias("prediction"), rnd("rmse", 3).alias("rmse"))


@query(
    "elastic_net",
    """WITH s AS (SELECT avg(o_custkey) AS mx, avg(o_totalprice) AS my, covar_pop(o_custkey, o_totalprice) AS c, var_pop(o_custkey) AS v FROM orders),
            w AS (SELECT *, sign(c) * greatest(abs(c) - 0.5 * 0.25, 0) / (v + 0.5 * 0.75) AS coef FROM s)
       SELECT round(coef, 6) AS coef, round(my - coef * mx, 4) AS intercept FROM w""",
)
def elastic_net(spark, folder):
    """One feature has a closed form: the soft-thresholded covariance."""
    model = linear.fit_elastic_net(table(spark, folder, "orders"), "o_totalprice", ["o_custkey"], alpha=0.5, l1_ratio=0.25)
    return model.coefficients(spark).select(rnd("coef").alias("coef"), F.round(F.lit(model.intercept), 4).alias("intercept"))


PATH = [(a, r) for a in (0.1, 10.0, 1000.0) for r in (0.0, 0.5, 1.0)]


@query(
    "elastic_net_path",
    "WITH s AS (SELECT covar_pop(l_quantity, l_extendedprice) AS c, var_pop(l_quantity) AS v FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT CAST({a} AS DOUBLE) AS alpha, CAST({r} AS DOUBLE) AS l1_ratio, round(sign(c) * greatest(abs(c) - {a} * {r}, 0) / (v + {a} * {1 - r}), 4) AS coef FROM s"
        for a, r in PATH
    ),
)
def elastic_net_path(spark, folder):
    """One feature has a closed form for every setting; all come from one pass."""
    models = linear.fit_elastic_net_path(items(spark, folder), TARGET, ["l_quantity"], [], PATH)
    rows = [(m.info["alpha"], m.info["l1_ratio"], float(m.beta[1])) for m in models]
    return spark.createDataFrame(rows, "alpha double, l1_ratio double, coef double").withColumn("coef", rnd("coef", 4))


PAIR_BINS = {"l_quantity": [10.5, 20.5, 30.5, 40.5], "l_discount": [0.025, 0.055, 0.085], "l_tax": [0.015, 0.045]}
BIN_SQL = {
    "l_quantity": "CASE WHEN l_quantity < 10.5 THEN 0 WHEN l_quantity < 20.5 THEN 1 WHEN l_quantity < 30.5 THEN 2 WHEN l_quantity < 40.5 THEN 3 ELSE 4 END",
    "l_discount": "CASE WHEN l_discount < 0.025 THEN 0 WHEN l_discount < 0.055 THEN 1 WHEN l_discount < 0.085 THEN 2 ELSE 3 END",
    "l_tax": "CASE WHEN l_tax < 0.015 THEN 0 WHEN l_tax < 0.045 THEN 1 ELSE 2 END",
}


def _gain(by: str) -> str:
    return f"(SELECT sum(s * s / n) FROM (SELECT sum(r) AS s, count(*) AS n FROM p GROUP BY {by}))"


@query(
    "pair_strength",
    "WITH p AS (SELECT (l_extendedprice - avg(l_extendedprice) OVER ()) / 1000 AS r, "
    + ", ".join(f"{e} AS {n}" for n, e in BIN_SQL.items())
    + " FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feat_a, '{b}' AS feat_b, round({_gain(a + ', ' + b)} - {_gain(a)} - {_gain(b)} + {_gain('()')}, 4) AS strength"
        for a, b in (("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax"))
    ),
)
def pair_strength(spark, folder):
    frame = items(spark, folder)
    mean = frame.agg(F.avg(TARGET)).first()[0]
    out = interactions.pair_strength(frame.withColumn("r", (F.col(TARGET) - mean) / 1000), "r", PAIR_BINS)
    return out.withColumn("strength", rnd("strength", 4))


def _losses(spark, model, frame, target, **extra):
    """One row with the model's loss next to the loss of the constant model."""
    y = F.col(target).cast("double")
    if model.task == "regression":
        base = frame.agg(F.var_pop(y)).first()[0]
    else:
        p = frame.agg(F.avg(y)).first()[0]
        base = frame.agg(F.avg(-y * F.log(F.lit(p)) - (1 - y) * F.log(F.lit(1 - p)))).first()[0]
    row = {"loss": float(model.loss(frame, target)), "constant_loss": float(base), **extra}
    return spark.createDataFrame([tuple(row.values())], list(row))


LEVEL_ODDS = _level_means("l_returnflag", "ln(avg(label) / (1 - avg(label)))", "log_odds", 3)


@query("logistic", LEVEL_ODDS)
def logistic(spark, folder):
    """Without a penalty, the log odds of a model of one factor are those of its levels."""
    frame = classes(spark, folder)
    model = linear.fit_logistic(frame, "label", [], ["l_returnflag"], penalty=None, tol=1e-13)
    return _by(model, frame, "l_returnflag", 3, "log_odds", "raw")


@query("decision_tree", _level_means("label", "avg(price)", "prediction"))
def decision_tree(spark, folder):
    """A tree of one split on a feature of two values predicts the mean of each."""
    frame = classes(spark, folder)
    return _by(trees.fit_tree(frame, "price", ["label"], max_depth=1), frame, "label")


@query("random_forest", _level_means("label", "avg(3 + 2 * label)", "prediction"))
def random_forest(spark, folder):
    """Where the target is a function of the feature, every bag's leaves are exact."""
    frame = classes(spark, folder).withColumn("y", 3.0 + 2 * F.col("label"))
    return _by(trees.fit_forest(frame, "y", ["label", "l_tax"], n_estimators=5, max_depth=2), frame, "label")


@query("boosted_trees", _level_means("label", "avg(price)", "prediction"))
def boosted_trees(spark, folder):
    """At rate 1 the first tree takes the means and leaves no residual to the others."""
    frame = classes(spark, folder)
    return _by(trees.fit_boosted_trees(frame, "price", ["label"], n_estimators=3, max_depth=1, learning_rate=1.0), frame, "label")


@query(
    "stump_gam",
    f"WITH {CLASSES} SELECT CAST(label AS DOUBLE) AS x_num, round(avg(price) - (SELECT avg(price) FROM c), 4) AS y, count(*) AS n FROM c GROUP BY label",
)
def stump_gam(spark, folder):
    """Centred effects of the stumps on a feature of two values: the means less the mean."""
    frame = classes(spark, folder)
    model = trees.fit_boosted_trees(frame, "price", ["label"], n_estimators=3, max_depth=1, learning_rate=1.0)
    return fx.center_effects(trees.stump_effects(model, frame)).where("feat_idx >= 0").select("x_num", rnd("y", 4).alias("y"), "n")


STEPS = """CASE WHEN l_quantity <= 24 THEN 0.0 WHEN l_tax <= 0.045 THEN 20.0 WHEN l_discount <= 0.055 THEN 33.0 ELSE 40.0 END"""


@query(
    "best_first_tree",
    f"""WITH y AS (SELECT *, {STEPS} AS step, {STEPS} + (l_partkey % 7 - 3) / 10 AS y FROM lineitem)
        SELECT CAST(round(step) AS INTEGER) AS step, round(avg(y), 5) AS prediction, round(sqrt(avg(pow(y - (SELECT avg(y) FROM y z WHERE z.step = y.step), 2))), 5) AS rmse,
               count(*) AS n FROM y GROUP BY step""",
)
def best_first_tree(spark, folder):
    """Four leaves on a ladder of three features: the splits are taken in the order of their gain, down one side, and each leaf is
    the mean of its step."""
    step = F.expr(STEPS)
    frame = items(spark, folder).withColumn("step", step.cast("double")).withColumn("y", step.cast("double") + (F.col("l_partkey") % 7 - 3) / 10)
    model = trees.fit_tree(frame, "y", NUM, CAT, max_depth=None, max_leaf_nodes=4, max_bins=64)
    error = F.col("y") - F.col("prediction")
    found = model.predict(frame).groupBy("step", "prediction").agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("n"))
    return found.select(F.col("step").cast("int").alias("step"), rnd("prediction", 5).alias("prediction"), rnd("rmse", 5).alias("rmse"), "n")


@query(
    "newton_boosting",
    f"""WITH {CLASSES}, b AS (SELECT avg(label) AS p, ln(avg(label) / (1 - avg(label))) AS f FROM c),
        a AS (SELECT l_linestatus, sum(label) AS s, count(*) AS n FROM c GROUP BY ALL),
        r1 AS (SELECT l_linestatus, s, n, f + 0.3 * (s - n * p) / (n * p * (1 - p) + 2.0) AS f FROM a, b),
        r2 AS (SELECT l_linestatus, n, f + 0.3 * (s - n / (1 + exp(-f))) / (n / (1 + exp(-f)) * (1 - 1 / (1 + exp(-f))) + 2.0) AS f FROM r1)
        SELECT l_linestatus, round(f, 6) AS raw, n FROM r2""",
)
def newton_boosting(spark, folder):
    """Two second-order steps with an L2 term on a factor of two levels have a closed form."""
    frame = classes(spark, folder)
    model = histograms.fit_newton_boosting(frame, "label", [], ["l_linestatus"], "classification", n_estimators=2, max_depth=3, reg_lambda=2.0)
    return _by(model, frame, "l_linestatus", 6, "raw", "raw")


@query(
    "newton_stump_gam",
    """WITH y AS (SELECT *, CASE WHEN l_linenumber > 4 THEN 3.0 ELSE 0.0 END AS a, CASE WHEN l_returnflag = 'N' THEN 5.0 ELSE 0.0 END AS b FROM lineitem)
       SELECT 'l_linenumber' AS feat_name, CAST(l_linenumber AS VARCHAR) AS value, round(CAST(avg(a) - (SELECT avg(a) FROM y) AS DOUBLE), 4) AS effect, count(*) AS n FROM y GROUP BY l_linenumber
       UNION ALL SELECT 'l_returnflag', l_returnflag, round(CAST(avg(b) - (SELECT avg(b) FROM y) AS DOUBLE), 4), count(*) FROM y GROUP BY l_returnflag""",
)
def newton_stump_gam(spark, folder):
    """Stumps boosted on two features, one of them a factor, as one additive model: the centred effects are the two parts of the target."""
    y = F.when(F.col("l_linenumber") > 4, 3.0).otherwise(0.0) + F.when(F.col("l_returnflag") == "N", 5.0).otherwise(0.0)
    frame = items(spark, folder).withColumn("y", y)
    model = histograms.fit_newton_boosting(frame, "y", ["l_linenumber"], ["l_returnflag"], n_estimators=12, max_depth=1, learning_rate=1.0, reg_lambda=0.0)
    table = fx.center_effects(model.additive().effects(frame)).where("feat_idx >= 0")
    value = F.coalesce("x_cat", F.col("x_num").cast("int").cast("string"))
    return table.select("feat_name", value.alias("value"), rnd("y", 4).alias("effect"), "n")


@query("perceptron", f"WITH {CLASSES} SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, true AS better FROM c")
def perceptron(spark, folder):
    """All rows are scored, and better than by the share of the labels."""
    frame = classes(spark, folder)
    model = trees.fit_perceptron(frame, "label", ["price", "l_discount"], [], hidden=(5,), max_iter=30)
    found = _losses(spark, model, frame, "label").select((F.col("loss") < F.col("constant_loss")).alias("better"))
    counts = model.predict(frame).agg(F.count("prediction").alias("n"), F.sum(F.col("label").cast("long")).alias("positives")).first()
    return found.select(F.lit(counts["n"]).alias("n"), F.lit(counts["positives"]).alias("positives"), "better")


@query("spline_gam", _level_means("l_linenumber", "avg(price)", "prediction", 3))
def spline_gam(spark, folder):
    """With more splines than values and next to no penalty, the fit at a value is its mean."""
    frame = classes(spark, folder)
    return _by(spline.fit_spline_gam(frame, "price", ["l_linenumber"], n_splines=12, lam=1e-6), frame, "l_linenumber", 3)


@query("spline_gam_logit", LEVEL_ODDS)
def spline_gam_logit(spark, folder):
    """With next to no penalty, the log odds of a factor are those of its levels."""
    frame = classes(spark, folder)
    model = spline.fit_spline_gam(frame, "label", [], ["l_returnflag"], "classification", lam=1e-7, tol=1e-12)
    return _by(model, frame, "l_returnflag", 3, "log_odds", "raw")


@query(
    "lambda_search",
    f"WITH {CLASSES} SELECT 1e9 AS lam, CAST(2 AS DOUBLE) AS edf, round(count(*) * count(*) * var_pop(price) * (1 - pow(corr(price, l_quantity), 2)) / pow(count(*) - 2, 2), 4) AS gcv FROM c",
)
def lambda_search(spark, folder):
    """At the largest penalty a spline is a straight line: two degrees of freedom and the line's residuals."""
    model = spline.fit_spline_gam(classes(spark, folder), "price", ["l_quantity"], n_splines=10, lambdas=(1.0, 1e9))
    return spark.createDataFrame(model.info["path"][-1:], "lam double, edf double, gcv double").select("lam", rnd("edf", 3).alias("edf"), rnd("gcv", 4).alias("gcv"))


@query("regression_spline", _level_means("l_linenumber", "avg(price)", "prediction", 3))
def regression_spline(spark, folder):
    """The basis has as many functions as there are values; next to no penalty gives the means."""
    frame = classes(spark, folder)
    return _by(spline.fit_regression_spline(frame, "price", ["l_linenumber"], max_k=8, lambdas=(1e-6,)), frame, "l_linenumber", 3)


@query(
    "smooth_terms",
    """SELECT 'l_linenumber' AS feat_name, CAST(l_linenumber AS DOUBLE) AS x, CAST(l_linenumber * 3 % 7 - 3 AS DOUBLE) AS y, true AS wiggly FROM lineitem GROUP BY l_linenumber
       UNION ALL SELECT 'l_quantity', l_quantity, round(0.1 * (l_quantity - (SELECT min(l_quantity) FROM lineitem)), 2), false FROM lineitem GROUP BY l_quantity""",
)
def smooth_terms(spark, folder):
    """A term that jumps from value to value and one that is straight, each with a penalty of its own: the one uses more than half of
    its functions (all of them, in fact), the other next to one; and both curves from their first value on."""
    noise = (F.pmod(F.xxhash64(*[F.col(k) for k in KEY]), F.lit(201)) - 100) / 5000
    y = F.col("l_linenumber") * 3 % 7 + 0.1 * F.col("l_quantity") + noise
    frame = items(spark, folder).withColumn("y", y)
    model = smooth.fit_smooth_gam(frame, "y", ["l_linenumber", "l_quantity"], max_k=10)
    curves = model.effects(frame).where("feat_idx >= 0")
    begin = F.min_by("y", "x_num").over(Window.partitionBy("feat_name"))
    sizes = {b.name: b.size for b in model.design.blocks}
    wiggly = F.create_map(*[x for n, v in model.info["edf"].items() for x in (F.lit(n), F.lit(v > sizes[n] / 2))])
    return curves.select("feat_name", F.col("x_num").alias("x"), rnd(F.col("y") - begin, 2).alias("y"), wiggly[F.col("feat_name")].alias("wiggly"))


@query(
    "partial_dependence",
    f"WITH {CLASSES} SELECT CAST(l_linenumber AS DOUBLE) AS x, round(avg(price) - (SELECT avg(price) FROM c WHERE l_linenumber = 1), 3) AS y FROM c GROUP BY l_linenumber",
)
def partial_dependence(spark, folder):
    """The curve of the fit that takes the means, at its values, less its begin."""
    model = spline.fit_spline_gam(classes(spark, folder), "price", ["l_linenumber"], n_splines=12, lam=1e-6)
    curve = spline.partial_dependence(spark, model, 7)
    begin = curve.orderBy("x").first()["y"]
    return curve.select("x", rnd(F.col("y") - F.lit(begin), 3).alias("y"))


@query("binned_boosting", _level_means("l_linenumber", "avg(l_linenumber * l_linenumber)", "prediction", 2))
def binned_boosting(spark, folder):
    """Boosted to the end, every bag has the value of a bin where the target is a function of it."""
    frame = classes(spark, folder).withColumn("y", (F.col("l_linenumber") * F.col("l_linenumber")).cast("double"))
    model = boosting.fit_binned_boosting(frame, "y", ["l_linenumber"], key=KEY, max_bins=16, outer_bags=2, inner_bags=2, learning_rate=0.5, rounds=400)
    return _by(model, frame, "l_linenumber", 2)


@query("binned_boosting_logit", _level_means("l_linenumber", "avg(CASE WHEN l_linenumber <= 3 THEN 1.0 ELSE 0.0 END)", "prediction"))
def binned_boosting_logit(spark, folder):
    """A label that a bin decides is predicted without error."""
    frame = classes(spark, folder).withColumn("y", (F.col("l_linenumber") <= 3).cast("int"))
    model = boosting.fit_binned_boosting(frame, "y", ["l_linenumber"], ["l_linestatus"], "classification", key=KEY, max_bins=16, inner_bags=2, rounds=100, passes=4)
    return _by(model, frame, "l_linenumber")


def _scaled(spark, folder, cols):
    frame = classes(spark, folder)
    return encode.standard_scale(frame, cols).transform(frame)


def _holdout():
    from ..functions.scalars import hash_uniform

    return hash_uniform("val", *[F.col(k) for k in KEY]) < 0.15


def _line(spark, folder):
    """A target on a straight line of the line number, scaled to about one."""
    x = (F.col("l_linenumber") - 4) / 2
    return classes(spark, folder).withColumn("x", x.cast("double")).withColumn("y", (2 * x - 1).cast("double"))


LINE = "(2 * (l_linenumber - 4) / 2 - 1)"


@query("hidden_boosting", _level_means("l_linenumber", f"avg({LINE})", "prediction", 2))
def hidden_boosting(spark, folder):
    """A target on a line: the linear start and the learners after it end on the line."""
    frame = _line(spark, folder)
    model = hidden.fit_hidden_boosting(frame, "y", ["x", "label"], _holdout(), n_hid=5, n_estimators=40, init_reg=1e-4, pairs=[("x", "label")])
    return _by(model, frame, "l_linenumber", 2)


@query("hidden_boosting_logit", _level_means("l_linenumber", "avg(CASE WHEN l_linenumber > 4 THEN 1.0 ELSE 0.0 END)", "prediction"))
def hidden_boosting_logit(spark, folder):
    """A label that the value decides is predicted without error."""
    frame = _line(spark, folder).withColumn("z", (F.col("l_linenumber") > 4).cast("int"))
    model = hidden.fit_hidden_boosting(frame, "z", ["x"], _holdout(), "classification", n_hid=5, n_estimators=5, boost_rate=0.5,
                                       optimize_threshold=True)
    return _by(model, frame, "l_linenumber")


@query("hidden_gam", _level_means("l_linenumber", f"avg({LINE})", "prediction", 2))
def hidden_gam(spark, folder):
    """The whole fit on unscaled columns keeps the feature that makes the target."""
    frame = _line(spark, folder)
    model = hidden.fit_hidden_gam(frame, "y", ["l_linenumber", "l_tax"], feat_select=1, n_hid=6, n_estimators=30, init_reg=1e-4)
    return _by(model, frame, "l_linenumber", 2)


@query(
    "shape_functions",
    f"SELECT CAST((l_linenumber - 4) / 2 AS DOUBLE) AS x_num, round({LINE} - (SELECT avg({LINE}) FROM lineitem), 2) AS y, count(*) AS n FROM lineitem GROUP BY l_linenumber",
)
def shape_functions(spark, folder):
    """The centred shape of the feature that makes the target."""
    frame = _line(spark, folder)
    model = hidden.fit_hidden_boosting(frame, "y", ["x"], _holdout(), n_hid=4, n_estimators=20, init_reg=1e-4)
    return fx.center_effects(model.shape_functions(frame)).where("feat_name = 'x'").select("x_num", rnd("y", 2).alias("y"), "n")


def _planted_gain(by: str) -> str:
    return f"(SELECT sum(s * s / n) FROM (SELECT sum(r) AS s, count(*) AS n FROM p GROUP BY {by}))"


def _strongest_pair(target: str) -> str:
    """The pair of discrete columns whose cells explain most beyond both columns."""
    names = ("l_discount", "l_linenumber", "l_tax")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    found = " UNION ALL ".join(
        f"SELECT '{a}' AS feat_a, '{b}' AS feat_b, {_planted_gain(a + ', ' + b)} - {_planted_gain(a)} - {_planted_gain(b)} AS g" for a, b in pairs
    )
    return f"WITH p AS (SELECT *, {target} - avg({target}) OVER () AS r FROM lineitem), g AS ({found}) SELECT feat_a, feat_b FROM g ORDER BY g DESC LIMIT 1"


@query(
    "select_features",
    "WITH p AS (SELECT *, pow(l_discount * 20 - 1, 2) - avg(pow(l_discount * 20 - 1, 2)) OVER () AS r FROM lineitem), g AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS feat_name, {_planted_gain(n)} AS g" for n in ("l_discount", "l_quantity", "l_tax"))
    + ") SELECT feat_name FROM g ORDER BY g DESC LIMIT 1",
)
def select_features(spark, folder):
    """The feature whose values explain the target is the one that is kept."""
    names = ["l_discount", "l_quantity", "l_tax"]
    frame = _scaled(spark, folder, names).join(items(spark, folder).select(*KEY, F.col("l_discount").alias("raw")).distinct(), KEY)
    frame = frame.withColumn("y", F.pow(F.col("raw") * 20 - 1, 2))
    kept = interactions.select_features(frame, "y", names, 1, n_hid=8)
    return spark.createDataFrame([(n,) for n in kept], "feat_name string")


@query("pairs_by_tree", _strongest_pair("CASE WHEN l_discount > 0.045 AND l_tax > 0.035 THEN 1.0 ELSE 0.0 END"))
def pairs_by_tree(spark, folder):
    """A label that two features decide together: the tree uses these two."""
    frame = classes(spark, folder).withColumn("y", ((F.col("l_discount") > 0.045) & (F.col("l_tax") > 0.035)).cast("int"))
    found = interactions.pairs_by_tree(frame, "y", ["l_discount", "l_linenumber", "l_tax"], 1, "classification")
    return spark.createDataFrame([tuple(sorted(n.removeprefix("num__") for n in p)) for p in found], "feat_a string, feat_b string")


@query("pairs_by_lasso", _strongest_pair("(l_discount - 0.05) * (l_tax - 0.04) * 1000"))
def pairs_by_lasso(spark, folder):
    """A target that is a product of two features: their pair is the one that is kept."""
    names = ["l_discount", "l_linenumber", "l_tax"]
    frame = _scaled(spark, folder, names).withColumn("y", F.col("l_discount") * F.col("l_tax"))
    found = interactions.pairs_by_lasso(frame, "y", names, 1, KEY, n_hid=6)
    return spark.createDataFrame([tuple(sorted(p)) for p in found], "feat_a string, feat_b string")


@query(
    "bagged_gam",
    "SELECT 'l_quantity' AS feat_name, round(avg(abs(3 * (l_quantity - (SELECT avg(l_quantity) FROM lineitem)))), 4) AS importance FROM lineitem",
)
def bagged_gam(spark, folder):
    """On a straight line every bag has the line's slope, so the importance is that of the line."""
    frame = items(spark, folder).withColumn("y", 3 * F.col("l_quantity") + 2)
    model = bagging.fit_bagged_ridge(frame, "y", ["l_quantity"], bags=5, key=KEY, alpha=0.0)
    return fx.bag_importance(model.member_effects(frame)).withColumn("importance", rnd("importance", 4))


@query("subspace_ensemble", _level_means("l_linenumber", "avg(CASE WHEN l_linenumber > 4 THEN 1.0 ELSE 0.0 END)", "prediction"))
def subspace_ensemble(spark, folder):
    """Every subset of features decides the label, so the fused members do."""
    frame = classes(spark, folder).withColumn("z", (F.col("l_linenumber") > 4).cast("int"))
    frame = frame.withColumn("a", F.col("l_linenumber") * 1.0).withColumn("b", -F.col("l_linenumber") / 7).withColumn("d", F.exp(F.col("l_linenumber") / 7))
    model = bagging.fit_subspace_ensemble(frame, "z", ["a", "b", "d"], [], members=3, key=KEY, fusion="w.avgagg")
    return _by(model, frame, "l_linenumber")


HELD = "CAST(CAST('0x' || substr(md5(concat_ws('_', 'val', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 < 0.15"


@query(
    "validation_path",
    f"""WITH {CLASSES}, h AS (SELECT *, {HELD} AS val FROM c), m AS (SELECT l_returnflag, avg(price) AS mean FROM h WHERE NOT val GROUP BY ALL)
        SELECT 1e-7 AS lam, round(avg(pow(price - mean, 2)), 4) AS loss FROM h JOIN m USING (l_returnflag) WHERE val""",
)
def validation_path(spark, folder):
    """At next to no penalty a factor has the training means of its levels; their loss on the held rows ends the path."""
    model = spline.fit_by_validation(classes(spark, folder), "price", [], ["l_returnflag"], _holdout(), lambdas=(1.0, 1e-7))
    return spark.createDataFrame(model.info["validation_path"][-1:], "lam double, loss double").withColumn("loss", rnd("loss", 4))


@query(
    "nested_evaluation",
    """SELECT m.model, CAST(quality AS VARCHAR) AS "row", round(count(*) / 2.0, 4) AS mean
       FROM documents JOIN labels USING (doc_id), (VALUES ('logistic'), ('tree')) m(model) GROUP BY ALL""",
)
def nested_evaluation(spark, folder):
    """Two models with two configurations each over two folds: every row is tested once by each model."""
    from ..operators.reports import fold_mean_std

    docs = table(spark, folder, "documents").select("doc_id", "n_chars", "lang", "source")
    frame = docs.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")
    _, reports = evaluate.nested_evaluation(
        frame, "documents", ["doc_id"], "quality", ["n_chars"], ["lang", "source"], "classification",
        {"logistic": [{"C": 0.1}, {"C": 1.0}], "tree": [{"max_depth": 2}, {"max_depth": 4}]}, folds=2,
    )
    found = fold_mean_std(reports.where("metric = 'support' AND row IN ('0', '1')"), ("model", "row"))
    return found.select("model", "row", rnd("mean", 4).alias("mean"))


def _grid_loss(alpha: float) -> str:
    """Loss on the held rows of a one-feature elastic net of the other rows (l1_ratio 0.5)."""
    return f"(SELECT avg(pow(price - (my + b * (l_quantity - mx)), 2)) FROM (SELECT *, sign(cv) * greatest(abs(cv) - {alpha} * 0.5, 0) / (v + {alpha} * 0.5) AS b FROM t), h WHERE val)"


@query(
    "grid_search",
    f"""WITH {CLASSES}, h AS (SELECT *, {HELD} AS val FROM c),
        t AS (SELECT avg(l_quantity) AS mx, avg(price) AS my, covar_pop(l_quantity, price) AS cv, var_pop(l_quantity) AS v FROM h WHERE NOT val)
        SELECT 0 AS config_id, round({_grid_loss(0.01)}, 5) AS loss, false AS failed UNION ALL SELECT 1, round({_grid_loss(5.0)}, 5), false
        UNION ALL SELECT 2, CAST(NULL AS DOUBLE), true""",
)
def grid_search(spark, folder):
    """Trial log with losses and a failed configuration."""
    frame = classes(spark, folder).withColumn("val", _holdout())
    done = evaluate.grid_search(
        evaluate.FITS["elastic_net"], frame.where(~F.col("val")), frame.where("val"), "price", ["l_quantity"], [], "regression",
        [{"alpha": 0.01}, {"alpha": 5.0}, {"alpha": 0.1, "unknown": 1}],
    )
    rows = [t.row("lineitem", "elastic_net", 0) for t in done]
    return spark.createDataFrame(rows, evaluate.TRIAL_SCHEMA).select("config_id", rnd("loss", 5).alias("loss"), "failed")


@query(
    "shared_folds",
    f"""WITH {CLASSES}, h AS (SELECT l_quantity AS x, price, l_linenumber % 3 AS own, {HELD} AS val FROM c),
        m AS (SELECT k.fold, avg(price) AS m, stddev_pop(price) AS s FROM h, (VALUES (0), (1), (2)) k(fold) WHERE own <> fold GROUP BY ALL),
        z AS (SELECT fold, own, val, x, (price - m) / s AS z FROM h, m),
        a(config_id, alpha) AS (VALUES (0, 1.0), (1, 50000.0), (2, 1e7)),
        fit AS (SELECT fold, config_id, alpha, avg(x) AS mx, avg(z) AS mz, covar_pop(x, z) * count(*) / (var_pop(x) * count(*) + alpha) AS b
                FROM z, a WHERE own <> fold AND NOT val GROUP BY fold, config_id, alpha),
        loss AS (SELECT z.fold, config_id, alpha, avg(pow(z - mz - b * (x - mx), 2)) AS loss FROM z JOIN fit ON z.fold = fit.fold WHERE own <> z.fold AND val GROUP BY z.fold, config_id, alpha),
        best AS (SELECT fold, arg_min(alpha, (loss, config_id)) AS alpha FROM loss GROUP BY fold),
        refit AS (SELECT z.fold, avg(x) AS mx, avg(z) AS mz, covar_pop(x, z) * count(*) / (var_pop(x) * count(*) + alpha) AS b FROM z JOIN best ON best.fold = z.fold WHERE own <> z.fold GROUP BY z.fold, alpha)
        SELECT fold, 'loss of ' || config_id AS line, round(loss, 6) AS value FROM loss
        UNION ALL SELECT z.fold, 'RMSE', round(sqrt(avg(pow(z - mz - b * (x - mx), 2))), 6) FROM z JOIN refit ON z.fold = refit.fold WHERE own = z.fold GROUP BY z.fold
        UNION ALL SELECT z.fold, 'MAE', round(avg(abs(z - mz - b * (x - mx))), 6) FROM z JOIN refit ON z.fold = refit.fold WHERE own = z.fold GROUP BY z.fold""",
)
def shared_folds(spark, folder):
    """Three ridge candidates over three folds, refits and test reports: one pass for all fits, one for all reports."""
    grid = {"ridge": [{"alpha": 1.0}, {"alpha": 50000.0}, {"alpha": 1e7}]}
    trials, reports = folds.shared_evaluation(classes(spark, folder), "lineitem", KEY, "price", ["l_quantity"], [], "regression", grid, 3,
                                              fold=F.col("l_linenumber") % 3, val=_holdout())
    losses = trials.select("fold", F.concat(F.lit("loss of "), F.col("config_id").cast("string")).alias("line"), rnd("loss").alias("value"))
    return losses.unionByName(reports.where("metric IN ('RMSE', 'MAE')").select("fold", F.col("metric").alias("line"), rnd("value").alias("value")))


PENALTIES = (0.01, 0.1, 1.0)


@query(
    "logistic_path",
    f"WITH {CLASSES}, s AS (SELECT count(*) AS n, sum(label) AS p FROM c) SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, "
    f"round(ln(max(s.p) / (max(s.n) - max(s.p))), 4) AS intercept, 0 AS kept, true AS falling FROM c, s",
)
def logistic_path(spark, folder):
    """Several features and both factors, a path of lasso penalties fitted in step. At the strongest penalty no feature is left, and
    the constant is the log odds; every weaker penalty has a lower loss."""
    frame = classes(spark, folder)
    settings = [{"C": 1e-9, "penalty": "l1"}, *[{"C": v, "penalty": "l1"} for v in PENALTIES]]
    models = linear.fit_logistic_path(frame, "label", ["price", *NUM], CAT, settings, scale=True)
    losses = [m.loss(frame, "label") for m in models]
    kept = int((models[0].beta[1:] != 0).sum())
    counts = models[0].predict(frame).agg(F.count("prediction").alias("n"), F.sum(F.col("label").cast("long")).alias("positives"))
    return counts.select("n", "positives", F.lit(round(float(models[0].beta[0]), 4)).alias("intercept"), F.lit(kept).alias("kept"), F.lit(losses == sorted(losses, reverse=True)).alias("falling"))


FUSED_LAMBDAS = (50.0, 200.0)
JUMP = "CASE WHEN l_linenumber > 3 THEN 10.0 ELSE 0.0 END + (l_partkey % 7 - 3) / 100"


@query(
    "fused_path",
    f"""WITH y AS (SELECT l_linenumber, l_linenumber > 3 AS high, CAST({JUMP} AS DOUBLE) AS y FROM lineitem),
        s AS (SELECT high, avg(y) AS mean, count(*) AS n FROM y GROUP BY high), l(lam) AS (VALUES {", ".join(f"({v})" for v in FUSED_LAMBDAS)})
        SELECT CAST(lam AS DOUBLE) AS lam, l_linenumber, round(mean + CASE WHEN high THEN -1 ELSE 1 END * lam / n, 5) AS prediction, 1 AS jumps
        FROM (SELECT DISTINCT l_linenumber, high FROM y) JOIN s USING (high), l""",
)
def fused_path(spark, folder):
    """A target that jumps once: at every penalty of the path there is one jump, between the segments' means, each moved towards the
    other by the penalty over its rows."""
    frame = items(spark, folder).withColumn("y", F.expr(JUMP).cast("double"))
    model = fused.fit_fused_path(frame, "y", ["l_linenumber"], lambdas=FUSED_LAMBDAS)
    out = None
    for (lam, _, jumps), beta in zip(model.info["path"], model.info["coefficients"]):
        at = _by(AdditiveModel(model.design, beta), frame, "l_linenumber", 5).select(F.lit(lam).alias("lam"), "l_linenumber", "prediction", F.lit(jumps).alias("jumps"))
        out = at if out is None else out.unionByName(at)
    return out


@query(
    "fit_timing",
    """SELECT m.model, m.config_id, true AS timed, CAST(n.n AS BIGINT) AS n FROM (VALUES ('ridge', 0), ('ridge', 1), ('elastic_net', 0)) m(model, config_id), (SELECT count(*) AS n FROM orders) n""",
)
def fit_timing(spark, folder):
    """Every fit of a search has its seconds, in the trials and in the table of the store that a broken search would go on from."""
    frame = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    store = evaluate.TrialStore(spark, shared_path(spark, "trials"))
    for name, grid in {"ridge": [{"alpha": 1.0}, {"alpha": 10.0}], "elastic_net": [{"alpha": 0.5}]}.items():
        evaluate.grid_search(evaluate.FITS[name], frame, frame, "o_totalprice", ["o_custkey"], [], "regression", grid, store=store, name=("orders", name, 0))
    timed = (F.col("seconds") > 0) & ~F.col("failed")
    return store.trials().select("model", "config_id", timed.alias("timed"), F.lit(frame.count()).alias("n"))


def _seed_share(seed: int) -> str:
    return f"CAST(CAST('0x' || substr(md5(concat_ws('_', '{seed}', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 < 0.3"


SEEDS = [11 + 10 * i for i in range(10)]


@query(
    "retry_next_seed",
    f"WITH {CLASSES}, t AS ("
    + " UNION ALL ".join(f"SELECT {s} AS seed, count(*) AS n, avg(label) - (SELECT avg(label) FROM c) AS more FROM c WHERE {_seed_share(s)}" for s in SEEDS)
    + ") SELECT seed, n, round(more, 6) AS more FROM t WHERE more > 0 ORDER BY seed LIMIT 1",
)
def retry_next_seed(spark, folder):
    """A draw that is refused (too few positive rows) is drawn again with the next seed, ten further, until one is accepted."""
    from ..functions.scalars import hash_uniform

    frame = classes(spark, folder).select(*KEY, "label")
    share = frame.agg(F.avg("label")).first()[0]

    def draw(seed: int):
        found = frame.where(hash_uniform(seed, *[F.col(k) for k in KEY]) < 0.3).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("share")).first()
        if found["share"] <= share:
            raise ValueError(f"seed {seed}: {found['share']} positive rows")
        return found["n"], found["share"] - share

    (n, more), seed = evaluate.retry_next_seed(draw, SEEDS[0], 10, len(SEEDS))
    return spark.createDataFrame([(seed, n, round(more, 6))], "seed int, n long, more double")


BAGS = 3


def _bag_sql(bag: int) -> str:
    """Poisson(1) weight of a row in a bag: how many steps of the distribution its hash has passed."""
    from ..functions.scalars import poisson_cdf

    u = f"CAST(CAST('0x' || substr(md5(concat_ws('_', '0', '{bag}', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"
    weight = " + ".join(f"CAST(u >= {edge!r} AS INTEGER)" for edge in poisson_cdf(1.0))
    return (
        f"SELECT {bag} AS bag, CAST(sum(w) AS BIGINT) AS n, (sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w)) / (sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)) AS slope, "
        f"sum(w * y) / sum(w) AS my, sum(w * x) / sum(w) AS mx FROM (SELECT x, y, {weight} AS w FROM (SELECT l_quantity AS x, l_extendedprice AS y, {u} AS u FROM lineitem))"
    )


@query(
    "bagged_slopes",
    f"WITH b AS ({' UNION ALL '.join(_bag_sql(k) for k in range(BAGS))}) SELECT bag, round(slope, 4) AS slope, round(my - slope * mx, 2) AS intercept, n FROM b",
)
def bagged_slopes(spark, folder):
    """Least squares in every Poisson bag of a target with noise: the weighted slope, so that the weights of the bags matter."""
    from ..operators.split import bag_weights

    frame = items(spark, folder)
    model = bagging.fit_bagged_ridge(frame, TARGET, ["l_quantity"], bags=BAGS, key=KEY, alpha=0.0)
    sizes = bag_weights(frame, KEY, BAGS).agg(*[F.sum(f"bag_{k}").cast("long") for k in range(BAGS)]).first()
    rows = [(k, round(float(m.beta[1]), 4), round(m.intercept, 2), sizes[k]) for k, m in enumerate(model.members)]
    return spark.createDataFrame(rows, "bag int, slope double, intercept double, n long")
