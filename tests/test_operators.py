import numpy as np
import pytest
from pyspark.sql import functions as F

from gamspark.functions.scalars import sigmoid
from gamspark.operators import effects as fx
from gamspark.operators import encode, ensemble, explain, hpo, metrics, reports, split


@pytest.fixture(scope="module")
def items(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet")


@pytest.fixture(scope="module")
def orders(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet")


def test_fold_sizes_differ_by_at_most_one(orders):
    sizes = [r["count"] for r in split.kfold(orders, ["o_orderkey"], 7).groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 7
    per = split.stratified_kfold(orders, ["o_orderkey"], "o_orderstatus", 4).groupBy("o_orderstatus", "fold").count().collect()
    for status in {r["o_orderstatus"] for r in per}:
        counts = [r["count"] for r in per if r["o_orderstatus"] == status]
        assert max(counts) - min(counts) <= 1


def test_unique_key_is_checked(items, orders):
    with pytest.raises(ValueError):
        split.assert_unique(items, ["l_orderkey"])
    split.assert_unique(orders, ["o_orderkey"])


def test_bag_columns_equal_bag_rows(orders):
    wide = split.bag_weights(orders, ["o_orderkey"], 3, 1.0, 9).agg(*[F.sum(f"bag_{b}") for b in range(3)]).first()
    long = split.bootstrap(orders, ["o_orderkey"], 3, 1.0, 9).groupBy("bag").agg(F.sum("weight").alias("w")).collect()
    assert list(wide) == [r["w"] for r in sorted(long, key=lambda r: r["bag"])]
    assert abs(wide[0] / orders.count() - 1) < 0.1


def test_one_hot_rules(spark):
    train = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z")], "two string, three string")
    hot = encode.one_hot(train, ["two", "three"])
    assert hot.names == ["cat__two_b", "cat__three_x", "cat__three_y", "cat__three_z"]
    unseen = hot.transform(spark.createDataFrame([("q", None)], "two string, three string")).first()
    assert [unseen[n] for n in hot.names] == [0, 0, 0, 0]


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    for fit in (encode.standard_scale, encode.minmax_scale, encode.robust_scale):
        assert [r["x"] for r in fit(df, ["x"]).transform(df).collect()] == [0.0, 0.0]


def test_target_scale_of_effects(items):
    scaler = encode.standard_scale(items, ["l_extendedprice"])
    raw = fx.center_effects(fx.mean_effects(items, "l_extendedprice", ["l_quantity"]))
    scaled = fx.center_effects(fx.mean_effects(scaler.transform(items), "l_extendedprice", ["l_quantity"]))
    back = scaler.effect_scale(scaled, "l_extendedprice")
    a = {(r["feat_name"], r["x_num"]): r["y"] for r in raw.collect()}
    b = {(r["feat_name"], r["x_num"]): r["y"] for r in back.collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_centred_effects_have_weighted_mean_zero(items):
    out = fx.center_effects(fx.mean_effects(items, "l_extendedprice", ["l_quantity", "l_tax"], ["l_returnflag"]))
    means = out.where("feat_idx >= 0").groupBy("feat_name").agg((F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("m"))
    assert all(abs(r["m"]) < 1e-6 for r in means.collect())


@pytest.fixture
def no_broadcast(spark):
    """Joins as of tables beyond the broadcast threshold."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("count", [1, 5, 20])
def test_contributions_read_the_rows_once(spark, no_broadcast, count):
    names = [f"f{i}" for i in range(count)]
    rows = spark.range(50).select("id", *[(F.col("id") % (i + 2)).cast("double").alias(n) for i, n in enumerate(names)])
    table = fx.mean_effects(rows, "id", names)
    scored = fx.score_by_effects(rows, table, names)
    plan = scored._jdf.queryExecution().analyzed().toString()
    assert plan.count("Range (0, 50") == 1 and plan.count("Join LeftOuter") == count
    means = {n: {r[n]: r["m"] for r in rows.groupBy(n).agg(F.avg("id").alias("m")).collect()} for n in names}
    assert all(abs(r["score"] - sum(means[n][r[n]] for n in names)) < 1e-9 for r in scored.collect())


def test_centring_keeps_scores_and_large_tables_join_the_same(items, no_broadcast, spark):
    raw = fx.mean_effects(items, "l_extendedprice", ["l_quantity"], ["l_returnflag"])
    total = [fx.score_by_effects(items, t, ["l_quantity"], ["l_returnflag"]).agg(F.sum("score")).first()[0]
             for t in (raw, fx.center_effects(raw))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    total.append(fx.score_by_effects(items, raw, ["l_quantity"], ["l_returnflag"]).agg(F.sum("score")).first()[0])
    assert np.allclose(total, total[0], rtol=1e-12)


def test_merged_levels_keep_the_score(spark, items):
    hot = encode.one_hot(items, ["l_returnflag"], drop=None)
    wide = hot.transform(items)
    raw = fx.mean_effects(wide, "l_extendedprice", ["l_quantity", *hot.names])
    merged = fx.merge_onehot_effects(raw, spark.createDataFrame(hot.mapping_rows(), encode.MAPPING_SCHEMA))
    a = fx.score_by_effects(wide, raw, ["l_quantity", *hot.names], name="a")
    both = fx.score_by_effects(a, merged, ["l_quantity"], ["l_returnflag"], name="b")
    assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-6


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_nearest_effect_and_ties_go_down(spark, no_broadcast, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    known = [(0.0, 10.0), (2.0, 20.0), (2.0, 25.0), (7.0, 30.0), (None, 1.0), (float("nan"), 2.0)]
    knots = spark.createDataFrame(known, "x_num double, y double")
    values = (-5.0, 1.0, 1.0, 1.01, 4.5, 4.6, 99.0, None, float("nan"))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r["y"] for r in fx.nearest_effect(df, "x", knots).orderBy("i").collect()]
    assert got == [10.0, 10.0, 10.0, 20.0, 20.0, 30.0, 30.0, None, None]
    assert [r["y"] for r in fx.nearest_effect(df, "x", knots.where("false")).collect()] == [None] * len(values)
    assert fx.nearest_effect(df.where("false"), "x", knots).count() == 0
    one = fx.nearest_effect(df, "x", knots.where("x_num = 0")).orderBy("i").collect()
    assert [r["y"] for r in one] == [10.0] * 7 + [None] * 2


def test_bin_effect_of_missing_values(spark):
    df = spark.createDataFrame([(0, None), (1, float("nan")), (2, 1.0), (3, 5.0)], "i int, x double")
    assert [r["y"] for r in fx.bin_effect(df, "x", [1.0], [7.0, 8.0]).orderBy("i").collect()] == [None, None, 8.0, 8.0]


def test_local_filters(spark):
    effects = fx.offset_row(spark, 5.0).unionByName(spark.createDataFrame(
        [("age", 0, 1.0, None, 0.9, None, 1), ("agent", 1, 1.0, None, -0.1, None, 1), ("agent", 1, 2.0, None, -3.0, None, 1)],
        "feat_name string, feat_idx int, x_num double, x_cat string, y double, y_std double, n bigint"))
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 2.0)], "id int, age double, agent double")
    out = explain.local_contributions(df, effects, ["age", "agent"])
    ids = lambda *f: sorted(r["id"] for r in explain.filter_local(out, f).collect())
    assert ids(explain.LocalFilter(number=1.0)) == [2]
    assert ids(explain.LocalFilter(number=4.0)) == []
    assert ids(explain.LocalFilter(word="agen")) == [1, 2]
    assert ids(explain.LocalFilter(word="agen", exact=True)) == []
    assert ids(explain.LocalFilter(number=0.5, word="agent", exact=True)) == [2]
    assert ids(explain.LocalFilter(number=0.5), explain.LocalFilter(number=1.0, word="agent")) == [2]


def test_scores_of_a_stream(spark, items, tmp_path):
    path = str(tmp_path / "in")
    items.select("l_quantity", "l_returnflag").write.parquet(path)
    effects = fx.center_effects(fx.mean_effects(items, "l_extendedprice", ["l_quantity"], ["l_returnflag"]))
    stream = spark.readStream.schema("l_quantity double, l_returnflag string").parquet(path)
    scored = fx.score_by_effects(stream, effects, ["l_quantity"], ["l_returnflag"])
    query = scored.writeStream.format("memory").queryName("scored_rows").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    want = fx.score_by_effects(items, effects, ["l_quantity"], ["l_returnflag"]).agg(F.sum("score"), F.count("score")).first()
    got = spark.table("scored_rows").agg(F.sum("score"), F.count("score")).first()
    assert got[1] == want[1] and abs(got[0] - want[0]) < 1e-3


def test_auc_brute_force_and_flip(spark):
    rng = np.random.default_rng(4)
    score, label = rng.integers(0, 9, 400), rng.integers(0, 2, 400)
    df = spark.createDataFrame([(int(s), int(y)) for s, y in zip(score, label)], "s int, y int")
    pos, neg = score[label == 1], score[label == 0]
    brute = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    auc = metrics.roc_auc(df, "y", "s").first()[0]
    flipped = metrics.roc_auc(df.withColumn("y", 1 - F.col("y")), "y", "s").first()[0]
    assert abs(auc - brute) < 1e-12 and abs(auc + flipped - 1) < 1e-12


def test_best_threshold_brute_force(spark):
    rng = np.random.default_rng(5)
    score, label = rng.random(200).round(2), rng.integers(0, 2, 200)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label)], "s double, y int")
    best = metrics.best_threshold(df, "y", "s").first()
    util = {t: (np.mean(score[label == 1] > t) + np.mean(score[label == 0] <= t)) / 2 for t in np.unique(score)}
    top = max(util.values())
    assert abs(best["utility"] - top) < 1e-12
    assert best["threshold"] == max(t for t, u in util.items() if abs(u - top) < 1e-12)


def test_report_of_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y int, p int")
    rows = {r["row"]: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert rows["1"]["precision"] == 0.0 and rows["1"]["recall"] == 0.0 and rows["1"]["f1_score"] == 0.0
    assert abs(rows["accuracy"]["support"] - 2 / 3) < 1e-12 and rows["macro avg"]["support"] == 3.0


def test_stable_functions(spark):
    row = spark.range(1).select(sigmoid(F.lit(-800.0)), sigmoid(F.lit(800.0)), metrics.raw_logloss(F.lit(1.0), F.lit(-800.0))).first()
    assert row[0] == 0.0 and row[1] == 1.0 and row[2] == 800.0


def test_config_text(spark):
    text = "'hidden': [8,\n 8]\n'act': 'relu'\nrate: 1e-3_x000D_"
    parsed = spark.createDataFrame([(text,), ("bad line",)], "t string").select(hpo.parse_config(F.col("t")).alias("p")).collect()
    assert parsed[0]["p"] == {"hidden": "[8,  8]", "act": "relu", "rate": "1e-3"} and parsed[1]["p"] is None
    kinds = spark.createDataFrame([("3",), ("1e-3",), ("relu",)], "v string").select(hpo.value_kind(F.col("v"))).collect()
    assert [k[0] for k in kinds] == ["int", "float", "text"]


def test_majority_tie_goes_to_the_first_fold(spark):
    rows = [(f, {"a": v}) for f, v in enumerate(["x", "y", "y", "x"], 1)] + [(5, {"b": "1"})]
    df = spark.createDataFrame(rows, "fold int, params map<string,string>").withColumns({"dataset": F.lit("d"), "model": F.lit("m")})
    out = {r["key"]: (r["value"], r["votes"], r["tie"]) for r in hpo.majority_config(df).collect()}
    assert out == {"a": ("x", 2, True), "b": ("1", 1, False)}


def test_invalid_configs(spark):
    rows = [{"solver": "lbfgs", "penalty": "l1"}, {"solver": "lbfgs", "penalty": "l2"}, {"solver": "saga", "penalty": "elasticnet"},
            {"solver": "saga", "penalty": "elasticnet", "l1_ratio": "0.5"}, {"solver": "liblinear", "penalty": "l2", "l1_ratio": "0.1"},
            {"max_depth": "3", "class_weight": "balanced"}]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(rows)], "id int, params map<string,string>")
    assert sorted(r["id"] for r in hpo.drop_invalid_configs(df).collect()) == [1, 3, 5]
    assert sorted(r["id"] for r in hpo.drop_invalid_configs(df, task="regression").collect()) == [1, 3]


def test_stopping(spark):
    losses = [5.0, 4.0, 4.5, 4.4, 3.0, 3.5, 3.6, 3.7, 1.0]
    df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(losses)], "round int, val_loss double")
    assert tuple(hpo.stopping_round(df, 2).first()) == (5, 8)
    assert tuple(hpo.stopping_round(df, 50).first()) == (9, 9)
    assert tuple(hpo.stopping_round(df, 2, initial=0.5).first()) == (0, 3)


def test_rank_sums(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(f"d{d}", f"m{m}", float(rng.integers(0, 4))) for d in range(5) for m in range(6)],
                               "dataset string, model string, mean double")
    for metric in ("RMSE", "ROC_AUC"):
        sums = reports.rank_models(df, metric).groupBy("dataset").agg(F.sum("rank").alias("s")).collect()
        assert all(r["s"] == 21.0 for r in sums)


def test_fused_columns_equal_fused_rows(spark):
    df = spark.createDataFrame([(1, 0.2, 0.9, 0.6), (2, 0.5, 0.1, 0.3)], "id int, a double, b double, c double")
    w = [1.0, 2.0, 0.5]
    wide = df.select("id", *[e.alias(n) for n, e in ensemble.fuse_columns([F.col(x) for x in "abc"], w).items()]).orderBy("id").collect()
    long = df.select("id", F.posexplode(F.array(*"abc")).alias("m", "p")).withColumn("w", F.get(F.array(*[F.lit(x) for x in w]), F.col("m")))
    rows = ensemble.fuse_members(long, ["id"], "p", "w").orderBy("id").collect()
    assert all(np.allclose([a[n] for n in a.__fields__], [b[n] for n in a.__fields__]) for a, b in zip(wide, rows))
