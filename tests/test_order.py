import numpy as np
import pytest
from pyspark.sql import functions as F

from gamspark.functions.joins import lookup_join
from gamspark.functions.order import exact_quantiles, exact_rank, hash_thresholds, value_prefix, value_ranges
from gamspark.functions.scalars import hash_order


@pytest.mark.parametrize("limit", [100_000, 50, 0])
def test_quantiles_equal_numpy(spark, limit):
    rng = np.random.default_rng(1)
    a = rng.normal(size=20_000)
    b = np.where(rng.random(20_000) < 0.35, 7.0, rng.integers(0, 12, 20_000)).astype(float)
    rows = [(float(x), float(y), 3.0, None) for x, y in zip(a, b)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(7)
    probs = [0.0, 0.013, 0.25, 0.5, 0.977, 1.0]
    got = exact_quantiles(df, ["a", "b", "c", "d"], probs, collect_limit=limit, accuracy=200)
    assert np.allclose(got["a"], np.quantile(a, probs))
    assert np.allclose(got["b"], np.quantile(b, probs))
    assert got["c"] == [3.0] * 6 and got["d"] == [None] * 6


def test_quantiles_ignore_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,), (10.0,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5])["x"] == [2.0]


@pytest.mark.parametrize("digits", [1, 3])
def test_rank_does_not_depend_on_partitioning(spark, digits):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") < 1000, None).otherwise(F.col("id") % 2))
    df = df.withColumn("o", hash_order(5, F.col("id")))
    one = {r["id"]: (r["r"], r["t"]) for r in exact_rank(df.repartition(1), "o", ["g"], "r", digits, "t").collect()}
    many = {r["id"]: (r["r"], r["t"]) for r in exact_rank(df.repartition(13), "o", ["g"], "r", digits, "t").collect()}
    assert one == many
    groups = {}
    for r in df.collect():
        groups.setdefault(r["g"], []).append((r["o"], r["id"]))
    for rows in groups.values():
        for rank, (_, key) in enumerate(sorted(rows), 1):
            assert one[key] == (rank, len(rows))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_prefix_sums_with_a_hot_value(spark, by):
    rng = np.random.default_rng(2)
    x = np.where(rng.random(6000) < 0.4, 0.5, rng.random(6000)).round(3)
    g = rng.choice(["a", "b"], 6000, p=[0.9, 0.1])
    df = spark.createDataFrame([(str(k), float(v)) for k, v in zip(g, x)], "g string, x double").repartition(5)
    out = value_prefix(df, "x", {"n": F.count(F.lit(1))}, by, buckets=16).collect()
    for row in out:
        mine = x if not by else x[g == row["g"]]
        assert row["n"] == np.sum(mine == row["x"])
        assert row["n_below"] == np.sum(mine < row["x"])
    assert sum(r["n"] for r in out) == 6000


def test_lookup_join_paths_agree(spark):
    rng = np.random.default_rng(3)
    keys = [None if u < 0.1 else (0 if u < 0.5 else int(u * 400)) for u in rng.random(4000)]
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k int")
    table = spark.range(0, 350).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    want = {i: None if k is None or k >= 350 else 2 * k for i, k in enumerate(keys)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        rows = lookup_join(left, table, ["k"]).select("id", "v").collect()
        assert len(rows) == 4000 and {r["id"]: r["v"] for r in rows} == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_value_prefix_leaves_nan_out(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,), (1.0,)], "x double")
    got = {r["x"]: (r["n"], r["n_below"]) for r in value_prefix(df, "x", {"n": F.count(F.lit(1))}).collect()}
    assert got == {1.0: (2, 0), 3.0: (1, 2)}


def test_poisson_weights_reach_far(spark):
    from gamspark.functions.scalars import poisson_cdf

    assert 1 - poisson_cdf(20.0)[-1] < 1e-15 and len(poisson_cdf(20.0)) > 60
    assert poisson_cdf(1.0, 3) == poisson_cdf(1.0)[:3]


def test_ranges_are_ordered_and_need_no_cut_list(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.random(5000) < 0.3, 1.0, rng.normal(size=5000))
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(6)
    ranged, n = value_ranges(df, "x", 7)
    assert n == 7
    ends = ranged.groupBy("__vb").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("__vb").collect()
    assert len(ends) > 3 and all(a["hi"] < b["lo"] for a, b in zip(ends, ends[1:]))
    assert sorted(r["x"] for r in ranged.collect()) == sorted(x.tolist())
    assert value_ranges(df, "x")[1] == 1


def test_prefix_with_a_null_group(spark):
    rows = [(None, 1.0), (None, 2.0), ("a", 1.0), (None, 2.0), ("a", 5.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    want = {(None, 1.0): (1, 0), (None, 2.0): (2, 1), ("a", 1.0): (1, 0), ("a", 5.0): (1, 1)}
    for buckets in (None, 3):
        got = value_prefix(df, "x", {"n": F.count(F.lit(1))}, ["g"], buckets).collect()
        assert {(r["g"], r["x"]): (r["n"], r["n_below"]) for r in got} == want


@pytest.mark.parametrize("few", [4096, 5, 0])
@pytest.mark.parametrize("frac", [0.0, 0.33, 1.0, 2.0])
def test_thresholds_equal_sorted_hashes(spark, monkeypatch, few, frac):
    monkeypatch.setattr("gamspark.functions.order.THRESHOLD_ROWS", few)
    df = spark.range(700).withColumn("s", F.explode(F.array(F.lit(3), F.lit(9))))
    df = df.withColumn("o", hash_order(F.col("s"), F.when(F.col("id") < 200, F.lit(-1)).otherwise(F.col("id")))).repartition(5)
    hashes = {}
    for r in df.collect():
        hashes.setdefault(r["s"], []).append(r["o"])
    k = min(700, int(np.ceil(frac * 700)))
    assert hash_thresholds(df, "s", "o", frac) == {s: sorted(h)[k - 1] if k else None for s, h in hashes.items()}


def test_repeated_splits_move_no_rows(spark):
    from gamspark.operators.split import repeat_splits

    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    out = repeat_splits(df, ["id"], [1, 2, 3], 0.25)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    counts = {(r["seed"], r["part"]): r["count"] for r in out.groupBy("seed", "part").count().collect()}
    assert counts == {(s, p): n for s in (1, 2, 3) for p, n in (("val", 250), ("train", 750))}
    assert repeat_splits(df.limit(0), ["id"], [1, 2]).count() == 0


def test_bag_weights_join_the_key_once(spark):
    """All bags hash one text of the key, the text that ``hash_order`` makes of its columns, also where some or all are missing."""
    from gamspark.functions.scalars import hash_uniform, poisson_cdf
    from gamspark.operators.split import bag_weights

    rows = [(1, "a", ""), (2, None, "x"), (None, "b", None), (None, None, None), (None, None, ""), (None, "", None), *[(i, str(i % 7), None) for i in range(60)]]
    df = spark.createDataFrame(rows, "p int, q string, r string")
    got = bag_weights(df, ["p", "q", "r"], 6, 2.0, seed=3)
    assert got.columns == ["p", "q", "r", *[f"bag_{b}" for b in range(6)]]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cast(p#") <= 2  # the text and whether there is one, not once a bag
    us = df.select(*[hash_uniform(3, F.lit(b), F.col("p"), F.col("q"), F.col("r")) for b in range(6)]).collect()
    steps = poisson_cdf(2.0)
    assert [tuple(r)[3:] for r in got.collect()] == [tuple(sum(u >= s for s in steps) for u in r) for r in us]
    none = spark.range(1).select(F.lit(None).cast("double").alias("u"))
    from gamspark.functions.scalars import poisson_weight

    assert none.select(poisson_weight(F.col("u"), 1.0)).first()[0] is None
