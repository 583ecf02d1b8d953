"""Splits and resampling on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.order import exact_quantiles, exact_rank, value_prefix
from ..functions.scalars import hash_order, poisson_cdf
from ..operators import split
from .catalog import query, rnd, table

KEY = ["o_orderkey"]


def _ord(seed) -> str:
    return f"md5('{seed}_' || CAST(o_orderkey AS VARCHAR))"


@query(
    "exact_rank",
    f"""SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_ord(7)}) AS rank,
               count(*) OVER (PARTITION BY o_orderstatus) AS size FROM orders""",
)
def rank_rows(spark, folder):
    frame = table(spark, folder, "orders").withColumn("ord", hash_order(7, F.col("o_orderkey")))
    return exact_rank(frame, "ord", ["o_orderstatus"], total="size").select("o_orderkey", "o_orderstatus", "rank", "size")


@query(
    "value_prefix",
    """SELECT l_returnflag, l_extendedprice, n, CAST(coalesce(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_below
       FROM (SELECT l_returnflag, l_extendedprice, count(*) AS n FROM lineitem GROUP BY ALL)""",
)
def prefix(spark, folder):
    return value_prefix(table(spark, folder, "lineitem"), "l_extendedprice", {"n": F.count(F.lit(1))}, ["l_returnflag"])


@query(
    "exact_quantiles",
    """SELECT l_linestatus, count(CASE WHEN l_extendedprice < q1 THEN 1 END) AS low,
              count(CASE WHEN l_extendedprice BETWEEN q1 AND q3 THEN 1 END) AS middle,
              count(CASE WHEN l_extendedprice > q3 THEN 1 END) AS high FROM lineitem,
              (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
       GROUP BY ALL""",
)
def quantiles(spark, folder):
    frame = table(spark, folder, "lineitem")
    q1, q3 = exact_quantiles(frame, ["l_extendedprice"], [0.25, 0.75])["l_extendedprice"]
    x = F.col("l_extendedprice")
    return frame.groupBy("l_linestatus").agg(
        F.count_if(x < q1).alias("low"), F.count_if(x.between(q1, q3)).alias("middle"), F.count_if(x > q3).alias("high")
    )


@query(
    "kfold",
    f"SELECT o_orderkey, CAST((row_number() OVER (ORDER BY {_ord(42)}) - 1) % 5 AS INTEGER) AS fold FROM orders",
)
def kfold(spark, folder):
    return split.kfold(table(spark, folder, "orders"), KEY).select("o_orderkey", "fold")


@query(
    "stratified_kfold",
    f"""SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_ord(42)}) - 1) % 5 AS INTEGER)
               AS fold FROM orders""",
)
def stratified_kfold(spark, folder):
    return split.stratified_kfold(table(spark, folder, "orders"), KEY, "o_orderstatus").select("o_orderkey", "fold")


@query(
    "train_val_split",
    f"""SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_ord(1337)}) <=
                                ceil(0.25 * count(*) OVER (PARTITION BY o_orderpriority)) THEN 'val' ELSE 'train' END AS part
        FROM orders""",
)
def train_val_split(spark, folder):
    return split.train_val_split(table(spark, folder, "orders"), KEY, 0.25, "o_orderpriority").select("o_orderkey", "part")


@query("shuffle", f"SELECT o_orderkey, {_ord(42)} AS ord FROM orders")
def shuffle(spark, folder):
    out = split.shuffle(table(spark, folder, "orders"), KEY)
    return out.select("o_orderkey", hash_order(42, F.col("o_orderkey")).alias("ord"))


def _poisson_sql(u: str, rate: float) -> str:
    return " + ".join(f"CASE WHEN {u} >= CAST({edge!r} AS DOUBLE) THEN 1 ELSE 0 END" for edge in poisson_cdf(rate))


@query(
    "bootstrap",
    f"""WITH u AS (SELECT o_orderkey, o_totalprice, CAST(b AS INTEGER) AS bag,
                          CAST(CAST('0x' || substr(md5('3_' || CAST(b AS VARCHAR) || '_' || CAST(o_orderkey AS VARCHAR)), 1, 8)
                               AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM orders, range(10) t(b)),
             w AS (SELECT bag, o_totalprice, {_poisson_sql('u', 0.8)} AS weight FROM u)
        SELECT bag, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight, round(sum(weight * o_totalprice), 2) AS total
        FROM w WHERE weight > 0 GROUP BY ALL""",
)
def bootstrap(spark, folder):
    out = split.bootstrap(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), KEY, 10, 0.8, 3)
    return out.groupBy("bag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"),
        rnd(F.sum(F.col("weight") * F.col("o_totalprice")), 2).alias("total"),
    )


@query(
    "random_subspace",
    """WITH f AS (SELECT DISTINCT p_name AS feat_name FROM part),
            r AS (SELECT CAST(b AS INTEGER) AS bag, feat_name, row_number() OVER (PARTITION BY b
                         ORDER BY md5('5_' || CAST(b AS VARCHAR) || '_' || feat_name)) AS r FROM f, range(10) t(b))
       SELECT bag, feat_name FROM r WHERE r <= 6""",
)
def random_subspace(spark, folder):
    features = table(spark, folder, "part").select(F.col("p_name").alias("feat_name")).distinct()
    return split.random_subspace(features, 10, 6, 5)


@query(
    "repeat_splits",
    """WITH s AS (SELECT o_orderkey, o_totalprice, CAST(seed AS INTEGER) AS seed, row_number() OVER (PARTITION BY seed
                  ORDER BY md5(CAST(seed AS VARCHAR) || '_' || CAST(o_orderkey AS VARCHAR))) AS r,
                  count(*) OVER (PARTITION BY seed) AS n FROM orders, range(1, 11) t(seed))
       SELECT seed, CASE WHEN r <= ceil(0.33 * n) THEN 'val' ELSE 'train' END AS part, count(*) AS n,
              round(sum(o_totalprice), 2) AS total FROM s GROUP BY ALL""",
)
def repeat_splits(spark, folder):
    out = split.repeat_splits(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), KEY, range(1, 11))
    return out.groupBy("seed", "part").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("o_totalprice"), 2).alias("total"))


@query("sample_rows", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_ord(0)} LIMIT 10000")
def sample_rows(spark, folder):
    return split.sample_rows(table(spark, folder, "orders"), KEY, 10_000).select("o_orderkey", "o_totalprice")
