"""Encoders and scalers on the shared tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import encode
from .catalog import query, rnd, table

FLAG = ("l_returnflag", "l_linestatus")


@query(
    "one_hot",
    """SELECT l_linenumber, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS "cat__l_returnflag_A",
              count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS "cat__l_returnflag_N",
              count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS "cat__l_returnflag_R",
              count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS "cat__l_linestatus_O" FROM lineitem GROUP BY ALL""",
)
def one_hot(spark, folder):
    frame = table(spark, folder, "lineitem")
    hot = encode.one_hot(frame, FLAG)
    return hot.transform(frame).groupBy("l_linenumber").agg(*[F.sum(n).alias(n) for n in hot.names])


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    "one_hot_dummies",
    "SELECT o_orderstatus, "
    + ", ".join(f"""count(CASE WHEN o_orderpriority = '{p}' THEN 1 END) AS "o_orderpriority_{p}" """ for p in PRIORITIES[1:])
    + " FROM orders GROUP BY ALL",
)
def one_hot_dummies(spark, folder):
    frame = table(spark, folder, "orders")
    hot = encode.one_hot_dummies(frame, ["o_orderpriority"], drop="first")
    return hot.transform(frame).groupBy("o_orderstatus").agg(*[F.sum(f"`{n}`").alias(n) for n in hot.names])


@query(
    "label_encode",
    """WITH lv AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS l FROM orders
                   WHERE o_orderpriority <> '3-MEDIUM'))
       SELECT o_orderpriority, CAST(coalesce(code, 0) AS INTEGER) AS code, count(*) AS n
       FROM orders LEFT JOIN lv ON l = o_orderpriority GROUP BY ALL""",
)
def label_encode(spark, folder):
    frame = table(spark, folder, "orders")
    known = encode.label_encode(frame.where("o_orderpriority <> '3-MEDIUM'"), ["o_orderpriority"])
    out = known.transform(frame.withColumn("level", F.col("o_orderpriority")))
    return out.groupBy(F.col("level").alias("o_orderpriority"), F.col("o_orderpriority").alias("code")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _scaled_sql(shift: str, scale: str) -> str:
    return f"""WITH s AS (SELECT {shift} AS a, {scale} AS b FROM orders)
               SELECT o_orderkey, round((o_totalprice - a) / b, 6) AS scaled FROM orders, s"""


def _scaled(scaler, frame):
    return scaler.transform(frame, {"o_totalprice": "scaled"}).select("o_orderkey", rnd("scaled").alias("scaled"))


@query("standard_scale", _scaled_sql("avg(o_totalprice)", "stddev_pop(o_totalprice)"))
def standard_scale(spark, folder):
    frame = table(spark, folder, "orders")
    return _scaled(encode.standard_scale(frame, ["o_totalprice"]), frame)


@query("minmax_scale", _scaled_sql("min(o_totalprice)", "max(o_totalprice) - min(o_totalprice)"))
def minmax_scale(spark, folder):
    frame = table(spark, folder, "orders")
    return _scaled(encode.minmax_scale(frame, ["o_totalprice"]), frame)


@query(
    "robust_scale",
    _scaled_sql("median(o_totalprice)", "quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)"),
)
def robust_scale(spark, folder):
    frame = table(spark, folder, "orders")
    return _scaled(encode.robust_scale(frame, ["o_totalprice"]), frame)


@query("inverse_scale", "SELECT o_orderkey, round(o_totalprice, 4) AS price FROM orders")
def inverse_scale(spark, folder):
    frame = table(spark, folder, "orders")
    scaler = encode.standard_scale(frame, ["o_totalprice"])
    return scaler.inverse(scaler.transform(frame)).select("o_orderkey", rnd("o_totalprice", 4).alias("price"))


@query(
    "column_transformer",
    """WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st
                  FROM lineitem)
       SELECT l_linenumber, count(*) AS n, round(sum((l_quantity - mq) / sq), 5) AS qty, round(sum((l_tax - mt) / st), 5) AS tax,
              CAST(count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS DOUBLE) AS open
       FROM lineitem, s GROUP BY ALL""",
)
def column_transformer(spark, folder):
    frame = table(spark, folder, "lineitem")
    fitted = encode.column_transformer(frame, ["l_quantity", "l_tax"], FLAG)
    at = {n: i for i, n in enumerate(fitted.names)}
    vec = fitted.transform(frame, vector="features").select("l_linenumber", vector_to_array("features").alias("v"))
    return vec.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"),
        rnd(F.sum(F.col("v")[at["num__l_quantity"]]), 5).alias("qty"),
        rnd(F.sum(F.col("v")[at["num__l_tax"]]), 5).alias("tax"),
        F.sum(F.col("v")[at["cat__l_linestatus_O"]]).alias("open"),
    )


@query(
    "feature_type_lists",
    """SELECT 'numeric' AS kind, 'p_size' AS source, CAST(1 AS BIGINT) AS n_encoded
       UNION ALL SELECT 'categorical', 'p_brand', count(DISTINCT p_brand) FROM part
       UNION ALL SELECT 'categorical', 'p_type', count(DISTINCT p_type) FROM part""",
)
def feature_type_lists(spark, folder):
    fitted = encode.column_transformer(table(spark, folder, "part"), ["p_size"], ["p_brand", "p_type"])
    return encode.feature_type_lists(fitted.mapping(spark))


@query(
    "balanced_weights",
    """WITH s AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality)
       SELECT l.quality, round(sum((SELECT sum(n) FROM s) / ((SELECT count(*) FROM s) * CAST(s.n AS DOUBLE))), 6) AS weight,
              count(*) AS n FROM labels l JOIN s USING (quality) GROUP BY ALL""",
)
def balanced_weights(spark, folder):
    out = encode.balanced_weights(table(spark, folder, "labels"), "quality")
    return out.groupBy("quality").agg(rnd(F.sum("weight")).alias("weight"), F.count(F.lit(1)).alias("n"))
