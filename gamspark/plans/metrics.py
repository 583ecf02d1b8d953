"""Metrics on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import effects as fx
from ..operators import metrics
from .catalog import query, rnd, table


def predicted(spark, folder):
    """Price predicted by the mean price of its quantity."""
    frame = table(spark, folder, "lineitem")
    effects = fx.mean_effects(frame, "l_extendedprice", ["l_quantity"])
    return fx.score_by_effects(frame, effects, ["l_quantity"], name="prediction")


PRED = (
    "p AS (SELECT l_returnflag, l_extendedprice AS y, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_quantity) AS e "
    "FROM lineitem)"
)


@query(
    "regression_report",
    f"""WITH {PRED} SELECT l_returnflag, round(sqrt(avg(e * e)), 4) AS "RMSE", round(avg(e * e), 2) AS "MSE",
        round(avg(abs(e)), 4) AS "MAE", round(1 - var_pop(e) / var_pop(y), 6) AS "EVS",
        round(1 - avg(e * e) / var_pop(y), 6) AS "R2", round(max(abs(e)), 5) AS "Max Error", count(*) AS n, CAST(0 AS BIGINT) AS n_unscored FROM p GROUP BY ALL""",
)
def regression_report(spark, folder):
    return _rounded_report(predicted(spark, folder))


def _rounded_report(frame):
    out = metrics.regression_report(frame, "l_extendedprice", "prediction", ["l_returnflag"])
    digits = {"RMSE": 4, "MSE": 2, "MAE": 4, "EVS": 6, "R2": 6, "Max Error": 5}
    return out.select("l_returnflag", *[rnd(n, d).alias(n) for n, d in digits.items()], "n", "n_unscored")


@query(
    "regression_report_unscored",
    f"""WITH {PRED} SELECT l_returnflag, round(sqrt(avg(e * e)), 4) AS "RMSE", round(avg(e * e), 2) AS "MSE",
        round(avg(abs(e)), 4) AS "MAE", round(1 - var_pop(e) / var_pop(y), 6) AS "EVS",
        round(1 - avg(e * e) / var_pop(y), 6) AS "R2", round(max(abs(e)), 5) AS "Max Error", count(*) AS n,
        (SELECT count(*) FROM p q WHERE q.y >= 30000 AND q.l_returnflag = p.l_returnflag) AS n_unscored FROM p WHERE y < 30000 GROUP BY ALL""",
)
def regression_report_unscored(spark, folder):
    """Rows without a prediction count, but enter no figure."""
    frame = predicted(spark, folder)
    return _rounded_report(frame.withColumn("prediction", F.when(F.col("l_extendedprice") < 30000, F.col("prediction"))))


def labelled(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", "lang")
    frame = docs.join(table(spark, folder, "labels"), "doc_id")
    return frame.withColumn("pred", (F.col("n_chars") >= 1000).cast("int")).withColumn("score", F.round(F.col("n_chars") / 100))


DOCS = (
    "d AS (SELECT doc_id, n_chars, lang, quality, toxic, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS pred, "
    "round(n_chars / 100) AS score FROM documents JOIN labels USING (doc_id))"
)


@query("confusion_matrix", f"WITH {DOCS} SELECT quality AS actual, pred AS predicted, count(*) AS n FROM d GROUP BY ALL")
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(labelled(spark, folder), "quality", "pred")


REPORT = """, k AS (SELECT c, count(CASE WHEN quality = c AND pred = c THEN 1 END) AS tp, count(CASE WHEN quality = c THEN 1 END) AS sup,
                count(CASE WHEN pred = c THEN 1 END) AS pr FROM d, (VALUES (0), (1)) v(c) GROUP BY c),
     m AS (SELECT *, CASE WHEN pr = 0 THEN 0 ELSE tp / CAST(pr AS DOUBLE) END AS p, CASE WHEN sup = 0 THEN 0 ELSE tp / CAST(sup AS DOUBLE) END AS r FROM k),
     f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM m)
  SELECT CAST(c AS VARCHAR) AS row, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1_score, CAST(sup AS DOUBLE) AS support FROM f
  UNION ALL SELECT 'accuracy', round(sum(tp) / sum(sup), 6), round(sum(tp) / sum(sup), 6), round(sum(tp) / sum(sup), 6), round(sum(tp) / sum(sup), 6) FROM f
  UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(sup) AS DOUBLE) FROM f
  UNION ALL SELECT 'weighted avg', round(sum(p * sup) / sum(sup), 6), round(sum(r * sup) / sum(sup), 6), round(sum(f * sup) / sum(sup), 6), CAST(sum(sup) AS DOUBLE) FROM f"""


@query("classification_report", f"WITH {DOCS} {REPORT}")
def classification_report(spark, folder):
    out = metrics.classification_report(labelled(spark, folder), "quality", "pred")
    return out.select("row", *[rnd(n).alias(n) for n in ("precision", "recall", "f1_score", "support")])


AUC = """SELECT {by} round(sum(p * (below + q / 2.0)) / (sum(p) * CAST(sum(q) AS DOUBLE)), 8) AS roc_auc FROM
  (SELECT *, coalesce(sum(q) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
   FROM (SELECT {by} score, sum(label) AS p, sum(1 - label) AS q FROM s GROUP BY ALL)) {group}"""


@query("roc_auc", f"WITH {DOCS}, s AS (SELECT score, quality AS label FROM d) " + AUC.format(by="", part="", group=""))
def roc_auc(spark, folder):
    return metrics.roc_auc(labelled(spark, folder), "quality", "score").select(rnd("roc_auc", 8).alias("roc_auc"))


@query(
    "roc_auc_by_group",
    "WITH s AS (SELECT l_linenumber, l_extendedprice AS score, CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END AS label FROM lineitem) "
    + AUC.format(by="l_linenumber,", part="PARTITION BY l_linenumber", group="GROUP BY l_linenumber"),
)
def roc_auc_by_group(spark, folder):
    frame = table(spark, folder, "lineitem").withColumn("label", (F.col("l_quantity") > 30).cast("int"))
    out = metrics.roc_auc(frame, "label", "l_extendedprice", ["l_linenumber"])
    return out.select("l_linenumber", rnd("roc_auc", 8).alias("roc_auc"))


@query(
    "selection_losses",
    f"""WITH {DOCS}, s AS (SELECT lang, quality AS y, n_chars / (n_chars + 500.0) AS p FROM d)
        SELECT lang, round(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS logloss,
               round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN -ln(1 - pow(2, -52)) ELSE -ln(pow(2, -52)) END), 6) AS hard_logloss,
               round(avg((y - p) * (y - p)), 6) AS mse FROM s GROUP BY ALL""",
)
def selection_losses(spark, folder):
    frame = labelled(spark, folder).withColumn("p", F.col("n_chars") / (F.col("n_chars") + 500.0))
    out = metrics.selection_losses(frame, "quality", "p", ["lang"])
    return out.select("lang", *[rnd(n).alias(n) for n in ("logloss", "hard_logloss", "mse")])


CURVE = """, g AS (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM s GROUP BY score),
     r AS (SELECT score AS threshold, coalesce(sum(p) OVER above, 0) / CAST(sum(p) OVER () AS DOUBLE) AS tpr,
                  coalesce(sum(q) OVER above, 0) / CAST(sum(q) OVER () AS DOUBLE) AS fpr FROM g
           WINDOW above AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) """
PRICE = "WITH s AS (SELECT l_extendedprice AS score, CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END AS label FROM lineitem)"


@query("roc_curve", PRICE + CURVE + "SELECT threshold, round(tpr, 8) AS tpr, round(fpr, 8) AS fpr FROM r")
def roc_curve(spark, folder):
    frame = table(spark, folder, "lineitem").withColumn("label", (F.col("l_quantity") > 30).cast("int"))
    out = metrics.roc_curve(frame, "label", "l_extendedprice")
    return out.select("threshold", rnd("tpr", 8).alias("tpr"), rnd("fpr", 8).alias("fpr"))


@query(
    "best_threshold",
    PRICE + CURVE + "SELECT threshold, round((tpr + 1 - fpr) / 2, 8) AS utility FROM r ORDER BY (tpr + 1 - fpr) / 2 DESC, threshold DESC LIMIT 1",
)
def best_threshold(spark, folder):
    frame = table(spark, folder, "lineitem").withColumn("label", (F.col("l_quantity") > 30).cast("int"))
    out = metrics.best_threshold(frame, "label", "l_extendedprice")
    return out.select("threshold", rnd("utility", 8).alias("utility"))


@query(
    "apply_threshold",
    "SELECT CASE WHEN l_extendedprice < 50000 THEN 0 ELSE 1 END AS label, count(*) AS n FROM lineitem GROUP BY ALL",
)
def apply_threshold(spark, folder):
    label = metrics.apply_threshold(F.col("l_extendedprice"), 50000.0)
    return table(spark, folder, "lineitem").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
