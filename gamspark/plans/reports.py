"""Report aggregation, ranks and agreement on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement, reports
from ..sources import readers
from .catalog import query, rnd, shared_path, table

MODELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FOLDS = (
    "f AS (SELECT o_orderstatus AS dataset, o_orderpriority AS model, CAST(o_orderkey % 5 AS INTEGER) AS fold, "
    "avg(o_totalprice) / 1000 AS rmse, max(o_totalprice) / 1000 AS worst FROM orders GROUP BY 1, 2, 3), "
    "r AS (SELECT dataset, model, fold, 'RMSE' AS metric, rmse AS value FROM f UNION ALL "
    "SELECT dataset, model, fold, 'Max Error', worst FROM f)"
)


def fold_rows(spark, folder):
    """Fold reports in long form: dataset = order status, model = priority."""
    folds = table(spark, folder, "orders").groupBy(
        F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("model"),
        (F.col("o_orderkey") % 5).cast("int").alias("fold"),
    ).agg((F.avg("o_totalprice") / 1000).alias("RMSE"), (F.max("o_totalprice") / 1000).alias("Max Error"))
    return folds.unpivot(["dataset", "model", "fold"], ["RMSE", "Max Error"], "metric", "value")


@query(
    "read_fold_reports",
    """SELECT CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'partial' END AS dataset, 'NET' AS model,
              CAST(o_orderkey % 5 AS INTEGER) AS fold, '0' AS row, 'RMSE' AS metric, round(avg(o_totalprice), 4) AS value
       FROM orders GROUP BY ALL
       UNION ALL SELECT CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'partial' END, 'NET',
              CAST(o_orderkey % 5 AS INTEGER), '0', 'MAE', round(min(o_totalprice), 4) FROM orders GROUP BY ALL""",
)
def read_fold_reports(spark, folder):
    """Writes one report per data set and fold (a handful) below the shared folder and reads them back."""
    path = shared_path(spark, "folds")
    rows = table(spark, folder, "orders").groupBy(
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'partial' END").alias("dataset"),
        (F.col("o_orderkey") % 5).cast("int").alias("fold"),
    ).agg(F.round(F.avg("o_totalprice"), 4).alias("rmse"), F.round(F.min("o_totalprice"), 4).alias("mae"))
    for r in rows.collect():
        report = spark.createDataFrame([(f",RMSE,MAE\n0,{r['rmse']},{r['mae']}",)], "value string")
        report.coalesce(1).write.text(f"{path}/{r['dataset']}/NET_Folds/NET_Fold_{r['fold']}.csv")
    out = readers.read_fold_reports(spark, path)
    return out.withColumn("value", rnd("value", 4))


@query(
    "fold_mean_std",
    f"WITH {FOLDS} SELECT dataset, model, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM r GROUP BY ALL",
)
def fold_mean_std(spark, folder):
    out = reports.fold_mean_std(fold_rows(spark, folder))
    return out.select("dataset", "model", "metric", rnd("mean").alias("mean"), rnd("std").alias("std"))


@query(
    "fold_mean_std_by_row",
    """WITH c AS (SELECT event_type AS dataset, user_id % 5 AS fold, CAST(user_id % 3 AS VARCHAR) AS row, avg(value) AS value
                  FROM events GROUP BY ALL)
       SELECT dataset, row, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM c GROUP BY ALL""",
)
def fold_mean_std_by_row(spark, folder):
    rows = table(spark, folder, "events").groupBy(
        F.col("event_type").alias("dataset"), (F.col("user_id") % 5).alias("fold"), (F.col("user_id") % 3).cast("string").alias("row")
    ).agg(F.avg("value").alias("value"))
    out = reports.fold_mean_std(rows, ("dataset", "row"))
    return out.select("dataset", "row", rnd("mean").alias("mean"), rnd("std").alias("std"))


@query(
    "timing_mean_std",
    f"WITH {FOLDS} SELECT model, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM r GROUP BY ALL",
)
def timing_mean_std(spark, folder):
    out = reports.timing_mean_std(fold_rows(spark, folder))
    return out.select("model", "metric", rnd("mean").alias("mean"), rnd("std").alias("std"))


@query(
    "format_mean_std",
    f"""WITH {FOLDS}, m AS (SELECT dataset, model, metric, avg(value) AS mean, stddev_samp(value) AS std FROM r GROUP BY ALL)
        SELECT dataset, model, metric, printf('%.3f', mean) || '±' || printf('%.3f', std) AS text FROM m""",
)
def format_mean_std(spark, folder):
    out = reports.fold_mean_std(fold_rows(spark, folder))
    return out.select("dataset", "model", "metric", reports.format_mean_std(F.col("mean"), F.col("std")).alias("text"))


PIVOT = ", ".join(f"""round(max(CASE WHEN model = '{m}' THEN mean END), 6) AS "{m}" """ for m in MODELS)
MEANS = ", m AS (SELECT dataset, model, metric, avg(value) AS mean FROM r GROUP BY ALL)"


def _rounded(df):
    return df.select("dataset", *[rnd(F.col(f"`{m}`")).alias(m) for m in MODELS])


@query("model_dataset_table", f"WITH {FOLDS}{MEANS} SELECT dataset, {PIVOT} FROM m WHERE metric = 'RMSE' GROUP BY dataset")
def model_dataset_table(spark, folder):
    rows = reports.metric_rows(reports.fold_mean_std(fold_rows(spark, folder)), "RMSE")
    return _rounded(reports.model_dataset_table(rows, MODELS))


@query("timing_table", f"WITH {FOLDS}{MEANS} SELECT dataset, {PIVOT} FROM m WHERE metric = 'Max Error' GROUP BY dataset")
def timing_table(spark, folder):
    return _rounded(reports.timing_table(fold_rows(spark, folder), "Max Error", MODELS))


@query(
    "reorder",
    f"""WITH {FOLDS}{MEANS}, t AS (SELECT dataset, {PIVOT} FROM m WHERE metric = 'RMSE' GROUP BY dataset)
        SELECT CAST(pos AS INTEGER) AS pos, o.dataset, "5-LOW", "1-URGENT" FROM (VALUES (0, 'P'), (1, 'X'), (2, 'F')) o(pos, dataset)
        LEFT JOIN t ON t.dataset = o.dataset""",
)
def reorder(spark, folder):
    return reports.reorder(model_dataset_table(spark, folder), ["P", "X", "F"], ["5-LOW", "1-URGENT"])


RANKS = (
    ", k AS (SELECT dataset, model, mean, rank() OVER (PARTITION BY dataset ORDER BY round(mean / 10)) AS r FROM m WHERE metric = 'RMSE'), "
    "a AS (SELECT dataset, model, r + (count(*) OVER (PARTITION BY dataset, r) - 1) / 2.0 AS rank FROM k)"
)


def _ranks(spark, folder):
    rows = reports.metric_rows(reports.fold_mean_std(fold_rows(spark, folder)), "RMSE")
    return reports.rank_models(rows.withColumn("mean", F.round(F.col("mean") / 10)), "RMSE")


@query("rank_models", f"WITH {FOLDS}{MEANS}{RANKS} SELECT dataset, model, CAST(rank AS DOUBLE) AS rank FROM a")
def rank_models(spark, folder):
    return _ranks(spark, folder).select("dataset", "model", "rank")


@query(
    "rank_models_score",
    """WITH s AS (SELECT event_type AS dataset, user_id AS model, round(avg(value)) AS mean FROM events GROUP BY ALL),
            k AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY mean DESC) AS r FROM s)
       SELECT dataset, model, mean, CAST(r + (count(*) OVER (PARTITION BY dataset, r) - 1) / 2.0 AS DOUBLE) AS rank FROM k""",
)
def rank_models_score(spark, folder):
    rows = table(spark, folder, "events").groupBy(F.col("event_type").alias("dataset"), F.col("user_id").alias("model")).agg(
        F.round(F.avg("value")).alias("mean")
    )
    return reports.rank_models(rows, "ROC_AUC").select("dataset", "model", "mean", "rank")


@query("mean_rank", f"WITH {FOLDS}{MEANS}{RANKS} SELECT model, round(CAST(avg(rank) AS DOUBLE), 6) AS mean_rank FROM a GROUP BY model")
def mean_rank(spark, folder):
    return reports.mean_rank(_ranks(spark, folder)).select("model", rnd("mean_rank").alias("mean_rank"))


@query(
    "tradeoff_points",
    f"""WITH {FOLDS}{MEANS}{RANKS}, w AS (SELECT o_orderstatus AS dataset, CAST(count(*) AS DOUBLE) AS weight FROM orders GROUP BY ALL),
        i AS (SELECT o_orderpriority AS model, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS interpretability FROM orders GROUP BY ALL)
        SELECT model, interpretability, round(CAST(5 - sum(rank * weight) / sum(weight) AS DOUBLE), 6) AS performance
        FROM a JOIN w USING (dataset) JOIN i USING (model) GROUP BY ALL""",
)
def tradeoff_points(spark, folder):
    orders = table(spark, folder, "orders")
    weights = orders.groupBy(F.col("o_orderstatus").alias("dataset")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    scores = orders.groupBy(F.col("o_orderpriority").alias("model")).agg(
        F.count_distinct("o_custkey").cast("double").alias("interpretability")
    )
    out = reports.tradeoff_points(reports.mean_rank(_ranks(spark, folder), weights), scores, n_models=5)
    return out.withColumn("performance", rnd("performance"))


@query(
    "grouped_parameters",
    """WITH c AS (SELECT o_orderstatus AS dataset, o_orderpriority AS model, o_orderkey % 5 AS fold,
                         'c: ' || CAST(max(o_custkey) AS VARCHAR) AS params FROM orders GROUP BY 1, 2, 3)
       SELECT dataset, string_agg(CASE WHEN model = '1-URGENT' THEN params END, '|' ORDER BY fold) AS "1-URGENT",
              string_agg(CASE WHEN model = '5-LOW' THEN params END, '|' ORDER BY fold) AS "5-LOW" FROM c GROUP BY dataset""",
)
def grouped_parameters(spark, folder):
    cells = table(spark, folder, "orders").groupBy(
        F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("model"), (F.col("o_orderkey") % 5).alias("fold")
    ).agg(F.concat(F.lit("c: "), F.max("o_custkey").cast("string")).alias("params"))
    return reports.grouped_parameters(cells, ["1-URGENT", "5-LOW"], "|")


@query(
    "table_labels",
    f"""WITH {FOLDS}{MEANS} SELECT dataset, CASE model WHEN '1-URGENT' THEN 'EBM' WHEN '5-LOW' THEN 'XGB' ELSE model END AS model,
          CASE dataset WHEN 'F' THEN 'REG' ELSE 'CLS' END AS task_label,
          CASE model WHEN '1-URGENT' THEN 'Interpretable Models' WHEN '5-LOW' THEN 'Black-box Models' END AS model_kind,
          CASE model WHEN '1-URGENT' THEN 'GAMs' WHEN '5-LOW' THEN '' END AS model_family, round(mean, 6) AS mean
        FROM m WHERE metric = 'RMSE'""",
)
def table_labels(spark, folder):
    rows = reports.metric_rows(reports.fold_mean_std(fold_rows(spark, folder)), "RMSE")
    named = rows.withColumn(
        "model", F.expr("CASE model WHEN '1-URGENT' THEN 'EBM' WHEN '5-LOW' THEN 'XGB' ELSE model END")
    ).withColumn("task", F.expr("CASE dataset WHEN 'F' THEN 'regression' ELSE 'classification' END"))
    return reports.table_labels(named).select(
        "dataset", "model", "task_label", "model_kind", "model_family", rnd("mean").alias("mean")
    )


@query(
    "krippendorff_alpha",
    """WITH r AS (SELECT user_id AS unit, floor(avg(value) / 10) AS value FROM events GROUP BY user_id, event_type),
            c AS (SELECT unit, value, count(*) AS n FROM r GROUP BY ALL),
            u AS (SELECT unit, sum(n) AS m FROM c GROUP BY unit HAVING sum(n) >= 2),
            p AS (SELECT c.* , m FROM c JOIN u USING (unit)),
            t AS (SELECT value, sum(n) AS nc, sum(sum(n)) OVER (ORDER BY value) AS cum FROM p GROUP BY value),
            o AS (SELECT a.value AS c, b.value AS k, sum(CAST(a.n AS DOUBLE) * b.n / (a.m - 1)) AS o
                  FROM p a JOIN p b ON a.unit = b.unit AND a.value <> b.value GROUP BY ALL),
            d AS (SELECT x.value AS c, y.value AS k, x.nc AS nc, y.nc AS nk,
                         pow((SELECT sum(nc) FROM t WHERE t.value BETWEEN least(x.value, y.value) AND greatest(x.value, y.value))
                             - (x.nc + y.nc) / 2.0, 2) AS d2 FROM t x, t y WHERE x.value <> y.value)
       SELECT round(1 - ((SELECT sum(nc) FROM t) - 1) * sum(coalesce(o, 0) * d2) / sum(CAST(nc AS DOUBLE) * nk * d2), 8) AS alpha,
              (SELECT CAST(sum(nc) AS BIGINT) FROM t) AS n, (SELECT count(*) FROM u) AS units
       FROM d LEFT JOIN o USING (c, k)""",
)
def krippendorff_alpha(spark, folder):
    ratings = table(spark, folder, "events").groupBy(F.col("user_id").alias("unit"), "event_type").agg(
        F.floor(F.avg("value") / 10).cast("double").alias("value")
    )
    out = agreement.krippendorff_alpha(ratings)
    return out.select(rnd("alpha", 8).alias("alpha"), "n", "units")
