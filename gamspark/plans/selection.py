"""Grids, trial tables, selection and votes on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble, hpo
from .catalog import query, rnd, table


@query(
    "expand_grid",
    """WITH b AS (SELECT DISTINCT p_type AS model, p_brand AS brand FROM part), s AS (SELECT DISTINCT p_type AS model,
                CAST(p_size AS VARCHAR) AS size FROM part)
       SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY brand, size) - 1 AS INTEGER) AS config_id, brand, size
       FROM b JOIN s USING (model)""",
)
def expand_grid(spark, folder):
    part = table(spark, folder, "part").select(F.col("p_type").alias("model"), "p_brand", "p_size")
    cells = part.select(
        "model",
        F.inline(
            F.array(
                F.struct(F.lit("brand").alias("param"), F.col("p_brand").alias("v")),
                F.struct(F.lit("size").alias("param"), F.col("p_size").cast("string").alias("v")),
            )
        ),
    )
    grid = cells.groupBy("model", "param").agg(F.sort_array(F.collect_set("v")).alias("values"))
    out = hpo.expand_grid(grid)
    return out.select("model", "config_id", F.col("params")["brand"].alias("brand"), F.col("params")["size"].alias("size"))


CONFIG = [
    "CASE l_returnflag WHEN 'A' THEN 'lbfgs' WHEN 'N' THEN 'liblinear' ELSE 'saga' END AS solver",
    "CASE l_linenumber WHEN 1 THEN 'l1' WHEN 2 THEN 'l2' WHEN 3 THEN 'none' ELSE 'elasticnet' END AS penalty",
    "CASE l_linestatus WHEN 'O' THEN '0.5' END AS l1_ratio",
]


@query(
    "drop_invalid_configs",
    f"""SELECT solver, penalty, l1_ratio, count(*) AS n FROM (SELECT {', '.join(CONFIG)} FROM lineitem)
        WHERE NOT (solver = 'lbfgs' AND penalty IN ('l1', 'elasticnet'))
          AND NOT (solver = 'liblinear' AND penalty IN ('elasticnet', 'none'))
          AND NOT (l1_ratio IS NOT NULL AND penalty <> 'elasticnet') AND NOT (l1_ratio IS NULL AND penalty = 'elasticnet')
        GROUP BY ALL""",
)
def drop_invalid_configs(spark, folder):
    rows = table(spark, folder, "lineitem").selectExpr(*CONFIG)
    params = F.create_map(*[x for n in ("solver", "penalty", "l1_ratio") for x in (F.lit(n), F.col(n))])
    return hpo.drop_invalid_configs(rows.withColumn("params", params)).groupBy("solver", "penalty", "l1_ratio").agg(
        F.count(F.lit(1)).alias("n")
    )


TRIALS = (
    "t AS (SELECT o_orderstatus AS dataset, o_orderpriority AS model, CAST(o_orderkey % 5 AS INTEGER) AS fold, "
    "CAST(o_custkey % 20 AS INTEGER) AS config_id, round(avg(o_totalprice), 6) AS loss, min(o_totalprice) < 2000 AS failed "
    "FROM orders GROUP BY ALL)"
)


def trials(spark, folder):
    return table(spark, folder, "orders").groupBy(
        F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("model"),
        (F.col("o_orderkey") % 5).cast("int").alias("fold"), (F.col("o_custkey") % 20).cast("int").alias("config_id"),
    ).agg(rnd(F.avg("o_totalprice")).alias("loss"), (F.min("o_totalprice") < 2000).alias("failed"))


@query(
    "select_best",
    f"""WITH {TRIALS}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, model, fold ORDER BY loss, config_id) AS r
                              FROM t WHERE NOT failed) SELECT dataset, model, fold, config_id, loss FROM r WHERE r = 1""",
)
def select_best(spark, folder):
    return hpo.select_best(trials(spark, folder))


@query(
    "trial_log",
    f"""WITH {TRIALS} SELECT dataset, model, fold, count(*) AS trials, count(CASE WHEN failed THEN 1 END) AS failures
        FROM t GROUP BY ALL""",
)
def trial_log(spark, folder):
    return hpo.trial_summary(trials(spark, folder))


CELL = (
    "concat('''alpha'': ', regexp_extract(props, '([0-9]+)', 1), '\n', '''kind'': ''', event_type, '''', '\n', "
    "'''layers'': [', cast(user_id as string), ',\n ', cast(user_id + 1 as string), ']')"
)


@query(
    "parse_config",
    r"""WITH e AS (SELECT event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS VARCHAR) AS k, user_id FROM events)
        SELECT 'alpha' AS key, 'int' AS kind, event_type, count(*) AS n, count(DISTINCT k) AS values FROM e GROUP BY ALL
        UNION ALL SELECT 'kind', 'text', event_type, count(*), count(DISTINCT event_type) FROM e GROUP BY ALL
        UNION ALL SELECT 'layers', 'text', event_type, count(*), count(DISTINCT user_id) FROM e GROUP BY ALL""",
)
def parse_config(spark, folder):
    rows = table(spark, folder, "events").select("event_type", hpo.parse_config(F.expr(CELL)).alias("params"))
    long = rows.select("event_type", F.explode("params").alias("key", "value"))
    return long.groupBy("key", hpo.value_kind(F.col("value")).alias("kind"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("values")
    )


@query(
    "format_config",
    r"""SELECT event_type, '''depth'': ' || regexp_extract(props, '([0-9]+)', 1) || chr(10) || '''kind'': ''' || event_type || '''' AS text,
               count(*) AS n FROM events GROUP BY ALL""",
)
def format_config(spark, folder):
    params = F.create_map(
        F.lit("kind"), F.col("event_type"), F.lit("depth"), F.regexp_extract("props", "([0-9]+)", 1)
    )
    return table(spark, folder, "events").groupBy("event_type", hpo.format_config(params).alias("text")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "majority_config",
    """WITH c AS (SELECT o_orderstatus AS dataset, o_orderpriority AS model, CAST(o_orderkey % 5 AS INTEGER) AS fold,
                         CAST(max(o_custkey) % 3 AS VARCHAR) AS a, CAST(count(*) % 2 AS VARCHAR) AS b FROM orders GROUP BY 1, 2, 3),
            l AS (SELECT dataset, model, fold, 'a' AS key, a AS value FROM c UNION ALL SELECT dataset, model, fold, 'b', b FROM c),
            v AS (SELECT dataset, model, key, value, count(*) AS votes, min(fold) AS f FROM l GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY dataset, model, key ORDER BY votes DESC, f) AS r,
                         count(*) OVER (PARTITION BY dataset, model, key, votes) AS same FROM v)
       SELECT dataset, model, key, value, votes, same > 1 AS tie FROM r WHERE r = 1""",
)
def majority_config(spark, folder):
    cells = table(spark, folder, "orders").groupBy(
        F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("model"),
        (F.col("o_orderkey") % 5).cast("int").alias("fold"),
    ).agg((F.max("o_custkey") % 3).cast("string").alias("a"), (F.count(F.lit(1)) % 2).cast("string").alias("b"))
    params = F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b"))
    return hpo.majority_config(cells.select("dataset", "model", "fold", params.alias("params")))


MEMBERS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def members(spark, folder):
    """Seven members per row: probabilities that depend on the row and on the member number."""
    frame = table(spark, folder, "lineitem").select(
        *[n.strip() for n in MEMBERS.split(",")],
        "l_quantity", "l_discount",
        F.explode(F.sequence(F.lit(1), F.lit(7))).alias("member"),
    )
    return frame.withColumn("p", F.col("l_quantity") / 51 * (F.lit(1) - F.col("l_discount") * F.col("member")))


LONG = (
    f"m AS (SELECT {MEMBERS}, CAST(member AS INTEGER) AS member, l_quantity / 51 * (1 - l_discount * member) AS p FROM lineitem, range(1, 8) t(member))"
)


@query(
    "bagged_probability",
    f"""WITH {LONG}, a AS (SELECT {MEMBERS}, avg(ln(p + pow(2, -23)) - ln(1 - p + pow(2, -23))) AS x FROM m GROUP BY ALL)
        SELECT l_linenumber, count(*) AS n, round(avg(1 / (1 + exp(-x))), 6) AS p FROM a GROUP BY ALL""",
)
def bagged_probability(spark, folder):
    fused = ensemble.bagged_probability(members(spark, folder), [n.strip() for n in MEMBERS.split(",")], "p")
    return fused.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("probability")).alias("p"))


@query(
    "fuse_members",
    f"""WITH {LONG}, w AS (SELECT *, 1.0 / member AS w FROM m),
        a AS (SELECT {MEMBERS}, avg(p) AS avgagg, avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) AS majvote,
                     sum(w * p) / sum(w) AS wavg, sum(CASE WHEN p >= 0.5 THEN w ELSE 0 END) / sum(w) AS wmaj FROM w GROUP BY ALL)
        SELECT l_linenumber, round(avg(avgagg), 6) AS avgagg, round(avg(majvote), 6) AS majvote,
               round(avg(wavg), 6) AS weighted_avgagg, round(avg(wmaj), 6) AS weighted_majvote FROM a GROUP BY ALL""",
)
def fuse_members(spark, folder):
    frame = members(spark, folder).withColumn("w", 1.0 / F.col("member"))
    fused = ensemble.fuse_members(frame, [n.strip() for n in MEMBERS.split(",")], "p", "w")
    names = ("avgagg", "majvote", "weighted_avgagg", "weighted_majvote")
    return fused.groupBy("l_linenumber").agg(*[rnd(F.avg(n)).alias(n) for n in names])


@query(
    "select_by_validation",
    """WITH s AS (SELECT l AS lam, l_extendedprice AS y, avg(l_extendedprice) OVER () * l / 10 + 2000 * l_quantity * (1 - l / 10) AS p
                  FROM lineitem, range(11) t(l)),
            e AS (SELECT lam, avg((y - p) * (y - p)) AS loss FROM s GROUP BY ALL)
       SELECT lam, round(loss / 1e6, 6) AS loss FROM e ORDER BY e.loss, lam LIMIT 1""",
)
def select_by_validation(spark, folder):
    frame = table(spark, folder, "lineitem").select("l_extendedprice", "l_quantity")
    mean = frame.agg(F.avg("l_extendedprice")).first()[0]
    path = frame.withColumn("lam", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(10).cast("bigint"))))
    share = F.col("lam") / 10
    scored = path.withColumn("p", mean * share + 2000 * F.col("l_quantity") * (1 - share))
    best = hpo.select_by_validation(scored, "l_extendedprice", "p", "lam")
    return best.select("lam", rnd(F.col("loss") / 1e6).alias("loss"))


@query(
    "stopping_round",
    """WITH t AS (SELECT l_returnflag, CAST(l_quantity AS INTEGER) AS round, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
            b AS (SELECT *, min(v) OVER (PARTITION BY l_returnflag ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM t),
            i AS (SELECT *, m IS NULL OR v < m AS imp FROM b),
            l AS (SELECT *, coalesce(max(CASE WHEN imp THEN round END) OVER (PARTITION BY l_returnflag ORDER BY round), 0) AS last FROM i),
            e AS (SELECT l_returnflag, coalesce(min(CASE WHEN round - last > 8 THEN round END), max(round)) AS stop FROM l GROUP BY ALL)
       SELECT l_returnflag, max(CASE WHEN imp THEN round END) AS best_round, max(round) AS stop_round
       FROM l JOIN e USING (l_returnflag) WHERE round <= stop GROUP BY ALL""",
)
def stopping_round(spark, folder):
    losses = table(spark, folder, "lineitem").groupBy(
        "l_returnflag", F.col("l_quantity").cast("int").alias("round")
    ).agg(F.avg("l_extendedprice").alias("val_loss"))
    return hpo.stopping_round(losses, 8, by=["l_returnflag"])
