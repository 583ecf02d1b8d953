"""Effect tables and explanations on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import logit, sigmoid
from ..operators import effects as fx
from ..operators import encode, explain
from .catalog import query, rnd, table

NUM, CAT = ["l_quantity", "l_discount"], ["l_returnflag"]
FEATURES = [*NUM, *CAT]


def _part(i: int, name: str, extra: str = "", y: str = "avg(l_extendedprice)") -> str:
    numeric = name in NUM or name == "l_tax"
    x = f"{name} AS x_num, CAST(NULL AS VARCHAR) AS x_cat" if numeric else f"CAST(NULL AS DOUBLE) AS x_num, {name} AS x_cat"
    return (
        f"SELECT {extra}'{name}' AS feat_name, {i} AS feat_idx, {x}, {y} AS y, count(*) AS n FROM lineitem GROUP BY ALL"
    )


EFF = (
    "WITH eff AS (SELECT 'offset' AS feat_name, -1 AS feat_idx, CAST(NULL AS DOUBLE) AS x_num, CAST(NULL AS VARCHAR) AS x_cat, "
    "CAST(0 AS DOUBLE) AS y, CAST(NULL AS BIGINT) AS n UNION ALL "
    + " UNION ALL ".join(_part(i, n) for i, n in enumerate(FEATURES))
    + "), mu AS (SELECT feat_name, sum(y * n) / sum(n) AS mu FROM eff WHERE feat_idx >= 0 GROUP BY feat_name), "
    "cen AS (SELECT eff.feat_name, feat_idx, x_num, x_cat, "
    "CASE WHEN feat_idx = -1 THEN y + (SELECT sum(mu) FROM mu) ELSE y - mu END AS y, n FROM eff LEFT JOIN mu USING (feat_name)) "
)
BAGS = "WITH bags AS (" + " UNION ALL ".join(_part(i, n, "l_linenumber AS model_id, ") for i, n in enumerate(FEATURES)) + ") "


def items(spark, folder):
    return table(spark, folder, "lineitem")


def raw_effects(spark, folder):
    return fx.mean_effects(items(spark, folder), "l_extendedprice", NUM, CAT)


def bag_effects(spark, folder, numeric=NUM, categorical=CAT):
    """Mean effects per line number: seven small models of one data set."""
    cells = fx.typed_values(items(spark, folder), numeric, categorical, ["l_linenumber", "l_extendedprice"])
    return cells.groupBy(F.col("l_linenumber").alias("model_id"), "feat_name", "feat_idx", "x_num", "x_cat").agg(
        F.avg("l_extendedprice").alias("y"), F.count(F.lit(1)).alias("n")
    )


def shown(df, *digits_cols, digits=6):
    for n in digits_cols or ("y",):
        df = df.withColumn(n, rnd(n, digits))
    return df


@query(
    "effects_from_predictor",
    "SELECT 'offset' AS feat_name, -1 AS feat_idx, CAST(NULL AS DOUBLE) AS x_num, CAST(8.0 AS DOUBLE) AS y, "
    "CAST(NULL AS BIGINT) AS n "
    "UNION ALL SELECT 'l_quantity', 0, l_quantity, round(0.5 * l_quantity * l_quantity - 0.5, 6), count(*) FROM lineitem GROUP BY ALL "
    "UNION ALL SELECT 'l_discount', 1, l_discount, round(4.0 - 4 * l_discount, 6), count(*) FROM lineitem GROUP BY ALL "
    "UNION ALL SELECT 'l_tax', 2, l_tax, round(exp(l_tax) - exp(1), 6), count(*) FROM lineitem GROUP BY ALL".replace(
        "CAST(8.0 AS DOUBLE)", "round(11.5 - 4 + 0.5 + exp(1), 6)"
    ),
)
def effects_from_predictor(spark, folder):
    names = ["l_quantity", "l_discount", "l_tax"]

    def scorer(frame):
        q, d, t = (F.col(n) for n in names)
        return frame.withColumn("score", 11.5 + 0.5 * q * q - 4 * d + F.exp(t))

    out = fx.effects_from_predictor(fx.feature_value_counts(items(spark, folder), names), names, scorer)
    return shown(out).select("feat_name", "feat_idx", "x_num", "y", "n")


@query("mean_effects", EFF + "SELECT feat_name, feat_idx, x_num, x_cat, round(y, 6) AS y, n FROM eff")
def mean_effects(spark, folder):
    return shown(raw_effects(spark, folder)).drop("y_std")


@query("center_effects", EFF + "SELECT feat_name, feat_idx, x_num, x_cat, round(y, 5) AS y, n FROM cen")
def center_effects(spark, folder):
    return shown(fx.center_effects(raw_effects(spark, folder)), digits=5).drop("y_std")


IMP = (
    "imp AS (SELECT feat_name, feat_idx, sum(n * abs(y)) / sum(n) AS importance FROM cen WHERE feat_idx >= 0 "
    "GROUP BY feat_name, feat_idx) "
)


@query("importance", EFF + ", " + IMP + "SELECT feat_name, feat_idx, round(importance, 5) AS importance FROM imp")
def importance(spark, folder):
    return shown(fx.importance(raw_effects(spark, folder)), "importance", digits=5)


@query(
    "top_features",
    EFF + ", " + IMP + "SELECT feat_name, feat_idx, round(importance, 5) AS importance FROM imp WHERE importance > 0 "
    "ORDER BY imp.importance DESC, feat_name LIMIT 2",
)
def top_features(spark, folder):
    return shown(fx.top_features(fx.importance(raw_effects(spark, folder)), 2), "importance", digits=5)


@query(
    "restrict_to_values",
    EFF + "SELECT a.feat_name, a.x_num, round(eff.y, 6) AS y, eff.n FROM (SELECT DISTINCT 'l_quantity' AS feat_name, "
    "floor(l_quantity / 3) * 3 AS x_num FROM lineitem) a LEFT JOIN eff ON eff.feat_name = a.feat_name AND eff.x_num = a.x_num",
)
def restrict_to_values(spark, folder):
    asked = items(spark, folder).select(
        F.lit("l_quantity").alias("feat_name"), (F.floor(F.col("l_quantity") / 3) * 3).cast("double").alias("x_num"),
        F.lit(None).cast("string").alias("x_cat"),
    ).distinct()
    out = fx.restrict_to_values(raw_effects(spark, folder), asked)
    return shown(out).select("feat_name", "x_num", "y", "n")


SCORED = (
    EFF + ", sc AS (SELECT l.*, a.y AS c_qty, b.y AS c_disc, f.y AS c_flag, (SELECT y FROM cen WHERE feat_idx = -1) AS off "
    "FROM lineitem l JOIN cen a ON a.feat_name = 'l_quantity' AND a.x_num = l_quantity "
    "JOIN cen b ON b.feat_name = 'l_discount' AND b.x_num = l_discount "
    "JOIN cen f ON f.feat_name = 'l_returnflag' AND f.x_cat = l_returnflag) "
)


@query(
    "score_by_effects",
    SCORED + "SELECT l_linenumber, l_returnflag, count(*) AS n, round(avg(off + c_qty + c_disc + c_flag), 4) AS score "
    "FROM sc GROUP BY ALL",
)
def score_by_effects(spark, folder):
    out = fx.score_by_effects(items(spark, folder), fx.center_effects(raw_effects(spark, folder)), NUM, CAT)
    return out.groupBy("l_linenumber", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("score"), 4).alias("score"))


@query(
    "local_contributions",
    SCORED + "SELECT feat_name, l_linenumber, count(*) AS n, round(avg(abs(v)), 4) AS size FROM ("
    "SELECT 'Intercept' AS feat_name, l_linenumber, off AS v FROM sc UNION ALL SELECT 'l_quantity', l_linenumber, c_qty FROM sc "
    "UNION ALL SELECT 'l_discount', l_linenumber, c_disc FROM sc UNION ALL SELECT 'l_returnflag', l_linenumber, c_flag FROM sc"
    ") GROUP BY ALL",
)
def local_contributions(spark, folder):
    frame = explain.local_contributions(items(spark, folder), fx.center_effects(raw_effects(spark, folder)), NUM, CAT)
    rows = explain.contribution_rows(frame, ["l_linenumber"])
    return rows.groupBy("feat_name", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg(F.abs("contribution")), 4).alias("size")
    )


@query(
    "filter_local",
    SCORED + "SELECT l_returnflag, count(*) AS n, round(avg(c_qty), 4) AS qty FROM sc "
    "WHERE (abs(c_qty) >= 900 OR abs(c_disc) >= 900 OR abs(c_flag) >= 900) AND abs(c_disc) >= 100 "
    "GROUP BY ALL",
)
def filter_local(spark, folder):
    frame = explain.local_contributions(items(spark, folder), fx.center_effects(raw_effects(spark, folder)), NUM, CAT)
    kept = explain.filter_local(
        frame,
        [
            explain.LocalFilter(number=900.0),
            explain.LocalFilter(word="l_disc"),
            explain.LocalFilter(number=100.0, word="l_discount", exact=True),
        ],
    )
    return kept.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg(F.col("explanation")[1]["contribution"]), 4).alias("qty")
    )


@query(
    "sigmoid_logit",
    """WITH s AS (SELECT l_returnflag, (l_quantity - 25) / 5.0 AS x FROM lineitem),
            p AS (SELECT l_returnflag, CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END AS p FROM s)
       SELECT l_returnflag, round(avg(p), 6) AS p,
              round(avg(ln(least(greatest(p, pow(2, -23)), 1 - pow(2, -23))) -
                        ln(1 - least(greatest(p, pow(2, -23)), 1 - pow(2, -23)))), 6) AS x FROM p GROUP BY ALL""",
)
def sigmoid_logit(spark, folder):
    frame = items(spark, folder).select("l_returnflag", sigmoid((F.col("l_quantity") - 25) / 5.0).alias("p"))
    return frame.groupBy("l_returnflag").agg(rnd(F.avg("p")).alias("p"), rnd(F.avg(logit(F.col("p")))).alias("x"))


KNOTS = (
    "knots AS (SELECT round(l_quantity / 10) * 10 AS k, avg(l_extendedprice) AS y FROM lineitem GROUP BY ALL), "
    "near AS (SELECT q, (SELECT arg_min(k, abs(k - q) * 1000 + k / 1000) FROM knots) AS k FROM "
    "(SELECT DISTINCT l_quantity + l_linenumber AS q FROM lineitem)) "
)
NEAREST_SQL = (
    "WITH " + KNOTS + "SELECT q AS x, count(*) AS n, round(max(y), 6) AS y FROM lineitem "
    "JOIN near ON q = l_quantity + l_linenumber JOIN knots USING (k) GROUP BY ALL"
)


def _knots(frame):
    knots = frame.groupBy(F.round(F.col("l_quantity") / 10).alias("k")).agg(F.avg("l_extendedprice").alias("y"))
    return knots.select((F.col("k") * 10).alias("x_num"), "y")


def _looked_up(asked, knots):
    out = fx.nearest_effect(asked, "x", knots)
    return out.groupBy("x").agg(F.count(F.lit(1)).alias("n"), rnd(F.max("y")).alias("y"))


@query("nearest_effect", NEAREST_SQL)
def nearest_effect(spark, folder):
    frame = items(spark, folder)
    return _looked_up(frame.select((F.col("l_quantity") + F.col("l_linenumber")).alias("x")), _knots(frame))


@query("nearest_effect_large", NEAREST_SQL)
def nearest_effect_large(spark, folder):
    """The same with every knot known several times: the least effect counts."""
    frame = items(spark, folder)
    knots = _knots(frame)
    more = knots.unionByName(knots.withColumn("y", F.col("y") + 1)).unionByName(knots.limit(3).withColumn("x_num", F.lit(float("nan"))))
    return _looked_up(frame.select((F.col("l_quantity") + F.col("l_linenumber")).alias("x")), more)


@query(
    "nearest_effect_missing",
    "SELECT CAST(NULL AS DOUBLE) AS y, count(*) AS n FROM lineitem WHERE l_linenumber <= 2",
)
def nearest_effect_missing(spark, folder):
    """NULL and NaN have no nearest value, and nothing is near when no value is known."""
    frame = items(spark, folder).where("l_linenumber <= 2")
    value = F.when(F.col("l_linenumber") == 1, F.lit(float("nan")))
    found = fx.nearest_effect(frame.where("l_tax > 0.04").select(value.alias("x")), "x", _knots(frame))
    none = fx.nearest_effect(frame.where("l_tax <= 0.04").select(F.col("l_quantity").alias("x")), "x", _knots(frame).where("false"))
    return found.select("y").unionByName(none.select("y")).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


CUTS = [10.0, 20.0, 30.0, 40.0]
BIN_SQL = "CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 1 WHEN l_quantity < 30 THEN 2 WHEN l_quantity < 40 THEN 3 ELSE 4 END"


@query(
    "bin_effect",
    f"""SELECT l_quantity, count(*) AS n, round(max(y), 6) AS y FROM
        (SELECT l_quantity, avg(l_extendedprice) OVER (PARTITION BY {BIN_SQL}) AS y FROM lineitem) GROUP BY ALL""",
)
def bin_effect(spark, folder):
    frame = items(spark, folder)
    bins = frame.groupBy(F.expr(BIN_SQL).alias("b")).agg(F.avg("l_extendedprice").alias("y")).orderBy("b").collect()
    out = fx.bin_effect(frame.select("l_quantity"), "l_quantity", CUTS, [r["y"] for r in bins])
    return out.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"), rnd(F.max("y")).alias("y"))


@query(
    "aggregate_effects",
    BAGS + "SELECT feat_name, feat_idx, x_num, x_cat, round(avg(y), 6) AS y, round(stddev_pop(y), 5) AS y_std, max(n) AS n "
    "FROM bags GROUP BY ALL",
)
def aggregate_effects(spark, folder):
    return shown(shown(fx.aggregate_effects(bag_effects(spark, folder))), "y_std", digits=5)


@query(
    "bag_importance",
    BAGS + """, v AS (SELECT feat_name, x_num, x_cat, count(DISTINCT model_id) AS m, sum(abs(y) * n) AS yn, sum(n) AS n
                      FROM bags GROUP BY ALL),
       b AS (SELECT feat_name, count(DISTINCT model_id) AS bags FROM bags GROUP BY ALL)
       SELECT feat_name, CASE WHEN min(m) = max(bags) AND max(m) = max(bags) THEN round(sum(yn) / sum(n), 4) END AS importance
       FROM v JOIN b USING (feat_name) GROUP BY feat_name""",
)
def bag_importance(spark, folder):
    return shown(fx.bag_importance(bag_effects(spark, folder)), "importance", digits=4)


def _hot_effects(spark, folder):
    frame = items(spark, folder)
    hot = encode.one_hot(frame, CAT, drop=None)
    effects = fx.mean_effects(hot.transform(frame), "l_extendedprice", ["l_quantity", *hot.names]).withColumn("y_std", F.lit(2.0))
    mapping = spark.createDataFrame(hot.mapping_rows(), encode.MAPPING_SCHEMA)
    return effects, mapping


HOT = """WITH lv AS (SELECT DISTINCT l_returnflag AS level FROM lineitem),
       v AS (SELECT level, avg(CASE WHEN l_returnflag = level THEN l_extendedprice END) AS y1,
                    avg(CASE WHEN l_returnflag <> level THEN l_extendedprice END) AS y0,
                    count(CASE WHEN l_returnflag = level THEN 1 END) AS n FROM lineitem, lv GROUP BY level),
       m AS (SELECT sum(n * (y1 - y0)) / sum(n) AS mu, sum(y0) AS base FROM v) """


@query(
    "merge_onehot_effects",
    HOT + """SELECT 'l_returnflag' AS feat_name, CAST(NULL AS DOUBLE) AS x_num, level AS x_cat, round(y1 - y0 - mu, 5) AS y,
                    round(sqrt(8), 6) AS y_std, n FROM v, m
       UNION ALL SELECT 'offset', NULL, NULL, round(mu + base, 5), 2.0, NULL FROM m
       UNION ALL SELECT 'l_quantity', l_quantity, NULL, round(avg(l_extendedprice), 5), 2.0, count(*) FROM lineitem GROUP BY l_quantity""",
)
def merge_onehot_effects(spark, folder):
    out = shown(fx.merge_onehot_effects(*_hot_effects(spark, folder)), digits=5)
    return shown(out, "y_std").drop("feat_idx")


@query(
    "onehot_bar_value",
    HOT + """SELECT 'l_returnflag' AS "column", level AS label, round(y1 + (SELECT sum(y0) FROM v) - y0, 5) AS value FROM v""",
)
def onehot_bar_value(spark, folder):
    effects, mapping = _hot_effects(spark, folder)
    pairs = effects.join(mapping, effects["feat_name"] == mapping["encoded"]).groupBy(
        F.col("source").alias("column"), F.col("level").alias("label")
    ).agg(F.max(F.expr("CASE WHEN x_num = 0 THEN y END")).alias("not_given"), F.max(F.expr("CASE WHEN x_num = 1 THEN y END")).alias("given"))
    return shown(fx.onehot_bar_value(pairs), "value", digits=5)


@query(
    "add_unseen_levels",
    EFF + """SELECT feat_name, feat_idx, x_num, x_cat, round(y, 6) AS y, n FROM eff
       UNION ALL SELECT 'l_quantity', 0, x, NULL, 0.0, 0 FROM (SELECT DISTINCT l_quantity + 25 AS x FROM lineitem)
                 WHERE x NOT IN (SELECT l_quantity FROM lineitem)
       UNION ALL SELECT 'l_returnflag', 2, NULL, x, 0.0, 0 FROM (SELECT DISTINCT l_linestatus AS x FROM lineitem)
                 WHERE x NOT IN (SELECT l_returnflag FROM lineitem)""",
)
def add_unseen_levels(spark, folder):
    frame = items(spark, folder)
    asked = frame.select(
        F.lit("l_quantity").alias("feat_name"), (F.col("l_quantity") + 25).alias("x_num"), F.lit(None).cast("string").alias("x_cat")
    ).unionByName(
        frame.select(F.lit("l_returnflag").alias("feat_name"), F.lit(None).cast("double").alias("x_num"),
                     F.col("l_linestatus").alias("x_cat"))
    ).distinct()
    return shown(fx.add_unseen_levels(raw_effects(spark, folder), asked)).drop("y_std")


@query(
    "renumber_features",
    "SELECT 'offset' AS feat_name, CAST(-1 AS INTEGER) AS feat_idx, CAST(1 AS BIGINT) AS n UNION ALL "
    "SELECT 'l_quantity', 0, count(DISTINCT l_quantity) FROM lineitem UNION ALL "
    "SELECT 'l_returnflag', 1, count(DISTINCT l_returnflag) FROM lineitem",
)
def renumber_features(spark, folder):
    effects = raw_effects(spark, folder).where(F.col("feat_name") != "l_discount")
    return fx.renumber_features(effects).groupBy("feat_name", "feat_idx").agg(F.count(F.lit(1)).alias("n"))


COEF = " UNION ALL ".join(
    f"SELECT '{n}' AS feat_name, covar_pop(l_extendedprice, {n}) / var_pop({n}) AS coef, min({n}) AS lo, max({n}) AS hi FROM lineitem"
    for n in ("l_quantity", "l_discount", "l_tax")
)


def _coefs(spark, folder):
    frame = fx.typed_values(items(spark, folder), ["l_quantity", "l_discount", "l_tax"], [], ["l_extendedprice"])
    return frame.groupBy("feat_name").agg(
        (F.covar_pop("l_extendedprice", "x_num") / F.var_pop("x_num")).alias("coef"),
        F.min("x_num").alias("lo"), F.max("x_num").alias("hi"),
    )


@query(
    "linear_effects",
    f"""SELECT feat_name, CAST(i AS INTEGER) AS pos, round(lo + (hi - lo) * i / 999, 6) AS x,
               round(coef * (lo + (hi - lo) * i / 999) + 10.0, 4) AS y FROM ({COEF}), range(1000) t(i)""",
)
def linear_effects(spark, folder):
    out = fx.linear_effects(_coefs(spark, folder), 1000, 10.0)
    return out.select("feat_name", "pos", rnd("x").alias("x"), rnd("y", 4).alias("y"))


@query(
    "avg_effect_percent",
    EFF + """SELECT feat_name, round(avg(abs(y)), 5) AS avg_effect,
                    round(100 * avg(abs(y)) / sum(avg(abs(y))) OVER (), 6) AS percent FROM cen WHERE feat_idx >= 0 GROUP BY feat_name""",
)
def avg_effect_percent(spark, folder):
    out = fx.avg_effect_percent(fx.center_effects(raw_effects(spark, folder)))
    return shown(shown(out, "avg_effect", digits=5), "percent")


@query(
    "interaction_grid",
    f"""WITH c AS ({COEF}), g AS (SELECT i FROM range(50) t(i))
        SELECT a.feat_name AS feat_a, b.feat_name AS feat_b, round(a.lo + (a.hi - a.lo) * ga.i / 49, 6) AS xa,
               round(b.lo + (b.hi - b.lo) * gb.i / 49, 6) AS xb,
               round((a.lo + (a.hi - a.lo) * ga.i / 49) * (b.lo + (b.hi - b.lo) * gb.i / 49), 6) AS y
        FROM c a, c b, g ga, g gb WHERE a.feat_name = 'l_quantity' AND b.feat_name = 'l_discount'""",
)
def interaction_grid(spark, folder):
    pair = items(spark, folder).agg(
        F.min("l_quantity").alias("lo_a"), F.max("l_quantity").alias("hi_a"),
        F.min("l_discount").alias("lo_b"), F.max("l_discount").alias("hi_b"),
    ).select(F.lit("l_quantity").alias("feat_a"), F.lit("l_discount").alias("feat_b"), "*")
    return shown(fx.interaction_grid(pair, lambda a, b: a * b, 50), "xa", "xb", "y")


KIND = ("l_quantity", "l_linestatus", "l_returnflag")


@query(
    "interaction_kind",
    "WITH lv AS (" + " UNION ALL ".join(f"SELECT '{n}' AS f, count(DISTINCT {n}) AS k FROM lineitem" for n in KIND) + ") "
    """SELECT a.f AS feat_a, b.f AS feat_b, a.k AS levels_a, b.k AS levels_b,
              CASE WHEN a.k <= 2 AND b.k <= 2 THEN 'cat_cat' WHEN a.k <= 2 OR b.k <= 2 THEN 'cat_cont' ELSE 'cont_cont' END AS kind
       FROM lv a, lv b WHERE a.f < b.f""",
)
def interaction_kind(spark, folder):
    from ..operators.clean import level_profile

    levels = level_profile(items(spark, folder), KIND).withColumnRenamed("column", "feat_name")
    pairs = spark.createDataFrame(
        [(a, b) for a in sorted(KIND) for b in sorted(KIND) if a < b], "feat_a string, feat_b string"
    )
    return fx.interaction_kind(pairs, levels)


@query(
    "confidence_band",
    """WITH c AS (SELECT l_linenumber AS seed, 'l_quantity' AS feat_name, l_quantity AS x_num, avg(l_extendedprice) AS y
                  FROM lineitem GROUP BY ALL
                  UNION ALL SELECT l_linenumber, 'l_discount', l_discount, avg(l_extendedprice) FROM lineitem GROUP BY ALL),
            p AS (SELECT *, row_number() OVER (PARTITION BY seed, feat_name ORDER BY x_num) AS pos FROM c),
            l AS (SELECT feat_name, min(k) AS k FROM (SELECT feat_name, seed, count(*) AS k FROM p GROUP BY ALL) GROUP BY ALL)
       SELECT feat_name, pos, round(avg(x_num), 6) AS x, round(avg(y), 6) AS y, round(stddev_pop(y), 5) AS y_std
       FROM p JOIN l USING (feat_name) WHERE pos <= k GROUP BY ALL""",
)
def confidence_band(spark, folder):
    curves = bag_effects(spark, folder, NUM, []).withColumnRenamed("model_id", "seed")
    return shown(shown(fx.confidence_band(curves), "x", "y"), "y_std", digits=5)


@query(
    "step_extend",
    EFF + """SELECT feat_name, x_num, round(y, 6) AS y, 0 AS extended FROM eff WHERE x_num IS NOT NULL
       UNION ALL SELECT feat_name, max(x_num), round(arg_max(y, x_num), 6), 1 FROM eff WHERE x_num IS NOT NULL GROUP BY feat_name""",
)
def step_extend(spark, folder):
    return shown(fx.step_extend(raw_effects(spark, folder)))


@query(
    "category_labels",
    """WITH l AS (SELECT 'l_returnflag' AS s, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY ALL
                  UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem WHERE l_linestatus <> 'F' GROUP BY ALL)
       SELECT 'cat__' || s || '_' || v AS encoded, CAST(k AS INTEGER) AS value,
              CASE WHEN s = 'l_linestatus' THEN CASE k WHEN 1 THEN 'open' ELSE 'filled' END
                   ELSE replace(s, '_', ' ') || ' ' || v || CASE k WHEN 1 THEN ' given' ELSE ' not given' END END AS label
       FROM l, range(2) t(k)""",
)
def category_labels(spark, folder):
    hot = encode.one_hot(items(spark, folder), ["l_returnflag", "l_linestatus"])
    mapping = spark.createDataFrame(hot.mapping_rows(), encode.MAPPING_SCHEMA)
    return fx.category_labels(mapping, {"l_linestatus": ("filled", "open")})
