"""Sources, cleaning and profiling on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean
from ..operators.encode import sorted_levels
from ..sources import readers, writers
from ..sources.spec import DatasetSpec, drop_special_rows, load_dataset
from .catalog import query, rnd, shared_path, table

# the tables hold no missing values, so blanks, tokens and NULLs are made by expression
DIRTY = [
    "l_orderkey",
    "l_linenumber",
    "l_extendedprice",
    "CASE WHEN l_quantity > 45 THEN '?' WHEN l_quantity > 40 THEN ' ' WHEN l_quantity > 35 THEN '' "
    "ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS qty_text",
    "CASE WHEN l_tax > 0.02 THEN NULL ELSE l_tax END AS tax_null",
    "CASE WHEN l_discount > 0.07 THEN NULL ELSE l_discount END AS disc_null",
    "CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_returnflag END AS flag_null",
    "l_linestatus",
]
D = f"(SELECT {', '.join(DIRTY)} FROM lineitem)"


def dirty(spark, folder):
    return table(spark, folder, "lineitem").selectExpr(*DIRTY)


@query(
    "read_delimited",
    "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL",
)
def read_delimited(spark, folder):
    path = shared_path(spark, "delimited")
    frame = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    frame.write.option("header", True).option("sep", ";").csv(path)
    back = readers.read_delimited(spark, path, ";", "o_orderkey bigint, o_orderstatus string, o_totalprice double")
    return back.groupBy("o_orderstatus").agg(F.count("o_orderkey").alias("n"), rnd(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "null_tokens",
    f"SELECT l_linestatus, count(nullif(qty_text, '?')) AS kept, count(*) AS n FROM {D} GROUP BY ALL",
)
def null_tokens(spark, folder):
    out = clean.null_tokens(dirty(spark, folder), ["?"])
    return out.groupBy("l_linestatus").agg(F.count("qty_text").alias("kept"), F.count(F.lit(1)).alias("n"))


LINEITEM_SPEC = DatasetSpec(
    "lineitem", "classification", "lineitem.parquet", "l_linestatus",
    numeric=("l_quantity", "l_discount", "l_tax"), categorical=("l_returnflag",),
    target_map={"O": 1, "F": 0}, drop_null_target=True, drop_rows_all_equal=0.0,
)


@query(
    "load_dataset",
    """SELECT CASE l_linestatus WHEN 'O' THEN 1 WHEN 'F' THEN 0 END AS l_linestatus, l_returnflag, count(*) AS n,
              round(sum(l_quantity), 2) AS qty, round(sum(l_discount), 4) AS disc
       FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY ALL""",
)
def load(spark, folder):
    frame, spec = load_dataset(spark, LINEITEM_SPEC, folder)
    return drop_special_rows(frame, spec).groupBy("l_linestatus", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("l_quantity"), 2).alias("qty"), rnd(F.sum("l_discount"), 4).alias("disc")
    )


@query(
    "load_dataset_missing",
    """SELECT CASE l_linestatus WHEN 'O' THEN 1 END AS l_linestatus, count(*) AS n,
              count(*) FILTER (l_linenumber <> 2) AS flags, count(*) FILTER (l_linenumber <> 3) AS taxes
       FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber <> 1 GROUP BY ALL""",
)
def load_dataset_missing(spark, folder):
    """Texts that mean missing, in a file: of the target, of a level, of a number; and a label that the map does not know."""
    path = shared_path(spark, "missing")
    number = F.col("l_linenumber")
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", F.when(number == 1, "NA").otherwise(F.col("l_linestatus")).alias("l_linestatus"),
        F.when(number == 2, "N/A").otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        F.when(number == 3, "NaN").otherwise(F.col("l_tax").cast("string")).alias("l_tax"),
    )
    rows.write.option("header", True).csv(path)
    spec = DatasetSpec("missing", "classification", path.rsplit("/", 1)[1], "l_linestatus", numeric=("l_tax",), categorical=("l_returnflag",),
                       target_map={"O": 1}, drop_null_target=True)
    frame, _ = load_dataset(spark, spec, path.rsplit("/", 1)[0])
    return frame.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count("l_returnflag").alias("flags"), F.count("l_tax").alias("taxes"))


@query(
    "read_rater_blocks",
    """SELECT 'r' || n_regionkey AS rater, '1:' || CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS VARCHAR) AS unit,
              CAST(CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey END AS DOUBLE) AS value FROM nation""",
)
def read_rater_blocks(spark, folder):
    """A grid file of the nations: a block for each region, '-' where a rating is missing."""
    path = shared_path(spark, "raters")
    cell = F.when(F.col("n_nationkey") % 3 == 0, "-").otherwise(F.col("n_nationkey").cast("string"))
    blocks = table(spark, folder, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", cell.alias("cell")))).alias("cells"))
    line = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("\n1;"), F.array_join(F.col("cells.cell"), ";"))
    blocks.select(F.concat(line, F.lit("\n")).alias("value")).coalesce(1).write.text(path)
    return readers.read_rater_blocks(spark, f"{path}/*.txt")


@query(
    "keys_from_path",
    r"""SELECT regexp_extract(p, '/([a-z]+)/([A-Za-z_]+)_Folds/', 1) AS dataset,
               regexp_extract(p, '/([a-z]+)/([A-Za-z_]+)_Folds/', 2) AS model, count(*) AS n
        FROM (SELECT '/results/' || lower(c_mktsegment) || '/' || c_mktsegment || '_NET_Folds/m_Fold_' ||
                     CAST(c_nationkey AS VARCHAR) || '.csv' AS p FROM customer) GROUP BY ALL""",
)
def keys_from_path(spark, folder):
    path = F.expr(
        "concat('/results/', lower(c_mktsegment), '/', c_mktsegment, '_NET_Folds/m_Fold_', c_nationkey, '.csv')"
    )
    frame = table(spark, folder, "customer").select(path.alias("p"))
    return frame.select(*readers.keys_from_path(F.col("p"))).groupBy("dataset", "model").agg(F.count(F.lit(1)).alias("n"))


@query(
    "read_param_grid",
    r"""WITH e AS (SELECT event_type AS model, regexp_extract(props, '([0-9]+)', 1) AS k, CAST(user_id AS VARCHAR) AS u
                   FROM events)
        SELECT model, param, count(*) AS n, count(DISTINCT v) AS distinct_values, min(v) AS lowest, max(v) AS highest
        FROM (SELECT model, 'depth' AS param, k AS v FROM e UNION ALL SELECT model, 'depth', u FROM e
              UNION ALL SELECT model, 'rate', k FROM e) GROUP BY ALL""",
)
def read_param_grid(spark, folder):
    text = F.expr(
        """concat('{"', event_type, '": {"depth": [', regexp_extract(props, '([0-9]+)', 1), ', ', user_id,
                  '], "rate": [', regexp_extract(props, '([0-9]+)', 1), ']}}')"""
    )
    grid = readers.read_param_grid(table(spark, folder, "events").select(text.alias("grid")), "grid")
    rows = grid.select("model", "param", F.explode("values").alias("v"))
    return rows.groupBy("model", "param").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("distinct_values"),
        F.min("v").alias("lowest"), F.max("v").alias("highest"),
    )


@query(
    "read_param_cells",
    """WITH m AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 'p: ' || o_orderpriority END) AS f,
                         max(CASE WHEN o_orderstatus = 'O' THEN 'q: ' || o_orderpriority END) AS o
                  FROM orders GROUP BY o_custkey)
       SELECT 'F' AS model, f AS params, count(*) AS n FROM m WHERE f IS NOT NULL GROUP BY ALL
       UNION ALL SELECT 'O', o, count(*) FROM m WHERE o IS NOT NULL GROUP BY ALL""",
)
def read_param_cells(spark, folder):
    # the P column holds bare numbers, which are no configurations
    matrix = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").cast("string").alias("dataset"))
        .agg(
            F.max(F.expr("CASE WHEN o_orderstatus = 'F' THEN concat('p: ', o_orderpriority) END")).alias("F"),
            F.max(F.expr("CASE WHEN o_orderstatus = 'O' THEN concat('q: ', o_orderpriority) END")).alias("O"),
            F.max(F.expr("CASE WHEN o_orderstatus = 'P' THEN cast(o_orderkey AS string) END")).alias("P"),
        )
    )
    return readers.read_param_cells(matrix, "dataset").groupBy("model", "params").agg(F.count(F.lit(1)).alias("n"))


@query(
    "write_report",
    """SELECT o_orderstatus AS dataset, o_orderpriority AS model, CAST(o_orderkey % 5 AS INTEGER) AS fold,
              round(avg(o_totalprice), 6) AS value FROM orders GROUP BY ALL""",
)
def write_report(spark, folder):
    path = shared_path(spark, "report")
    rows = table(spark, folder, "orders").groupBy(
        F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("model"),
        (F.col("o_orderkey") % 5).cast("int").alias("fold"),
    ).agg(F.avg("o_totalprice").alias("value"))
    writers.write_report(rows, path)
    back = spark.read.schema("fold int, value double, dataset string, model string").parquet(path)
    return back.select("dataset", "model", "fold", rnd("value").alias("value"))


@query(
    "upsert_best_config",
    """SELECT fold, dataset, max(CASE WHEN model = '1-URGENT' THEN params END) AS urgent,
              max(CASE WHEN model = '5-LOW' THEN params END) AS low
       FROM (SELECT CAST(o_custkey % 5 AS INTEGER) AS fold, o_orderstatus AS dataset, o_orderpriority AS model,
                    arg_max('c: ' || CAST(o_custkey AS VARCHAR), o_orderkey) AS params FROM orders GROUP BY ALL)
       GROUP BY ALL""",
)
def upsert_best_config(spark, folder):
    path = shared_path(spark, "configs")
    log = table(spark, folder, "orders").select(
        (F.col("o_custkey") % 5).cast("int").alias("fold"), F.col("o_orderstatus").alias("dataset"),
        F.col("o_orderpriority").alias("model"), F.concat(F.lit("c: "), F.col("o_custkey").cast("string")).alias("params"),
        F.col("o_orderkey").alias("written_at"),
    )
    writers.append_best_config(log, path)
    back = spark.read.schema(log.schema).parquet(path)
    matrix = writers.config_matrix(writers.latest_config(back), ["1-URGENT", "5-LOW"])
    return matrix.withColumnRenamed("1-URGENT", "urgent").withColumnRenamed("5-LOW", "low")


@query(
    "blank_to_null",
    f"""SELECT l_linestatus, count(CASE WHEN qty_text NOT IN ('', ' ') THEN 1 END) AS kept,
               count(CASE WHEN qty_text = '?' THEN 1 END) AS tokens FROM {D} GROUP BY ALL""",
)
def blank_to_null(spark, folder):
    out = clean.blank_to_null(dirty(spark, folder), ["qty_text", "l_extendedprice"])
    return out.groupBy("l_linestatus").agg(
        F.count("qty_text").alias("kept"), F.count_if(F.col("qty_text") == "?").alias("tokens")
    )


@query(
    "coerce_numeric",
    f"""SELECT l_linestatus, count(TRY_CAST(qty_text AS DOUBLE)) AS numbers,
               sum(TRY_CAST(qty_text AS DOUBLE)) AS total FROM {D} GROUP BY ALL""",
)
def coerce_numeric(spark, folder):
    out = clean.coerce_numeric(dirty(spark, folder), ["qty_text"])
    return out.groupBy("l_linestatus").agg(F.count("qty_text").alias("numbers"), F.sum("qty_text").alias("total"))


PROFILED = ("qty_blank", "tax_null", "disc_null", "flag_null", "l_linestatus")
PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{n}' AS "column", round(avg(CASE WHEN {n} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_share FROM d"""
    for n in PROFILED
)
PROFILE_CTE = f"WITH d AS (SELECT *, CASE WHEN qty_text IN ('', ' ') THEN NULL ELSE qty_text END AS qty_blank FROM {D})"


def profiled(spark, folder):
    return clean.blank_to_null(dirty(spark, folder).withColumn("qty_blank", F.col("qty_text")), ["qty_blank"])


@query("missing_profile", f"{PROFILE_CTE} {PROFILE_SQL}")
def missing_profile(spark, folder):
    out = clean.missing_profile(profiled(spark, folder), PROFILED)
    return out.withColumn("missing_share", rnd("missing_share"))


@query("drop_sparse_cols", f"{PROFILE_CTE} SELECT * FROM ({PROFILE_SQL}) WHERE missing_share <= 0.5")
def drop_sparse_cols(spark, folder):
    kept = clean.drop_sparse_cols(profiled(spark, folder).select(*PROFILED))
    return clean.missing_profile(kept).withColumn("missing_share", rnd("missing_share"))


LEVELS_SQL = " UNION ALL ".join(
    f"""SELECT '{n}' AS "column", count(DISTINCT {n}) AS levels FROM part""" for n in ("p_name", "p_brand", "p_type")
)


@query("level_profile", LEVELS_SQL)
def level_profile(spark, folder):
    return clean.level_profile(table(spark, folder, "part"), ["p_name", "p_brand", "p_type"])


@query("drop_high_card", f"SELECT * FROM ({LEVELS_SQL}) WHERE levels <= 25")
def drop_high_card(spark, folder):
    part = table(spark, folder, "part").select("p_name", "p_brand", "p_type")
    kept = clean.drop_high_card(part, part.columns)
    return clean.level_profile(kept, kept.columns)


@query("fill_categorical", f"SELECT coalesce(flag_null, 'unknown') AS flag, count(*) AS n FROM {D} GROUP BY ALL")
def fill_categorical(spark, folder):
    out = clean.fill_categorical(dirty(spark, folder), ["flag_null"])
    return out.groupBy(F.col("flag_null").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "impute_median",
    f"""WITH d AS (SELECT *, TRY_CAST(qty_text AS DOUBLE) AS q,
                          CASE WHEN l_extendedprice > 90000 THEN NULL ELSE l_extendedprice END AS price FROM {D}),
             m AS (SELECT median(q) AS mq, median(disc_null) AS md, median(price) AS mp FROM d)
        SELECT l_linestatus, sum(coalesce(q, mq)) AS qty, round(sum(coalesce(disc_null, md)), 4) AS disc,
               round(sum(coalesce(price, mp)), 2) AS price, count(*) AS n FROM d, m GROUP BY ALL""",
)
def impute_median(spark, folder):
    frame = dirty(spark, folder).withColumn(
        "price", F.expr("CASE WHEN l_extendedprice > 90000 THEN NULL ELSE l_extendedprice END")
    )
    out = clean.impute_median(clean.coerce_numeric(frame, ["qty_text"]), ["qty_text", "disc_null", "price"])
    return out.groupBy("l_linestatus").agg(
        F.sum("qty_text").alias("qty"), rnd(F.sum("disc_null"), 4).alias("disc"), rnd(F.sum("price"), 2).alias("price"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "prepare_features",
    f"""WITH d AS (SELECT *, TRY_CAST(qty_text AS DOUBLE) AS q FROM {D}),
             m AS (SELECT median(q) AS mq, median(disc_null) AS md FROM d)
        SELECT coalesce(flag_null, 'unknown') AS flag_null, l_linestatus, sum(coalesce(q, mq)) AS qty,
               round(sum(coalesce(disc_null, md)), 4) AS disc, count(*) AS n FROM d, m GROUP BY ALL""",
)
def prepare_features(spark, folder):
    """All cleaning steps in their fixed order: the sparse tax column is dropped on the way."""
    frame = dirty(spark, folder)
    cleaner = clean.fit_cleaner(frame, ["qty_text", "tax_null", "disc_null"], ["flag_null", "l_linestatus"])
    out = cleaner.transform(frame)
    return out.groupBy("flag_null", "l_linestatus").agg(
        F.sum("qty_text").alias("qty"), rnd(F.sum("disc_null"), 4).alias("disc"), F.count(F.lit(1)).alias("n")
    )


@query("project_features", "SELECT o_totalprice, o_custkey, o_orderstatus, o_orderpriority, o_orderkey FROM orders")
def project_features(spark, folder):
    return clean.project_features(
        table(spark, folder, "orders"), ["o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"], ["o_orderkey"]
    )


@query(
    "map_target",
    """SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS label, count(*) AS n,
              round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL""",
)
def map_target(spark, folder):
    out = clean.map_target(table(spark, folder, "orders"), "o_orderstatus", {"F": 1, "O": 0})
    return out.groupBy(F.col("o_orderstatus").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "drop_null_target",
    """SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL""",
)
def drop_null_target(spark, folder):
    out = clean.map_target(table(spark, folder, "orders"), "o_orderstatus", {"F": 1, "O": 0})
    return clean.drop_null_target(out, "o_orderstatus").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "drop_all_equal",
    """SELECT l_returnflag, count(*) AS n FROM lineitem WHERE NOT (l_discount = 0 AND l_tax = 0) GROUP BY ALL""",
)
def drop_all_equal(spark, folder):
    out = clean.drop_all_equal(table(spark, folder, "lineitem"), ["l_discount", "l_tax"], 0.0)
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "feature_set_difference",
    """SELECT 'l_quantity' AS feat_name, count(l_quantity) AS n FROM lineitem
       UNION ALL SELECT 'l_discount', count(l_discount) FROM lineitem
       UNION ALL SELECT 'l_tax', count(l_tax) FROM lineitem""",
)
def feature_set_difference(spark, folder):
    frame = table(spark, folder, "lineitem")
    excluded = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag",
                "l_linestatus", "l_shipdate"]
    names = clean.feature_set_difference(frame.columns, excluded)
    return clean.feature_values(frame, names).groupBy("feat_name").agg(F.count("x").alias("n"))


@query(
    "clean_values",
    """SELECT translate(o_orderpriority, ' -?+~', '_____') AS priority, count(*) AS n FROM orders GROUP BY ALL""",
)
def clean_values(spark, folder):
    out = clean.clean_values(table(spark, folder, "orders"), ["o_orderpriority"])
    return out.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "clean_names",
    """SELECT p_type AS "p_type", count(*) AS "n_parts", max(p_size) AS "sizeunder50", min(p_size) AS "n_parts_2"
       FROM part GROUP BY ALL""",
)
def clean_names(spark, folder):
    frame = table(spark, folder, "part").groupBy(F.col("p_type").alias("p type")).agg(
        F.count(F.lit(1)).alias("n-parts"), F.max("p_size").alias("size<50"), F.min("p_size").alias("n parts")
    )
    return frame.toDF(*clean.clean_names(clean.clean_names(frame.columns, "plain"), "trees"))


@query(
    "winsorize",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.9) AS hi FROM lineitem)
       SELECT l_returnflag, round(sum(least(greatest(l_extendedprice, lo), hi)), 2) AS total,
              round(min(least(greatest(l_extendedprice, lo), hi)), 6) AS lowest,
              round(max(least(greatest(l_extendedprice, lo), hi)), 6) AS highest FROM lineitem, q GROUP BY ALL""",
)
def winsorize(spark, folder):
    out = clean.winsorize(table(spark, folder, "lineitem"), ["l_extendedprice"], 0.05, 0.9)
    return out.groupBy("l_returnflag").agg(
        rnd(F.sum("l_extendedprice"), 2).alias("total"), rnd(F.min("l_extendedprice")).alias("lowest"),
        rnd(F.max("l_extendedprice")).alias("highest"),
    )


@query(
    "dataset_profile",
    """SELECT 'regression' AS task, 'lineitem' AS dataset, (SELECT count(*) FROM lineitem) AS samples, 3 AS num, 2 AS cat,
              CAST(count(*) AS VARCHAR) || ' (' || CAST(count(*) - (SELECT count(*) FROM lineitem) AS VARCHAR) || ')'
                AS clean_samples,
              '2 (-1)' AS clean_num, '2 (0)' AS clean_cat, 2 AS encoded_num,
              CAST(count(DISTINCT coalesce(flag_null, 'unknown')) + 1 AS VARCHAR) || ' (+' ||
              CAST(count(DISTINCT coalesce(flag_null, 'unknown')) - 1 AS VARCHAR) || ')' AS encoded_cat
       FROM (SELECT CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_returnflag END AS flag_null FROM lineitem
             WHERE NOT (l_discount = 0 AND l_tax = 0))""",
)
def dataset_profile(spark, folder):
    raw = dirty(spark, folder)
    full = table(spark, folder, "lineitem").where(~((F.col("l_discount") == 0) & (F.col("l_tax") == 0))).selectExpr(*DIRTY)
    cleaner = clean.fit_cleaner(full, ["qty_text", "tax_null", "disc_null"], ["flag_null", "l_linestatus"])
    return clean.dataset_profile(
        raw, cleaner.transform(full), "lineitem", "regression", 3, 2, cleaner.numeric, cleaner.categorical
    )


COUNTED = ("l_quantity", "l_discount", "l_returnflag", "l_linenumber")
COUNTS_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS feat_name, CAST({n} AS VARCHAR) AS x, count(*) AS n FROM lineitem GROUP BY {n}" for n in COUNTED
)


@query("value_counts", COUNTS_SQL)
def value_counts(spark, folder):
    return clean.value_counts(table(spark, folder, "lineitem"), COUNTED)


@query("unique_values", f"SELECT feat_name, x FROM ({COUNTS_SQL})")
def unique_values(spark, folder):
    return clean.unique_values(table(spark, folder, "lineitem"), COUNTED)


@query(
    "histogram",
    """WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
            b AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n
                  FROM lineitem, r GROUP BY ALL)
       SELECT CAST(i AS INTEGER) AS bin, round(lo + i * ((hi - lo) / 10), 6) AS low,
              round(lo + (i + 1) * ((hi - lo) / 10), 6) AS high, coalesce(n, 0) AS n
       FROM range(10) t(i) CROSS JOIN r LEFT JOIN b ON b.bin = i""",
)
def histogram(spark, folder):
    out = clean.histogram(table(spark, folder, "lineitem"), "l_extendedprice", 10)
    return out.select("bin", rnd("low").alias("low"), rnd("high").alias("high"), "n")


@query(
    "rescale_range",
    """WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
       SELECT o_orderkey, round((o_totalprice - lo) * (100.0 / (hi - lo)), 6) AS scaled FROM orders, r""",
)
def rescale_range(spark, folder):
    out = clean.rescale_range(table(spark, folder, "orders"), "o_totalprice", (0.0, 100.0), "scaled")
    return out.select("o_orderkey", rnd("scaled").alias("scaled"))


@query(
    "denormalise",
    "SELECT l_linenumber, round(sum(l_discount * 41.0 - 8.0), 4) AS celsius FROM lineitem GROUP BY ALL",
)
def denormalise(spark, folder):
    out = table(spark, folder, "lineitem").select("l_linenumber", clean.denormalise(F.col("l_discount"), -8.0, 33.0).alias("t"))
    return out.groupBy("l_linenumber").agg(rnd(F.sum("t"), 4).alias("celsius"))


@query(
    "infer_roles",
    """SELECT 'categorical' AS role, 'l_returnflag' AS "column", count(DISTINCT l_returnflag) AS levels FROM lineitem
       UNION ALL SELECT 'categorical', 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem
       UNION ALL SELECT 'numeric', 'l_quantity', count(DISTINCT l_quantity) FROM lineitem
       UNION ALL SELECT 'numeric', 'l_discount', count(DISTINCT l_discount) FROM lineitem
       UNION ALL SELECT 'numeric', 'l_tax', count(DISTINCT l_tax) FROM lineitem
       UNION ALL SELECT 'numeric', 'l_linenumber', count(DISTINCT l_linenumber) FROM lineitem""",
)
def infer_roles(spark, folder):
    frame = table(spark, folder, "lineitem")
    skip = ("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    numeric, categorical = clean.infer_roles(frame, skip)
    role = F.when(F.col("column").isin(categorical), "categorical").otherwise("numeric")
    return clean.level_profile(frame, [*numeric, *categorical]).select(role.alias("role"), "column", "levels")


@query(
    "sorted_levels",
    """SELECT p_brand AS level, count(*) AS n FROM part GROUP BY ALL""",
)
def level_table(spark, folder):
    part = table(spark, folder, "part")
    levels = sorted_levels(part, ["p_brand"])["p_brand"]
    return part.where(F.col("p_brand").isin(levels)).groupBy(F.col("p_brand").alias("level")).agg(F.count(F.lit(1)).alias("n"))
