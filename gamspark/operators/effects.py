"""Effect tables: any additive model as rows (feat_name, feat_idx, x_num, x_cat, y, y_std, n).

The first row of a model is its offset (feat_idx -1, no x). Numeric values sit in ``x_num``,
levels in ``x_cat``; ``n`` counts the training rows that have the value.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.joins import lookup_join
from ..functions.order import value_prefix, value_ranges
from ..functions.scalars import c, clean_double, logit
from ..session import materialise

OFFSET = "offset"
NESTED_ROWS = 200_000
COLUMNS = ["feat_name", "feat_idx", "x_num", "x_cat", "y", "y_std", "n"]


def is_offset() -> Column:
    return F.col("feat_idx") == -1


def x_key(num: Column, cat: Column) -> Column:
    """One join key for both kinds of value."""
    return F.when(cat.isNotNull(), F.concat(F.lit("c:"), cat)).otherwise(
        F.concat(F.lit("n:"), clean_double(num).cast("string"))
    )


def typed_values(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """(extra..., feat_name, feat_idx, x_num, x_cat): one row per row and feature, no shuffle."""
    cells = [
        F.struct(
            F.lit(n).alias("feat_name"),
            F.lit(i).alias("feat_idx"),
            clean_double(c(n)).alias("x_num"),
            F.lit(None).cast("string").alias("x_cat"),
        )
        for i, n in enumerate(numeric)
    ] + [
        F.struct(
            F.lit(n).alias("feat_name"),
            F.lit(len(numeric) + i).alias("feat_idx"),
            F.lit(None).cast("double").alias("x_num"),
            c(n).cast("string").alias("x_cat"),
        )
        for i, n in enumerate(categorical)
    ]
    return df.select(*[c(n) for n in extra], F.inline(F.array(*cells)))


def feature_value_counts(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """(feat_name, feat_idx, x_num, x_cat, n)."""
    return typed_values(df, numeric, categorical).groupBy("feat_name", "feat_idx", "x_num", "x_cat").agg(
        F.count(F.lit(1)).alias("n")
    )


def offset_row(spark: SparkSession, y: float) -> DataFrame:
    return spark.range(1).select(
        F.lit(OFFSET).alias("feat_name"),
        F.lit(-1).alias("feat_idx"),
        F.lit(None).cast("double").alias("x_num"),
        F.lit(None).cast("string").alias("x_cat"),
        F.lit(float(y)).alias("y"),
        F.lit(None).cast("double").alias("y_std"),
        F.lit(None).cast("bigint").alias("n"),
    )


def mean_effects(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Raw effects as the mean target at each value, with offset 0: the simplest additive table."""
    table = (
        typed_values(df, numeric, categorical, [target])
        .groupBy("feat_name", "feat_idx", "x_num", "x_cat")
        .agg(F.avg(c(target)).alias("y"), F.count(F.lit(1)).alias("n"))
        .withColumn("y_std", F.lit(None).cast("double"))
    )
    return offset_row(df.sparkSession, 0.0).select(COLUMNS).unionByName(table.select(COLUMNS))


def effects_from_predictor(values: DataFrame, numeric: Sequence[str], scorer: Callable[[DataFrame], DataFrame],
                           probability: bool = False, base: float = 1.0) -> DataFrame:
    """Effects of a black box that is additive in its features.

    ``values`` is a value-count table. Each value becomes one probe row whose other features stand at
    ``base``; ``scorer`` adds a column ``score`` to a frame with the feature columns. The score of the
    all-base row is the offset.
    """
    spark = values.sparkSession
    probes = values.select(
        "feat_name", "feat_idx", "x_num", "x_cat", "n",
        *[F.when(F.col("feat_name") == n, F.col("x_num")).otherwise(F.lit(base)).alias(n) for n in numeric],
    )

    def score(frame):
        scored = scorer(frame)
        return scored.withColumn("score", logit(F.col("score"))) if probability else scored

    origin = score(spark.range(1).select(*[F.lit(base).alias(n) for n in numeric])).first()["score"]
    table = score(probes).select(
        "feat_name", "feat_idx", "x_num", "x_cat", (F.col("score") - F.lit(origin)).alias("y"),
        F.lit(None).cast("double").alias("y_std"), "n",
    )
    return offset_row(spark, origin).select(COLUMNS).unionByName(table.select(COLUMNS))


def _feature_means(effects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return effects.where(F.col("feat_idx") >= 0).groupBy(*by, "feat_name").agg(
        (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("__mu")
    )


def center_effects(effects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every feature gets count-weighted mean 0; the offset takes the sum of the removed means.

    The means are one aggregate (a row per feature), so a feature with very many values is never
    gathered in one window partition. ``by`` tells several models in one table apart.
    """
    by = list(by)
    means = _feature_means(effects, by)
    lift = means.groupBy(*by).agg((-F.sum("__mu")).alias("__mu")).withColumn("feat_name", F.lit(OFFSET))
    joined = effects.join(means.unionByName(lift), [*by, "feat_name"], "left")
    return joined.withColumn("y", F.col("y") - F.coalesce("__mu", F.lit(0.0))).select(effects.columns)


def importance(effects: DataFrame) -> DataFrame:
    """(feat_name, feat_idx, importance): count-weighted mean distance from the feature's mean effect."""
    joined = effects.where(F.col("feat_idx") >= 0).join(_feature_means(effects), "feat_name")
    return joined.groupBy("feat_name", "feat_idx").agg(
        (F.sum(F.col("n") * F.abs(F.col("y") - F.col("__mu"))) / F.sum("n")).alias("importance")
    )


def restrict_to_values(effects: DataFrame, lookup: DataFrame) -> DataFrame:
    """Effects only at the asked values (feat_name, x_num, x_cat); a value without effect has NULL y."""
    key = x_key(F.col("x_num"), F.col("x_cat"))
    table = effects.where(F.col("feat_idx") >= 0).select("feat_name", key.alias("__k"), "feat_idx", "y", "y_std", "n")
    asked = lookup.select("feat_name", "x_num", "x_cat", key.alias("__k"))
    return lookup_join(asked, table, ["feat_name", "__k"]).select(COLUMNS)


def contributions(df: DataFrame, effects: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
                  prefix: str = "contrib_") -> DataFrame:
    """One contribution column per feature by equi-join on the value; unknown values give NULL.

    The effect table is written once, so that the optimizer knows its bytes: below the broadcast
    threshold the rows are never shuffled. Each feature is one join, the rows are read once.
    """
    effects = materialise(effects.where(F.col("feat_idx") >= 0).select("feat_name", "x_num", "x_cat", "y"))
    out = df
    for name in (*numeric, *categorical):
        is_num = name in numeric
        value = clean_double(c(name)) if is_num else c(name).cast("string")
        table = effects.where(F.col("feat_name") == name).select(
            F.col("x_num" if is_num else "x_cat").alias("__k"), F.col("y").alias(f"{prefix}{name}")
        )
        out = lookup_join(out.withColumn("__k", value), table, ["__k"]).drop("__k")
    return out


def offset_value(effects: DataFrame) -> float:
    row = effects.where(is_offset()).agg(F.sum("y")).first()
    return float(row[0] or 0.0)


def score_by_effects(df: DataFrame, effects: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
                     name: str = "score") -> DataFrame:
    """Offset plus the sum of the looked-up effects."""
    wide = contributions(df, effects, numeric, categorical)
    cols = [f"contrib_{n}" for n in (*numeric, *categorical)]
    total = F.lit(offset_value(effects))
    for n in cols:
        total = total + c(n)
    return wide.withColumn(name, total).drop(*cols)


def nearest_effect(df: DataFrame, col: str, effects: DataFrame, out: str = "y") -> DataFrame:
    """Effect of the nearest known value; beyond the ends the last one counts, ties go down.

    A value known several times has its least effect; NULL and NaN, and any value when none is known, give NULL. The distinct
    values are resolved by ``nearest_knots`` and looked up, for any number of known values.
    """
    table = effects.select(clean_double(c("x_num")).alias("x_num"), "y").where(F.col("x_num").isNotNull())
    table = materialise(table.groupBy("x_num").agg(F.min("y").alias("y")))
    keyed = df.withColumn("__k", clean_double(c(col)))
    matched = nearest_knots(keyed.select(F.col("__k").alias("x")).distinct(), table)
    known = matched.join(table.withColumnRenamed("x_num", "knot"), "knot").select(F.col("x").alias("__k"), F.col("y").alias(out))
    return lookup_join(keyed, known, ["__k"]).drop("__k")


def nearest_knots(values: DataFrame, table: DataFrame, buckets: int | None = None) -> DataFrame:
    """(x, knot): nearest ``x_num`` of ``table`` for every distinct ``x``, without a global sort.

    Values and knots are partitioned by range; inside a range the neighbours are window functions, and a table with one row per
    range carries the nearest knot of the other ranges.
    """
    both = values.where(F.col("x").isNotNull()).select("x", F.lit(None).cast("double").alias("knot")).unionByName(
        table.select(F.col("x_num").alias("x"), F.col("x_num").alias("knot"))
    )
    both, ranges = value_ranges(both, "x", buckets)
    inside = Window.partitionBy("__vb").orderBy("x")
    low = F.last("knot", True).over(inside.rangeBetween(Window.unboundedPreceding, 0))
    high = F.first("knot", True).over(inside.rangeBetween(0, Window.unboundedFollowing))
    if ranges > 1:
        ends = both.groupBy("__vb").agg(F.max("knot").alias("__hi"), F.min("knot").alias("__lo"))
        order = Window.partitionBy(F.lit(0)).orderBy("__vb")
        ends = ends.select(
            "__vb",
            F.last("__hi", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__prev"),
            F.first("__lo", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("__next"),
        )
        both = both.join(ends, "__vb")
        low, high = F.coalesce(low, "__prev"), F.coalesce(high, "__next")
    near = both.select("x", "knot", low.alias("a"), high.alias("b")).where(F.col("knot").isNull())
    down = F.col("b").isNull() | (F.col("a").isNotNull() & (F.col("x") - F.col("a") <= F.col("b") - F.col("x")))
    return near.select("x", F.when(down, F.col("a")).otherwise(F.col("b")).alias("knot"))


def bin_effect(df: DataFrame, col: str, cuts: Sequence[float], scores: Sequence[float], out: str = "y") -> DataFrame:
    """Score of the model bin that holds the value; a value on a cut belongs to the upper bin, NULL and NaN to none.

    The scores are one literal of the plan, however many bins the model has.
    """
    if not cuts:
        return df.withColumn(out, F.lit(float(scores[0])))
    keyed = df.withColumn("__v", clean_double(c(col)))
    binned = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__v", outputCol="__bin",
                        handleInvalid="keep").transform(keyed)
    table = F.from_json(F.lit(json.dumps([float(s) for s in scores])), "array<double>")
    return binned.withColumn(out, F.when(F.col("__v").isNotNull(), F.get(table, F.col("__bin").cast("int")))).drop("__v", "__bin")


def aggregate_effects(models: DataFrame) -> DataFrame:
    """Mean and population std of y at each value over models (``model_id`` tells them apart)."""
    return models.groupBy("feat_name", "feat_idx", "x_num", "x_cat").agg(
        F.avg("y").alias("y"), F.stddev_pop("y").alias("y_std"), F.max("n").alias("n")
    )


def bag_importance(models: DataFrame) -> DataFrame:
    """(feat_name, importance): mean over bags of the count-weighted mean |y|; NULL when the bags do
    not share one set of values."""
    rows = models.where(F.col("feat_idx") >= 0)
    per_value = rows.groupBy("feat_name", "x_num", "x_cat").agg(
        F.count_distinct("model_id").alias("__m"), F.sum(F.abs("y") * F.col("n")).alias("__yn"), F.sum("n").alias("__n")
    )
    sets = per_value.groupBy("feat_name").agg(
        F.min("__m").alias("__lo"), F.max("__m").alias("__hi"), (F.sum("__yn") / F.sum("__n")).alias("__imp")
    )
    bags = rows.groupBy("feat_name").agg(F.count_distinct("model_id").alias("__bags"))
    same = (F.col("__lo") == F.col("__bags")) & (F.col("__hi") == F.col("__bags"))
    return sets.join(bags, "feat_name").select("feat_name", F.when(same, F.col("__imp")).alias("importance"))


def merge_onehot_effects(effects: DataFrame, mapping: DataFrame) -> DataFrame:
    """Level columns become one categorical feature.

    A level's value is y(1)-y(0) (0 when only one of both is known), centred by level share. The
    offset takes what was removed, so that scores by table stay equal to the raw score.
    """
    levels = mapping.where(F.col("kind") == "categorical").select(
        F.col("encoded").alias("feat_name"), F.col("source").alias("__src"), F.col("level").alias("__level")
    )
    tagged = effects.join(levels, "feat_name", "left")
    rest = tagged.where(F.col("__src").isNull()).select(COLUMNS)
    one, zero = F.col("x_num") == 1, F.col("x_num") == 0
    pairs = tagged.where(F.col("__src").isNotNull()).groupBy("__src", "__level").agg(
        F.min("feat_idx").alias("feat_idx"),
        F.max(F.when(one, F.col("y"))).alias("y1"),
        F.max(F.when(zero, F.col("y"))).alias("y0"),
        F.max(F.when(one, F.col("y_std"))).alias("s1"),
        F.max(F.when(zero, F.col("y_std"))).alias("s0"),
        F.coalesce(F.sum(F.when(one, F.col("n"))), F.lit(0)).alias("n"),
    )
    both = F.col("y1").isNotNull() & F.col("y0").isNotNull()
    pairs = pairs.select(
        "__src", "__level", "feat_idx", "n",
        F.when(both, F.col("y1") - F.col("y0")).otherwise(0.0).alias("v"),
        F.when(both, F.sqrt(F.col("s0") * F.col("s0") + F.col("s1") * F.col("s1"))).otherwise(0.0).alias("y_std"),
        F.coalesce("y0", "y1").alias("__base"),
    )
    totals = pairs.groupBy("__src").agg(
        F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("v")), F.sum("n")), F.lit(0.0)).alias("__mu"),
        F.sum("__base").alias("__zero"),
        F.min("feat_idx").alias("feat_idx"),
    )
    merged = pairs.drop("feat_idx").join(totals, "__src").select(
        F.col("__src").alias("feat_name"), "feat_idx", F.lit(None).cast("double").alias("x_num"),
        F.col("__level").alias("x_cat"), (F.col("v") - F.col("__mu")).alias("y"), "y_std", "n",
    )
    lift = totals.agg(F.sum(F.col("__mu") + F.col("__zero")).alias("y"))
    offset = (
        rest.where(is_offset()).select("y", "y_std").unionByName(lift.withColumn("y_std", F.lit(None).cast("double")))
        .agg(F.sum("y").alias("y"), F.max("y_std").alias("y_std"))
        .withColumns({"feat_name": F.lit(OFFSET), "feat_idx": F.lit(-1), "x_num": F.lit(None).cast("double"),
                      "x_cat": F.lit(None).cast("string"), "n": F.lit(None).cast("bigint")})
    )
    others = rest.where(~is_offset())
    return offset.select(COLUMNS).unionByName(others.select(COLUMNS)).unionByName(merged.select(COLUMNS))


def add_unseen_levels(effects: DataFrame, lookup: DataFrame) -> DataFrame:
    """Asked-for values (feat_name, x_num, x_cat) that the model does not know get effect 0."""
    key = x_key(F.col("x_num"), F.col("x_cat"))
    offset = effects.where(is_offset())
    known = effects.where(F.col("feat_idx") >= 0).withColumn("__k", key)
    index = known.groupBy("feat_name").agg(F.min("feat_idx").alias("__idx"))
    asked = lookup.select("feat_name", F.col("x_num").alias("__xn"), F.col("x_cat").alias("__xc"), key.alias("__k")).distinct()
    full = known.join(asked, ["feat_name", "__k"], "full_outer").join(index, "feat_name", "left")
    return offset.select(COLUMNS).unionByName(
        full.select(
            "feat_name",
            F.coalesce("feat_idx", "__idx").alias("feat_idx"),
            F.coalesce("x_num", "__xn").alias("x_num"),
            F.coalesce("x_cat", "__xc").alias("x_cat"),
            F.coalesce("y", F.lit(0.0)).alias("y"),
            F.coalesce("y_std", F.lit(0.0)).alias("y_std"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def renumber_features(effects: DataFrame) -> DataFrame:
    """feat_idx -1 for the offset, then 0..k in the old order (new features last, by name).

    The window runs over the feature table, which has one row per model column."""
    feats = effects.groupBy("feat_name").agg(F.min("feat_idx").alias("__old"))
    first = F.when(F.col("__old") == -1, 0).otherwise(1)
    order = Window.partitionBy(F.lit(0)).orderBy(first, F.col("__old").asc_nulls_last(), "feat_name")
    has_offset = F.max(F.when(F.col("__old") == -1, 1).otherwise(0)).over(Window.partitionBy(F.lit(0)))
    feats = feats.select("feat_name", (F.row_number().over(order) - 1 - has_offset).cast("int").alias("feat_idx"))
    return effects.drop("feat_idx").join(feats, "feat_name").select(effects.columns)


def onehot_bar_value(table: DataFrame) -> DataFrame:
    """(column, label, not_given, given) to the value of choosing one label: its own given effect plus
    the not-given effects of all other labels."""
    total = table.groupBy("column").agg(F.sum("not_given").alias("__all"))
    return table.join(total, "column").select(
        "column", "label", (F.col("given") + F.col("__all") - F.col("not_given")).alias("value")
    )


def linear_effects(coefs: DataFrame, grid: int = 1000, intercept: float | None = None) -> DataFrame:
    """(feat_name, x, y) over an even grid between each feature's min and max.

    ``coefs`` has feat_name, coef, lo, hi.
    """
    step = F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    points = coefs.select("*", step.alias("pos")).withColumn(
        "x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("pos") / (grid - 1)
    )
    return points.select("feat_name", "pos", "x", (F.col("coef") * F.col("x") + (intercept or 0.0)).alias("y"))


def avg_effect_percent(effects: DataFrame) -> DataFrame:
    """(feat_name, avg_effect, percent): unweighted mean |y| over the values, also as a share of the sum."""
    per = effects.where(F.col("feat_idx") >= 0).groupBy("feat_name").agg(F.avg(F.abs("y")).alias("avg_effect"))
    whole = Window.partitionBy(F.lit(0))  # one row per feature
    return per.withColumn("percent", 100 * F.col("avg_effect") / F.sum("avg_effect").over(whole))


def top_features(imp: DataFrame, n: int) -> DataFrame:
    """The n most important features with importance above zero."""
    return imp.where(F.col("importance") > 0).orderBy(F.col("importance").desc(), "feat_name").limit(n)


def interaction_grid(pairs: DataFrame, scorer: Callable[[Column, Column], Column], points: int = 50) -> DataFrame:
    """(feat_a, feat_b, xa, xb, y) over points x points. ``pairs`` has feat_a, feat_b, lo/hi of both;
    columns it also carries may be used by ``scorer(xa, xb)``."""
    even = F.sequence(F.lit(0), F.lit(points - 1))
    grid = pairs.select("*", F.explode(even).alias("ia")).select("*", F.explode(even).alias("ib"))
    xa = F.col("lo_a") + (F.col("hi_a") - F.col("lo_a")) * F.col("ia") / (points - 1)
    xb = F.col("lo_b") + (F.col("hi_b") - F.col("lo_b")) * F.col("ib") / (points - 1)
    grid = grid.withColumn("xa", xa).withColumn("xb", xb)
    return grid.withColumn("y", scorer(F.col("xa"), F.col("xb"))).select("feat_a", "feat_b", "xa", "xb", "y")


def interaction_kind(pairs: DataFrame, levels: DataFrame) -> DataFrame:
    """cat_cat / cat_cont / cont_cont by the number of values of both features (2 or fewer: categorical)."""
    a = levels.select(F.col("feat_name").alias("feat_a"), F.col("levels").alias("levels_a"))
    b = levels.select(F.col("feat_name").alias("feat_b"), F.col("levels").alias("levels_b"))
    cats = (F.col("levels_a") <= 2).cast("int") + (F.col("levels_b") <= 2).cast("int")
    kind = F.when(cats == 2, "cat_cat").when(cats == 1, "cat_cont").otherwise("cont_cont")
    return pairs.join(a, "feat_a").join(b, "feat_b").withColumn("kind", kind)


def confidence_band(curves: DataFrame) -> DataFrame:
    """(feat_name, pos, x, y, y_std) from curves (seed, feat_name, x_num, y).

    Curves are aligned by position and cut at the shortest. Positions come from bucketed prefix
    counts, so that a curve with very many points does not have to sort in one task.
    """
    placed = _positions(curves)
    shortest = placed.groupBy("feat_name", "seed").agg(F.count(F.lit(1)).alias("__len")).groupBy("feat_name").agg(
        F.min("__len").alias("__min")
    )
    return (
        placed.join(shortest, "feat_name")
        .where(F.col("pos") <= F.col("__min"))
        .groupBy("feat_name", "pos")
        .agg(F.avg("x_num").alias("x"), F.avg("y").alias("y"), F.stddev_pop("y").alias("y_std"))
    )


def _positions(curves: DataFrame) -> DataFrame:
    points = value_prefix(
        curves, "x_num", {"__one": F.count(F.lit(1)), "__sum": F.sum("y")}, by=["seed", "feat_name"]
    )
    return points.select(
        "seed", "feat_name", "x_num", (F.col("__sum") / F.col("__one")).alias("y"), (F.col("__one_below") + 1).alias("pos")
    )


def step_extend(effects: DataFrame) -> DataFrame:
    """Repeats the last value of each numeric feature one step further: edges = values + 1."""
    rows = effects.where((F.col("feat_idx") >= 0) & F.col("x_num").isNotNull()).select("feat_name", "x_num", "y")
    last = rows.groupBy("feat_name").agg(F.max(F.struct("x_num", "y")).alias("m")).select(
        "feat_name", "m.x_num", "m.y", F.lit(1).alias("extended")
    )
    return rows.withColumn("extended", F.lit(0)).unionByName(last)


def category_labels(mapping: DataFrame, binary_names: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(encoded, value, label): tick labels of level columns; named binary features use their own names."""
    values = mapping.where(F.col("kind") == "categorical").select(
        "encoded", "source", "level", F.explode(F.array(F.lit(0), F.lit(1))).alias("value")
    )
    label = F.concat(
        F.regexp_replace("source", "_", " "), F.lit(" "), F.col("level"),
        F.when(F.col("value") == 1, " given").otherwise(" not given"),
    )
    for source, (no, yes) in (binary_names or {}).items():
        label = F.when(F.col("source") == source, F.when(F.col("value") == 1, yes).otherwise(no)).otherwise(label)
    return values.select("encoded", "value", label.alias("label"))


def coefficient_table(spark: SparkSession, names: Sequence[str], coefs: Sequence[float]) -> DataFrame:
    """(feat_name, coef), ordered by value."""
    rows = [(n, float(b)) for n, b in zip(names, coefs)]
    return spark.createDataFrame(rows, "feat_name string, coef double").orderBy("coef")


def nested_effects(effects: DataFrame) -> DataFrame:
    """One row per feature with an array of points. For display: only small tables are nested."""
    if effects.limit(NESTED_ROWS + 1).count() > NESTED_ROWS:
        raise ValueError("the effect table is too large to be shown as arrays; use the long form")
    return effects.groupBy("feat_name", "feat_idx").agg(
        F.array_sort(F.collect_list(F.struct("x_num", "x_cat", "y", "y_std", "n"))).alias("points")
    )
