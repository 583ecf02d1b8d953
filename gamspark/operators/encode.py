"""Encoders and scalers: fitted on one frame, applied to any other as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import exact_quantiles
from ..functions.scalars import c
from .clean import feature_values, replace_columns

MAPPING_SCHEMA = "encoded string, source string, level string, kind string"
MAX_ENCODED_LEVELS = 10_000


def sorted_levels(df: DataFrame, cols: Sequence[str], limit: int = MAX_ENCODED_LEVELS) -> dict[str, list[str]]:
    """Sorted distinct levels per column. Level tables are column metadata: a column of more than ``limit`` levels is refused."""
    if not cols:
        return {}
    levels = feature_values(df, cols).where(F.col("x").isNotNull()).select("feat_name", "x").distinct()
    counts = {r[0]: r[1] for r in levels.groupBy("feat_name").agg(F.count(F.lit(1))).collect()}
    wide = [n for n in cols if counts.get(n, 0) > limit]
    if wide:
        raise ValueError(f"more than {limit} levels in {wide}; drop high-cardinality columns first")
    rows = levels.collect()
    return {n: sorted(r["x"] for r in rows if r["feat_name"] == n) for n in cols}


@dataclass
class OneHot:
    """Level columns. ``drop``: 'if_binary' keeps only the second of two levels, 'first' drops the
    first level of every column, None keeps all. An unseen level gives all zeros."""

    levels: dict[str, list[str]]
    drop: str | None = "if_binary"
    prefix: str = "cat__"

    def kept(self, col: str) -> list[str]:
        levels = self.levels[col]
        if self.drop == "first" or (self.drop == "if_binary" and len(levels) == 2):
            return levels[1:]
        return levels

    def name(self, col: str, level: str) -> str:
        return f"{self.prefix}{col}_{level}"

    @property
    def names(self) -> list[str]:
        return [self.name(col, lv) for col in self.levels for lv in self.kept(col)]

    def mapping_rows(self) -> list[tuple]:
        return [(self.name(col, lv), col, lv, "categorical") for col in self.levels for lv in self.kept(col)]

    def transform(self, df: DataFrame) -> DataFrame:
        exprs = {
            self.name(col, lv): F.coalesce((c(col).cast("string") == lv).cast("int"), F.lit(0))
            for col in self.levels
            for lv in self.kept(col)
        }
        return replace_columns(df, exprs)


def one_hot(df: DataFrame, cols: Sequence[str], drop: str | None = "if_binary", prefix: str = "cat__") -> OneHot:
    return OneHot(sorted_levels(df, cols), drop, prefix)


def one_hot_dummies(df: DataFrame, cols: Sequence[str], drop: str | None = None) -> OneHot:
    """One column per level named <column>_<level>; columns absent from new data become 0."""
    return one_hot(df, cols, drop=drop, prefix="")


@dataclass
class LabelEncoder:
    """Sorted position of the level; unseen or missing levels take code 0."""

    levels: dict[str, list[str]]

    def transform(self, df: DataFrame) -> DataFrame:
        exprs = {}
        for col, levels in self.levels.items():
            codes = F.create_map(*[x for i, lv in enumerate(levels) for x in (F.lit(lv), F.lit(i))])
            exprs[col] = F.coalesce(F.try_element_at(codes, c(col).cast("string")), F.lit(0)) if levels else F.lit(0)
        return replace_columns(df, exprs)


def label_encode(df: DataFrame, cols: Sequence[str]) -> LabelEncoder:
    return LabelEncoder(sorted_levels(df, cols))


@dataclass
class Scaler:
    """value -> (value - shift) / scale per column."""

    params: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame, out: dict[str, str] | None = None) -> DataFrame:
        out = out or {}
        return replace_columns(df, {out.get(n, n): (c(n) - F.lit(a)) / F.lit(b) for n, (a, b) in self.params.items()})

    def inverse(self, df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
        names = cols if cols is not None else list(self.params)
        return replace_columns(df, {n: c(n) * F.lit(self.params[n][1]) + F.lit(self.params[n][0]) for n in names})

    def effect_scale(self, effects: DataFrame, target: str) -> DataFrame:
        """Effects of a model fitted on the scaled target, in target units: every effect is stretched,
        only the offset takes the mean."""
        mean, scale = self.params[target]
        y = c("y") * F.lit(scale) + F.when(F.col("feat_idx") == -1, F.lit(mean)).otherwise(F.lit(0.0))
        return effects.withColumn("y", y)


def _pairs(df: DataFrame, cols: Sequence[str], first, second) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(c(n)).cast("double") for n in cols for f in (first, second)]).first()
    return {n: (row[2 * i], row[2 * i + 1]) for i, n in enumerate(cols)}


def standard_scale(df: DataFrame, cols: Sequence[str]) -> Scaler:
    """Mean and population standard deviation; a constant column is only shifted."""
    return Scaler({n: (m, s or 1.0) for n, (m, s) in _pairs(df, cols, F.avg, F.stddev_pop).items()})


def minmax_scale(df: DataFrame, cols: Sequence[str]) -> Scaler:
    return Scaler({n: (lo, (hi - lo) or 1.0) for n, (lo, hi) in _pairs(df, cols, F.min, F.max).items()})


def robust_scale(df: DataFrame, cols: Sequence[str]) -> Scaler:
    """Exact median and interquartile range."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    return Scaler({n: (q[n][1], (q[n][2] - q[n][0]) or 1.0) for n in cols})


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Row weight n / (classes * class size); NULL is a class."""
    sizes = df.groupBy(c(label).alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    whole = sizes.agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    weights = sizes.select("__label", (F.lit(float(whole["n"] or 0)) / (F.lit(float(whole["k"])) * F.col("__n"))).alias(name))
    return df.join(weights, c(label).eqNullSafe(F.col("__label")), "left").drop("__label")


@dataclass
class ColumnTransformer:
    """One-hot plus scaling with named outputs (cat__<col>_<level>, num__<col>) and a mapping table."""

    hot: OneHot
    scaler: Scaler

    @property
    def names(self) -> list[str]:
        return [*self.hot.names, *[f"num__{n}" for n in self.scaler.params]]

    def transform(self, df: DataFrame, vector: str | None = None) -> DataFrame:
        out = self.hot.transform(df)
        out = self.scaler.transform(out, {n: f"num__{n}" for n in self.scaler.params})
        if vector is None:
            return out
        # VectorAssembler reads dots in names as nesting, so it works on positional names
        tmp = {f"__x{i}": c(n).cast("double") for i, n in enumerate(self.names)}
        out = out.withColumns(tmp)
        return VectorAssembler(inputCols=list(tmp), outputCol=vector).transform(out).drop(*tmp)

    def mapping(self, spark: SparkSession) -> DataFrame:
        rows = [*self.hot.mapping_rows(), *[(f"num__{n}", n, None, "numeric") for n in self.scaler.params]]
        return spark.createDataFrame(rows, MAPPING_SCHEMA)


def column_transformer(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                       drop: str | None = "if_binary") -> ColumnTransformer:
    return ColumnTransformer(one_hot(train, categorical, drop), standard_scale(train, numeric) if numeric else Scaler({}))


def feature_type_lists(mapping: DataFrame) -> DataFrame:
    """(kind, source, encoded columns): sources by kind through the mapping table, never by name prefix."""
    return mapping.groupBy("kind", "source").agg(F.count(F.lit(1)).alias("n_encoded"))
