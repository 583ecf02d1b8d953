"""Cleaning, profiling and value transforms."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.order import exact_quantiles
from ..functions.scalars import c

UNKNOWN = "unknown"
MAX_LEVELS = 25
MAX_MISSING = 0.5
# Characters that are replaced in cells and in names.
CELL_CHARS = " -?+~"
NAME_RULES = {
    "plain": [(r"[ \-?+~]", "_")],
    "formula": [
        (r"-", "_"), (r" ", "_"), (r"\$", ""), (r"/", "_"), (r">", "_big_"), (r"\(", "_lq_"), (r"\)", "_rq_"),
        (r"\?", "_ques_"), (r"\.", "_dot_"), (r"&", "_and_"), (r"^_", "s_"),
    ],
    "trees": [(r"<", "under")],
    "display": [(r"_", " ")],
}


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def infer_roles(df: DataFrame, exclude: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) by column type: text is categorical, everything else numeric."""
    skip, text = set(exclude), set(string_columns(df))
    names = [n for n in df.columns if n not in skip]
    return [n for n in names if n not in text], [n for n in names if n in text]


def feature_set_difference(columns: Sequence[str], excluded: Iterable[str]) -> list[str]:
    gone = set(excluded)
    return [n for n in columns if n not in gone]


def replace_columns(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    return df.withColumns(exprs) if exprs else df


def null_tokens(df: DataFrame, tokens: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """Tokens such as '?' become NULL in text columns."""
    names = string_columns(df) if cols is None else cols
    return replace_columns(df, {n: F.when(~c(n).isin(*tokens), c(n)) for n in names})


def blank_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """'' and a single blank become NULL; other text is left for ``coerce_numeric``."""
    text = set(string_columns(df))
    return null_tokens(df, ("", " "), [n for n in cols if n in text])


def to_number(x: Column) -> Column:
    """Text to double; anything that is not a number becomes NULL (also NaN and Java suffixes)."""
    text = x.cast("string")
    value = F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    text = set(string_columns(df))
    return replace_columns(
        df,
        {
            n: to_number(c(n)) if n in text else F.when(~F.isnan(c(n).cast("double")), c(n).cast("double"))
            for n in cols
        },
    )


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, missing_share), one pass for all columns."""
    names = list(cols or df.columns)
    wide = df.agg(*[F.avg(c(n).isNull().cast("double")).alias(f"m{i}") for i, n in enumerate(names)])
    pairs = [F.struct(F.lit(n).alias("column"), F.col(f"m{i}").alias("missing_share")) for i, n in enumerate(names)]
    return wide.select(F.inline(F.array(*pairs)))


def sparse_columns(df: DataFrame, cols: Sequence[str], threshold: float = MAX_MISSING) -> list[str]:
    return [r["column"] for r in missing_profile(df, cols).collect() if (r["missing_share"] or 0.0) > threshold]


def drop_sparse_cols(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = MAX_MISSING) -> DataFrame:
    """Drops columns with a missing share strictly above the threshold."""
    gone = set(sparse_columns(df, list(cols or df.columns), threshold))
    return df.select(*[c(n) for n in df.columns if n not in gone])


def feature_values(df: DataFrame, cols: Sequence[str], extra: Sequence[str] = (), cast: str = "string") -> DataFrame:
    """Long form (extra..., feat_name, x): one row per row and feature, without a shuffle."""
    cells = F.array(*[F.struct(F.lit(n).alias("feat_name"), c(n).cast(cast).alias("x")) for n in cols])
    return df.select(*[c(n) for n in extra], F.inline(cells))


def level_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, levels): distinct non-NULL values. Values collapse per map task before the shuffle."""
    return (
        feature_values(df, cols)
        .groupBy("feat_name", "x")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(F.col("feat_name").alias("column"))
        .agg(F.count("x").alias("levels"))
    )


def high_card_columns(df: DataFrame, cols: Sequence[str], max_levels: int = MAX_LEVELS) -> list[str]:
    """Columns with more than ``max_levels`` levels. A sketch settles the clear cases first, so that
    only columns near the limit pay for an exact distinct count."""
    if not cols:
        return []
    guess = df.agg(*[F.approx_count_distinct(c(n), 0.02).alias(f"a{i}") for i, n in enumerate(cols)]).first()
    clear = [n for i, n in enumerate(cols) if guess[f"a{i}"] > 4 * max_levels + 100]
    near = [n for n in cols if n not in clear]
    exact = {r["column"]: r["levels"] for r in level_profile(df, near).collect()} if near else {}
    return [n for n in cols if n in clear or exact.get(n, 0) > max_levels]


def drop_high_card(df: DataFrame, cols: Sequence[str], max_levels: int = MAX_LEVELS) -> DataFrame:
    gone = set(high_card_columns(df, cols, max_levels))
    return df.select(*[c(n) for n in df.columns if n not in gone])


def fill_categorical(df: DataFrame, cols: Sequence[str], level: str = UNKNOWN) -> DataFrame:
    return df.fillna(level, subset=list(cols)) if cols else df


def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    return {n: q[0] for n, q in exact_quantiles(df, cols, [0.5]).items()}


def impute_median(df: DataFrame, cols: Sequence[str], medians: dict[str, float | None] | None = None) -> DataFrame:
    """NULL numbers take the exact column median."""
    medians = fit_medians(df, cols) if medians is None else medians
    return replace_columns(df, {n: F.coalesce(c(n), F.lit(medians[n]).cast("double")) for n in cols})


def project_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[c(n) for n in (*numeric, *categorical, *keep)])


def map_target(df: DataFrame, target: str, codes: dict[str, int]) -> DataFrame:
    """Label text to its code; unknown text becomes NULL."""
    expr = F.lit(None).cast("int")
    for text, code in reversed(list(codes.items())):
        expr = F.when(c(target) == text, F.lit(code)).otherwise(expr)
    return df.withColumn(target, expr)


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.dropna(subset=[target])


def drop_all_equal(df: DataFrame, cols: Sequence[str], value: float) -> DataFrame:
    """Drops rows in which every feature equals ``value`` (a NULL feature keeps the row)."""
    same = reduce(lambda a, b: a & b, [F.coalesce(c(n).try_cast("double") == value, F.lit(False)) for n in cols])
    return df.where(~same)


def clean_values(df: DataFrame, cols: Sequence[str] | None = None, chars: str = CELL_CHARS) -> DataFrame:
    """Characters that break formula engines become '_' in text cells."""
    names = string_columns(df) if cols is None else cols
    return replace_columns(df, {n: F.translate(c(n), chars, "_" * len(chars)) for n in names})


def clean_names(names: Sequence[str], kind: str = "plain") -> list[str]:
    """Column names under one of the naming rules; two names that collide get a number."""
    import re

    out: list[str] = []
    for name in names:
        new = name
        for pattern, repl in NAME_RULES[kind]:
            new = re.sub(pattern, repl, new)
        base, k = new, 2
        while new in out:
            new, k = f"{base}_{k}", k + 1
        out.append(new)
    return out


def winsorize(df: DataFrame, cols: Sequence[str], lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    """Clamps both tails of each column at its exact quantiles."""
    edges = exact_quantiles(df, cols, [lower, upper])
    return replace_columns(
        df,
        {
            n: F.when(c(n).isNotNull(), F.least(F.greatest(c(n), F.lit(edges[n][0])), F.lit(edges[n][1])))
            for n in cols
            if edges[n][0] is not None
        },
    )


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feat_name, x, n) with x as text."""
    return feature_values(df, cols).where(F.col("x").isNotNull()).groupBy("feat_name", "x").agg(
        F.count(F.lit(1)).alias("n")
    )


def unique_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feat_name, x): the distinct values of each feature."""
    return feature_values(df, cols).where(F.col("x").isNotNull()).distinct()


def column_ranges(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(c(n)).cast("double") for n in cols for f in (F.min, F.max)]).first()
    return {n: (row[2 * i], row[2 * i + 1]) for i, n in enumerate(cols)}


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n): equal-width bins, the last one closed on the right, empty bins included.

    A column without values has bins without edges.
    """
    lo, hi = column_ranges(df, [col])[col]
    if lo is None:
        none = F.lit(None).cast("double")
        return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), none.alias("low"), none.alias("high"), F.lit(0).cast("bigint").alias("n"))
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    index = F.least(F.floor((c(col) - lo) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(c(col).isNotNull()).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("low"),
        (lo + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def rescale_range(df: DataFrame, col: str, to: tuple[float, float] = (0.0, 100.0), out: str | None = None,
                  source: tuple[float, float] | None = None) -> DataFrame:
    """Affine map of the column's range (or a given one) onto ``to``."""
    lo, hi = source or column_ranges(df, [col])[col]
    span = hi - lo
    expr = F.lit(to[0]) + (c(col) - lo) * ((to[1] - to[0]) / span) if span else F.lit(float(to[0]))
    return df.withColumn(out or col, expr)


def denormalise(x: Column, lo: float, hi: float) -> Column:
    """Back to units from a value stored as a share of a known range."""
    return x * (hi - lo) + lo


@dataclass
class Cleaner:
    """Statistics of the preparation, fitted once and applied to any split of the data."""

    numeric: list[str]
    categorical: list[str]
    dropped_sparse: list[str]
    dropped_levels: list[str]
    medians: dict[str, float | None] = field(default_factory=dict)

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        out = blank_to_null(df, self.numeric)
        out = project_features(out, self.numeric, self.categorical, keep)
        out = fill_categorical(out, self.categorical)
        out = coerce_numeric(out, self.numeric)
        return impute_median(out, self.numeric, self.medians) if self.numeric else out


def fit_cleaner(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    train: Column | None = None,
    max_missing: float = MAX_MISSING,
    max_levels: int = MAX_LEVELS,
) -> Cleaner:
    """Decides column drops and medians on the training rows (``train``) or, without it, on all rows.

    Missing shares are taken before numbers are coerced, so junk text does not count as missing.
    """
    base = blank_to_null(df if train is None else df.where(train), numeric)
    sparse = sparse_columns(base, [*numeric, *categorical], max_missing)
    wide = high_card_columns(base, list(categorical), max_levels)
    keep_num = [n for n in numeric if n not in sparse]
    keep_cat = [n for n in categorical if n not in sparse and n not in wide]
    medians = fit_medians(coerce_numeric(base, keep_num), keep_num)
    return Cleaner(keep_num, keep_cat, sparse, wide, medians)


def dataset_profile(raw: DataFrame, cleaned: DataFrame, name: str, task: str, raw_numeric: int, raw_categorical: int,
                    numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """One row of sample and column counts before, after and encoded, with signed differences as text."""
    levels = (
        level_profile(cleaned, categorical).agg(
            F.coalesce(F.sum(F.when(F.col("levels") == 2, 1).otherwise(F.col("levels"))), F.lit(0)).alias("encoded_cat")
        )
        if categorical
        else cleaned.sparkSession.range(1).select(F.lit(0).alias("encoded_cat"))
    ).first()["encoded_cat"]
    before = raw.agg(F.count(F.lit(1)).alias("samples"))
    after = cleaned.count()

    def signed(value, base):
        # a plus sign only for growth
        value, delta = F.lit(value), F.lit(value) - base
        return F.when(delta > 0, F.format_string("%d (+%d)", value, delta)).otherwise(
            F.format_string("%d (%d)", value, delta)
        )

    return before.select(
        F.lit(task).alias("task"),
        F.lit(name).alias("dataset"),
        F.col("samples"),
        F.lit(raw_numeric).alias("num"),
        F.lit(raw_categorical).alias("cat"),
        signed(after, F.col("samples")).alias("clean_samples"),
        signed(len(numeric), F.lit(raw_numeric)).alias("clean_num"),
        signed(len(categorical), F.lit(raw_categorical)).alias("clean_cat"),
        F.lit(len(numeric)).alias("encoded_num"),
        signed(int(levels), F.lit(len(categorical))).alias("encoded_cat"),
    )
