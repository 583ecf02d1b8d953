"""Deterministic splits and resampling by hash order.

The same row lands in the same fold whatever the partitioning, the engine or the run. Keys must be
unique per row; ``assert_unique`` checks that before a split is trusted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import by_group, exact_rank, hash_thresholds
from ..functions.scalars import c, hash_order, hash_uniform, poisson_cdf, poisson_weight
from ..functions.small import reused

ORDER = "__ord"


def assert_unique(df: DataFrame, key: Sequence[str]) -> None:
    twice = df.groupBy(*[c(k) for k in key]).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").limit(1).count()
    if twice:
        raise ValueError(f"{list(key)} does not identify rows; splits need a unique key")


def _ordered(df: DataFrame, key: Sequence[str], seed) -> DataFrame:
    return df.withColumn(ORDER, hash_order(seed, *[c(k) for k in key]))


def kfold(df: DataFrame, key: Sequence[str], n: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Fold 0..n-1 per row; sizes differ by at most one."""
    ranked = exact_rank(_ordered(df, key, seed), ORDER, name="__r")
    return ranked.withColumn(name, ((F.col("__r") - 1) % n).cast("int")).drop(ORDER, "__r")


def stratified_kfold(df: DataFrame, key: Sequence[str], label: str, n: int = 5, seed: int = 42,
                     name: str = "fold") -> DataFrame:
    """Folds whose sizes differ by at most one inside every class."""
    ranked = exact_rank(_ordered(df, key, seed), ORDER, [label], name="__r")
    return ranked.withColumn(name, ((F.col("__r") - 1) % n).cast("int")).drop(ORDER, "__r")


def train_val_split(df: DataFrame, key: Sequence[str], frac: float = 0.25, stratify: str | None = None,
                    seed: int = 1337, name: str = "part") -> DataFrame:
    """'val' for the first ceil(frac * n) rows in hash order (per class when stratified), else 'train'."""
    ranked = exact_rank(_ordered(df, key, seed), ORDER, [stratify] if stratify else [], name="__r", total="__t")
    part = F.when(F.col("__r") <= F.ceil(F.lit(frac) * F.col("__t")), "val").otherwise("train")
    return ranked.withColumn(name, part).drop(ORDER, "__r", "__t")


def shuffle(df: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Rows in hash order: a range-partitioned distributed sort."""
    return _ordered(df, key, seed).orderBy(ORDER).drop(ORDER)


def bootstrap(df: DataFrame, key: Sequence[str], bags: int, frac: float = 1.0, seed: int = 0) -> DataFrame:
    """(row, bag, weight) with Poisson(frac) weights: bagging without copying rows that get weight 0."""
    long = df.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    # the hash stands in its own projection, and weight 0 is filtered on the hash itself: a filter on
    # the weight would be pushed down with one copy of the hash per step of the inversion
    long = long.withColumn("__u", hash_uniform(seed, F.col("bag"), *[c(k) for k in key]))
    kept = long.where(F.col("__u") >= F.lit(poisson_cdf(frac, 1)[0]))
    return kept.withColumn("weight", poisson_weight(F.col("__u"), frac)).drop("__u")


def bag_weights(df: DataFrame, key: Sequence[str], bags: int, frac: float = 1.0, seed: int = 0,
                prefix: str = "bag_") -> DataFrame:
    """The same weights as one column per bag: fits read them without multiplying the rows. The key's text is joined once for all
    bags; where all of it is missing it stays missing, so that the hashed text is that of ``hash_order`` on the columns."""
    keys = [c(k).cast("string") for k in key]
    text = F.when(F.coalesce(*keys).isNotNull(), F.concat_ws("_", *keys)) if keys else F.lit(None).cast("string")
    drawn = df.withColumn("__text", text).withColumns({f"__u{b}": hash_uniform(seed, F.lit(b), F.col("__text")) for b in range(bags)})
    weighted = drawn.withColumns({f"{prefix}{b}": poisson_weight(F.col(f"__u{b}"), frac) for b in range(bags)})
    return weighted.drop("__text", *[f"__u{b}" for b in range(bags)])


def random_subspace(features: DataFrame, bags: int, k: int, seed: int = 0) -> DataFrame:
    """(bag, feat_name): k hash-ranked features per bag. ``features`` has one row per feature."""
    long = features.select("feat_name").withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    keyed = long.withColumn(ORDER, hash_order(seed, F.col("bag"), F.col("feat_name")))
    ranked = exact_rank(keyed, ORDER, ["bag"], name="__r", digits=1)
    return ranked.where(F.col("__r") <= k).select("bag", "feat_name")


def repeat_splits(df: DataFrame, key: Sequence[str], seeds: Sequence[int], frac: float = 0.33) -> DataFrame:
    """Rows x seeds with a 'part' column: each seed has its own holdout, its first ceil(frac * n) rows in hash order.

    The last hash of each holdout is found from the key columns alone; then every row is compared with it, so no row is moved.
    Rows with the same key stay together.
    """
    each = F.explode(F.array(*[F.lit(s) for s in seeds]))
    order = hash_order(F.col("seed"), *[c(k) for k in key])
    with reused(df.select(*[c(k) for k in key])) as keys:
        last = hash_thresholds(keys.withColumn("seed", each).select("seed", order.alias(ORDER)), "seed", ORDER, frac)
    part = F.when(order <= by_group("seed", last), "val").otherwise("train")
    return df.withColumn("seed", each).withColumn("part", part)


def sample_rows(df: DataFrame, key: Sequence[str], n: int = 10_000, seed: int = 0) -> DataFrame:
    """The first n rows in hash order: per-partition top n, then a merge."""
    return _ordered(df, key, seed).orderBy(ORDER).limit(n).drop(ORDER)
