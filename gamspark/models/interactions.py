"""Interaction search: binned residual gains, trees, and the Lasso on blocks of pair features."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import c
from ..operators.split import sample_rows
from .design import Constant, Design, Hidden, HiddenPair
from .gram import gram
from .linear import centred, coordinate_descent
from .trees import fit_tree, used_features


def binned(df: DataFrame, cuts: dict[str, Sequence[float]], prefix: str = "__bin_") -> DataFrame:
    """Adds the bin number of every column (JVM binary search)."""
    out = df
    for name, edges in cuts.items():
        if not len(edges):
            out = out.withColumn(f"{prefix}{name}", F.lit(0.0))
            continue
        tmp = out.withColumn("__v", c(name).cast("double"))
        out = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="__v", outputCol=f"{prefix}{name}",
                         handleInvalid="keep").transform(tmp).drop("__v")
    return out


def pair_strength(df: DataFrame, residual: str, cuts: dict[str, Sequence[float]]) -> DataFrame:
    """(feat_a, feat_b, strength): squared residual that cell means of the pair explain beyond both
    features alone. Rows collapse into cells before the shuffle; the shuffle holds pairs x bins^2 rows."""
    names = list(cuts)
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("feat_a"), F.lit(b).alias("feat_b"), c(f"__bin_{a}").alias("ba"), c(f"__bin_{b}").alias("bb"))
            for a, b in combinations(names, 2)
        ]
    )
    sums = (
        binned(df, cuts)
        .select(c(residual).cast("double").alias("__r"), F.inline(cells))
        .groupBy("feat_a", "feat_b", "ba", "bb")
        .agg(F.sum("__r").alias("s"), F.count("__r").alias("n"))
    )
    gain = F.sum(F.try_divide(F.col("s") * F.col("s"), F.col("n")))

    def side(cols):
        part = sums.groupBy("feat_a", "feat_b", *cols).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        return part.groupBy("feat_a", "feat_b").agg(gain.alias("g"))

    both = sums.groupBy("feat_a", "feat_b").agg(
        gain.alias("cell"), (F.sum("s") * F.sum("s") / F.sum("n")).alias("all")
    )
    first = side(["ba"]).withColumnRenamed("g", "ga")
    second = side(["bb"]).withColumnRenamed("g", "gb")
    joined = both.join(first, ["feat_a", "feat_b"]).join(second, ["feat_a", "feat_b"])
    return joined.select("feat_a", "feat_b", (F.col("cell") - F.col("ga") - F.col("gb") + F.col("all")).alias("strength"))


def pairs_by_tree(df: DataFrame, target: str, features: Sequence[str], count: int, task: str = "regression",
                  depths: Sequence[int] = range(2, 10), leaf_sizes: Sequence[int] = (10, 5, 3, 1)) -> list[tuple[str, str]]:
    """Pairs of features a single tree uses; trees grow until one uses enough of them."""
    best: list[tuple[str, str]] = []
    for leaf in leaf_sizes:
        for depth in depths:
            tree = fit_tree(df, target, features, task=task, max_depth=depth, min_rows=leaf)
            found = list(combinations(used_features(tree), 2))
            if len(found) >= len(best):
                best = found
            if len(found) >= count:
                return found[:count]
    return best[:count]


def bisect_alpha(blocks_at: Callable[[float, np.ndarray | None], tuple[list, np.ndarray]], wanted: int,
                 low: float = 1e-10, high: float = 1000.0, steps: int = 1000):
    """Bisects the penalty until exactly ``wanted`` blocks survive; returns (blocks, alpha, found)."""
    alpha, blocks = (low + high) / 2, []
    for _ in range(steps):
        blocks, _ = blocks_at(alpha, None)
        if len(blocks) == wanted:
            return blocks, alpha, True
        if len(blocks) < wanted:
            high = alpha
        else:
            low = alpha
        if high - low < 1e-12 * max(1.0, high):
            break
        alpha = (low + high) / 2
    return blocks, alpha, False


def _surviving(design: Design, stats, first: int):
    g, b, _, _ = centred(stats)
    n = stats.g[0, 0]

    def at(alpha, start):
        w = coordinate_descent(g, b, n, alpha, 1.0, max_iter=300, tol=1e-7, start=start)
        full = np.r_[0.0, w]
        blocks = [
            i for i, sl in enumerate(design.slices) if i >= first and np.any(full[sl] != 0)
        ]
        return blocks, w

    return at


def hidden_weights(rng: np.random.Generator, scale: float, n_hid: int) -> tuple[float, ...]:
    return tuple(rng.normal(0.0, scale, n_hid).tolist())


def select_features(df: DataFrame, target: str, features: Sequence[str], wanted: int, n_hid: int = 10, scale: float = 1.0,
                    act: str = "elu", seed: int = 0) -> list[str]:
    """Features whose block of random features survives the Lasso; one Gram serves all penalties."""
    rng = np.random.default_rng(seed)
    design = Design((Constant(), *[Hidden(n, hidden_weights(rng, scale, n_hid), act) for n in features]))
    stats = gram(df, design, target)[0]
    blocks, _, _ = bisect_alpha(_surviving(design, stats, 1), wanted)
    return [features[i - 1] for i in blocks]


def pairs_by_lasso(df: DataFrame, target: str, features: Sequence[str], count: int, key: Sequence[str], n_hid: int = 5,
                   scale: float = 1.0, scale_inter: float = 0.5, act: str = "elu", rows: int | None = None,
                   seed: int = 0) -> list[tuple[str, str]]:
    """Pairs whose block survives a Lasso next to all single blocks; one pass over all rows.

    ``target`` may be a residual; ``rows`` asks for a hash sample by ``key`` instead.
    """
    rng = np.random.default_rng(seed)
    singles = [Hidden(n, hidden_weights(rng, scale, n_hid), act) for n in features]
    doubles = [
        HiddenPair(a, b, hidden_weights(rng, scale_inter, n_hid), hidden_weights(rng, scale_inter, n_hid), act)
        for a, b in combinations(features, 2)
    ]
    design = Design((Constant(), *singles, *doubles))
    stats = gram(df if rows is None else sample_rows(df, key, rows, seed), design, target)[0]
    first = 1 + len(singles)
    blocks, _, _ = bisect_alpha(_surviving(design, stats, first), count)
    return [design.blocks[i].columns for i in blocks]
