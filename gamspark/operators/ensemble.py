"""Fusion of ensemble members: long rows per member, or one array per row without any shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import c, sigmoid, smoothed_log_odds


def bagged_probability(long: DataFrame, key: Sequence[str], p: str) -> DataFrame:
    """(key..., probability): sigmoid of the mean log-odds over members."""
    mean = long.groupBy(*[c(k) for k in key]).agg(F.avg(smoothed_log_odds(c(p))).alias("__x"))
    return mean.select(*[c(k) for k in key], sigmoid(F.col("__x")).alias("probability"))


def bagged_probability_of(members: Sequence[Column]) -> Column:
    """The same for members that stand next to each other in one row."""
    total = F.lit(0.0)
    for m in members:
        total = total + smoothed_log_odds(m)
    return sigmoid(total / len(members))


def fuse_members(long: DataFrame, key: Sequence[str], p: str, weight: str | None = None) -> DataFrame:
    """(key..., avgagg, majvote, weighted_avgagg, weighted_majvote) over members."""
    w = c(weight) if weight else F.lit(1.0)
    vote = (c(p) >= 0.5).cast("double")
    return long.groupBy(*[c(k) for k in key]).agg(
        F.avg(c(p)).alias("avgagg"),
        F.avg(vote).alias("majvote"),
        (F.sum(w * c(p)) / F.sum(w)).alias("weighted_avgagg"),
        (F.sum(w * vote) / F.sum(w)).alias("weighted_majvote"),
    )


def fuse_columns(members: Sequence[Column], weights: Sequence[float] | None = None) -> dict[str, Column]:
    """The four rules for members in columns of one row."""
    weights = list(weights or [1.0] * len(members))

    def mean(values, ws):
        total = F.lit(0.0)
        for v, w in zip(values, ws):
            total = total + v * F.lit(float(w))
        return total / float(sum(ws))

    votes = [(m >= 0.5).cast("double") for m in members]
    ones = [1.0] * len(members)
    return {
        "avgagg": mean(members, ones),
        "majvote": mean(votes, ones),
        "weighted_avgagg": mean(members, weights),
        "weighted_majvote": mean(votes, weights),
    }
