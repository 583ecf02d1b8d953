"""Agreement between raters with missing ratings allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import lookup_join
from ..functions.order import value_prefix


def krippendorff_alpha(ratings: DataFrame, level: str = "ordinal") -> DataFrame:
    """(alpha, n, units) from (unit, value), one row per rating; NULL values are missing.

    The ordinal distance of two values is the squared difference of their mid-ranks among all
    pairable ratings. A sum of squared differences over all pairs of a group equals
    2 (m * sum r^2 - (sum r)^2), so neither the pairs of a unit nor those of the whole are formed:
    a unit with very many ratings is three partial sums.
    """
    rated = ratings.where(F.col("value").isNotNull()).groupBy("unit", "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = rated.groupBy("unit").agg(F.sum("n").alias("m")).where(F.col("m") >= 2)
    pairable = rated.join(sizes, "unit")
    if level == "ordinal":
        ranks = value_prefix(pairable, "value", {"total": F.sum("n")})
        ranks = ranks.select("value", (F.col("total_below") + F.col("total") / 2.0).alias("r"))
    elif level == "interval":
        ranks = pairable.select("value", F.col("value").cast("double").alias("r")).distinct()
    else:
        raise ValueError(f"level must be ordinal or interval, not {level!r}")
    placed = lookup_join(pairable, ranks, ["value"])
    units = placed.groupBy("unit", "m").agg(
        F.sum(F.col("n") * F.col("r") * F.col("r")).alias("s2"), F.sum(F.col("n") * F.col("r")).alias("s1")
    )
    total = units.agg(
        F.sum(2 * (F.col("m") * F.col("s2") - F.col("s1") * F.col("s1")) / (F.col("m") - 1)).alias("observed"),
        F.sum("m").alias("n"),
        F.sum("s2").alias("s2"),
        F.sum("s1").alias("s1"),
        F.count(F.lit(1)).alias("units"),
    )
    expected = 2 * (F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")) / (F.col("n") - 1)
    return total.select((1 - F.try_divide(F.col("observed"), expected)).alias("alpha"), "n", "units")
