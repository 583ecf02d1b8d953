"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT32_EPS = 2.0**-23


def c(name: str) -> Column:
    """Column by literal name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def sigmoid(x: Column) -> Column:
    """Logistic function without overflow for large |x|."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(p: Column, eps: float = FLOAT32_EPS) -> Column:
    """Log-odds of a probability clipped to [eps, 1-eps]."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return F.log(q) - F.log(1 - q)


def smoothed_log_odds(p: Column, eps: float = FLOAT32_EPS) -> Column:
    """ln(p+eps) - ln(1-p+eps): finite at 0 and 1 without clipping."""
    return F.log(p + eps) - F.log(1 - p + eps)


def hash_order(seed, *keys: Column) -> Column:
    """md5(seed || '_' || key): an order that depends neither on partitioning nor on the engine."""
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("_", seed_col.cast("string"), *[k.cast("string") for k in keys]))


def hash_uniform(seed, *keys: Column) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of ``hash_order``."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("double") / 4294967296.0


def fast_uniform(seed, *keys: Column) -> Column:
    """Uniform number in [0, 1) from Spark's own 64-bit hash, for draws that no other engine repeats."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(str(seed)), *keys), 11) / float(1 << 53)


def poisson_cdf(rate: float, terms: int | None = None) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until what is left is below 2**-53 (or for as many terms as asked)."""
    p, total, out, k = math.exp(-rate), 0.0, [], 0
    while len(out) < terms if terms is not None else k <= rate or p > 2.0**-53:
        total += p
        out.append(total)
        k += 1
        p *= rate / k
    return out


def poisson_weight(u: Column, rate: float) -> Column:
    """Poisson(rate) draw by inversion of a uniform column: the number of the first step above it, so most rows compare twice."""
    edges = poisson_cdf(rate)
    weight = F.when(u < F.lit(edges[0]), 0)
    for k, edge in enumerate(edges[1:], 1):
        weight = weight.when(u < F.lit(edge), k)
    return weight.when(u >= F.lit(edges[-1]), len(edges))


def clean_double(x: Column) -> Column:
    """Double usable as a join key: -0.0 becomes 0.0, NaN becomes NULL."""
    x = x.cast("double")
    return F.when(~F.isnan(x), F.when(x == 0, F.lit(0.0)).otherwise(x))
