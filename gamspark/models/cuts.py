"""Cut points of binned columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import c


def quantile_cuts(df: DataFrame, cols: Sequence[str], max_bins: int, accuracy: int = 10_000) -> dict[str, tuple[float, ...]]:
    """At most max_bins - 1 cut points per column from a quantile sketch, in one pass for all columns.

    A cut lies between neighbouring sketched values, so that a discrete column gets one bin per value.
    """
    if not cols:
        return {}
    probs = [i / (2 * max_bins) for i in range(2 * max_bins + 1)]
    row = df.agg(*[F.percentile_approx(c(n).cast("double"), probs, accuracy).alias(f"q{i}") for i, n in enumerate(cols)]).first()
    out = {}
    for i, n in enumerate(cols):
        values = sorted(set(row[f"q{i}"] or []))
        cuts = [(a + b) / 2 for a, b in zip(values, values[1:])]
        if len(cuts) >= max_bins:
            at = np.linspace(0, len(cuts) - 1, max_bins - 1).round().astype(int)
            cuts = [cuts[j] for j in sorted(set(at))]
        out[n] = tuple(cuts)
    return out
