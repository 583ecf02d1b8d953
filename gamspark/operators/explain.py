"""Row-level explanations: the contributions of one prediction and filters over them.

Contributions travel as one array column per row, so that filtering explanations is a narrow
operation: no row is multiplied and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import c
from .effects import contributions, offset_value

INTERCEPT = "Intercept"


def local_contributions(df: DataFrame, effects: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
                        name: str = "explanation") -> DataFrame:
    """Adds array<struct<feat_name, label, contribution>>; the label is 'feature (value)'."""
    wide = contributions(df, effects, numeric, categorical)
    items = [
        F.struct(
            F.lit(n).alias("feat_name"),
            F.concat(F.lit(f"{n} ("), c(n).cast("string"), F.lit(")")).alias("label"),
            c(f"contrib_{n}").alias("contribution"),
        )
        for n in (*numeric, *categorical)
    ]
    base = F.struct(
        F.lit(INTERCEPT).alias("feat_name"), F.lit(INTERCEPT).alias("label"),
        F.lit(offset_value(effects)).alias("contribution"),
    )
    return wide.withColumn(name, F.array(base, *items)).drop(*[f"contrib_{n}" for n in (*numeric, *categorical)])


def contribution_rows(df: DataFrame, key: Sequence[str], name: str = "explanation") -> DataFrame:
    """Long form (key..., feat_name, label, contribution)."""
    return df.select(*[c(k) for k in key], F.inline(c(name)))


@dataclass(frozen=True)
class LocalFilter:
    """Keeps a row when one contribution is large enough, matches the word, or both at once."""

    number: float | None = None
    word: str | None = None
    exact: bool = False

    def _matches(self, label: Column) -> Column:
        if self.exact:  # the whole feature name, followed by its value in brackets
            return label.rlike(re.escape(self.word) + r"\s\([^)]*\)")
        return label.contains(self.word)

    def expr(self, explanation: Column) -> Column:
        if self.number is not None and self.word is not None:
            return F.exists(
                explanation, lambda e: (F.abs(e["contribution"]) >= self.number) & self._matches(e["label"])
            )
        if self.number is not None:
            return F.exists(
                explanation, lambda e: (F.abs(e["contribution"]) >= self.number) & (e["feat_name"] != INTERCEPT)
            )
        return F.exists(explanation, lambda e: self._matches(e["label"]))


def filter_local(df: DataFrame, filters: Sequence[LocalFilter], name: str = "explanation") -> DataFrame:
    """Rows that satisfy every filter."""
    for item in filters:
        df = df.where(F.coalesce(item.expr(c(name)), F.lit(False)))
    return df
