"""Bagged additive models: one fit per bag, effects and log-odds averaged over bags."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import effects as fx
from ..operators.ensemble import bagged_probability_of, fuse_columns
from ..functions.scalars import c, logit, sigmoid
from ..operators.split import bag_weights, random_subspace
from ..session import cut_lineage
from .additive import AdditiveModel, Fitted
from .design import Design
from .gram import Member, gram, logistic_working, reused, run_together
from .linear import _additive, centred, linear_design, ridge_solve
from .spline import _fitted, spline_design, spline_steps


@dataclass
class BaggedModel(Fitted):
    members: list[AdditiveModel]
    task: str = "regression"
    threshold: float = 0.0

    def raw(self) -> Column:
        if self.task == "classification":
            return logit(bagged_probability_of([sigmoid(m.raw()) for m in self.members]))
        total = F.lit(0.0)
        for m in self.members:
            total = total + m.raw()
        return total / len(self.members)

    def member_effects(self, df: DataFrame) -> DataFrame:
        """Effect rows of every member with its model_id."""
        first = self.members[0]
        values = cut_lineage(fx.feature_value_counts(df, first.numeric, first.categorical))
        parts = [m.effects_at(values).withColumn("model_id", F.lit(i)) for i, m in enumerate(self.members)]
        return fx.center_effects(reduce(DataFrame.unionByName, parts), by=["model_id"])

    def effects(self, df: DataFrame) -> DataFrame:
        return fx.aggregate_effects(self.member_effects(df))


def fit_bagged_ridge(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (), bags: int = 10,
                     frac: float = 1.0, alpha: float = 1.0, key: Sequence[str] = (), seed: int = 0) -> BaggedModel:
    """Ridge members on Poisson bags: all bags come from one pass with one weight column each."""
    key = list(key) or [*numeric, *categorical]
    design = linear_design(df, numeric, categorical)
    stats = gram(bag_weights(df, key, bags, frac, seed), design, target, [f"bag_{b}" for b in range(bags)])
    members = []
    for b in range(bags):
        g, rhs, means, y_mean = centred(stats[b])
        slopes = ridge_solve(g, rhs, alpha)
        members.append(_additive(design, [y_mean - slopes @ means, *slopes], "regression", numeric, categorical))
    return BaggedModel(members)


def fit_bagged(df: DataFrame, key: Sequence[str], fit: Callable[[DataFrame], AdditiveModel], bags: int, seed: int = 0,
               frac: float = 1.0) -> BaggedModel:
    """Members from any fit that takes a frame: each gets its own Poisson sample, repeated by weight."""
    members = []
    drawn = bag_weights(df, key, bags, frac, seed)
    for b in range(bags):
        rows = drawn.where(F.col(f"bag_{b}") > 0).withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col(f"bag_{b}"))))
        members.append(fit(rows.select(*[c(n) for n in df.columns])))
    return BaggedModel(members, members[0].task)


FUSIONS = {"avgagg": "avgagg", "majvote": "majvote", "w.avgagg": "weighted_avgagg", "w.majvote": "weighted_majvote"}


@dataclass
class SubspaceEnsemble(Fitted):
    """Members on random feature subsets, fused by mean or vote, plain or weighted by training accuracy."""

    members: list[AdditiveModel]
    weights: list[float]
    fusion: str
    task: str = "classification"
    threshold: float = 0.0
    passes: int = 0

    def probability(self) -> Column:
        return fuse_columns([sigmoid(m.raw()) for m in self.members], self.weights)[FUSIONS[self.fusion]]

    def raw(self) -> Column:
        return logit(self.probability())

    def predict(self, df: DataFrame) -> DataFrame:
        """Scores of the members first, each once, then what is made of them."""
        names = [f"__member{i}" for i in range(len(self.members))]
        scored = df.withColumns({n: m.raw() for n, m in zip(names, self.members)}).withColumns({n: sigmoid(c(n)) for n in names})
        fused = fuse_columns([c(n) for n in names], self.weights)[FUSIONS[self.fusion]]
        out = scored.withColumn("__fused", fused).withColumn("raw", logit(F.col("__fused"))).withColumn("probability", sigmoid(F.col("raw")))
        return out.withColumn("prediction", F.when(F.col("raw") < self.threshold, 0.0).otherwise(1.0)).drop("__fused", *names)


def fit_subspace_ensemble(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (),
                          members: int = 10, subspace: int = 2, bagging: bool = True, subspaces: bool = True,
                          fusion: str = "avgagg", n_splines: int = 6, lam: float = 1.0, key: Sequence[str] = (),
                          seed: int = 0) -> SubspaceEnsemble:
    """Spline members for 0/1 labels on Poisson bags and hash-ranked feature subsets. All members are fitted in step: a pass over
    the rows gives each its cross-products."""
    if fusion not in FUSIONS:
        raise ValueError(f"fusion must be one of {sorted(FUSIONS)}")
    features = [*numeric, *categorical]
    rows = bag_weights(df, list(key) or features, members, 1.0, seed) if bagging else df
    chosen = {b: features for b in range(members)}
    if subspaces:
        table = df.sparkSession.createDataFrame([(n,) for n in features], "feat_name string")
        picked = random_subspace(table, members, subspace, seed).collect()
        chosen = {b: [n for n in features if (b, n) in {tuple(r) for r in picked}] for b in range(members)}
    whole = spline_design(df, numeric, categorical, n_splines)  # members share its terms, which a pass builds once
    jobs = []
    for b in range(members):
        design = Design(tuple(t for t in whole.blocks if not t.columns or t.columns[0] in chosen[b]))
        member = Member(design, weight=f"bag_{b}" if bagging else None, working=logistic_working)
        jobs.append((member, spline_steps(design, [lam], 2, 1.0, 8, 1e-5)))
    narrow = rows.select(*[c(n) for n in dict.fromkeys([*whole.columns, target, *[f"bag_{b}" for b in range(members) if bagging]])])
    with reused(narrow) as kept:
        found, passes = run_together(kept, target, jobs)
        fits = []
        for b, ((member, _), result) in enumerate(zip(jobs, found)):
            if isinstance(result, Exception):
                raise result
            mine = [n for n in numeric if n in chosen[b]], [n for n in categorical if n in chosen[b]]
            fits.append(_fitted(member.design, *result, "classification", *mine))
        hits = kept.agg(*[F.avg(((m.raw() >= 0) == (c(target) == 1)).cast("double")) for m in fits]).first()
    return SubspaceEnsemble(fits, [float(h) for h in hits], fusion, passes=passes)
