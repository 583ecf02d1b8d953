"""Trees on shared histograms: best-first trees with a limit on their leaves, and second-order boosting.

Rows are binned once and kept. A pass adds up, per open node and bin, the rows' gradients, curvatures and counts; what reaches
the driver are these sums, whose size depends on nodes and bins, not on rows. A tree needs about as many passes as it is deep: nodes
are taken from a heap in the order of their gain, and all children whose sums are not known yet are asked for in the same pass.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import c, fast_uniform, logit
from ..operators import encode
from .additive import AdditiveModel, Fitted, check_task
from .cuts import quantile_cuts
from .design import Bins, Constant, Design, Levels, numbers
from .gram import OUT_SCHEMA, arrow_score, block_sums, partial_blocks, reused

PASS_VALUES = 4_000_000
CUT_TREES = 10
SPLITTERS = ("best", "random")


@dataclass(frozen=True)
class Binning:
    """Codes of rows: a number's bin from 1 on, 0 where it is missing; 2 for a row of the level and 1 for others."""

    cuts: tuple[tuple[str, tuple[float, ...]], ...]
    levels: tuple[tuple[str, str], ...]

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([n for n, _ in self.cuts] + [n for n, _ in self.levels]))

    @property
    def widths(self) -> list[int]:
        return [len(cuts) + 2 for _, cuts in self.cuts] + [3] * len(self.levels)

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.widths)]).astype(np.int64)

    def codes(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        out = []
        for name, cuts in self.cuts:
            x = numbers(batch, name)
            out.append(np.where(np.isnan(x), 0, np.searchsorted(np.asarray(cuts), x, side="right") + 1).astype(np.int16))
        for name, level in self.levels:
            same = pc.equal(batch.column(name).cast(pa.string()), level).fill_null(False)
            out.append(same.to_numpy(zero_copy_only=False).astype(np.int16) + np.int16(1))
        return out


def binning(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], max_bins: int) -> Binning:
    hot = encode.one_hot(df, categorical) if categorical else None
    cuts = quantile_cuts(df, numeric, max_bins)
    return Binning(tuple((n, cuts[n]) for n in numeric), tuple((n, lv) for n in categorical for lv in hot.kept(n)))


@dataclass
class Tree:
    """Nodes by number: rows with a code up to ``cut`` of ``feature`` go left; a feature of -1 is a leaf with its ``value``."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    @property
    def leaves(self) -> int:
        return int(np.sum(self.feature < 0))

    def nodes(self, codes: list[np.ndarray], rows: int) -> np.ndarray:
        at = np.zeros(rows, dtype=np.int64)
        for _ in range(self.depth):
            inner = np.flatnonzero(self.feature[at] >= 0)
            for f in np.unique(self.feature[np.flatnonzero(np.bincount(at[inner]))]).tolist():
                mine = inner[self.feature[at[inner]] == f]
                node = at[mine]
                at[mine] = np.where(codes[f][mine] <= self.cut[node], self.left[node], self.right[node])
        return at

    def score(self, codes: list[np.ndarray], rows: int) -> np.ndarray:
        return self.value[self.nodes(codes, rows)]


@dataclass
class Rules:
    """What a split must keep to. ``most_leaves`` and ``max_depth`` may be None."""

    max_depth: int | None = None
    most_leaves: int | None = None
    min_rows: int = 1
    min_weight: float = 0.0
    reg_lambda: float = 0.0
    min_gain: float = 0.0
    splitter: str = "best"
    seed: int = 0

    def check(self) -> None:
        if self.splitter not in SPLITTERS:
            raise ValueError(f"splitter must be one of {SPLITTERS}, not {self.splitter!r}")
        if self.most_leaves is not None and self.most_leaves < 2:
            raise ValueError("a tree has two leaves at least")


@dataclass
class _Node:
    path: int  # 1 for the root, 2p and 2p + 1 for the children of p
    depth: int
    totals: np.ndarray | None = None  # gradients, curvatures, rows
    split: tuple | None = None  # gain, feature, cut, totals on the left
    known: bool = False
    children: tuple | None = None

    def value(self, rules: Rules) -> float:
        weight = self.totals[1] + rules.reg_lambda
        return float(-self.totals[0] / weight) if weight > 0 else 0.0


def best_split(sums: np.ndarray, starts: np.ndarray, rules: Rules, path: int, tree: int = 0):
    """Best (gain, feature, cut, totals on the left) of a node; the first of equals. ``sums``: 3 rows over the bins of all features.

    A random splitter draws one cut per feature, from a seed of its own per tree, node and feature, and takes the best of these.
    """
    best = None
    for f in range(len(starts) - 1):
        own = sums[:, starts[f] : starts[f + 1]]
        left = np.cumsum(own, axis=1)[:, :-1]
        total = own.sum(axis=1)
        right = total[:, None] - left
        ok = (left[2] >= max(rules.min_rows, 0.5)) & (right[2] >= max(rules.min_rows, 0.5)) & (left[1] >= rules.min_weight) & (right[1] >= rules.min_weight)
        ok &= (left[1] + rules.reg_lambda > 0) & (right[1] + rules.reg_lambda > 0)
        if rules.splitter == "random":
            filled = np.flatnonzero(own[2] > 0)
            if len(filled) < 2:
                continue
            draw = np.random.default_rng([rules.seed, tree, path, f]).integers(filled[0], filled[-1])
            ok &= np.arange(len(ok)) == draw
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        parts = left[0, at] ** 2 / (left[1, at] + rules.reg_lambda) + right[0, at] ** 2 / (right[1, at] + rules.reg_lambda)
        whole = total[0] ** 2 / (total[1] + rules.reg_lambda)
        k = int(np.argmax(parts))
        gain = float(parts[k] - whole) / 2
        if gain > max(rules.min_gain, 1e-10 * float(parts[k])) and (best is None or gain > best[0] * (1 + 1e-12)):
            best = (gain, f, int(at[k]), left[:, at[k]].copy())
    return best


def grow(sums_of, starts: np.ndarray, rules: Rules, tree: int = 0) -> Tree:
    """``sums_of(tree so far, numbers of its nodes)`` gives the sums of these nodes, in one pass over the rows."""
    root, rounds = _Node(1, 0), 0
    while True:
        taken, wanted, heap = [root], [], []

        def offer(node: _Node) -> None:
            if node.known and node.split:
                heapq.heappush(heap, (-node.split[0], node.path, node))
            elif not node.known:
                wanted.append(node)

        offer(root)
        leaves, order = 1, []
        while heap and (rules.most_leaves is None or leaves < rules.most_leaves):
            node = heapq.heappop(heap)[2]
            if node.children is None:
                closed = rules.max_depth is not None and node.depth + 1 >= rules.max_depth
                sides = (node.split[3], node.totals - node.split[3])
                node.children = tuple(_Node(2 * node.path + i, node.depth + 1, t, known=closed) for i, t in enumerate(sides))
            leaves += 1
            order.append(node)
            taken += node.children
            for child in node.children:
                offer(child)
        built, number = _as_tree(taken, {id(n) for n in order}, rules)
        if not wanted:
            return built
        for node, sums in zip(wanted, sums_of(built, [number[id(n)] for n in wanted], rounds == 0)):
            first = sums[:, starts[0] : starts[1]].sum(axis=1) if len(starts) > 1 else sums.sum(axis=1)
            node.totals = first if node.totals is None else node.totals
            node.split, node.known = (best_split(sums, starts, rules, node.path, tree) if rules.max_depth != 0 else None), True
        rounds += 1


def _as_tree(nodes: list[_Node], split: set, rules: Rules) -> tuple[Tree, dict]:
    number = {id(n): i for i, n in enumerate(nodes)}
    size = len(nodes)
    out = Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), max(n.depth for n in nodes))
    for i, n in enumerate(nodes):
        if id(n) in split:
            out.feature[i], out.cut[i] = n.split[1], n.split[2]
            out.left[i], out.right[i] = number[id(n.children[0])], number[id(n.children[1])]
        elif n.totals is not None:
            out.value[i] = n.value(rules)
    return out, number


def _squared(y, score):
    return score - y, np.ones(len(y)), (y - score) ** 2


def _logistic(y, score):
    p = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
    return p - y, p * (1 - p), np.logaddexp(0, score) - y * score


@dataclass
class _Rows:
    """Binned rows (codes, __y, __w, __score and key columns) and what is added up over them."""

    frame: DataFrame
    bins: Binning
    loss: object
    passes: int = 0

    def sums(self, tree: Tree, wanted: list[int], waiting: list[tuple[float, Tree]], drawn: Column | None, held: Column | None):
        """Per wanted node the sums over its drawn rows, 3 x bins; and the loss and weight of held rows at the present score."""
        width, starts, loss, count = int(self.bins.starts[-1]), self.bins.starts, self.loss, len(self.bins.widths)
        size, out = max(1, 3 * width), []
        sampled, parted = drawn is not None, held is not None
        frame = self.frame.select(  # only these travel to the Python workers
            *[f"__c{i}" for i in range(count)], "__y", "__w", "__score",
            *([drawn.cast("double").alias("__d")] if sampled else []),
            *([F.coalesce(held, F.lit(False)).alias("__h")] if parted else []),
        )
        held_sums = np.zeros(2)
        for a in range(0, len(wanted), max(1, PASS_VALUES // size)):
            nodes = wanted[a : a + max(1, PASS_VALUES // size)]
            place = np.full(len(tree.feature), -1, dtype=np.int64)
            place[nodes] = np.arange(len(nodes))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(len(nodes) * size + 2)
                for batch in batches:
                    n = batch.num_rows
                    codes = [batch.column(f"__c{i}").to_numpy() for i in range(count)]
                    y, weight, score = numbers(batch, "__y"), numbers(batch, "__w"), numbers(batch, "__score").copy()
                    for rate, t in waiting:
                        score += rate * t.score(codes, n)
                    g, h, losses = loss(y, score)
                    at = place[tree.nodes(codes, n)]
                    open_ = at >= 0
                    if parted:
                        away = batch.column("__h").to_numpy(zero_copy_only=False).astype(bool)
                        total[-2:] += (losses[away] @ weight[away], weight[away].sum())
                        open_ &= ~away
                    if sampled:
                        open_ &= numbers(batch, "__d") > 0
                    if not open_.all():
                        use = np.flatnonzero(open_)
                        at, weight, g, h, codes = at[use], weight[use], g[use], h[use], [x[use] for x in codes]
                    for f in range(count):
                        cell = at * size + starts[f] + codes[f]
                        for k, values in enumerate((g * weight, h * weight, None)):
                            total[k * width : -2] += np.bincount(cell, values, len(total) - 2 - k * width)
                yield partial_blocks(0, total)

            found = block_sums(frame.mapInArrow(run, OUT_SCHEMA)).get(0, np.zeros(len(nodes) * size + 2))
            self.passes += 1
            held_sums = found[-2:]
            out += list(found[:-2].reshape(len(nodes), 3, width))
        return out, held_sums


def _binned_rows(df: DataFrame, bins: Binning, target: str, weight: str | None, keep: Sequence[str]) -> DataFrame:
    names = [f"__c{i}" for i in range(len(bins.widths))]
    narrow = df.select(*[c(n) for n in bins.columns], *[c(k).alias(f"__k{i}") for i, k in enumerate(keep)], c(target).cast("double").alias("__y"),
                       (c(weight) if weight else F.lit(1.0)).cast("double").alias("__w")).where(F.col("__y").isNotNull())
    more = [f for f in narrow.schema.fields if f.name.startswith("__")]

    def run(batches):
        for batch in batches:
            columns = [pa.array(x) for x in bins.codes(batch)] + [batch.column(f.name) for f in more]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(np.zeros(batch.num_rows))], [*names, *[f.name for f in more], "__score"])

    schema = ", ".join([f"{n} short" for n in names] + [f"{f.name} {f.dataType.simpleString()}" for f in more] + ["__score double"])
    return narrow.mapInArrow(run, schema)


@dataclass
class HistogramModel(Fitted):
    """A weighted sum of trees over binned columns. ``shares``: leaves are shares of class 1 instead of parts of a score."""

    bins: Binning
    trees: list[Tree]
    rate: float
    base: float
    task: str
    shares: bool = False
    threshold: float = 0.0
    info: dict = field(default_factory=dict)

    def raw(self) -> Column:
        bins, trees, rate, base = self.bins, self.trees, self.rate, self.base

        def run(batch: pa.RecordBatch) -> np.ndarray:
            codes, out = bins.codes(batch), np.full(batch.num_rows, base)
            for tree in trees:
                out += rate * tree.score(codes, batch.num_rows)
            return out

        score = arrow_score(run, bins.columns) if bins.columns else F.lit(base + rate * sum(float(t.value[0]) for t in trees))
        return logit(score, 1e-15) if self.shares else score

    def additive(self) -> AdditiveModel:
        """The same scores as an additive model, for trees of one split: effects per bin and level against what missing and other rows get."""
        if self.shares or any(t.depth > 1 for t in self.trees):
            raise ValueError("only sums of trees of depth 1 are additive")
        numeric, levels = [n for n, _ in self.bins.cuts], {}
        effect = [np.zeros(w) for w in self.bins.widths]
        constant = self.base
        for t in self.trees:
            if t.feature[0] < 0:
                constant += self.rate * t.value[0]
                continue
            low, high = t.value[t.left[0]], t.value[t.right[0]]
            constant += self.rate * low
            effect[t.feature[0]][t.cut[0] + 1 :] += self.rate * (high - low)
        for n, lv in self.bins.levels:
            levels.setdefault(n, []).append(lv)
        blocks = [Constant(), *[Bins(n, cuts) for n, cuts in self.bins.cuts], *[Levels(n, tuple(lv)) for n, lv in levels.items()]]
        parts = [np.array([constant]), *[e[1:] for e in effect[: len(numeric)]], np.array([e[2] for e in effect[len(numeric) :]])]
        return AdditiveModel(Design(tuple(blocks)), np.concatenate(parts), self.task, tuple(numeric), tuple(levels), self.threshold, dict(self.info))


def fit_best_first_tree(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (), task: str = "regression",
                        max_depth: int | None = None, max_leaf_nodes: int | None = None, min_rows: int = 1, class_weight: str | None = None,
                        splitter: str = "best", max_bins: int = 64, seed: int = 0) -> HistogramModel:
    """A tree that always splits the leaf of the largest gain next, until ``max_leaf_nodes`` leaves, ``max_depth`` or no gain.

    Gains are reductions of the squared error, for 0/1 labels of the Gini impurity; leaves are means. A missing number lies below all
    others, a missing or unseen level is none of the levels. Rows without a target are left out.
    """
    rules = Rules(max_depth, max_leaf_nodes, min_rows, splitter=splitter, seed=seed)
    rules.check()
    shares = check_task(task) == "classification"
    frame = encode.balanced_weights(df, target, "__balanced") if class_weight == "balanced" else df
    bins = binning(df, numeric, categorical, max_bins)
    with reused(_binned_rows(frame, bins, target, "__balanced" if class_weight == "balanced" else None, [])) as kept:
        rows = _Rows(kept, bins, _squared)
        if not bins.widths:
            mean = kept.agg(F.sum(F.col("__y") * F.col("__w")) / F.sum("__w")).first()[0]
            return HistogramModel(bins, [], 1.0, float(mean or 0.0), task, shares)
        tree = grow(lambda t, wanted, first: rows.sums(t, wanted, [], None, None)[0], bins.starts, rules)
    return HistogramModel(bins, [tree], 1.0, 0.0, task, shares, info={"leaves": tree.leaves, "depth": tree.depth, "passes": rows.passes})


def fit_newton_boosting(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (), task: str = "regression",
                        n_estimators: int = 100, max_depth: int | None = 6, learning_rate: float = 0.3, reg_lambda: float = 1.0,
                        min_child_weight: float = 1.0, min_gain: float = 0.0, subsample: float = 1.0, max_leaf_nodes: int | None = None,
                        key: Sequence[str] = (), validation: str | None = None, early_stopping: int = 10, max_bins: int = 64,
                        base_score: float | None = None, seed: int = 0) -> HistogramModel:
    """Second-order boosting: leaves are Newton steps -G / (H + lambda), gains what such steps lower the loss by.

    ``subsample`` draws rows per tree by a hash of ``key`` (else of all features and the target), so the draw does not depend on
    partitions. ``validation`` names a boolean column: its rows only give the loss that stops the fit after ``early_stopping`` trees
    without a better one. Every tree needs as many passes as it is deep; the score is written down every CUT_TREES trees.
    """
    rules = Rules(max_depth, max_leaf_nodes, 1, min_child_weight, reg_lambda, min_gain, seed=seed)
    rules.check()
    classes = check_task(task) == "classification"
    bins = binning(df, numeric, categorical, max_bins)
    keys = (list(key) or [*numeric, *categorical, target]) if subsample < 1 else []  # kept only for the draw
    keep = [*keys, validation] if validation else keys
    held = F.col(f"__k{len(keys)}").cast("boolean") if validation else None
    with reused(_binned_rows(df, bins, target, None, keep)) as kept:
        rows = _Rows(kept, bins, _logistic if classes else _squared)
        mean = kept.where(~F.coalesce(held, F.lit(False)) if validation else F.lit(True)).agg(F.avg("__y")).first()[0] or 0.0
        if base_score is None:
            base = float(np.log(mean / (1 - mean)) if classes and 0 < mean < 1 else mean)
        else:
            base = base_score
        model = HistogramModel(bins, [], learning_rate, base, task)
        if not bins.widths:
            return model
        rows.frame = kept.withColumn("__score", F.lit(base))
        waiting: list[tuple[float, Tree]] = []
        losses, frames = [], []
        for k in range(n_estimators):
            drawn = (fast_uniform(f"{seed}s{k}", *[F.col(f"__k{i}") for i in range(len(keys))]) < subsample) if subsample < 1 else None

            def sums(tree, wanted, first):
                found, loss = rows.sums(tree, wanted, waiting, drawn, held)
                if first and validation:
                    losses.append(float(loss[0] / loss[1]) if loss[1] else np.nan)
                return found

            model.trees.append(grow(sums, bins.starts, rules, k))
            if validation and len(losses) - 1 - int(np.argmin(losses)) >= early_stopping:
                break
            waiting.append((learning_rate, model.trees[-1]))
            if len(waiting) == CUT_TREES:
                rows.frame = _scored(rows.frame, bins, waiting).persist()
                frames.append(rows.frame)
                rows.frame.count()
                if len(frames) > 1:
                    frames.pop(0).unpersist()
                waiting = []
        if validation:  # losses[k] is that of the first k trees
            model.trees = model.trees[: int(np.argmin(losses))]
        model.info = {"passes": rows.passes, "validation_losses": losses, "leaves": [t.leaves for t in model.trees]}
        for frame in frames:
            frame.unpersist()
    return model


def _scored(frame: DataFrame, bins: Binning, waiting: list[tuple[float, Tree]]) -> DataFrame:
    def run(*arrays: pa.Array) -> pa.Array:
        codes, out = [a.to_numpy() for a in arrays[:-1]], arrays[-1].to_numpy().copy()
        for rate, tree in waiting:
            out += rate * tree.score(codes, len(out))
        return pa.array(out)

    added = F.arrow_udf(run, "double")
    return frame.withColumn("__score", added(*[F.col(f"__c{i}") for i in range(len(bins.widths))], F.col("__score")))
