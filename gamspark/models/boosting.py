"""Explainable boosting on bins.

For squared loss every cyclic update can be computed from the Gram of the bin indicators: the
residual sum of a bin is b_j - sum_k G_jk f_k. One data pass therefore replaces thousands of
rounds; log loss takes a bounded number of reweighted passes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import c, fast_uniform, poisson_weight
from ..operators.encode import sorted_levels
from .additive import AdditiveModel, check_task
from .cuts import quantile_cuts
from .design import Bins, Constant, Design, Levels, PairBins
from .gram import Gram, batch_score, gram, logistic_step, reused
from .interactions import pair_strength

PAIR_BINS = 16
VALIDATION_SHARE = 0.15


def binned_design(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], max_bins: int) -> Design:
    cuts = quantile_cuts(df, numeric, max_bins)
    levels = sorted_levels(df, categorical)
    blocks = [Constant(), *[Bins(n, cuts[n]) for n in numeric], *[Levels(n, tuple(levels[n])) for n in categorical if levels[n]]]
    return Design(tuple(blocks))


def tree_step(counts: np.ndarray, sums: np.ndarray, leaves: int, ordered: bool = True) -> np.ndarray:
    """Leaf means of a small tree over bins: the best cuts one after the other, empty gains not taken."""
    if leaves >= len(counts):  # room for every bin: plain bin means
        return np.divide(sums, counts, out=np.zeros(len(counts)), where=counts > 0)
    order = np.arange(len(counts))
    if not ordered:
        with np.errstate(invalid="ignore", divide="ignore"):
            order = np.argsort(np.where(counts > 0, sums / np.maximum(counts, 1e-300), 0.0), kind="stable")
    n, s = counts[order], sums[order]
    cn, cs = np.r_[0.0, np.cumsum(n)], np.r_[0.0, np.cumsum(s)]
    edges = [0, len(n)]

    def value(a, b):
        total = cn[b] - cn[a]
        return (cs[b] - cs[a]) ** 2 / total if total > 0 else 0.0

    while len(edges) <= leaves:
        best_gain, best_cut = 1e-12, None
        for a, b in zip(edges, edges[1:]):
            cut = np.arange(a + 1, b)
            if not len(cut):
                continue
            ln, rn = cn[cut] - cn[a], cn[b] - cn[cut]
            ok = (ln > 0) & (rn > 0)
            with np.errstate(invalid="ignore", divide="ignore"):
                gains = np.where(ok, (cs[cut] - cs[a]) ** 2 / ln + (cs[b] - cs[cut]) ** 2 / rn, -np.inf) - value(a, b)
            at = int(np.argmax(gains))
            if gains[at] > best_gain:
                best_gain, best_cut = gains[at], int(cut[at])
        if best_cut is None:
            break
        edges = sorted([*edges, best_cut])
    out = np.zeros(len(n))
    for a, b in zip(edges, edges[1:]):
        total = cn[b] - cn[a]
        out[order[a:b]] = (cs[b] - cs[a]) / total if total > 0 else 0.0
    return out


def cyclic_boost(design: Design, train: Sequence[Gram], val: Gram | None, rate: float, rounds: int, leaves: int,
                 patience: int, tol: float = 1e-6):
    """Cyclic boosting on cross-products. ``train`` holds one Gram per inner bag; their steps are averaged.

    Returns the coefficients of the best validation round (or the last one) and the loss path.
    """
    f = np.zeros(design.size)
    grads = [t.b.copy() for t in train]
    slices = design.slices

    def loss():
        return val.squared_error(f) / val.weight if val is not None and val.weight else train[0].squared_error(f) / train[0].weight

    if isinstance(design.blocks[0], Constant):
        step = float(np.mean([g[0] / t.g[0, 0] for g, t in zip(grads, train)]))
        f[0] += step
        grads = [g - t.g[:, 0] * step for g, t in zip(grads, train)]
    best, best_loss, since, path = f.copy(), loss(), 0, [loss()]
    for _ in range(rounds):
        for block, sl in zip(design.blocks, slices):
            if isinstance(block, Constant):
                continue
            step = np.zeros(block.size)
            for g, t in zip(grads, train):
                step += tree_step(np.diag(t.g)[sl], g[sl], block.size if isinstance(block, PairBins) else leaves,
                                  ordered=not isinstance(block, Levels))
            step *= rate / len(train)
            f[sl] += step
            grads = [g - t.g[:, sl] @ step for g, t in zip(grads, train)]
        now = loss()
        path.append(now)
        if now < best_loss - tol * abs(best_loss):
            best, best_loss, since = f.copy(), now, 0
        else:
            since += 1
            if since >= patience:
                break
    return best, path


def _centre(design: Design, beta: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Every term gets count-weighted mean 0; the constant takes the rest."""
    out = beta.copy()
    for block, sl in zip(design.blocks, design.slices):
        if not isinstance(block, Constant) and counts[sl].sum() > 0:
            mean = float(beta[sl] @ counts[sl] / counts[sl].sum())
            out[sl] -= mean
            out[0] += mean
    return out


def purify(design: Design, beta: np.ndarray, counts: np.ndarray, tol: float = 1e-12, sweeps: int = 10_000) -> tuple[Design, np.ndarray]:
    """The same scores with pure pair effects: what a pair's surface says about one feature alone moves to a term of that feature on the
    pair's bins, and the overall mean to the constant. ``counts`` are the rows of every column; afterwards the weighted mean of each
    row and column of a surface is 0 (of those with rows), and so is that of the new terms. For a row that misses just one of the
    two numbers, a pair has no effect, but the term of the other feature has.
    """
    blocks, parts, extra = list(design.blocks), [beta[sl].copy() for sl in design.slices], {}
    for k, (block, sl) in enumerate(zip(design.blocks, design.slices)):
        if not isinstance(block, PairBins):
            continue
        shape = (block.first.size, block.second.size)
        surface, n = parts[k].reshape(shape).copy(), counts[sl].reshape(shape)
        surface[n == 0] = 0.0  # cells without rows say nothing, and would never be asked for by the rows
        sides = [np.zeros(shape[0]), np.zeros(shape[1])]
        for _ in range(sweeps):
            moved = 0.0
            for axis in (0, 1):
                total = n.sum(axis=1 - axis)
                mean = np.divide((surface * n).sum(axis=1 - axis), total, out=np.zeros(shape[axis]), where=total > 0)
                sides[axis] += mean
                surface -= mean[:, None] if axis == 0 else mean[None, :]
                moved = max(moved, float(np.max(np.abs(mean))))
            if moved <= tol * max(1.0, float(np.max(np.abs(parts[k])))):
                break
        kept = parts[k].reshape(shape) - sides[0][:, None] - sides[1][None, :]  # also for cells without rows: the sum is as before
        for axis, bins in enumerate((block.first, block.second)):
            weight = n.sum(axis=1 - axis)
            mean = float(sides[axis] @ weight / weight.sum()) if weight.sum() else 0.0
            parts[0] = parts[0] + mean
            extra[bins] = extra.get(bins, 0.0) + sides[axis] - mean
        parts[k] = kept.ravel()
    for bins, effect in extra.items():
        blocks.append(bins)
        parts.append(np.asarray(effect))
    return Design(tuple(blocks)), np.concatenate(parts)


def _with_bags(df: DataFrame, key: Sequence[str], outer: int, inner: int, seed: int) -> tuple[DataFrame, list[list[str]], list[str]]:
    """Weight columns: per outer bag its training rows (times inner Poisson weights) and its validation rows."""
    cols, train, val = {}, [], []
    for b in range(outer):
        cols[f"__v{b}"] = (fast_uniform(f"{seed}v{b}", *[c(k) for k in key]) < VALIDATION_SHARE).cast("int")
        for i in range(inner):
            cols[f"__p{b}_{i}"] = fast_uniform(f"{seed}p{b}_{i}", *[c(k) for k in key])
    drawn = df.withColumns(cols)
    weights = {}
    for b in range(outer):
        base = 1 - F.col(f"__v{b}")
        names = [f"__t{b}_{i}" for i in range(max(inner, 1))]
        for i, n in enumerate(names):
            weights[n] = base * poisson_weight(F.col(f"__p{b}_{i}"), 1.0) if inner else base
        train.append(names)
        val.append(f"__v{b}")
    return drawn.withColumns(weights), train, val


def _boost_stage(df, target, design, key, task, base, base_columns, outer, inner, seed, rate, rounds, leaves, patience, passes):
    """Averaged coefficients over the outer bags for one stage; ``base`` is the score of earlier stages.

    Log loss: each pass linearises the loss at the score so far and boosts the correction on its Gram.
    """
    drawn, train, val = _with_bags(df, key, outer, inner, seed)
    fits, paths = [], []
    if task == "regression":
        names = [n for group in train for n in group] + val
        stats = gram(drawn, design, target, names, offset=base, offset_columns=base_columns, spread=False)
        at = {n: stats[i] for i, n in enumerate(names)}
        for names_b, val_b in zip(train, val):
            f, path = cyclic_boost(design, [at[n] for n in names_b], at[val_b], rate, rounds, leaves, patience)
            fits.append(f)
            paths.append(path)
        counts = np.diag(at[train[0][0]].g) + np.diag(at[val[0]].g)
    else:
        for names_b, val_b in zip(train, val):
            f, best, best_loss, path = np.zeros(design.size), np.zeros(design.size), np.inf, []
            for at_pass in range(passes + 1):  # the last one only judges the correction before

                def offset(batch, f=f):
                    score = design.score(batch, f)
                    return score if base is None else score + base(batch)

                stats = gram(drawn, design, target, [*names_b, val_b], working=logistic_step, offset=offset,
                             offset_columns=base_columns, spread=False)
                held = stats[len(names_b)]
                loss = held.loss / max(held.rows, 1.0)
                path.append(loss)
                if loss < best_loss - 1e-6:
                    best, best_loss = f, loss
                else:
                    break
                if at_pass == passes:
                    break
                bags = [stats[i] for i in range(len(names_b))]
                f = f + cyclic_boost(design, bags, held, rate, rounds, leaves, patience)[0]
            fits.append(best)
            paths.append(path)
    if task != "regression" or inner:  # the passes before have weights; terms are centred by rows
        counts = np.diag(gram(df, design, target, spread=False)[0].g)
    return np.mean(fits, axis=0), paths, counts


def fit_binned_boosting(
    df: DataFrame,
    target: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    task: str = "regression",
    key: Sequence[str] = (),
    max_bins: int = 64,
    interactions: int = 0,
    outer_bags: int = 1,
    inner_bags: int = 0,
    learning_rate: float = 0.1,
    rounds: int = 1000,
    max_leaves: int = 3,
    early_stopping: int = 50,
    passes: int = 10,
    seed: int = 42,
) -> AdditiveModel:
    """Main effects on quantile bins, then the strongest pairs on coarser bins of the residual.

    ``key`` identifies rows for the validation draw; without it all feature columns together do.
    """
    check_task(task)
    key = list(key) or [*numeric, *categorical]
    options = (outer_bags, inner_bags, seed, learning_rate, rounds, max_leaves, early_stopping, passes)
    with reused(df.select(*[c(n) for n in dict.fromkeys([*key, *numeric, *categorical, target])])) as rows:
        return _fit_stages(rows, target, list(numeric), list(categorical), task, key, max_bins, interactions, options)


def _fit_stages(df, target, numeric, categorical, task, key, max_bins, interactions, options) -> AdditiveModel:
    design = binned_design(df, numeric, categorical, max_bins)
    beta, paths, counts = _boost_stage(df, target, design, key, task, None, (), *options)
    beta = _centre(design, beta, counts)
    model = AdditiveModel(design, beta, task, tuple(numeric), tuple(categorical), info={"paths": paths})
    if not interactions or len(numeric) < 2:
        return model
    residual = c(target).cast("double") - (model.raw() if task == "regression" else 1 / (1 + F.exp(-model.raw())))
    cuts = quantile_cuts(df, numeric, PAIR_BINS)
    ranked = pair_strength(df.withColumn("__res", residual), "__res", cuts)
    best = ranked.orderBy(F.col("strength").desc(), "feat_a", "feat_b").limit(interactions).collect()
    pairs = [PairBins(Bins(r["feat_a"], cuts[r["feat_a"]]), Bins(r["feat_b"], cuts[r["feat_b"]])) for r in best]
    pair_design = Design((Constant(), *pairs))
    more, pair_paths, pair_counts = _boost_stage(
        df, target, pair_design, key, task, batch_score(design, beta), design.columns, *options
    )
    more = _centre(pair_design, more, pair_counts)
    joined = Design((*design.blocks, *pairs))
    beta = np.r_[beta, more[1:]]
    beta[0] += more[0]
    joined, beta = purify(joined, beta, np.r_[counts, pair_counts[1:]])
    return AdditiveModel(joined, beta, task, tuple(numeric), tuple(categorical),
                         info={"paths": paths, "pair_paths": pair_paths, "pairs": [p.columns for p in pairs]})
