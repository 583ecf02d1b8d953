"""The shared data pass: weighted cross-products of a basis, summed over all rows.

Every task adds up B'WB and B'Wz of its own batches and emits them in blocks. Blocks are summed in
two shuffled steps (by block and salt, then by block), so that neither a reducer nor the driver sees
one partial result per task. What reaches the driver is one matrix of basis x basis.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import c
from ..functions.small import reused, spread_small  # noqa: F401 - fits import them from here
from .design import Design, numbers

BLOCK = 8_192
SALTS = 32
CHUNK_VALUES = 2_000_000
OUT_SCHEMA = "part int, grp int, block int, data array<double>"
DRIVER_VALUES = 40_000_000


@dataclass
class Gram:
    """B'WB, B'Wz, z'Wz, the weight sum, the row count and the loss at the current coefficients."""

    g: np.ndarray
    b: np.ndarray
    yy: float
    weight: float
    rows: float
    loss: float = 0.0

    def __sub__(self, other: "Gram") -> "Gram":
        return Gram(self.g - other.g, self.b - other.b, self.yy - other.yy, self.weight - other.weight,
                    self.rows - other.rows, self.loss - other.loss)

    def __add__(self, other: "Gram") -> "Gram":
        return Gram(self.g + other.g, self.b + other.b, self.yy + other.yy, self.weight + other.weight,
                    self.rows + other.rows, self.loss + other.loss)

    def squared_error(self, beta: np.ndarray) -> float:
        """Weighted sum of squared errors of B @ beta."""
        return float(self.yy - 2 * beta @ self.b + beta @ self.g @ beta)

    def take(self, index) -> "Gram":
        return Gram(self.g[np.ix_(index, index)], self.b[index], self.yy, self.weight, self.rows, self.loss)


Working = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _dense_products(design: Design):
    """(B'WB, B'Wz) by matrix products; without weights half of the symmetric one is enough."""

    def products(basis, w, z):
        if np.all(w == 1):
            return basis.T @ basis, basis.T @ z
        weighted = basis * w[:, None]
        return weighted.T @ basis, weighted.T @ z

    return design.build, (lambda basis, pick: basis[pick]), products


def _count_products(design: Design):
    """The same for indicator blocks: joint weighted counts of the codes of two blocks, which cost
    rows x blocks^2 instead of rows x columns^2."""
    sizes, slices = [b.size for b in design.blocks], design.slices

    def build(batch):
        return [b.codes(batch) for b in design.blocks]

    def products(codes, w, z):
        g, rhs, wz = np.zeros((design.size, design.size)), np.zeros(design.size), w * z
        for i, a in enumerate(codes):
            known = a >= 0
            ai, wi = (a, w) if known.all() else (a[known], w[known])
            rhs[slices[i]] = np.bincount(ai, wz if ai is a else wz[known], sizes[i])
            np.fill_diagonal(g[slices[i], slices[i]], np.bincount(ai, wi, sizes[i]))
            for j in range(i + 1, len(codes)):
                both = known & (codes[j] >= 0)
                cell = a * sizes[j] + codes[j]
                cell, wc = (cell, w) if both.all() else (cell[both], w[both])
                joint = np.bincount(cell, wc, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
                g[slices[i], slices[j]], g[slices[j], slices[i]] = joint, joint.T
        return g, rhs

    return build, (lambda codes, pick: [a[pick] for a in codes]), products


def _partial_sums(design: Design, names: dict, working, offset, n_weights: int):
    size = design.size
    upper = np.triu_indices(size)
    square = len(upper[0])  # B'WB is symmetric: its upper triangle travels
    width = square + size + 4
    build, take, products = _count_products(design) if design.indicators else _dense_products(design)
    chunk = 1 << 20 if design.indicators else max(256, CHUNK_VALUES // max(size, 1))

    def run(batches: Iterator[pa.RecordBatch]):
        sums: dict[int, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, chunk):
                batch = whole.slice(start, chunk)
                basis = build(batch)
                y = numbers(batch, "__y")
                base = offset(batch) if offset is not None else None
                w0, z, loss = np.ones(len(y)), y, np.zeros(len(y))
                if working is not None:
                    w0, z, loss = working(y, base if base is not None else np.zeros(len(y)))
                elif base is not None:
                    z = y - base
                    loss = z * z
                groups = numbers(batch, "__g").astype(np.int64) if names["group"] else None
                for k in range(max(n_weights, 1)):
                    case = numbers(batch, f"__w{k}") if n_weights else np.ones(len(y))
                    keys = np.unique(groups) if groups is not None else (k,)
                    for key in keys:
                        pick = groups == key if groups is not None else case != 0
                        whole_batch = bool(pick.all())
                        bb = basis if whole_batch else take(basis, pick)
                        cw, zz, w1, ll = (case, z, w0, loss) if whole_batch else (case[pick], z[pick], w0[pick], loss[pick])
                        w = w1 * cw
                        g, rhs = products(bb, w, zz)
                        acc = sums.setdefault(int(key), np.zeros(width))
                        acc[:square] += g[upper]
                        acc[square:-4] += rhs
                        acc[-4:] += (w @ (zz * zz), w.sum(), cw.sum(), ll @ cw)
        for key, acc in sums.items():
            yield partial_blocks(key, acc)

    return run


def partial_blocks(key: int, values: np.ndarray) -> pa.RecordBatch:
    """A task's sums for one group, cut into blocks."""
    starts = range(0, len(values), BLOCK)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([TaskContext.get().partitionId()] * len(starts), pa.int32()),
            pa.array([key] * len(starts), pa.int32()),
            pa.array(range(len(starts)), pa.int32()),
            pa.array([values[s : s + BLOCK] for s in starts], pa.list_(pa.float64())),
        ],
        names=["part", "grp", "block", "data"],
    )


def block_sums(partial: DataFrame) -> dict[int, np.ndarray]:
    """Partial sums of all tasks added up, per group. Two steps, so that no reducer reads a block of every task."""
    partial = partial.groupBy("grp", "block", (F.col("part") % SALTS).alias("salt")).agg(Summarizer.sum(array_to_vector(F.col("data"))).alias("v"))
    rows = partial.groupBy("grp", "block").agg(Summarizer.sum(F.col("v")).alias("v")).select(
        "grp", "block", vector_to_array("v").alias("v")
    ).collect()
    return {
        key: np.concatenate([np.asarray(r["v"]) for r in sorted((r for r in rows if r["grp"] == key), key=lambda r: r["block"])])
        for key in sorted({r["grp"] for r in rows})
    }


def gram(
    df: DataFrame,
    design: Design,
    y: str | Column,
    weights: Sequence[str] = (),
    group: str | Column | None = None,
    working: Working | None = None,
    offset: Callable[[pa.RecordBatch], np.ndarray] | None = None,
    offset_columns: Sequence[str] = (),
    spread: bool = True,
) -> dict[int, Gram]:
    """One pass over ``df``; returns a Gram per group, or per weight column, or {0: ...}.

    ``offset`` is the score a row already has; ``working(y, score)`` turns it into iteration weights,
    a working response and the loss. Rows with a NULL target are left out, and rows with a NULL or NaN in
    a column that enters as a number (``rows`` of the result says how many were used); a missing value of
    a binned or level column has no indicator. ``spread=False`` says that the frame is already dealt out
    (see ``reused``).
    """
    design.check()
    if group is not None and weights:
        raise ValueError("give groups or weight columns, not both")
    at_once = max(1, DRIVER_VALUES // (design.size * design.size))
    if len(weights) > at_once:  # more matrices than the driver should hold in flight: several passes
        out = {}
        for start in range(0, len(weights), at_once):
            part = gram(df, design, y, weights[start : start + at_once], None, working, offset, offset_columns, spread)
            out.update({start + k: v for k, v in part.items()})
        return out
    target = c(y) if isinstance(y, str) else y
    columns = list(dict.fromkeys([*design.columns, *offset_columns]))
    narrow = df.select(
        *[c(n) for n in columns],
        target.cast("double").alias("__y"),
        *[c(w).cast("double").alias(f"__w{i}") for i, w in enumerate(weights)],
        *([] if group is None else [(c(group) if isinstance(group, str) else group).cast("int").alias("__g")]),
    ).where(F.col("__y").isNotNull())
    for name in dict.fromkeys(n for b in design.blocks if not hasattr(b, "codes") for n in b.columns):
        narrow = narrow.where(c(name).isNotNull() & ~F.isnan(c(name).cast("double")))
    names = {"group": group is not None}
    if group is not None:
        groups = narrow.select("__g").distinct().limit(at_once + 1).count()
        if groups > at_once:
            raise ValueError(f"more than {at_once} groups; the driver holds a matrix of each")
    source = spread_small(narrow) if spread else narrow
    partial = source.mapInArrow(_partial_sums(design, names, working, offset, len(weights)), OUT_SCHEMA)
    size = design.size
    upper = np.triu_indices(size)
    square = len(upper[0])
    out: dict[int, Gram] = {}
    for key, flat in block_sums(partial).items():
        g = np.zeros((size, size))
        g[upper] = flat[:square]
        g = g + np.triu(g, 1).T
        out[key] = Gram(g, flat[square:-4], *[float(v) for v in flat[-4:]])
    return out


@dataclass(frozen=True)
class Member:
    """One of several cross-products of the same pass: its own columns, weight, share of the rows and score so far."""

    design: Design
    beta: np.ndarray | None = None  # score so far, for ``working``
    weight: str | None = None
    cells: frozenset[int] | None = None  # only rows of these cells
    working: Working | None = None


def _member_sums(members: Sequence[Member], weights: dict[str, str], celled: bool):
    sizes = [m.design.size for m in members]
    uppers = {n: np.triu_indices(n) for n in set(sizes)}
    counted = [m.design.indicators for m in members]
    products = [(_count_products if k else _dense_products)(m.design)[2] for m, k in zip(members, counted)]
    chunk = max(256, CHUNK_VALUES // max(sizes))

    def run(batches: Iterator[pa.RecordBatch]):
        sums = [np.zeros(len(uppers[n][0]) + n + 4) for n in sizes]
        for whole in batches:
            for start in range(0, whole.num_rows, chunk):
                batch = whole.slice(start, chunk)
                y, built = numbers(batch, "__y"), {}
                cell = numbers(batch, "__cell").astype(np.int64) if celled else None

                def columns(block):  # terms that members share are built once
                    if id(block) not in built:
                        built[id(block)] = block.build(batch)
                    return built[id(block)]

                def codes(block):
                    if ("codes", id(block)) not in built:
                        built["codes", id(block)] = block.codes(batch)
                    return built["codes", id(block)]

                def whole_basis(design, indicators):
                    if id(design) not in built:
                        built[id(design)] = [codes(b) for b in design.blocks] if indicators else np.hstack([columns(b) for b in design.blocks])
                    return built[id(design)]

                for k, m in enumerate(members):
                    basis = whole_basis(m.design, counted[k])
                    weight = numbers(batch, weights[m.weight]) if m.weight else np.ones(len(y))
                    use = weight != 0
                    if m.cells is not None:
                        use &= np.isin(cell, list(m.cells))
                    if not counted[k]:
                        use &= ~np.isnan(basis).any(axis=1)
                    if not use.all():
                        basis = [x[use] for x in basis] if counted[k] else basis[use]
                    cw, z, w, loss = weight[use], y[use], np.ones(int(use.sum())), np.zeros(int(use.sum()))
                    if m.working is not None:
                        beta = m.beta if m.beta is not None else np.zeros(m.design.size)
                        if counted[k]:
                            score = sum(np.r_[beta[sl], 0.0][x] for x, sl in zip(basis, m.design.slices))
                        else:
                            score = basis @ beta
                        w, z, loss = m.working(z, score)
                    w = w * cw
                    g, rhs = products[k](basis, w, z)
                    square = len(uppers[sizes[k]][0])
                    sums[k][:square] += g[uppers[sizes[k]]]
                    sums[k][square:-4] += rhs
                    sums[k][-4:] += (w @ (z * z), w.sum(), cw.sum(), loss @ cw)
        for k, values in enumerate(sums):
            yield partial_blocks(k, values)

    return run


def gram_many(df: DataFrame, y: str | Column, members: Sequence[Member], cell: str | Column | None = None) -> list[Gram]:
    """The cross-products of all members from one pass over ``df`` (several when the driver could not hold all matrices).

    Each member leaves out rows with a missing number of its own terms. ``rows`` counts weights of 1 and more as they are.
    """
    at_once, waiting, out = [], list(members), []
    for m in members:
        m.design.check()
    while waiting:
        at_once, held = [], 0
        while waiting and (not at_once or held + waiting[0].design.size ** 2 <= DRIVER_VALUES):
            at_once.append(waiting.pop(0))
            held += at_once[-1].design.size ** 2
        names = {w: f"__w{i}" for i, w in enumerate(dict.fromkeys(m.weight for m in at_once if m.weight))}
        columns = dict.fromkeys(n for m in at_once for n in m.design.columns)
        target = c(y) if isinstance(y, str) else y
        narrow = df.select(
            *[c(n) for n in columns], target.cast("double").alias("__y"), *[c(w).cast("double").alias(n) for w, n in names.items()],
            *([] if cell is None else [(c(cell) if isinstance(cell, str) else cell).cast("int").alias("__cell")]),
        ).where(F.col("__y").isNotNull())
        found = block_sums(narrow.mapInArrow(_member_sums(at_once, names, cell is not None), OUT_SCHEMA))
        for k, m in enumerate(at_once):
            size = m.design.size
            upper = np.triu_indices(size)
            flat = found.get(k, np.zeros(len(upper[0]) + size + 4))
            g = np.zeros((size, size))
            g[upper] = flat[: len(upper[0])]
            out.append(Gram(g + np.triu(g, 1).T, flat[len(upper[0]) : -4], *[float(v) for v in flat[-4:]]))
    return out


def run_together(df: DataFrame, y: str | Column, jobs: Sequence[tuple[Member, Iterator]], cell: str | Column | None = None) -> tuple[list, int]:
    """Iterative fits in step: every round is one pass that serves all fits which still go on.

    A fit is a generator that yields coefficients, is sent the cross-products there, and returns its result. Returns the results and
    the number of rounds.
    """
    results, state, rounds = [None] * len(jobs), {}, 0

    def advance(k: int, stats: Gram | None) -> None:
        try:
            state[k] = jobs[k][1].send(stats)
        except StopIteration as end:
            results[k] = end.value
            state.pop(k, None)
        except np.linalg.LinAlgError as error:  # the other fits go on
            results[k] = error
            state.pop(k, None)

    for k in range(len(jobs)):
        advance(k, None)
    while state:
        live = sorted(state)
        members = [Member(jobs[k][0].design, state[k], jobs[k][0].weight, jobs[k][0].cells, jobs[k][0].working) for k in live]
        rounds += 1
        for k, stats in zip(live, gram_many(df, y, members, cell)):
            advance(k, stats)
    return results, rounds


def run_alone(steps: Iterator, stats_at: Callable[[np.ndarray], Gram]):
    """The result of one such fit, with a pass of its own per step."""
    try:
        beta = next(steps)
        while True:
            beta = steps.send(stats_at(beta))
    except StopIteration as end:
        return end.value


def batch_score(design: Design, beta: np.ndarray) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Score of a fitted design for use as ``offset``."""
    return lambda batch: design.score(batch, beta)


def logistic_working(y: np.ndarray, score: np.ndarray):
    """IRLS for 0/1 labels: weights p(1-p), response score + (y-p)/w, and the log loss."""
    p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    w = np.maximum(p * (1 - p), 1e-6)
    loss = np.logaddexp(0, score) - y * score
    return w, score + (y - p) / w, loss


def logistic_step(y: np.ndarray, score: np.ndarray):
    """The same step as a correction to the score: the response is (y-p)/w alone."""
    w, z, loss = logistic_working(y, score)
    return w, z - score, loss


def score_column(design: Design, beta: np.ndarray) -> Column:
    """B @ beta as a column. Linear terms and levels stay JVM expressions; other bases go through one
    Arrow-batched function that receives only the columns it needs."""
    from .design import Constant, Levels, Linear

    beta = np.asarray(beta, dtype=np.float64)
    total, rest, rest_beta = F.lit(0.0), [], []
    for block, sl in zip(design.blocks, design.slices):
        if isinstance(block, Constant):
            total = total + F.lit(float(beta[sl][0]))
        elif isinstance(block, Linear):
            total = total + (c(block.name) - F.lit(block.shift)) / F.lit(block.scale) * F.lit(float(beta[sl][0]))
        elif isinstance(block, Levels):
            pairs = [x for lv, v in zip(block.levels, beta[sl]) for x in (F.lit(lv), F.lit(float(v)))]
            if pairs:
                total = total + F.coalesce(F.try_element_at(F.create_map(*pairs), c(block.name).cast("string")), F.lit(0.0))
        else:
            rest.append(block)
            rest_beta.append(beta[sl])
    if not rest:
        return total
    return total + arrow_score(batch_score(Design(tuple(rest)), np.concatenate(rest_beta)), Design(tuple(rest)).columns)


def arrow_score(fn: Callable[[pa.RecordBatch], np.ndarray], columns: Sequence[str]) -> Column:
    """A batch function as a column; only ``columns`` travel to the Python worker."""
    names = list(columns)

    @F.arrow_udf("double")
    def run(*arrays: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays(list(arrays), names=names)
        return pa.array(np.asarray(fn(batch), dtype=np.float64))

    return run(*[c(n) for n in names])
