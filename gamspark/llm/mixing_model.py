"""The arithmetic of the context mixing model: code tree, hashed-context predictors, gated mixing. Numpy only."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from .common import mix64

#: Bits of the counting tables: previous word, previous two words, last frequent word.
TABLE_BITS = (20, 20, 19)
FREQUENT = 64
#: Added to the zeros and the ones of a cell.
HALF = np.float32(0.4)
INPUTS = 5
BIAS = 0.3
GATES = 16
GOLD = np.uint64(0x9E3779B97F4A7C15)
START_WEIGHTS = np.array([0.2, 0.4, 0.3, 0.3, 0.0])
#: Mixed log odds stay within LIMIT; the final stage has so many buckets of them for each gate.
LIMIT = 12.0
BUCKETS = 24
PRIOR = 50.0
REFINE_RATE = 0.02
CHUNK = 1 << 17


@dataclass
class Code:
    """A Huffman code of the most frequent words; symbol ``len(hashes)`` stands for all other words."""

    hashes: np.ndarray  # sorted
    rank: np.ndarray  # by frequency, of each sorted hash
    begin: np.ndarray  # of each symbol's path
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    prior: np.ndarray  # of each node, the log odds of a 1

    @classmethod
    def build(cls, hashes: np.ndarray, counts: np.ndarray, others: float) -> Code:
        order = np.argsort(hashes)
        weights = [*counts[order].astype(float).tolist(), max(others, 0.1)]
        n = len(weights)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, side, mass = {}, {}, dict(enumerate(weights))
        ones = np.zeros(max(n - 1, 0))
        nodes = 0
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            inner = n + nodes
            parent[x], side[x], parent[y], side[y] = inner, 0, inner, 1
            mass[inner] = a + b
            ones[nodes] = np.log(b / a)
            heapq.heappush(heap, (a + b, inner))
            nodes += 1
        node, bit, begin, length = [], [], [], []
        for symbol in range(n):
            path, at = [], symbol
            while at in parent:
                path.append((parent[at] - n, side[at]))
                at = parent[at]
            begin.append(len(node))
            length.append(len(path))
            for k, s in reversed(path):
                node.append(k)
                bit.append(s)
        rank = np.empty(n - 1, dtype=np.int64)
        rank[np.lexsort((hashes[order], -counts[order]))] = np.arange(n - 1)
        return cls(hashes[order], rank, np.array(begin), np.array(length), np.array(node, np.int32), np.array(bit, np.uint8), ones.astype(np.float32))

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, len(self.hashes))


@dataclass
class Events:
    """The binary decisions of a run of documents, turn by turn; ``index`` has the cell of each decision in each table."""

    doc: np.ndarray
    bit: np.ndarray
    prior: np.ndarray
    index: list[np.ndarray]
    turns: np.ndarray  # bounds of the turns


def events(code: Code, symbol: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, turn_tokens: int) -> Events:
    """``symbol`` and ``hashes`` of the tokens of documents of these lengths. A turn has so many tokens of each document."""
    n = len(hashes)
    begins = np.cumsum(lengths) - lengths
    begin = np.repeat(begins, lengths)
    place = np.arange(n) - begin
    one, two = np.zeros_like(hashes), np.zeros_like(hashes)
    one[1:] = np.where(place[1:] > 0, hashes[:-1], 0)
    two[1:] = np.where(place[1:] > 0, one[:-1], 0)
    frequent = np.append(code.rank, FREQUENT)[symbol] < FREQUENT
    last = np.maximum.accumulate(np.where(frequent, np.arange(n), -1))
    before = np.append(-1, last[:-1])[:n]
    seen = np.where(before >= begin, hashes[np.maximum(before, 0)], 0)
    contexts = [mix64(one + np.uint64(1)), mix64(one * GOLD + two + np.uint64(2)), mix64(seen + np.uint64(3))]

    turn = place // turn_tokens
    order = np.argsort(turn, kind="stable")  # by token; decisions then come out in the order they are taken
    token_doc = np.repeat(np.arange(len(lengths)), lengths)[order]
    symbol = symbol[order]
    length = code.length[symbol]
    start = np.cumsum(length) - length
    total = int(length.sum())
    path = np.arange(total) + np.repeat(code.begin[symbol] - start, length)
    node = code.node[path]
    spread = ((np.arange(max(len(code.prior), 1), dtype=np.uint64) + np.uint64(1)) * GOLD)[node]
    index = []
    for context, bits in zip(contexts, TABLE_BITS):
        mixed = np.repeat(context[order], length)
        mixed ^= spread
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed >>= np.uint64(64 - bits)
        index.append(mixed.view(np.int64))
    of_turn = np.searchsorted(turn[order], np.arange(int(turn.max()) + 2)) if n else np.zeros(1, dtype=np.int64)
    return Events(np.repeat(token_doc, length), code.bit[path], code.prior[node], index, np.append(start, total)[of_turn])


def new_tables() -> list[np.ndarray]:
    """Numbers of zeros and ones of each cell, side by side."""
    return [np.zeros(2 << bits, dtype=np.int64) for bits in TABLE_BITS]


def count_into(tables: list[np.ndarray], e: Events) -> None:
    for one, index in zip(tables, e.index):
        one += np.bincount(2 * index + e.bit, minlength=len(one))


def _confidence(n: np.ndarray) -> np.ndarray:
    return ((n > 0).astype(np.uint8) + (n > 3) + (n > 30)).astype(np.uint8)


@dataclass
class Predictors:
    """Log odds and confidence of each cell; ``leave_out``: of each cell and bit, without one decision of that bit."""

    odds: list[np.ndarray]
    sure: list[np.ndarray]
    leave_out: bool

    @classmethod
    def build(cls, tables: list[np.ndarray], leave_out: bool) -> Predictors:
        odds, sure = [], []
        for one in tables:
            zeros, ones = one[0::2].astype(np.float32), one[1::2].astype(np.float32)
            if leave_out:
                less_zero, less_one = np.maximum(zeros - 1, 0), np.maximum(ones - 1, 0)
                both = [np.log((ones + HALF) / (less_zero + HALF)), np.log((less_one + HALF) / (zeros + HALF))]
                odds.append(np.column_stack(both).ravel())
                sure.append(np.column_stack([_confidence(less_zero + ones), _confidence(zeros + less_one)]).ravel())
            else:
                odds.append(np.log((ones + HALF) / (zeros + HALF)))
                sure.append(_confidence(zeros + ones))
        return cls(odds, sure, leave_out)

    def inputs(self, e: Events) -> tuple[list[np.ndarray], np.ndarray]:
        """Columns of the mixer's inputs, and the gate of each decision."""
        columns, gate = [e.prior], None
        for k, index in enumerate(e.index):
            at = 2 * index + e.bit if self.leave_out else index
            columns.append(self.odds[k][at])
            if k < 2:
                gate = self.sure[k][at].astype(np.int64) if gate is None else 4 * gate + self.sure[k][at]
        return columns, gate


def weight_sums(columns: list[np.ndarray], gate: np.ndarray, e: Events, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums over decisions for one Newton step: of each gate the cost in nats, gradient and curvature of the weights, then of each
    cell of the final stage the ones less the probability and the curvature. They add up in any order of documents."""
    out = np.zeros((GATES, 1 + INPUTS + INPUTS * INPUTS))
    cells = np.zeros((2, GATES * BUCKETS))
    lift = np.exp(-offsets).astype(np.float32).ravel()
    for begin in range(0, len(gate), CHUNK):  # that fits the processor's cache
        part = slice(begin, begin + CHUNK)
        own = gate[part].astype(np.uint8)
        order = np.argsort(own, kind="stable")
        own = own[order]
        bounds = np.searchsorted(own, np.arange(GATES + 1))
        x = np.empty((INPUTS, len(own)), dtype=np.float32)
        for k, column in enumerate(columns):
            np.take(column[part], order, out=x[k])
        x[-1] = BIAS
        some = np.flatnonzero(np.diff(bounds)).tolist()
        z = np.empty(len(own), dtype=np.float32)
        for g in some:
            np.matmul(weights[g].astype(np.float32), x[:, bounds[g] : bounds[g + 1]], out=z[bounds[g] : bounds[g + 1]])
        np.clip(z, -LIMIT, LIMIT, out=z)
        y = e.bit[part][order].astype(np.float32)
        odds = np.exp(-z)
        p = 1 / (1 + odds)
        off, slope = y - p, p * (1 - p)
        cost = np.log1p(odds) + (1 - y) * z
        sloped = x * slope
        for g in some:
            at = slice(bounds[g], bounds[g + 1])
            out[g, 0] += cost[at].sum(dtype=np.float64)
            out[g, 1 : 1 + INPUTS] += x[:, at] @ off[at]
            out[g, 1 + INPUTS :] += (sloped[:, at] @ x[:, at].T).ravel()
        cell = own * np.int64(BUCKETS) + bucket_of(z)
        if offsets.any():
            p = 1 / (1 + odds * lift[cell])
            off, slope = y - p, p * (1 - p)
        cells[0] += np.bincount(cell, weights=off, minlength=GATES * BUCKETS)
        cells[1] += np.bincount(cell, weights=slope, minlength=GATES * BUCKETS)
    return np.concatenate([out.ravel(), cells.reshape(2, GATES, BUCKETS).swapaxes(0, 1).ravel()])


N_SUMS = GATES * (1 + INPUTS + INPUTS * INPUTS + 2 * BUCKETS)


def newton_step(sums: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of the gates at these weights, the next weights and the next offsets of the final stage. START_WEIGHTS and offsets of 0
    count as PRIOR decisions, so that gates and cells without decisions stay there."""
    own = sums[: GATES * (1 + INPUTS + INPUTS * INPUTS)].reshape(GATES, -1)
    cells = sums[own.size :].reshape(GATES, 2, BUCKETS)
    after = np.empty_like(weights)
    for g in range(GATES):
        pull = PRIOR * (START_WEIGHTS - weights[g])
        curve = own[g, 1 + INPUTS :].reshape(INPUTS, INPUTS) + PRIOR * np.eye(INPUTS)
        after[g] = weights[g] + np.linalg.solve(curve, own[g, 1 : 1 + INPUTS] + pull)
    moved = offsets + np.clip((cells[:, 0] - PRIOR * offsets) / (cells[:, 1] + PRIOR), -1, 1)
    return own[:, 0], after, moved


def bucket_of(z: np.ndarray) -> np.ndarray:
    """The final stage's cell of a mixed log odds between -LIMIT and LIMIT."""
    return ((z + LIMIT) * (BUCKETS / (2 * LIMIT) * (1 - 1e-6))).astype(np.int64)


def mix(columns: list[np.ndarray], gate: np.ndarray, e: Events, n_docs: int, weights: np.ndarray, offsets: np.ndarray, rate: float) -> np.ndarray:
    """Log10 probability of each decision.

    The gate's weights mix the inputs to log odds; the final stage adds the offset of their cell (gate and bucket). Each document
    begins with a copy of the weights and offsets, and after each turn both follow the gradient of the coding cost.
    """
    state = np.tile(weights.T.astype(np.float32), (1, n_docs))
    refine = np.tile(offsets.astype(np.float32).ravel(), n_docs)
    row = e.doc * GATES + gate
    cost = np.empty(len(e.bit), dtype=np.float32)
    for a, b in zip(e.turns[:-1].tolist(), e.turns[1:].tolist()):
        if a == b:
            continue
        at, y = row[a:b], e.bit[a:b].astype(np.float32)
        z = state[-1][at] * np.float32(BIAS)
        for k, column in enumerate(columns):
            z += state[k][at] * column[a:b]
        np.clip(z, -LIMIT, LIMIT, out=z)
        error = y - 1 / (1 + np.exp(-z))
        cell = at * BUCKETS + bucket_of(z)
        off = y - 1 / (1 + np.exp(-z - refine[cell]))
        cost[a:b] = np.log10(1 - np.minimum(np.abs(off), np.float32(1 - 1e-6)))
        np.add.at(refine, cell, off * np.float32(REFINE_RATE))
        low = int(at.min())
        at = at - low
        n = rate / (np.bincount(at) + 50)
        span = slice(low, low + len(n))
        for k, column in enumerate(columns):
            state[k, span] += np.bincount(at, weights=error * column[a:b]) * n
        state[-1, span] += np.bincount(at, weights=error) * n * BIAS
    return cost
