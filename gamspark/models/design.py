"""Basis blocks: how a row becomes the columns of an additive model.

A block builds its columns for one Arrow batch inside a task. Designs are small picklable objects;
their size does not depend on the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_COLUMNS = 3_000


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A numeric column as float64 with NULL as NaN."""
    return batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def indicators(codes: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(codes), size))
    known = np.flatnonzero(codes >= 0)
    out[known, codes[known]] = 1.0
    return out


@dataclass(frozen=True)
class Constant:
    name: str = "intercept"

    @property
    def columns(self):
        return ()

    @property
    def size(self):
        return 1

    def codes(self, batch):
        return np.zeros(batch.num_rows, dtype=np.int64)

    def build(self, batch):
        return np.ones((batch.num_rows, 1))


@dataclass(frozen=True)
class Linear:
    """(x - shift) / scale."""

    name: str
    shift: float = 0.0
    scale: float = 1.0

    @property
    def columns(self):
        return (self.name,)

    @property
    def size(self):
        return 1

    def build(self, batch):
        return ((numbers(batch, self.name) - self.shift) / self.scale)[:, None]


@dataclass(frozen=True)
class Levels:
    """One indicator per level; an unknown level gives zeros."""

    name: str
    levels: tuple[str, ...]

    @property
    def columns(self):
        return (self.name,)

    @property
    def size(self):
        return len(self.levels)

    def codes(self, batch):
        """Level number, -1 for an unknown level."""
        at = pc.index_in(batch.column(self.name).cast(pa.string()), value_set=pa.array(self.levels, pa.string()))
        return at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def build(self, batch):
        out = np.zeros((batch.num_rows, self.size))
        at = self.codes(batch)
        rows = np.flatnonzero(at >= 0)
        out[rows, at[rows]] = 1.0
        return out


@dataclass(frozen=True)
class Bins:
    """One indicator per bin of a numeric column; a value on a cut belongs to the upper bin, a missing one to none (effect 0)."""

    name: str
    cuts: tuple[float, ...]

    @property
    def columns(self):
        return (self.name,)

    @property
    def size(self):
        return len(self.cuts) + 1

    def codes(self, batch):
        x = numbers(batch, self.name)
        return np.where(np.isnan(x), -1, np.searchsorted(np.asarray(self.cuts), x, side="right"))

    def build(self, batch):
        return indicators(self.codes(batch), self.size)


@dataclass(frozen=True)
class PairBins:
    """One indicator per cell of two binned columns."""

    first: Bins
    second: Bins

    @property
    def name(self):
        return f"{self.first.name} x {self.second.name}"

    @property
    def columns(self):
        return (self.first.name, self.second.name)

    @property
    def size(self):
        return self.first.size * self.second.size

    def codes(self, batch):
        a, b = self.first.codes(batch), self.second.codes(batch)
        return np.where((a < 0) | (b < 0), -1, a * self.second.size + b)

    def build(self, batch):
        return indicators(self.codes(batch), self.size)


@dataclass(frozen=True)
class Spline:
    """B-splines on even knots between lo and hi; values outside are held at the ends."""

    name: str
    lo: float
    hi: float
    n_splines: int = 20
    degree: int = 3

    @property
    def columns(self):
        return (self.name,)

    @property
    def size(self):
        return self.n_splines

    def evaluate(self, x: np.ndarray) -> np.ndarray:
        inner = self.n_splines - self.degree
        step = (self.hi - self.lo) / inner
        u = np.clip((np.asarray(x, dtype=np.float64) - self.lo) / step, 0.0, inner * (1 - 1e-12))
        cell = np.minimum(np.floor(u).astype(np.int64), inner - 1)
        t = u - cell
        # the degree+1 splines that live on a cell, by raising the degree one step at a time
        local = [np.ones(len(u))]
        for d in range(1, self.degree + 1):
            left = [0.0, *[local[j - 1] * (t + d - j) / d for j in range(1, d + 1)]]
            right = [*[local[j] * (j + 1 - t) / d for j in range(d)], 0.0]
            local = [a + b for a, b in zip(left, right)]
        out = np.zeros((len(u), self.n_splines))
        rows = np.arange(len(u))
        for j, values in enumerate(local):
            out[rows, cell + j] = values
        return out

    def build(self, batch):
        return self.evaluate(numbers(batch, self.name))

    def penalty(self, order: int = 2) -> np.ndarray:
        diff = np.diff(np.eye(self.n_splines), n=min(order, self.n_splines - 1), axis=0)
        return diff.T @ diff


def _elu(z: np.ndarray) -> np.ndarray:
    """In place, over all values at once: exp of the negative parts less 1, plus the positive parts."""
    low = np.minimum(z, 0.0)
    np.exp(low, out=low)
    low -= 1.0
    np.maximum(z, 0.0, out=z)
    z += low
    return z


ACTIVATIONS = {"elu": _elu, "relu": lambda z: np.maximum(z, 0.0, out=z)}


@dataclass(frozen=True)
class Hidden:
    """Random features of one column: act(x * w), with fixed weights."""

    name: str
    weights: tuple[float, ...]
    act: str = "elu"

    @property
    def columns(self):
        return (self.name,)

    @property
    def size(self):
        return len(self.weights)

    def fill(self, values, out):
        """The columns as rows of ``out``; ``values`` gives a column's numbers."""
        np.multiply.outer(np.asarray(self.weights), values(self.name), out=out)
        ACTIVATIONS[self.act](out)

    def build(self, batch):
        return Design((self,)).build(batch)


@dataclass(frozen=True)
class HiddenPair:
    """Random features of two columns: act(x * w + z * v)."""

    first: str
    second: str
    weights: tuple[float, ...]
    other: tuple[float, ...]
    act: str = "elu"

    @property
    def name(self):
        return f"{self.first} x {self.second}"

    @property
    def columns(self):
        return (self.first, self.second)

    @property
    def size(self):
        return len(self.weights)

    def fill(self, values, out):
        np.multiply.outer(np.asarray(self.weights), values(self.first), out=out)
        out += np.multiply.outer(np.asarray(self.other), values(self.second))
        ACTIVATIONS[self.act](out)

    def build(self, batch):
        return Design((self,)).build(batch)


@dataclass(frozen=True)
class Design:
    blocks: tuple = field(default_factory=tuple)

    @property
    def size(self) -> int:
        return sum(b.size for b in self.blocks)

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(n for b in self.blocks for n in b.columns))

    @property
    def slices(self) -> list[slice]:
        out, at = [], 0
        for b in self.blocks:
            out.append(slice(at, at + b.size))
            at += b.size
        return out

    @property
    def indicators(self) -> bool:
        """Every block has at most one 1 per row."""
        return all(hasattr(b, "codes") for b in self.blocks)

    def build(self, batch: pa.RecordBatch) -> np.ndarray:
        """Blocks of random features are written column by column into one array, each input read once."""
        if not any(hasattr(b, "fill") for b in self.blocks):
            return np.hstack([b.build(batch) for b in self.blocks])
        read, out = {}, np.empty((self.size, batch.num_rows))

        def values(name):
            if name not in read:
                read[name] = numbers(batch, name)
            return read[name]

        for b, sl in zip(self.blocks, self.slices):
            if hasattr(b, "fill"):
                b.fill(values, out[sl])
            else:
                out[sl] = b.build(batch).T
        return out.T

    def score(self, batch: pa.RecordBatch, beta: np.ndarray) -> np.ndarray:
        """build(batch) @ beta; indicator blocks are looked up instead of multiplied."""
        total = np.zeros(batch.num_rows)
        for block, sl in zip(self.blocks, self.slices):
            if hasattr(block, "codes"):
                total += np.r_[beta[sl], 0.0][block.codes(batch)]  # code -1 reads the appended 0
            else:
                total += block.build(batch) @ beta[sl]
        return total

    def check(self, limit: int = MAX_COLUMNS) -> None:
        if self.size > limit:
            raise ValueError(f"{self.size} basis columns; at most {limit} fit the driver's dense solve: use fewer bins or units")
