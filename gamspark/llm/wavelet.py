"""A wavelet matrix: bit-planes of a token sequence with rank and select, small enough to answer from without decoding.

Plane 0 holds the highest bit of each token. Each further plane holds the next bit of the tokens in an order that puts those
with a 0 in the plane before first, otherwise unchanged. ``ranks`` has the number of ones before each block of a plane.
"""

from __future__ import annotations

import numpy as np

BLOCK = 2048


class WaveletMatrix:
    def __init__(self, n: int, planes: np.ndarray, zeros: np.ndarray, ranks: np.ndarray):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @property
    def levels(self) -> int:
        return len(self.zeros)

    @classmethod
    def build(cls, tokens: np.ndarray, levels: int) -> WaveletMatrix:
        n, width = len(tokens), -(-len(tokens) // BLOCK) * BLOCK // 8
        planes, zeros = np.zeros((levels, width), dtype=np.uint8), np.zeros(levels, dtype=np.int64)
        now = np.ascontiguousarray(tokens)
        for level in range(levels):
            one = (now >> (levels - 1 - level) & 1).astype(bool)
            bits = np.packbits(one)
            planes[level, : len(bits)] = bits
            left = now[~one]
            zeros[level] = len(left)
            now = np.concatenate([left, now[one]])
        return cls(n, planes, zeros, cls._directory(planes))

    @staticmethod
    def _directory(planes: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(planes.view(np.uint64)).reshape(len(planes), -1, BLOCK // 64).sum(axis=2, dtype=np.int64)
        out = np.zeros((len(planes), ones.shape[1] + 1), dtype=np.uint32)
        np.cumsum(ones, axis=1, out=out[:, 1:])
        return out

    def to_bytes(self) -> tuple[bytes, list[int], bytes]:
        return self.planes.tobytes(), self.zeros.tolist(), self.ranks.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, n: int, planes: bytes, zeros: list[int], ranks: bytes) -> WaveletMatrix:
        levels = len(zeros)
        return cls(
            n,
            np.frombuffer(planes, dtype=np.uint8).reshape(levels, -1),
            np.asarray(zeros, dtype=np.int64),
            np.frombuffer(ranks, dtype="<u4").reshape(levels, -1),
        )

    def bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return self.planes[level, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = np.asarray(at, dtype=np.int64)
        block = at // BLOCK
        out = self.ranks[level, block].astype(np.int64)
        words = self.planes[level].view(np.uint64)
        for k in range(BLOCK // 64):  # whole 64-bit words before the position
            word = block * (BLOCK // 64) + k
            full = (word + 1) * 64 <= at
            if not full.any():
                break
            out[full] += np.bitwise_count(words[word[full]])
        begin = at & ~np.int64(63)
        for k in range(8):
            byte = (begin >> 3) + k
            inside = np.clip(at - begin - 8 * k, 0, 8)
            some = inside > 0
            mask = (0xFF00 >> inside[some] & 0xFF).astype(np.uint8)
            out[some] += np.bitwise_count(self.planes[level, byte[some]] & mask)
        return out

    def select(self, level: int, one: int, nth: np.ndarray) -> np.ndarray:
        """Position of the nth one or zero (from 0)."""
        starts = np.arange(self.ranks.shape[1], dtype=np.int64) * BLOCK
        before = self.ranks[level].astype(np.int64)
        before = before if one else starts - before
        block = np.searchsorted(before, nth, "right") - 1
        out = np.empty(len(nth), dtype=np.int64)
        for b in np.unique(block):
            bits = np.unpackbits(self.planes[level, b * BLOCK // 8 : (b + 1) * BLOCK // 8])
            mine = block == b
            out[mine] = b * BLOCK + np.flatnonzero(bits == one)[nth[mine] - before[b]]
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """Tokens at the positions."""
        at = np.asarray(at, dtype=np.int64)
        out = np.zeros(len(at), dtype=np.uint32)
        for level in range(self.levels):
            one = self.bit(level, at).astype(bool)
            ones = self.rank(level, at)
            out = out << 1 | one
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return out

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            ones = self.rank(level, np.array([begin, end]))
            if token >> (self.levels - 1 - level) & 1:
                begin, end = (self.zeros[level] + ones).tolist()
            else:
                begin, end = begin - int(ones[0]), end - int(ones[1])
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often the token stands in [begin, end)."""
        low, high = self._range(token, begin, self.n if end is None else end)
        return high - low

    def locate(self, token: int) -> np.ndarray:
        """Positions of the token, ascending."""
        low, high = self._range(token, 0, self.n)
        at = np.arange(low, high, dtype=np.int64)
        for level in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - level) & 1
            at = self.select(level, one, at - self.zeros[level] if one else at)
        return np.sort(at)

    def decode(self) -> np.ndarray:
        """All tokens in order, from the lowest plane up."""
        now = np.zeros(self.n, dtype=np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n).astype(bool)
            out = np.empty_like(now)
            out[~one] = now[: self.zeros[level]]
            out[one] = now[self.zeros[level] :] | now.dtype.type(1 << (self.levels - 1 - level))
            now = out
        return now
