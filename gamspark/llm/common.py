"""What the operators share: word extraction and hashing over Arrow text, and places to write to.

Texts are looked at as the UTF-8 bytes of an Arrow column. Batches are cut into slices of bounded bytes, so
memory depends on the slice and the longest text, never on the number of rows in a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder

SLICE_BYTES = 4 << 20
BATCH_ROWS = 1000
U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes outside `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z are lower-cased: word bytes are 0-9, a-z, 128-255.
_MARK = np.ones(256, dtype=bool)
_MARK[0x30:0x3A] = _MARK[0x61:0x7B] = _MARK[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=U64)
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
LONG_WORD = 64


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (fixed constants)."""
    x = x ^ (x >> U64(33))
    x = x * _M1
    x ^= x >> U64(33)
    x *= _M2
    x ^= x >> U64(33)
    return x


class Texts:
    """Texts of one slice as bytes: ``data``, ``offsets`` (one more than texts). Nulls are empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Texts:
        return Texts(LOWER[self.data], self.offsets)

    def fold(self) -> Texts:
        """A-Z and the capitals of U+00C0 to U+00DE lower-cased."""
        data = LOWER[self.data]
        capital = np.zeros(len(data), dtype=bool)
        capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[capital] += 0x20
        return Texts(data, self.offsets)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, spaces: bool = True) -> Words:
        """``spaces``: words `[^\\x20\\x09-\\x0D]+`; else `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`."""
        gap = (_SPACE if spaces else _MARK)[self.data]
        n = len(gap)
        first, last = np.ones(n + 1, dtype=bool), np.ones(n, dtype=bool)
        first[1:], last[:-1] = gap, gap[1:]
        first[self.offsets] = True  # a text begins
        last[self.offsets[1:][self.offsets[1:] > 0] - 1] = True  # a text ends
        keep = ~gap
        starts = np.flatnonzero(first[:n] & keep)
        ends = np.flatnonzero(last & keep) + 1
        return Words(self, starts, ends, np.searchsorted(starts, self.offsets))


class Words:
    """Words of a slice: byte ranges, and ``bounds[i]:bounds[i + 1]`` are the words of text i."""

    def __init__(self, texts: Texts, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray):
        self.texts, self.starts, self.ends, self.bounds = texts, starts, ends, bounds

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return hash_ranges(self.texts.data, self.starts, self.ends, seed)

    def word(self, i: int) -> bytes:
        return self.texts.data[self.starts[i] : self.ends[i]].tobytes()

    def grams_fit(self, n: int) -> np.ndarray:
        """Whether n words of the same text stand from here on."""
        end = np.repeat(self.bounds[1:], self.counts)
        return np.arange(len(self)) + n <= end


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes a step; longer words than LONG_WORD go through BLAKE2."""
    lengths = (ends - starts).astype(np.int64)
    out = np.full(len(starts), U64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % 2**64), dtype=U64)
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    chunks = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out ^= lengths.astype(U64) * _M2
    out = mix64(out ^ (chunks[starts] & _KEEP[np.minimum(lengths, 8)]))
    live, at = np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD)), 8
    while len(live):
        left = np.minimum(lengths[live] - at, 8)
        out[live] = mix64(out[live] * U64(0x9E3779B97F4A7C15) ^ (chunks[starts[live] + at] & _KEEP[left]))
        at += 8
        live = live[lengths[live] > at]
    for i in np.flatnonzero(lengths > LONG_WORD):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
        out[i] = U64(int.from_bytes(digest.digest(), "little"))
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes (runs cross texts; see ``grams_fit``). The last n - 1 places are missing."""
    base = U64(0x9E3779B97F4A7C15)
    if len(words) < n:
        return np.zeros(0, dtype=U64)

    def power(k: int) -> np.uint64:
        return U64(pow(int(base), k, 2**64))

    def run(k: int) -> np.ndarray:
        if k == 1:
            return words
        half = run(k // 2)
        out = half[: len(half) - k // 2] * power(k // 2) + half[k // 2 :]
        return out if k % 2 == 0 else out[: len(words) - k + 1] * base + words[k - 1 :]

    return mix64(run(n))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    if len(x) < width:
        return x[:0]
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def text_array(column: pa.Array) -> pa.Array:
    """The column as large strings without nulls (null: empty)."""
    return column.cast(pa.large_string()).fill_null("")


def as_texts(column: pa.Array) -> Texts:
    column = text_array(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Runs of rows with about ``size`` bytes of text (at least one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = as_texts(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(texts.offsets, texts.offsets[begin] + size, "right")) - 1)
            at = texts.offsets[begin : end + 1]
            yield batch.slice(begin, end - begin), Texts(texts.data[at[0] : at[-1]], at - at[0])
            begin = end


def stored(df: DataFrame, kind: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later steps do not redo it after a lost executor."""
    path = new_folder(df.sparkSession, kind)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Batches for Python of at most BATCH_ROWS rows, as texts may be long. Every operator here sets the same."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch whose rows are large, each copied only when it is its turn."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name, whatever other columns there are: of names that differ in case only the one that is
    spelled so, of the same name twice the first."""
    lower = [n.lower() for n in docs.columns]
    if all(lower.count(n.lower()) <= 1 for n in names):
        return docs.select(*[F.col(f"`{n}`") for n in names])
    at = [docs.columns.index(n) for n in names]
    return docs.toDF(*[f"c{i}" for i in range(len(lower))]).select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names)])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
