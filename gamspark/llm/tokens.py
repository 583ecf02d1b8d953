"""Token-ID output: documents as token ids in shards, each a wavelet matrix in one compressed file.

Documents are dealt into ranges of ascending id; each range is encoded in order and cut into shards of whole documents of about
SHARD_TOKENS ids. A shard is one row of a Parquet file of its own (``maxRecordsPerFile``): document ids, lengths, bit-planes and
rank directory, so one file answers access, count and locate. Writing goes through Spark's committer: a lost executor leaves no
half file. Nothing passes through the driver; a task holds a shard and its longest document.

Encoding is cached by pieces between places where the pattern always begins a new token; each distinct piece is encoded once
per worker (cache of bounded size).

Nulls and odd cases: a null text is empty (only the end id); null ids come last; rows with the same id are separate documents,
ordered by text; an empty table gives no files to read and an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_folder
from .common import SLICE_BYTES, Texts, hash_ranges, one_by_one, pick, slices, small_batches, table
from .registry import query
from .wavelet import WaveletMatrix

END_ID = 0
SHARD_TOKENS = 1 << 20
CACHE_PIECES = 1 << 20
CHUNK_BYTES = 1 << 16
SHARD_SCHEMA = (
    "part int, seq int, n_tokens long, doc_ids array<long>, lengths array<int>, planes binary, zeros array<long>, ranks binary"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceEncoder:
    """Encodes texts of a byte-level tokenizer piece by piece, with a cache (an open-addressing table of piece hashes).

    Texts are cut where the byte-level pattern always begins a new token: before a space that a visible character follows,
    between letters and ASCII punctuation, and after a single line end.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism; threads would hold memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.levels = max(1, max(vocab.values(), default=1).bit_length())
        self.dtype = np.uint16 if self.levels <= 16 else np.uint32
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids of tokens that begin with a space
        self.opens[[i for token, i in vocab.items() if token.startswith("Ġ")]] = True
        special = {c for t in self.tokenizer.get_added_tokens_decoder().values() for c in t.content.encode()}
        #: After a space, these bytes surely begin a character that is no white space.
        self.visible = np.zeros(256, dtype=bool)
        self.visible[0x21:0x7F] = self.visible[0xC3:0xE1] = self.visible[0xE4:0xF5] = True
        self.letter = np.zeros(256, dtype=bool)
        self.letter[0x41:0x5B] = self.letter[0x61:0x7B] = True
        mark = np.array([0x21 <= b < 0x7F and not chr(b).isalnum() and b != 0x27 and b not in special for b in range(256)])
        self.mark = mark
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot_of = np.zeros(2 * CACHE_PIECES, np.uint64), np.zeros(2 * CACHE_PIECES, np.int32)
        self.at, self.length, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.dtype)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        out, begin = [], 0
        while begin < len(texts):  # little at a time, as the library's results are much larger than the ids
            end, size = begin, 0
            while end < len(texts) and size < CHUNK_BYTES:
                size += len(texts[end])
                end += 1
            out += [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts[begin:end], add_special_tokens=False)]
            begin = end
        return out

    def _encode_plain(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for pieces with one space, at their start: joined, and cut before tokens that begin with a space."""
        length = ends - starts
        begin = np.cumsum(length) - length
        joined = data[np.repeat(starts - begin, length) + np.arange(int(length.sum()))].tobytes()
        cuts = np.append(begin[np.flatnonzero(np.diff(begin // CHUNK_BYTES, prepend=-1))], len(joined)).tolist()
        ids = np.concatenate(self._encode([joined[a:b].decode() for a, b in zip(cuts, cuts[1:])]) or [np.zeros(0, self.dtype)])
        opens = np.flatnonzero(self.opens[ids])
        if len(opens) == len(starts) and (not len(opens) or opens[0] == 0):
            return ids, np.diff(np.append(opens, len(ids)))
        each = self._encode([joined[a : a + n].decode() for a, n in zip(begin.tolist(), length.tolist())])
        return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        spaces = np.concatenate([[0], np.cumsum(data == 0x20, dtype=np.int32)])
        plain = (data[np.minimum(starts, len(data) - 1)] == 0x20) & (spaces[ends] - spaces[starts] == 1)
        ids, count = self._encode_plain(data, starts[plain], ends[plain])
        other = self._encode([data[a:b].tobytes().decode() for a, b in zip(starts[~plain].tolist(), ends[~plain].tolist())])
        length = np.concatenate([count, np.array([len(x) for x in other], dtype=np.int64)])
        keys = np.concatenate([keys[plain], keys[~plain]])
        new = np.arange(len(self.at), len(self.at) + len(keys), dtype=np.int32)
        self.at = np.concatenate([self.at, (len(self.ids) + np.cumsum(length) - length).astype(np.int32)])
        self.length = np.concatenate([self.length, length.astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids, *other])
        todo, step = np.arange(len(keys)), 0
        while len(todo):  # each takes the next free slot; of several for one slot, the first
            slot = (keys[todo] + np.uint64(step)).astype(np.int64) & (len(self.keys) - 1)
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            take = free[first]
            self.keys[slot[take]], self.slot_of[slot[take]] = keys[todo[take]], new[todo[take]]
            todo, step = np.delete(todo, take), step + 1

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each piece in the cache, -1 where it is not there."""
        slot = keys.astype(np.int64) & (len(self.keys) - 1)
        there = self.keys[slot]
        out = np.where(there == keys, self.slot_of[slot], -1)
        todo, step = np.flatnonzero((there != keys) & (there != 0)), 1
        while len(todo):
            slot = (keys[todo] + np.uint64(step)).astype(np.int64) & (len(self.keys) - 1)
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.slot_of[slot[hit]]
            todo, step = todo[~hit & (there != 0)], step + 1
        return out

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data) + 1, dtype=bool)
        if len(data):
            here, before = data[1:], data[:-1]
            visible, mark = self.visible[data], self.mark[data]
            cut[: len(data) - 1] = (before == 0x20) & visible[1:]
            letter = self.letter[data]
            accent = np.zeros(len(data), dtype=bool)  # last byte of a letter of U+00C0 to U+00FF
            accent[1:] = (before == 0xC3) & (here != 0x97) & (here != 0xB7)
            cut[1:-1] |= (letter[:-1] | accent[:-1]) & mark[1:] | mark[:-1] & letter[1:]
            cut[2:-1] |= (data[1:-1] == 0x0A) & visible[:-2] & (self.letter | self.mark)[data[2:]] & (data[:-2] < 0x80)
            cut[offsets] = True
        cut[len(data)] = False
        return np.flatnonzero(cut)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, END_ID after each, and the ids per text."""
        data, offsets = texts.data, texts.offsets
        starts = self._cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys = hash_ranges(data, starts, ends) | np.uint64(1)
        place = self._find(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            distinct, first = np.unique(keys[new], return_index=True)
            if len(self.at) + len(distinct) > CACHE_PIECES:
                self.clear()
                distinct, first = np.unique(keys, return_index=True)
                new = np.arange(len(keys))
                if len(distinct) > CACHE_PIECES:  # one very long text may hold that many pieces
                    return self._encode_whole(texts)
            self._learn(distinct, data, starts[new[first]], ends[new[first]])
            place[new] = self._find(keys[new])
        length, at = self.length[place].astype(np.int64), self.at[place]
        begin = np.cumsum(length) - length
        total = int(length.sum())
        ids = self.ids[np.repeat(at - begin, length) + np.arange(total)]
        ends_of = np.append(begin, total)[np.searchsorted(starts, offsets)]
        return np.insert(ids, ends_of[1:], END_ID), np.diff(ends_of) + 1

    def _encode_whole(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        each = [np.append(x, self.dtype(END_ID)) for x in self._encode([texts.text(i).decode() for i in range(len(texts))])]
        return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)


_ENCODERS: dict[str, PieceEncoder] = {}


def _shard(part: int, seq: int, ids: list, lengths: list, doc_ids: list, levels: int) -> pa.RecordBatch:
    tokens = np.concatenate(ids)
    planes, zeros, ranks = WaveletMatrix.build(tokens, levels).to_bytes()
    row = {
        "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_tokens": pa.array([len(tokens)], pa.int64()),
        "doc_ids": pa.array([[x for d in doc_ids for x in d]], pa.list_(pa.int64())),
        "lengths": pa.array([np.concatenate(lengths)], pa.list_(pa.int32())),
        "planes": pa.array([planes], pa.binary()), "zeros": pa.array([zeros], pa.list_(pa.int64())), "ranks": pa.array([ranks], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(row)


def write_shards(docs: DataFrame, path: str, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes ``docs`` (doc_id, text) into shard files below ``path``."""
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(tokenizer) or _ENCODERS.setdefault(tokenizer, PieceEncoder(tokenizer))
        part, seq, size, ids, lengths, doc_ids = TaskContext.get().partitionId(), 0, 0, [], [], []
        for rows, texts in slices(batches, size=SLICE_BYTES // 4):
            got, length = encoder.encode(texts)
            ids.append(got)
            lengths.append(length.astype(np.int32))
            doc_ids.append(rows.column("doc_id").to_pylist())
            size += len(got)
            if size >= shard_tokens:
                yield _shard(part, seq, ids, lengths, doc_ids, encoder.levels)
                seq, size, ids, lengths, doc_ids = seq + 1, 0, [], [], []
        if ids:
            yield _shard(part, seq, ids, lengths, doc_ids, encoder.levels)

    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = rows.repartitionByRange(order[0]).sortWithinPartitions(*order)
    ranged.mapInArrow(encode, SHARD_SCHEMA).write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix.from_bytes(row["n_tokens"], row["planes"], row["zeros"], row["ranks"])


def _shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, before): ids of all shards before. Sums per part first, then over parts."""
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    heads = parts.select("part", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("head"))
    return sizes.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(heads, "part").select(
        "part", "seq", (F.col("head") + F.col("inner")).alias("before")
    )


def read_documents(shards: DataFrame) -> DataFrame:
    """Reads shards back: doc_id, start, n_tokens, ids_crc32 of the ids as little-endian unsigned 32-bit integers."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in one_by_one(batch):
                raw = memoryview(_matrix(row).decode().astype("<u4")).cast("B")
                ends = np.cumsum(row["lengths"])
                begins = ends - row["lengths"]
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                n = len(crcs)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()), "part": pa.array([row["part"]] * n, pa.int32()),
                        "seq": pa.array([row["seq"]] * n, pa.int32()), "inner": pa.array(begins, pa.int64()),
                        "n_tokens": pa.array(row["lengths"], pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()),
                    }
                )

    rows = shards.mapInArrow(decode, "doc_id long, part int, seq int, inner long, n_tokens long, ids_crc32 long")
    return rows.join(_shard_starts(shards), ["part", "seq"]).select(
        "doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"
    )


def find_token(shards: DataFrame, token: int) -> DataFrame:
    """(start): global positions of a token, by select in each shard."""

    def find(batches):
        for batch in batches:
            for row in one_by_one(batch):
                at = _matrix(row).locate(token)
                yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]] * len(at), pa.int32()), "seq": pa.array([row["seq"]] * len(at), pa.int32()), "inner": pa.array(at, pa.int64())})

    return shards.mapInArrow(find, "part int, seq int, inner long").join(_shard_starts(shards), ["part", "seq"]).select((F.col("before") + F.col("inner")).alias("start"))


def count_token(shards: DataFrame, token: int) -> DataFrame:
    """(n): how often a token occurs, by rank in each shard."""

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([_matrix(row).count(token) for row in one_by_one(batch)], pa.int64())})

    return shards.mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes ``docs`` as shards to the shared folder and reads the files back."""
    path = new_folder(docs.sparkSession, "tokens")
    write_shards(docs, path, tokenizer or default_tokenizer())
    return read_documents(read_shards(docs.sparkSession, path))


@query("op6_token_output")
def op6_token_output(spark: SparkSession, folder: str) -> DataFrame:
    return token_output(table(spark, folder, "documents"))
