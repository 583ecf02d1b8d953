"""Best-fit packing by large-item matching: pieces of documents into sequences of at most ``capacity`` tokens.

1. Documents are encoded in one narrow scan into pieces (a longer one is cut into whole sequences, its first piece being the rest),
   written with their ids and with a number among the pieces of the same length of their task.
2. The plan needs only how many pieces there are of each length, at most ``capacity`` numbers. Pieces above a third of the capacity
   go at most two to a sequence: from the longest down, each is paired with the longest that still fits, which gives the most pairs.
   Then the others, from the longest down, go where the gap is least, or open a new sequence. Pieces of one length are planned all
   at once: a step fills a run of equal sequences, so the plan has some thousand steps whatever the number of documents.
3. A piece's rank among those of its length says which step it belongs to, and so its sequence and place. Ranks are prefix counts
   over tasks; only narrow rows are shuffled, ids are not.

Nulls and odd cases: a null text is empty (only the end id); null and repeated ids are documents like others, ranks do not depend on
ids; very long texts are encoded whole, in bounded slices; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, pick, slices, small_batches, stored, table
from .registry import query
from .tokens import PieceEncoder, default_tokenizer

CAPACITY = 2048
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary, task long, seq long"
_ENCODERS: dict[str, PieceEncoder] = {}


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, begin and length of each piece: whole sequences from the end, the rest (if any) first."""
    count = -(-lengths // capacity)
    doc = np.repeat(np.arange(len(lengths)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = lengths - (count - 1) * capacity
    begin = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
    return doc, begin, np.where(piece == 0, first[doc], capacity)


def encode_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids (little-endian unsigned 32-bit), and task and seq for ``place``. Written."""
    small_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(tokenizer) or _ENCODERS.setdefault(tokenizer, PieceEncoder(tokenizer))
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for rows, texts in slices(batches, size=SLICE_BYTES // 4):
            ids, lengths = encoder.encode(texts)
            lengths = np.asarray(lengths, dtype=np.int64)
            doc, begin, length = cut(lengths, capacity)
            at = (np.cumsum(lengths) - lengths)[doc] + begin
            seq = np.empty(len(doc), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            new, counts = np.unique(length, return_counts=True)
            seq[order] = np.repeat(seen[new], counts) + np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            seen[new] += counts
            raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
            binary = [raw[4 * a : 4 * (a + n)].tobytes() for a, n in zip(at.tolist(), length.tolist())]
            number = np.arange(len(doc)) - np.searchsorted(doc, doc)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(begin, pa.int64()), pa.array(length, pa.int64()),
                    pa.array(binary, pa.binary()), pa.array(np.full(len(doc), task), pa.int64()), pa.array(seq, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids", "task", "seq"],
            )

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(encode, PIECE_SCHEMA), "pieces")


@dataclass
class Plan:
    """Steps by length: pieces from rank ``begin`` on go ``each`` to a sequence, from sequence ``first`` on, at ``offset``."""

    capacity: int
    sequences: int = 0
    steps: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    placed: dict[int, int] = field(default_factory=dict)

    def put(self, length: int, first: int, n: int, each: int, offset: int) -> None:
        begin = self.placed.get(length, 0)
        self.steps.setdefault(length, []).append((begin, first, each, offset))
        self.placed[length] = begin + n

    def open(self, n: int) -> int:
        first, self.sequences = self.sequences, self.sequences + n
        return first


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """Where the pieces of each length go, from how many there are."""
    plan = Plan(capacity)
    left = dict(sorted((k, n) for k, n in counts.items() if n > 0))
    large = [k for k in left if 3 * k > capacity]
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, number of sequences), sorted by gap
    for a in reversed(large):
        for b in reversed(large):
            if left[a] == 0:
                break
            if b > a or a + b > capacity or left[b] == 0:
                continue
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if not n:
                continue
            first = plan.open(n)
            plan.put(a, first, n, 1, 0)
            plan.put(b, first, n, 1, a)
            left[a] -= n
            left[b] -= n
            if a + b < capacity:
                gaps.append((capacity - a - b, first, n))
        if left[a]:
            first = plan.open(left[a])
            plan.put(a, first, left[a], 1, 0)
            if a < capacity:
                gaps.append((capacity - a, first, left[a]))
            left[a] = 0
    gaps.sort()
    for s in reversed([k for k in left if 3 * k <= capacity]):
        while left[s]:
            at = bisect.bisect_left(gaps, (s, -1, -1))
            if at == len(gaps):
                fit = capacity // s
                bisect.insort(gaps, (capacity, plan.open(-(-left[s] // fit)), -(-left[s] // fit)))
                at = bisect.bisect_left(gaps, (capacity, -1, -1))
            gap, first, n = gaps.pop(at)
            fit = gap // s
            full = min(n, left[s] // fit)  # sequences that take as many of these as go in
            if full:
                plan.put(s, first, full * fit, fit, capacity - gap)
                left[s] -= full * fit
                if gap > fit * s:
                    bisect.insort(gaps, (gap - fit * s, first, full))
            if full < n and left[s] and left[s] < fit:
                plan.put(s, first + full, left[s], fit, capacity - gap)
                bisect.insort(gaps, (gap - left[s] * s, first + full, 1))
                left[s], full = 0, full + 1
            if full < n:
                bisect.insort(gaps, (gap, first + full, n - full))
    return plan


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset instead of task and seq. What else they carry is shuffled along."""
    spark = pieces.sparkSession
    sizes = stored(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    steps = {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for k, v in plan_packing(counts, capacity).steps.items()}
    known = spark.sparkContext.broadcast(steps)  # bounded by the capacity, not by the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for k in np.unique(length).tolist():
                rows = np.flatnonzero(length == k)
                begin, first, each, at = known.value[k]
                step = np.searchsorted(begin, rank[rows], side="right") - 1
                inside = rank[rows] - begin[step]
                sequence[rows] = first[step] + inside // each[step]
                offset[rows] = at[step] + inside % each[step] * k
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("task", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("seq"))
    keep = [f for f in pieces.schema.fields if f.name not in ("task", "seq")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return ranked.select(*[f.name for f in keep], "rank").mapInArrow(run, f"{schema}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """Placed pieces with ids -> (sequence_id, ids, parts): whole sequences, and the length, document and piece of each part in order."""
    part = F.struct("offset", "length", "doc_id", "piece", "ids")
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))  # at most ``capacity`` ids
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda all_ids, p: F.concat(all_ids, p["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), F.transform("parts", lambda p: F.struct(p["offset"], p["length"], p["doc_id"], p["piece"])).alias("parts"))


@query("op13_best_fit_packing")
def op13_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = encode_pieces(table(spark, folder, "documents"))
    return place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
