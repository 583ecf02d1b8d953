"""Substring dedup: words covered by a 20-word window that also starts earlier are removed, exactly.

1. Count-min prefilter. Every window is known by its anchor, the least hash among the 8-word grams in it: equal windows have
   equal anchors, and neighbouring windows share one, so there are about a seventh as many anchors as words. Each task sketches
   its anchors (two rows of cells that count 0, 1, 2 or more); partition sketches are merged by blocks of cells in two steps.
   A merged count is at least the number of windows with that anchor, so a window that occurs twice always shows 2 or more.
2. Exact grouping. A second pass takes the windows whose cells both show 2 or more. Of equal windows in a slice only the first
   goes on, the others are marked at once; so a window that half of all documents share is sent once a slice. Windows meet by
   ranges of their hash (128 bits), the first start stays, the others are marked.
3. A third pass finishes documents without candidates; only the others' texts are shuffled, by id, to the marks, which are runs
   of starts. Nothing but shuffles is written, and no pass depends on how another one cut its slices.

The sketch has 4 cells for each expected anchor, at most 2**MAX_BITS in a row (256 MB in all); beyond some 40 GB of text it lets
more windows through to step 2, never fewer. Nulls and odd cases: a null or empty text has no words (sha256 of nothing); a null
id counts as the largest; rows with one id are ordered by a hash of their text, and rows equal in both count as the same place,
so neither removes the other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Words, gram_hashes, mix64, pick, slices, sliding_min, small_batches, table
from .registry import query

WINDOW, GRAM = 20, 8
MIN_BITS, MAX_BITS, BLOCK_BITS = 16, 30, 20
CELLS_PER_ANCHOR, BYTES_PER_ANCHOR = 4, 40
FLUSH_ANCHORS = 1 << 20
RANGE_WINDOWS = 1 << 20
LAST = np.iinfo(np.int64).max
SENT_SCHEMA = "bucket int, area int, ids binary, hashes binary, doc_of binary, at binary, h1 binary, h2 binary"
MARK_SCHEMA = "area int, ids binary, hashes binary, doc_of binary, at binary"
DOC_SCHEMA = "doc_id long, text_hash long, n_words long, kept_sha256 string, text string"


def window_keys(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window that fits into its text, and its anchor."""
    least = sliding_min(gram_hashes(hashes, GRAM), WINDOW - GRAM + 1)
    starts = np.flatnonzero(words.grams_fit(WINDOW)[: len(least)])
    return starts, least[starts]


def anchors(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Anchors of the windows, once for each place of an anchor."""
    starts, least = window_keys(words, hashes)
    grams = gram_hashes(hashes, GRAM)
    width = WINDOW - GRAM + 1
    padded = np.zeros(len(grams) + 2 * (width - 1), dtype=np.uint64)
    padded[starts + width - 1] = least
    most = ~sliding_min(~padded, width)[: len(grams)]  # largest anchor of the windows that hold the gram
    return grams[(most == grams) & (grams != 0)]


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    mixed = keys if row == 0 else (keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
    return (mixed & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _sketch(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    part, waiting, size = TaskContext.get().partitionId(), [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(waiting)
        for row in (0, 1):
            cell, count = np.unique(cells(keys, row, bits), return_counts=True)
            bounds = np.flatnonzero(np.diff(cell >> BLOCK_BITS, prepend=-1, append=1 << 40))
            for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                many = count[a:b] > 1
                own = cell[a:b] & np.uint32((1 << BLOCK_BITS) - 1)
                yield row, int(cell[a] >> BLOCK_BITS), own, own[many]

    def batch() -> pa.RecordBatch:
        rows = list(flush())
        return pa.RecordBatch.from_pydict(
            {
                "row": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int32()),
                "part": pa.array([part] * len(rows), pa.int32()),
                "once": pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary()),
                "twice": pa.array([r[3].astype("<u4").tobytes() for r in rows], pa.binary()),
            }
        )

    for _, texts in slices(batches):
        words = texts.words()
        waiting.append(anchors(words, words.hashes()))
        size += len(waiting[-1])
        if size >= FLUSH_ANCHORS:
            yield batch()
            waiting, size = [], 0
    if size:
        yield batch()


def _merge_cells(rows: pa.Table) -> pa.Table:
    """Partial sketches of one block, lists of cells to bitmaps: seen, and seen twice."""
    count = np.zeros(1 << BLOCK_BITS, dtype=np.uint8)
    for once, twice in zip(rows.column("once").to_pylist(), rows.column("twice").to_pylist()):
        one, two = np.frombuffer(once, "<u4"), np.frombuffer(twice, "<u4")
        count[one] = np.minimum(count[one] + 1, 2)
        count[two] = 2
    return _bitmaps(rows, np.packbits(count > 0), np.packbits(count > 1))


def _merge_bitmaps(rows: pa.Table) -> pa.Table:
    seen = twice = np.zeros(1 << (BLOCK_BITS - 3), dtype=np.uint8)
    for a, b in zip(rows.column("once").to_pylist(), rows.column("twice").to_pylist()):
        once = np.frombuffer(a, np.uint8)
        twice = twice | np.frombuffer(b, np.uint8) | (seen & once)
        seen = seen | once
    return _bitmaps(rows, seen, twice)


def _bitmaps(rows: pa.Table, seen: np.ndarray, twice: np.ndarray) -> pa.Table:
    return pa.table(
        {
            "row": rows.column("row").slice(0, 1), "block": rows.column("block").slice(0, 1),
            "once": pa.array([seen.tobytes()], pa.binary()), "twice": pa.array([twice.tobytes()], pa.binary()),
        }
    )


def sketch(docs: DataFrame, bits: int, size: int) -> np.ndarray:
    """Bitmap of cells that show two or more, by row: at most 2 * 2**MAX_BITS bits come to the driver."""
    parts = docs.mapInArrow(lambda b: _sketch(b, bits), "row int, block int, part int, once binary, twice binary")
    group = max(1, math.isqrt(size // SLICE_BYTES))  # so both merge steps take about as many parts
    merged = (
        parts.withColumn("salt", F.col("part") % group).groupBy("row", "block", "salt").applyInArrow(_merge_cells, "row int, block int, once binary, twice binary")
        .groupBy("row", "block").applyInArrow(_merge_bitmaps, "row int, block int, once binary, twice binary")
    )
    out = np.zeros((2, max(1, 1 << max(0, bits - BLOCK_BITS)), 1 << (BLOCK_BITS - 3)), dtype=np.uint8)
    for r in merged.select("row", "block", "twice").toLocalIterator():
        out[r["row"], r["block"]] = np.frombuffer(r["twice"], np.uint8)
    return out.reshape(2, -1)


def _shows_two(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(keys), dtype=bool)
    for row in (0, 1):
        cell = cells(keys, row, bits)
        out &= (bitmap[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _place_order(h1, h2, ids, hashes, at) -> np.ndarray:
    return np.lexsort((at, hashes, ids, h2, h1))


def _later(h1, h2, ids, hashes, at) -> tuple[np.ndarray, np.ndarray]:
    """Order by window and place; whether each in that order starts after the first of its window."""
    order = _place_order(h1, h2, ids, hashes, at)
    a, b = h1[order], h2[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    place = [x[order] for x in (ids, hashes, at)]
    return order, np.logical_or.reduce([p != p[head] for p in place])


def _text_hash(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _candidates(words: Words, hashes: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    starts, keys = window_keys(words, hashes)
    return starts[_shows_two(bitmap, keys, bits)]


def _by_area(ids: np.ndarray, hashes: np.ndarray, at: np.ndarray, areas: int) -> Iterator[dict]:
    """Marks packed by area: documents, and for each of them runs of starts. An area is a remainder of id and text hash together,
    so that the copies of one text are dealt to all areas."""
    area = (mix64(ids.view(np.uint64) ^ mix64(hashes.view(np.uint64))) % np.uint64(areas)).astype(np.int64)
    order = np.lexsort((at, ids, hashes, area))
    ids, hashes, at, area = ids[order], hashes[order], at[order], area[order]
    bounds = np.append(np.flatnonzero(np.diff(area, prepend=-1)), len(area)).tolist()
    for a, b in zip(bounds, bounds[1:]):
        change = np.ones(b - a, dtype=bool)
        change[1:] = (ids[a + 1 : b] != ids[a : b - 1]) | (hashes[a + 1 : b] != hashes[a : b - 1])
        own = np.cumsum(change) - 1
        first = change.copy()
        first[1:] |= np.diff(at[a:b]) > 1
        start = np.flatnonzero(first)
        last = np.append(start[1:], b - a) - 1
        yield {
            "area": int(area[a]), "ids": ids[a:b][change].astype("<i8").tobytes(), "hashes": hashes[a:b][change].astype("<i8").tobytes(),
            "doc_of": own[start].astype("<i4").tobytes(), "at": np.column_stack([at[a:b][start], at[a:b][last]]).astype("<i4").tobytes(),
        }


def _send(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, bits: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each slice: its first ones of equal candidate windows, by range of the hash, and the marks of the others."""
    schema = pa.schema([("bucket", pa.int32()), ("area", pa.int32())] + [(n, pa.binary()) for n in ("ids", "hashes", "doc_of", "at", "h1", "h2")])
    for rows, texts in slices(batches):
        words = texts.words()
        hashes = words.hashes()
        starts = _candidates(words, hashes, bitmap, bits)
        if not len(starts):
            continue
        doc = np.searchsorted(words.bounds, starts, "right") - 1
        h1, h2 = gram_hashes(hashes, WINDOW)[starts], gram_hashes(words.hashes(1), WINDOW)[starts]
        id_of = rows.column("doc_id").fill_null(LAST).to_numpy()
        hash_of = np.zeros(len(texts), dtype=np.int64)
        for i in np.unique(doc).tolist():
            hash_of[i] = _text_hash(texts.text(i))
        at = starts - words.bounds[doc]
        order, later = _later(h1, h2, id_of[doc], hash_of[doc], at)
        marked = order[later]
        out = [m | {"bucket": m["area"]} for m in _by_area(id_of[doc[marked]], hash_of[doc[marked]], at[marked], buckets)]
        send = np.sort(order[~later])
        bucket = ((h1 >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
        send = send[np.argsort(bucket[send], kind="stable")]
        bounds = np.append(np.flatnonzero(np.diff(bucket[send], prepend=-1)), len(send))
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            one = send[a:b]
            own, where = np.unique(doc[one], return_inverse=True)
            out.append(
                {
                    "bucket": int(bucket[one[0]]), "ids": id_of[own].astype("<i8").tobytes(), "hashes": hash_of[own].astype("<i8").tobytes(),
                    "doc_of": where.astype("<i4").tobytes(), "at": at[one].astype("<i4").tobytes(), "h1": h1[one].tobytes(), "h2": h2[one].tobytes(),
                }
            )
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _mark(rows: pa.Table, areas: int) -> pa.Table:
    """Windows of one range of hashes from all slices: those that start later than another, by area; slices' own marks as they are."""
    parts, out = [], []
    for r in rows.to_pylist():
        if r["h1"] is None:
            out.append({k: r[k] for k in ("area", "ids", "hashes", "doc_of", "at")})
            continue
        of = np.frombuffer(r["doc_of"], "<i4")
        places = (np.frombuffer(r["ids"], "<i8")[of], np.frombuffer(r["hashes"], "<i8")[of], np.frombuffer(r["at"], "<i4"))
        parts.append((np.frombuffer(r["h1"], np.uint64), np.frombuffer(r["h2"], np.uint64), *places))
    if parts:
        h1, h2, ids, hashes, at = (np.concatenate(x) for x in zip(*parts))
        order, later = _later(h1, h2, ids, hashes, at)
        marked = order[later]
        out += _by_area(ids[marked], hashes[marked], at[marked], areas)
    return pa.Table.from_pylist(out, schema=pa.schema([("area", pa.int32())] + [(n, pa.binary()) for n in ("ids", "hashes", "doc_of", "at")]))


def _gather(rows: pa.Table) -> pa.Table:
    """All marks of an area's documents, a row per document."""
    parts = []
    for r in rows.to_pylist():
        of = np.frombuffer(r["doc_of"], "<i4")
        parts.append((np.frombuffer(r["ids"], "<i8")[of], np.frombuffer(r["hashes"], "<i8")[of], np.frombuffer(r["at"], "<i4").reshape(-1, 2)))
    ids, hashes, runs = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, hashes))
    ids, hashes, runs = ids[order], hashes[order], runs[order]
    change = np.ones(len(ids), dtype=bool)
    change[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(change)
    marks = [runs[a:b].tobytes() for a, b in zip(first.tolist(), [*first[1:].tolist(), len(ids)])]
    return pa.table({"doc_key": pa.array(ids[first], pa.int64()), "hash_key": pa.array(hashes[first], pa.int64()), "marks": pa.array(marks, pa.binary())})


def _open(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Documents without candidates are finished; the others keep their text."""
    for rows, texts in slices(batches):
        words = texts.words()
        starts = _candidates(words, words.hashes(), bitmap, bits)
        has = np.zeros(len(texts), dtype=bool)
        has[np.searchsorted(words.bounds, starts, "right") - 1] = True
        raw = [texts.text(i) for i in range(len(texts))]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": rows.column("doc_id"), "text_hash": pa.array([_text_hash(t) if h else 0 for t, h in zip(raw, has)], pa.int64()),
                "n_words": pa.array(words.counts, pa.int64()), "kept_sha256": pa.array([None if h else _digest(t.split()) for t, h in zip(raw, has)], pa.string()),
                "text": pa.array([t.decode() if h else None for t, h in zip(raw, has)], pa.string()),
            }
        )


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, digests = [], []
        for text, n, digest, marks in zip(*(batch.column(c).to_pylist() for c in ("text", "n_words", "kept_sha256", "marks"))):
            if digest is not None:
                removed.append(0)
                digests.append(digest)
                continue
            change = np.zeros(n + 1, dtype=np.int64)
            first, last = np.frombuffer(marks or b"", "<i4").reshape(-1, 2).T
            np.add.at(change, first, 1)
            np.add.at(change, last + WINDOW, -1)
            gone = np.cumsum(change[:-1]) > 0
            removed.append(int(gone.sum()))
            digests.append(_digest([w for w, g in zip(text.encode().split(), gone.tolist()) if not g]))
        yield pa.RecordBatch.from_pydict(
            {"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(1, CELLS_PER_ANCHOR * size / BYTES_PER_ANCHOR)))))
    bitmap = spark.sparkContext.broadcast(sketch(rows, bits, size))
    buckets = max(8, math.ceil(size / 6 / RANGE_WINDOWS))
    marks = (
        rows.mapInArrow(lambda b: _send(b, bitmap.value, bits, buckets), SENT_SCHEMA)
        .groupBy("bucket").applyInArrow(lambda t: _mark(t, buckets), MARK_SCHEMA)
        .groupBy("area").applyInArrow(_gather, "doc_key long, hash_key long, marks binary")
    )
    opened = rows.mapInArrow(lambda b: _open(b, bitmap.value, bits), DOC_SCHEMA)
    joined = opened.join(marks, (F.coalesce("doc_id", F.lit(LAST)) == F.col("doc_key")) & (F.col("text_hash") == F.col("hash_key")), "left")
    return joined.select("doc_id", "n_words", "kept_sha256", "text", "marks").mapInArrow(_finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


@query("op10_repeats")
def op10_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"))
