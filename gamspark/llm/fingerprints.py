"""Document fingerprints from closed syncmers.

A k-mer (K bytes) is a closed syncmer if the least hash of the S-byte strings in it is that of its first or last one. Whether it
is one depends on the k-mer alone, so an edit changes no anchors but those that overlap it. Anchors are the distinct syncmer hashes
below a fixed share (SHARE) of all hashes, so their number grows with the text and a passage of some 50 words brings about seven of
its own wherever it stands; a text with fewer than ANCHORS of them has its ANCHORS least hashes (all, if it has no more). The
fingerprint is the anchors in text order (by first place), eight hex digits each; a text without syncmers has one anchor, its own
hash; an empty text has an empty fingerprint. Likeness of two fingerprints: of the hashes of either up to the least bound to which
both are complete, the share that both have in the same order (longest increasing run of places).

``compare_edits`` also makes, for every document, an edited text: its last third replaced by the beginning of the next document.
Documents are dealt by ranges of the id; each range is sorted, and the first document of the next range is copied to its end, so
one shuffle of the texts is enough and each text meets its neighbour in one task.

Nulls and odd cases: a null text is empty; null ids come last (one range); rows with the same id are separate documents, ordered
by a hash of the text, then the text; a single document is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Texts, mix64, pick, small_batches, table
from .registry import query

K, S = 16, 6
ANCHORS = 64
SHARE = 1 << 29  # of 2**32 hashes
RANGE_BYTES = 16 << 20


def syncmers(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Places and 32-bit hashes of the closed syncmers of all texts."""
    data = texts.data
    if len(data) < K:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    chunks = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    inner = (mix64(chunks[: len(data) - S + 1] & np.uint64((1 << (8 * S)) - 1)) >> np.uint64(32)).astype(np.uint32)
    width = K - S + 1
    least, have = inner, 1
    while have * 2 <= width:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    rest = width - have
    least = np.minimum(least[: len(least) - rest], least[rest:])
    at = np.flatnonzero((least == inner[: len(least)]) | (least == inner[width - 1 :]))
    ends = texts.offsets[np.searchsorted(texts.offsets, at, "right")]
    at = at[at + K <= ends]
    hashes = mix64(mix64(chunks[at]) * np.uint64(0x9E3779B97F4A7C15) ^ chunks[at + 8]) >> np.uint64(32)
    return at, hashes.astype(np.uint32)


def fingerprints(texts: Texts, anchors: int = ANCHORS) -> list[list[int]]:
    """Anchors of each text, in text order."""
    at, hashes = syncmers(texts)
    bounds = np.searchsorted(at, texts.offsets)
    n = np.diff(bounds)
    limit = np.clip((2 * anchors + 40) / np.maximum(n, 1) * 2.0**32, SHARE, 2.0**32)
    doc = np.repeat(np.arange(len(texts)), n)
    some = np.flatnonzero(hashes < limit[doc])  # the least ones of a long text are among these, unless it repeats itself
    order = some[np.lexsort((at[some], hashes[some], doc[some]))]
    starts = np.searchsorted(doc[order], np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        one = order[starts[i] : starts[i + 1]]
        chosen = _least(hashes[one], at[one], anchors)
        if len(chosen) < anchors and len(one) < n[i]:
            one = np.arange(bounds[i], bounds[i + 1])
            one = one[np.lexsort((at[one], hashes[one]))]
            chosen = _least(hashes[one], at[one], anchors)
        if not chosen and texts.offsets[i + 1] > texts.offsets[i]:
            chosen = [int.from_bytes(hashlib.blake2b(texts.text(i), digest_size=4).digest(), "big")]
        out.append(chosen)
    return out


def _least(hashes: np.ndarray, at: np.ndarray, anchors: int) -> list[int]:
    """Of hashes sorted with their places, the distinct ones below SHARE, or so many least ones if those are fewer, by first place."""
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    first = np.flatnonzero(new)
    first = first[: max(anchors, int(np.searchsorted(hashes[first], SHARE)))]
    return hashes[first[np.argsort(at[first])]].tolist()


def likeness(a: list[int], b: list[int], anchors: int = ANCHORS) -> float:
    """Share, from 0 to 1, of the hashes up to both texts' bounds that both have in the same order."""
    if a == b:
        return 1.0
    bound = min(_bound(a, anchors), _bound(b, anchors))
    a, b = [h for h in a if h <= bound], [h for h in b if h <= bound]
    place = {h: i for i, h in enumerate(b)}
    tails: list[int] = []
    common = 0
    for h in a:
        at = place.get(h)
        if at is None:
            continue
        common += 1
        if not tails or at > tails[-1]:
            tails.append(at)
        else:
            tails[bisect_left(tails, at)] = at
    return len(tails) / max(len(a) + len(b) - common, 1)


def _bound(one: list[int], anchors: int) -> int:
    """The largest hash up to which these anchors are all of their text's syncmers."""
    return 1 << 32 if len(one) < anchors else max(SHARE - 1, max(one))


def _texts(parts: list[bytes]) -> Texts:
    return Texts(np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]))


def _compare(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (copied, doc_id, text) in order; all but the last are looked at, each with the one behind it."""
    texts = [r[2] for r in rows]
    own = [i for i in range(len(rows) - 1) if not rows[i][0]]
    edited = []
    for i in own:
        third = len(texts[i]) // 3
        edited.append((texts[i][: len(texts[i]) - third] + texts[i + 1][:third]).encode())
    prints = fingerprints(_texts([t.encode() for t in texts]))
    edited_prints = fingerprints(_texts(edited))
    write = lambda anchors: "".join(f"{h:08x}" for h in anchors)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([rows[i][1] for i in own], pa.int64()), "n_chars": pa.array([len(texts[i]) for i in own], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            "fingerprint": pa.array([write(prints[i]) for i in own], pa.string()),
            "edited_fingerprint": pa.array([write(p) for p in edited_prints], pa.string()),
            "near_edited": pa.array([likeness(prints[i], p) for i, p in zip(own, edited_prints)], pa.float64()),
            "near_next": pa.array([likeness(prints[i], prints[i + 1]) for i in own], pa.float64()),
        }
    )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("copied", "doc_id", "text"))):
            waiting.append(row)
            size += len(row[2])
            if size >= SLICE_BYTES and len(waiting) > 1:
                yield _compare(waiting)
                waiting, size = waiting[-1:], len(row[2])
    if len(waiting) > 1:
        yield _compare(waiting)


def compare_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES, 2)
    steps = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("doc_id", steps, 100 * ranges)).first()[0] or []
    bounds = np.unique(np.array(cuts, dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        found = np.searchsorted(bounds, ids.where(known, 0).astype("int64"), "right")
        return pd.Series(np.where(known, len(bounds) - found, len(bounds) + 1), dtype="int32")

    ranged = rows.withColumn("range", range_of("doc_id"))
    # The first document of each range (at most one row a range comes to the driver) follows the last one of the range before.
    heads = [(r["range"], r["id"]) for r in ranged.select("range", "doc_id").groupBy("range").agg(F.max("doc_id").alias("id")).orderBy("range").collect()]
    before = [(i, heads[k - 1][0]) for k, (_, i) in enumerate(heads)]
    targets = spark.createDataFrame(before, "head_id long, target int")
    copies = rows.join(F.broadcast(targets), F.col("doc_id").eqNullSafe(F.col("head_id"))).select(F.lit(1).alias("copied"), "doc_id", "text", F.col("target").alias("range"))
    every = ranged.select(F.lit(0).alias("copied"), "doc_id", "text", "range").unionByName(copies)
    order = ["range", "copied", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text"]
    dealt = every.repartitionById(ranges + 2, "range").sortWithinPartitions(*order)  # a task has one range
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("copied", "doc_id", "text").mapInArrow(_neighbours, schema)


@query("op2_fingerprints")
def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return compare_edits(table(spark, folder, "documents"))
