"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are lower-cased (Latin letters) runs of letters and digits, so case and punctuation do not matter. One pass counts the words of the test
items in the corpus. At each place of an item the seed is the shortest run of 3 to 8 words whose product of word frequencies is
below MAX_RATE (the longest, if none is): rare by its words, not by its own count, so a passage that a third of all documents
copy keeps its seeds. A second pass finds the seeds in the documents, takes the stretch around them, and aligns it with the item
(match +1, other word or gap -1, best local path). The score is the path's value over the item's words.

Items are taken in blocks of at most about BLOCK_ITEMS; a block's index is broadcast, and the documents are read once for each
block: a stated query set against all rows. There is no shuffle of documents.

Nulls and odd cases: null or empty items and texts match nothing; null ids are carried along; items of fewer than three words
are one seed; repeated rows give the same result each; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, as_texts, gram_hashes, pick, slices, small_batches, stored, table
from .registry import query

SEED, LONGEST_SEED = 3, 8
MAX_RATE = 1e-8
THRESHOLD = 0.5
BLOCK_ITEMS = 20_000
FILTER_BITS = 22


class Index:
    """Seeds of a block of items: by length, sorted hashes with their item and place."""

    def __init__(self, ids: list, words: list[np.ndarray], rate: dict[int, float]):
        self.ids, self.words = ids, words
        found = defaultdict(list)
        for item, own in enumerate(words):
            n = len(own)
            logs = np.log10([rate.get(int(w), 0.0) + 1e-15 for w in own])
            for at in range(max(1, n - SEED + 1) if n else 0):
                length = min(SEED, n - at)
                while length < min(LONGEST_SEED, n - at) and logs[at : at + length].sum() > np.log10(MAX_RATE):
                    length += 1
                found[length].append((int(gram_hashes(own[at : at + length], length)[0]), item, at))
        self.seeds = {}
        for length, rows in sorted(found.items()):
            rows.sort()
            hashes = np.array([r[0] for r in rows], dtype=np.uint64)
            sieve = np.zeros(1 << FILTER_BITS, dtype=bool)
            sieve[hashes & np.uint64((1 << FILTER_BITS) - 1)] = True
            self.seeds[length] = (hashes, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.packbits(sieve))

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, place in item) of all seeds in a run of word hashes; may cross texts."""
        out = []
        for length, (seeds, items, at, sieve) in self.seeds.items():
            grams = gram_hashes(hashes, length)
            low = grams & np.uint64((1 << FILTER_BITS) - 1)
            place = np.flatnonzero(sieve[low >> np.uint64(3)] >> (np.uint64(7) - (low & np.uint64(7))).astype(np.uint8) & 1)
            first, last = np.searchsorted(seeds, grams[place]), np.searchsorted(seeds, grams[place], "right")
            many = last - first
            which = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            out.append((np.repeat(place, many), items[which], at[which], np.full(len(which), length)))
        place, items, at, length = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, dtype=np.int64)] * 4
        return place, items, at, length

    def matches(self, texts: Texts, threshold: float) -> list[tuple]:
        """(text, item, score, first word, last word, first word of item, last word of item), the best of each text and item."""
        words = texts.fold().words(spaces=False)
        hashes = words.hashes()
        place, items, at, length = self.hits(hashes)
        doc = np.searchsorted(words.bounds, place, "right") - 1
        inside = place + length <= words.bounds[doc + 1]
        place, items, at, doc = place[inside], items[inside], at[inside], doc[inside]
        order = np.lexsort((place - at, items, doc))
        best: dict[tuple[int, int], tuple] = {}
        todo = []
        for d, item, diagonal in zip(doc[order].tolist(), items[order].tolist(), (place - at)[order].tolist()):
            n = len(self.words[item])
            if todo and todo[-1][:2] == [d, item] and diagonal - todo[-1][3] <= n:
                todo[-1][3] = diagonal
            else:
                todo.append([d, item, diagonal, diagonal])
        for d, item, low, high in todo:
            own = self.words[item]
            slack = len(own) // 4 + 2
            begin, end = max(int(words.bounds[d]), low - slack), min(int(words.bounds[d + 1]), high + len(own) + slack)
            value, i, j = align(own, hashes[begin:end])
            score = value / len(own)
            if score < threshold or (d, item) in best and best[d, item][2] >= score:
                continue
            _, back_i, back_j = align(own[: i + 1][::-1], hashes[begin : begin + j + 1][::-1])
            shift = begin - int(words.bounds[d])
            best[d, item] = (d, item, score, shift + j - back_j, shift + j, i - back_i, i)
        return list(best.values())


def align(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """Best local path: its value, and its last word in the item and in the stretch (the first such of equal ones)."""
    n = len(stretch)
    steps = np.arange(1, n + 1)
    row = np.zeros(n + 1, dtype=np.int64)
    best, where = 0, (0, 0)
    for i, word in enumerate(item):
        now = np.maximum(row[:-1] + np.where(stretch == word, 1, -1), row[1:] - 1)
        now = np.maximum.accumulate(np.maximum(now, 0) + steps) - steps
        j = int(now.argmax())
        if now[j] > best:
            best, where = int(now[j]), (i, j)
        row[1:] = now
    return best, *where


def _count_words(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    for _, texts in slices(batches):
        hashes = texts.fold().words(spaces=False).hashes()
        at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
        hit = at[vocabulary[at] == hashes]
        counts = np.bincount(hit, minlength=len(vocabulary))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"word": pa.array(np.append(some, -1), pa.int64()), "n": pa.array(np.append(counts[some], len(hashes)), pa.int64())})


def item_blocks(items: DataFrame, size: int = BLOCK_ITEMS) -> Iterator[list]:
    """The items in blocks of about ``size`` rows."""
    rows = pick(items, "item_id", "text")
    blocks = max(1, -(-rows.count() // size))
    for block in range(blocks):
        yield rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()


def build_index(docs: DataFrame, block: list) -> Index | None:
    """Index of a block of items, with word rates from all documents."""
    texts = as_texts(pa.array([r["text"] for r in block], pa.string())).fold().words(spaces=False)
    hashes = texts.hashes()
    words = [hashes[a:b] for a, b in zip(texts.bounds, texts.bounds[1:])]
    vocabulary = np.unique(hashes)
    if not len(vocabulary):
        return None
    small_batches(docs.sparkSession)
    counted = pick(docs, "text").mapInArrow(lambda b: _count_words(b, vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r["word"]: r["n"] for r in counted.collect()}  # one row per word of the block at most
    total = max(counts.pop(-1, 0), 1)
    return Index([r["item_id"] for r in block], words, {int(vocabulary[k]): n / total for k, n in counts.items()})


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text), (item_id, text) -> doc_id, item_id, score, first_word, last_word, item_first, item_last; a row per leak."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, first_word long, last_word long, item_first long, item_last long"
    out = spark.createDataFrame([], schema)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in item_blocks(items):
        index = build_index(rows, block)
        if index is None:
            continue
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, texts in slices(batches):
                found = shared.value.matches(texts, threshold)
                ids = batch.column("doc_id").to_pylist()
                columns = list(zip(*[(ids[d], shared.value.ids[item], *rest) for d, item, *rest in found])) or [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.float64()] + [pa.int64()] * 4
                names = ["doc_id", "item_id", "score", "first_word", "last_word", "item_first", "item_last"]
                yield pa.RecordBatch.from_pydict({n: pa.array(list(c), k) for n, c, k in zip(names, columns, kinds)})

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The documents in which no item was found, unchanged; word rates are those of all ``docs``.

    One block of items is a filter in one scan. With more, each block's leaking texts are found by a scan of its own, written as
    SHA-256, and their documents left out by one anti join; so the scans grow with the blocks and equal texts are treated alike.
    """
    spark = docs.sparkSession
    found = (build_index(docs, block) for block in item_blocks(items, block_items))
    blocks = [spark.sparkContext.broadcast(index) for index in found if index is not None]
    if not blocks:
        return docs
    if len(blocks) == 1:
        return docs.mapInArrow(lambda b: _clean(b, blocks[0], threshold), docs.schema)
    texts = pick(docs, "text")
    leaks = reduce(DataFrame.unionByName, [texts.mapInArrow(lambda b, one=one: _leaking(b, one, threshold), "leak binary") for one in blocks])
    leaks = stored(leaks.distinct(), "leaking-texts")
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names may differ in case only
    digest = F.unhex(F.sha2(F.col(f"c{names.index('text')}").cast("binary"), 256))
    return rows.join(leaks, digest == F.col("leak"), "left_anti").toDF(*names)


def _clean(batches: Iterator[pa.RecordBatch], index, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        clean = np.ones(len(texts), dtype=bool)
        clean[[m[0] for m in index.value.matches(texts, threshold)]] = False
        yield batch.filter(pa.array(clean))


def _leaking(batches: Iterator[pa.RecordBatch], index, threshold: float) -> Iterator[pa.RecordBatch]:
    for _, texts in slices(batches):
        found = {m[0] for m in index.value.matches(texts, threshold)}
        yield pa.RecordBatch.from_pydict({"leak": pa.array([hashlib.sha256(texts.text(d)).digest() for d in sorted(found)], pa.binary())})


@query("op1_benchmark_leaks")
def op1_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
