"""LM scoring by online logistic context mixing over word codes.

The model codes each token as binary decisions on a Huffman tree of the CODED most frequent words; all other words share one
leaf and then have the base model's probability among themselves. Predictors give the log odds of each decision: the word's
frequency, and counts in tables hashed by the decision with the previous word, the previous two words, and the last frequent
word. A logistic mixer with a set of weights for each gate (how often both word contexts have been seen) adds them up. Weights
are learned in one pass over all training documents, each left out of its own counts, and while a document is read its own copy
follows the coding cost turn by turn. The sum of the decisions' and leaves' log10 probabilities is the score; bits per byte too.

Corpus counts. Documents are packed into blocks of words as numbers; a block sends its distinct words (64-bit hashes) with their
training counts to ranges of the hash, which add up and send every block its totals: one exchange of distinct words, not of
tokens. Tables are counted in tasks of BLOCKS_PER_TASK blocks and merged in two steps, as whole sums; they, the code and the weights are of
fixed size and are broadcast.

Nulls and odd cases: null and empty texts are the end token alone; a null id counts as the empty text for the hold-out hash;
without training documents all probabilities are those of N = V = 0; rows with the same id are separate; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing_model as M
from .common import one_by_one, pick, slices, small_batches, stored, table
from .registry import query
from .toxicity import held_out

ALPHA = 0.1
CODED = 8191
END = 0x656E64  # the end token's key; words have hashes
BLOCK_BYTES = 8 << 20
RANGE_WORDS = 1 << 21
BLOCKS_PER_TASK = 8
SLICE_CELLS = 1 << 16
RUN_TOKENS = 1 << 17
TURN_TOKENS = 64
DOCUMENT_RATE = 0.5
LEARN_PASSES = 2
BLOCK_SCHEMA = "block long, n_docs int, doc_ids binary, no_id binary, held binary, sizes binary, lengths binary, tokens binary, words binary, counts binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq, size, waiting = TaskContext.get().partitionId(), 0, 0, []

    def block() -> pa.RecordBatch:
        ids, none, held, sizes, lengths, hashes = (np.concatenate(x) for x in zip(*waiting))
        words, inverse = np.unique(hashes, return_inverse=True)
        train = np.repeat(held == 0, lengths)
        total, counts = np.bincount(inverse, minlength=len(words)), np.bincount(inverse[train], minlength=len(words))
        order = np.argsort(-total, kind="stable")  # frequent words get small numbers
        number = np.empty(len(words), dtype=np.uint32)
        number[order] = np.arange(len(words), dtype=np.uint32)
        row = [ids.astype("<i8"), none.astype(np.uint8), held.astype(np.uint8), sizes.astype("<i8"), lengths.astype("<i4"), number[inverse], words[order], counts[order].astype("<i4")]
        names = ["doc_ids", "no_id", "held", "sizes", "lengths", "tokens", "words", "counts"]
        out = {"block": pa.array([part << 32 | seq], pa.int64()), "n_docs": pa.array([len(ids)], pa.int32())}
        return pa.RecordBatch.from_pydict(out | {n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(names, row)})

    for rows, texts in slices(batches):
        words = texts.lower().words()
        ends = words.bounds[1:]
        hashes = np.insert(words.hashes(), ends, np.uint64(END))
        ids = rows.column("doc_id")
        none = np.asarray(ids.is_null().to_numpy(zero_copy_only=False))
        waiting.append((ids.fill_null(0).to_numpy(), none, rows.column("held").to_numpy(zero_copy_only=False), np.diff(texts.offsets), words.counts + 1, hashes))
        size += len(texts.data)
        if size >= BLOCK_BYTES:
            yield block()
            seq, size, waiting = seq + 1, 0, []
    if waiting:
        yield block()


def _arrays(row: dict) -> dict[str, np.ndarray]:
    kinds = {"doc_ids": "<i8", "no_id": "u1", "held": "u1", "sizes": "<i8", "lengths": "<i4", "tokens": "<u4", "words": "<u8", "counts": "<i4"}
    return {k: np.frombuffer(row[k], kind) for k, kind in kinds.items() if k in row}


def _range_of(words: np.ndarray, ranges: int) -> np.ndarray:
    return ((words >> np.uint64(20)) % np.uint64(ranges)).astype(np.int64)


def _send(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in one_by_one(batch):
            a = _arrays(row)
            of = _range_of(a["words"], ranges)
            order = np.argsort(of, kind="stable")
            bounds = np.searchsorted(of[order], np.arange(ranges + 1))
            some = np.flatnonzero(np.diff(bounds))
            yield pa.RecordBatch.from_pydict(
                {
                    "range": pa.array(some, pa.int32()), "block": pa.array([row["block"]] * len(some), pa.int64()),
                    "words": pa.array([a["words"][order[bounds[r] : bounds[r + 1]]].tobytes() for r in some], pa.binary()),
                    "counts": pa.array([a["counts"][order[bounds[r] : bounds[r + 1]]].tobytes() for r in some], pa.binary()),
                }
            )


def _totals(rows: pa.Table, coded: int) -> pa.Table:
    """Totals of a range's words for each block; in a row of its own (block -1) the range's sums and most frequent words."""
    blocks, words, counts = (rows.column(c).to_pylist() for c in ("block", "words", "counts"))
    words = [np.frombuffer(w, "<u8") for w in words]
    distinct, inverse = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([np.frombuffer(c, "<i4") for c in counts])).astype(np.int64)
    ends = np.cumsum([len(w) for w in words])
    back = [total[inverse[e - len(w) : e]].astype("<i8").tobytes() for e, w in zip(ends, words)]
    top = np.lexsort((distinct, -total))[:coded]
    top = top[total[top] > 0]
    nothing = [None] * len(blocks)
    return pa.table(
        {
            "block": pa.array([*blocks, -1], pa.int64()), "range": pa.array([rows.column("range")[0].as_py()] * (len(blocks) + 1), pa.int32()),
            "totals": pa.array([*back, None], pa.binary()), "n": pa.array([*nothing, int(total.sum())], pa.int64()),
            "v": pa.array([*nothing, int((total > 0).sum())], pa.int64()),
            "top_words": pa.array([*nothing, distinct[top].view(np.int64)], pa.list_(pa.int64())), "top_counts": pa.array([*nothing, total[top]], pa.list_(pa.int64())),
        }
    )


def _runs(a: dict[str, np.ndarray], wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents (numbers) in runs of about RUN_TOKENS tokens, with the places of their tokens."""
    ends = np.cumsum(a["lengths"])
    begin = 0
    while begin < len(wanted):
        size = np.cumsum(a["lengths"][wanted[begin:]])
        end = begin + max(1, int(np.searchsorted(size, RUN_TOKENS, "right")))
        docs = wanted[begin:end]
        lengths = a["lengths"][docs]
        at = np.repeat(ends[docs] - lengths - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        yield docs, at
        begin = end


def _run_events(code: M.Code, a: dict[str, np.ndarray], symbol_of: np.ndarray, docs: np.ndarray, at: np.ndarray) -> M.Events:
    number = a["tokens"][at]
    return M.events(code, symbol_of[number], a["words"][number], a["lengths"][docs].astype(np.int64), TURN_TOKENS)


def _pack(cells: np.ndarray) -> bytes:
    """A slice of counts, whole, in the narrowest width that holds its largest."""
    return cells.astype(np.min_scalar_type(int(cells.max())).newbyteorder("<")).tobytes()


def _unpack(cells: bytes) -> np.ndarray:
    return np.frombuffer(cells, f"<u{len(cells) // SLICE_CELLS}").astype(np.int64)


def _count_tables(batches: Iterator[pa.RecordBatch], code: M.Code) -> Iterator[pa.RecordBatch]:
    tables, part = M.new_tables(), TaskContext.get().partitionId()
    for batch in batches:
        for row in one_by_one(batch):
            a = _arrays(row)
            symbol_of = code.symbols(a["words"])
            for docs, at in _runs(a, np.flatnonzero(a["held"] == 0)):
                M.count_into(tables, _run_events(code, a, symbol_of, docs, at))
    for k, one in enumerate(tables):
        for s in range(0, len(one), SLICE_CELLS):
            cells = one[s : s + SLICE_CELLS]
            if cells.any():
                yield pa.RecordBatch.from_pydict({"tab": pa.array([k], pa.int32()), "at": pa.array([s], pa.int32()), "part": pa.array([part], pa.int32()), "cells": pa.array([_pack(cells)], pa.binary())})


def _add_cells(rows: pa.Table) -> pa.Table:
    total = sum(_unpack(c) for c in rows.column("cells").to_pylist())
    return pa.table({"tab": rows.column("tab").slice(0, 1), "at": rows.column("at").slice(0, 1), "cells": pa.array([_pack(total)], pa.binary())})


def _weight_sums(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    code, tables, weights, offsets = model.value
    predictors = M.Predictors.build(tables, leave_out=True)
    sums = np.zeros(M.N_SUMS)
    for batch in batches:
        for row in one_by_one(batch):
            a = _arrays(row)
            symbol_of = code.symbols(a["words"])
            for docs, at in _runs(a, np.flatnonzero(a["held"] == 0)):
                e = _run_events(code, a, symbol_of, docs, at)
                sums += M.weight_sums(*predictors.inputs(e), e, weights, offsets)
    yield pa.RecordBatch.from_pydict({"sums": pa.array([sums], pa.list_(pa.float64()))})


def learn_weights(blocks: DataFrame, code: M.Code, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the gates and offsets of the final stage: LEARN_PASSES Newton steps, each from sums over all training documents.
    A gate whose cost a step has raised goes back to its weights before."""
    weights, offsets = np.tile(M.START_WEIGHTS, (M.GATES, 1)), np.zeros((M.GATES, M.BUCKETS))
    before, before_cost = weights, np.full(M.GATES, np.inf)
    for _ in range(LEARN_PASSES):
        shared = blocks.sparkSession.sparkContext.broadcast((code, tables, weights, offsets))
        sums = blocks.mapInArrow(lambda b, shared=shared: _weight_sums(b, shared), "sums array<double>")
        rows = sums.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("sum")).orderBy("pos").collect()  # N_SUMS rows
        shared.destroy()
        if not rows:
            break
        cost, after, moved = M.newton_step(np.array([r["sum"] for r in rows]), weights, offsets)
        worse = cost > before_cost
        after[worse] = before[worse]
        before, before_cost = weights, np.minimum(cost, before_cost)
        weights, offsets = after, moved
    return weights, offsets


def _score(batches: Iterator[pa.RecordBatch], model, n: int, v: int, rest_n: int, rest_v: int, ranges: int) -> Iterator[pa.RecordBatch]:
    code, tables, weights, offsets = model.value
    predictors = M.Predictors.build(tables, leave_out=False)
    for batch in batches:
        for row in one_by_one(batch):
            a = _arrays(row)
            known = np.zeros(len(a["words"]), dtype=np.int64)
            of = _range_of(a["words"], ranges)
            for part in row["totals"]:
                known[of == part["range"]] = np.frombuffer(part["totals"], "<i8")
            base_of = np.log10((known + ALPHA) / (n + ALPHA * (v + 1)))
            symbol_of = code.symbols(a["words"])
            leaf_of = np.where(symbol_of == len(code.hashes), np.log10((known + ALPHA) / (rest_n + ALPHA * (rest_v + 1))), 0.0)
            n_docs = row["n_docs"]
            doc_of = np.repeat(np.arange(n_docs), a["lengths"])
            base = np.bincount(doc_of, weights=base_of[a["tokens"]], minlength=n_docs)
            n_known = np.bincount(doc_of, weights=known[a["tokens"]] > 0, minlength=n_docs).astype(np.int64)
            score = np.bincount(doc_of, weights=leaf_of[a["tokens"]], minlength=n_docs)
            for docs, at in _runs(a, np.arange(n_docs)):
                e = _run_events(code, a, symbol_of, docs, at)
                cost = M.mix(*predictors.inputs(e), e, len(docs), weights, offsets, DOCUMENT_RATE)
                score[docs] += np.bincount(e.doc, weights=cost, minlength=len(docs))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(a["doc_ids"], pa.int64(), mask=a["no_id"].astype(bool)), "held_out": pa.array(a["held"].astype(bool)),
                    "n_tokens": pa.array(a["lengths"], pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                    "train_tokens": pa.array(np.full(n_docs, n), pa.int64()), "base_score": pa.array(base), "score": pa.array(score),
                    "bits_per_byte": pa.array(-score / math.log10(2) / (a["sizes"] + 1)),
                }
            )


def lm_scores(docs: DataFrame, coded: int = CODED) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id"), 10).cast("int").alias("held"))
    blocks = stored(rows.mapInArrow(_blocks, BLOCK_SCHEMA), "lm-blocks")
    sizes = blocks.select(F.octet_length("words").alias("w")).agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("w"), F.lit(0)).alias("bytes")).first()
    ranges = max(4, math.ceil(sizes["bytes"] / 8 / RANGE_WORDS))
    sent = blocks.select("block", "words", "counts").mapInArrow(lambda b: _send(b, ranges), "range int, block long, words binary, counts binary")
    answer = "block long, range int, totals binary, n long, v long, top_words array<long>, top_counts array<long>"
    totals = stored(sent.groupBy("range").applyInArrow(lambda t: _totals(t, coded), answer), "lm-totals")
    own = totals.where("block = -1")
    sums = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n, v = sums["n"], sums["v"]
    ranked = own.select(F.explode(F.arrays_zip("top_words", "top_counts")).alias("w")).select("w.top_words", "w.top_counts")
    top = ranked.orderBy(F.desc("top_counts"), "top_words").limit(coded).collect()
    hashes, counts = np.array([r[0] for r in top], dtype=np.int64).view(np.uint64), np.array([r[1] for r in top], dtype=np.int64)
    rest_n, rest_v = n - int(counts.sum()), v - len(counts)
    code = M.Code.build(hashes, counts, rest_n)

    tasks = max(1, math.ceil(sizes["blocks"] / BLOCKS_PER_TASK))
    group = max(1, math.isqrt(tasks))
    parts = blocks.coalesce(tasks).mapInArrow(lambda b: _count_tables(b, code), "tab int, at int, part int, cells binary")
    cells = "tab int, at int, cells binary"
    merged = parts.withColumn("salt", F.col("part") % group).groupBy("tab", "at", "salt").applyInArrow(_add_cells, cells).groupBy("tab", "at").applyInArrow(_add_cells, cells)
    tables = M.new_tables()
    for r in merged.toLocalIterator():  # of fixed size
        tables[r["tab"]][r["at"] : r["at"] + SLICE_CELLS] = _unpack(r["cells"])
    tables = [t.astype(np.min_scalar_type(int(t.max()))) for t in tables]
    weights, offsets = learn_weights(blocks, code, tables)
    model = spark.sparkContext.broadcast((code, tables, weights, offsets))
    answers = totals.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("range", "totals")).alias("totals"))
    joined = blocks.drop("counts").join(answers.hint("merge"), "block")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return joined.mapInArrow(lambda b: _score(b, model, n, v, rest_n, rest_v, ranges), schema)


@query("op4_lm_score")
def op4_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(table(spark, folder, "documents"))
