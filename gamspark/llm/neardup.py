"""Near-duplicates by BagMinHash signatures of word shingles, banded and verified.

A document is the multiset of its shingles of five words (fewer words: one shingle of them all). Weighted Jaccard similarity is
the sum of the smaller counts over the sum of the larger.

Signature. Weights (counts) are cut into dyadic intervals (0, 1], (1, 2], (2, 4], ...; each shingle and interval has one Poisson
process of points, seeded by both, with the interval's length as rate. A point has a time, a slot and a level in its interval,
and counts if the level is within the weight: at least half of the points drawn do. A slot's value is the time of its first
point. So two documents agree in a slot with a probability of their weighted Jaccard similarity. Processes run up to a time at
which nearly always every slot has a point; documents with an empty slot go on to twice that time.

Grouping. Equal texts are one node. Nodes that agree in a band of ROWS slots share a bucket; at similarity 0.8 a pair misses all
BANDS buckets with probability 1e-7. Round 1 verifies each node of a bucket against the bucket's least node. Where that leaves
nodes of several components in touching buckets, round 2 compares all that are outside of the largest component with all the
others, in parts of bounded size. Every pair of a bucket that is not connected already is verified, yet no bucket's pairs are
written: a meeting of two parts gives a forest of links.

Nulls and odd cases: null and empty texts have no shingles and are copies of each other, null and empty alike; a null id is a
document like others, but names a class only if no member has an id; repeated rows are exact copies; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, gram_hashes, mix64, pick, slices, small_batches, stored, table
from .groups import components
from .registry import query

SHINGLE = 5
BANDS, ROWS = 40, 5
SLOTS = BANDS * ROWS
SIMILARITY = 0.8
SURPLUS = 4.0
#: Nodes to a part in round 2, and columns of its incidence matrix at a time.
PART, COLUMNS = 192, 4096
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each shingle, by text."""
    hashes = words.hashes()
    grams = gram_hashes(hashes, n)
    at = np.flatnonzero(words.grams_fit(n)[: len(grams)])
    doc, out = words.doc()[at] if len(at) else at, grams[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        whole = np.array([gram_hashes(hashes[words.bounds[i] : words.bounds[i + 1]], int(words.counts[i]))[0] for i in short], dtype=np.uint64)
        order = np.argsort(np.concatenate([doc, short]), kind="stable")
        doc, out = np.concatenate([doc, short])[order], np.concatenate([out, whole])[order]
    return doc, out


def counted(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return doc[first], hashes[first], np.diff(np.append(first, len(doc)))


def signatures(n_texts: int, doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """One row of slot values per text; texts without shingles have infinite values."""
    total = np.bincount(doc, weights=weights, minlength=n_texts)
    out = np.full(n_texts * slots, np.inf)
    limit = np.zeros(n_texts)
    limit[total > 0] = slots * (np.log(slots) + SURPLUS) / total[total > 0]
    wanted = total > 0
    while wanted.any():
        out.reshape(n_texts, slots)[wanted] = np.inf
        mine = wanted[doc]
        _run(out, slots, limit, doc[mine], hashes[mine], weights[mine])
        wanted &= np.isinf(out.reshape(n_texts, slots)).any(axis=1)
        limit[wanted] *= 2
    return out.reshape(n_texts, slots)


def _run(out: np.ndarray, slots: int, limit: np.ndarray, doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> None:
    parts, low, high = [], 0, 1
    while True:  # dyadic intervals; most shingles have the first only
        live = np.flatnonzero(weights > low)
        if not len(live):
            break
        parts.append((live, np.full(len(live), low, np.int64), np.full(len(live), high - low, np.int64)))
        low, high = high, 2 * high
    item, low, length = (np.concatenate(x) for x in zip(*parts))
    doc, weights = doc[item], weights[item]
    stream = mix64(hashes[item] ^ (low.astype(np.uint64) * GOLD + np.uint64(1)))
    time, step = np.zeros(len(item)), 0
    while len(time):
        step += 1
        draw = mix64(stream + np.uint64(int(GOLD) * step % 2**64))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
        on = time <= limit[doc]
        if not on.all():
            time, doc, weights, stream, low, length, draw = (x[on] for x in (time, doc, weights, stream, low, length, draw))
        where = mix64(draw ^ GOLD)
        level = low + 1 + ((where >> np.uint64(32)).astype(np.int64) % length)
        at = doc * slots + (where & np.uint64(0xFFFFFFFF)).astype(np.int64) % slots
        ok = level <= weights
        np.minimum.at(out, at[ok], time[ok])


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    cells = signature.view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLD, cells.shape[:2]).copy()
    for r in range(rows):
        key = mix64(key ^ cells[:, :, r]) + GOLD
    return key


def multiset(doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each occurrence as an element of its own, so that set overlap is multiset overlap; sorted within each text."""
    doc, hashes = np.repeat(doc, weights), np.repeat(hashes, weights)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(weights) - weights, weights)
    element = mix64(hashes + nth.astype(np.uint64) * GOLD)
    order = np.lexsort((element, doc))
    return doc[order], element[order]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in slices(batches):
        doc, hashes, weights = counted(*shingles(texts.words()))
        keys = band_keys(signatures(len(texts), doc, hashes, weights)).view(np.int64)
        size = np.bincount(doc, weights=weights, minlength=len(texts)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": rows.column("doc_id"), "text_key": pa.array([hashlib.md5(texts.text(i)).digest() for i in range(len(texts))], pa.binary()),
                "size": pa.array(size, pa.int64()), "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[size > 0].ravel())),
            }
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in slices(batches):
        doc, element = multiset(*counted(*shingles(texts.words())))
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        yield pa.RecordBatch.from_pydict(
            {"node": rows.column("node"), "elements": pa.array([element[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())}
        )


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            kept.append(common >= similarity * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose multisets are as similar as asked."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lambda b: _verify(b, similarity), "a long, b long")


def _forest(rows: pa.Table, similarity: float) -> pa.Table:
    """Links between labels that hold the nodes of two parts together as far as they are similar; no more than nodes less one."""
    nodes, label = rows.column("node").to_pylist(), rows.column("label").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("elements").to_pylist()]
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = many[column] > 1
    owner, column = owner[shared], (np.cumsum(many > 1) - 1)[column[shared]]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    for begin in range(0, width, COLUMNS):
        at = slice(*np.searchsorted(column, [begin, begin + COLUMNS]))
        has = np.zeros((len(sets), min(COLUMNS, width - begin)), dtype=np.float32)
        has[owner[at], column[at] - begin] = 1
        common += has @ has.T
    near = np.triu(common >= similarity * (size[:, None] + size[None, :] - common), 1)
    parent = {x: x for x in label}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    links = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
        x, y = find(label[i]), find(label[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            links.append((nodes[i], nodes[j]))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def across_labels(shared: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between nodes of different labels that share a bucket.

    Buckets that touch make a neighbourhood; its nodes are dealt to parts of about PART nodes, those of its largest label apart.
    Two parts meet if a bucket has nodes of both and not all of them are of the largest label. A meeting compares all its nodes
    at once and gives a forest of links, so neither pairs of nodes nor all links of a group are ever written.
    """
    star = shared.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    near = components(star).select("node", F.col("label").alias("area"))
    tab = stored(near.join(labels.hint("merge"), "node", "left").select("node", "area", F.coalesce("label", "node").alias("label")), "areas")
    most = tab.groupBy("area", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("area").agg(
        F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label")).alias("major"), F.sum("n").alias("all")
    )
    outside = F.col("label") != F.col("major.label")
    own = F.when(outside, F.col("all") - F.col("major.n")).otherwise(F.col("major.n"))
    number = F.pmod(F.xxhash64("node"), F.ceil(own / PART)) * 2 + outside.cast("long")  # odd numbers are outside
    placed = stored(tab.join(most.where("labels > 1").hint("merge"), "area").select("node", "area", "label", number.alias("part")), "parts")
    met = stored(shared.select("bucket", "node").join(placed.hint("merge"), "node").select("bucket", "area", "part").distinct(), "met")
    first = met.where("part % 2 = 1").select("bucket", F.col("part").alias("i"))
    second = met.select("bucket", "area", F.col("part").alias("j"))
    meetings = first.join(second.hint("merge"), "bucket").where("j % 2 = 0 OR i <= j").select("area", "i", "j").distinct()
    sides = meetings.withColumn("part", F.explode(F.array_distinct(F.array("i", "j"))))
    members = sides.join(placed.hint("merge"), ["area", "part"]).join(sets.hint("merge"), "node").select("area", "i", "j", "node", "label", "elements")
    return members.groupBy("area", "i", "j").applyInArrow(lambda t: _forest(t, similarity), "a long, b long")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) -> rows: doc_id, text_key, node; groups: node, label for nodes with a near-duplicate of another text."""
    small_batches(docs.sparkSession)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(rows.mapInArrow(_sign, "doc_id long, text_key binary, size long, bands array<long>"), "signed")
    nodes = stored(
        signed.groupBy("text_key").agg(F.min("doc_id").alias("of_id"), F.first("size").alias("size"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes"
    )
    banded = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    pivots = banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = stored(banded.join(pivots.hint("merge"), "bucket").select("bucket", "node", "size", "pivot"), "buckets")
    sizes = nodes.select(F.col("node").alias("pivot"), F.col("size").alias("pivot_size"))
    first = shared.where("node <> pivot").select("node", "pivot", "size").distinct().join(sizes.hint("merge"), "pivot")
    fits = F.least("size", "pivot_size") >= similarity * F.greatest("size", "pivot_size")
    first = stored(first.where(fits).select(F.col("node").alias("a"), F.col("pivot").alias("b")), "pairs")
    wanted = shared.select("node").distinct().join(nodes.select("node", "text_key", "of_id").hint("merge"), "node")
    chosen = rows.withColumn("text_key", F.unhex(F.md5(F.coalesce("text", F.lit(""))))).join(
        wanted.hint("merge").withColumnRenamed("text_key", "its_key"), (F.col("text_key") == F.col("its_key")) & F.col("doc_id").eqNullSafe(F.col("of_id"))
    )
    sets = stored(chosen.select("node", "text").mapInArrow(_sets, "node long, elements binary"), "sets").dropDuplicates(["node"])
    links = stored(verified(first, sets, similarity), "verified")
    labels = components(links)

    more = stored(across_labels(shared, labels, sets, similarity), "verified")
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    keyed = signed.select("doc_id", "text_key").join(nodes.select("text_key", "node").hint("merge"), "text_key")
    return keyed, labels


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (least id of the class), class_size, text_id (least id with the same text), kept; a row per document."""
    rows, labels = classes(docs, similarity)
    full = rows.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    full = stored(full.select("doc_id", "node", "label"), "classes")
    texts = full.groupBy("node", "label").agg(F.min("doc_id").alias("text_id"), F.count(F.lit(1)).alias("n"))
    whole = texts.groupBy("label").agg(F.min("text_id").alias("class_id"), F.sum("n").alias("class_size"))
    per_node = texts.join(whole.hint("merge"), "label").select("node", "class_id", "class_size", "text_id")
    return full.join(per_node.hint("merge"), "node").select(
        "doc_id", "class_id", "class_size", "text_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept")
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without those that repeat another's text nearly or fully: of each class one row with the least id stays."""
    rows, labels = classes(docs, similarity)
    full = rows.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    least = stored(full.groupBy("label").agg(F.min(place).alias("one")).select(F.col("one.doc_id").alias("its_id"), F.col("one.text_key").alias("its_key")), "kept")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("key"))
    kept = keyed.join(least.hint("merge"), F.col("id").eqNullSafe(F.col("its_id")) & (F.col("key") == F.col("its_key")))
    return kept.dropDuplicates(["id", "key"]).select("row.*")


@query("op8_near_duplicates")
def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
