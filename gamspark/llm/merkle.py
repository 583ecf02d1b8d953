"""Merkle dataset manifest by butterfly exchange: every row gets its leaf, the roots above it and the proof that ties it to the root.

1. Leaves are hashed in one narrow scan; only ids and digests go on. A range shuffle by group and order numbers the leaves of each
   group, and aligned runs of ``fanout ** k`` leaves (about LEAVES) become blocks, each with the root of its own subtree.
2. Butterfly: in round r, the blocks of a group whose numbers agree in all digits but digit r (base ``fanout``) meet, at most
   ``fanout`` of them, and swap the roots of their subtrees. Each hashes the next ancestor for itself and notes the others as its
   siblings; after all rounds each block has the root and its whole upper proof, without a pass down. In a ragged last subtree
   with fewer blocks than places, its blocks also stand in for the missing ones, so a round sends less than two messages a block.
3. The roots of the groups are the leaves of one more such tree, by the same code.
4. Blocks hash their inner levels once more and give each leaf its proof: inner levels, upper levels, levels above the group.

No group is gathered: a task holds one block. Rounds are few (the logarithm of the number of blocks) and small (a row a block).

Nulls and odd cases: a null group is a group of its own, before all others; a null id comes first; rows of the same id are ordered by
their leaf, and equal rows, whose leaves are equal, in any order; empty and very long texts are hashed like any other; other columns
are not looked at; an empty table gives an empty result. A lone leaf is its group's root, a lone group's root is the root.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, stored, table
from .registry import query

LEAVES = 4096
TASK_LEAVES = 1 << 17
CUT_ROUNDS = 6
CHUNK = 512
STEP_TYPE = pa.struct([("pos", pa.int32()), ("siblings", pa.list_(pa.string()))])
PROOF = "array<struct<pos:int,siblings:array<string>>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(columns: Sequence[Column]) -> Column:
    """SHA-256 of the values: `-` for null, else the number of UTF-8 bytes, a colon and the value."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""

    def step(node: Column, s: Column) -> Column:
        before, after = F.slice(s["siblings"], F.lit(1), s["pos"]), F.slice(s["siblings"], s["pos"] + 1, F.size(s["siblings"]))
        return F.sha2(F.concat_ws("", before, node, after), 256)

    return F.aggregate(proof, leaf, step)


def depth(n: int, fanout: int) -> int:
    """Levels above n leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // fanout), out + 1
    return out


def block_levels(fanout: int, leaves: int = LEAVES) -> int:
    """Levels of a block of at most ``leaves`` leaves, one level at least."""
    out = 1
    while fanout ** (out + 1) <= leaves:
        out += 1
    return out


def _inner(leaves: list[str], total: int, fanout: int, most: int) -> list[list[str]]:
    """Nodes of a block, level by level up to its root: a run of one is hashed too as long as its group has more nodes."""
    levels = [leaves]
    for _ in range(min(most, depth(total, fanout))):
        below = levels[-1]
        levels.append([digest(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def _blocks(rows: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """(grp, order, leaf, ...) -> (grp, block, total, rows): aligned blocks of each group's leaves, in order."""
    rows = stored(rows, "leaves")
    tasks = max(1, math.ceil(rows.count() / TASK_LEAVES))
    keys = ["grp", *order, "leaf", "spread"]  # of equal rows any order will do, but they need not be in one task
    ranged = rows.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    placed = stored(ranged.drop("spread").withColumn("place", F.monotonically_increasing_id()), "places")  # task, then row of the task
    placed = placed.withColumn("task", F.shiftright("place", 33))
    starts = placed.groupBy("grp", "task").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("grp")
    before = F.sum("n").over(group.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("grp", "task", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(group).alias("total"))
    rank = F.col("place") - F.col("first") + F.col("before")
    ranked = placed.join(starts, ["grp", "task"]).withColumn("rank", rank).withColumn("block", F.floor(F.col("rank") / size).cast("long"))
    content = F.struct("rank", *[n for n in rows.columns if n != "grp"])
    packed = ranked.repartition(tasks, "grp", "block").groupBy("grp", "block").agg(F.first("total").alias("total"), F.sort_array(F.collect_list(content)).alias("rows"))
    return stored(packed, "blocks")


def _block_roots(blocks: DataFrame, fanout: int, most: int) -> DataFrame:
    """(grp, block, n_blocks, node, path): the subtree root of each block, and nothing above it yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = batch.column("total").to_pylist()
            nodes = [_inner(leaves.as_py(), n, fanout, most)[-1][0] for leaves, n in zip(batch.column("leaf"), totals)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("grp"), batch.column("block"), batch.column("total"), pa.array(nodes, pa.string())], ["grp", "block", "total", "node"]
            )

    size = fanout**most
    roots = blocks.select("grp", "block", "total", F.col("rows.leaf").alias("leaf")).mapInArrow(run, "grp string, block long, total long, node string")
    return roots.select("grp", "block", F.ceil(F.col("total") / size).cast("long").alias("n_blocks"), "node", F.array().cast(PROOF).alias("path"))


def butterfly(state: DataFrame, fanout: int) -> DataFrame:
    """(grp, block, n_blocks, node, path) -> the same, with the group's root as node and the whole upper proof as path."""
    state = stored(state, "round")
    most = state.agg(F.max("n_blocks")).first()[0] or 0
    for r in range(depth(most, fanout)):
        state = _exchange(state, fanout, fanout**r)
        if r % CUT_ROUNDS == CUT_ROUNDS - 1:
            state = stored(state, "round")
    return stored(state, "round") if most > 1 else state


def _exchange(state: DataFrame, fanout: int, step: int) -> DataFrame:
    """One round: ``step`` is the number of blocks below a node that is swapped."""
    block, n = F.col("block"), F.col("n_blocks")
    at = state.withColumn("sub", F.floor(block / step).cast("long")).withColumn("low", block % step).withColumn("last", F.floor((n - 1) / step).cast("long"))
    digit, high, have = (F.col("sub") % fanout).cast("int"), F.floor(F.col("sub") / fanout).cast("long"), n - F.col("last") * step
    ragged = (F.col("sub") == F.col("last")) & (digit > 0) & (have < step)
    slots = F.when(ragged, F.sequence(F.col("low"), F.lit(step - 1).cast("long"), have)).otherwise(F.array("low"))
    sent = at.select("grp", "n_blocks", (F.col("last") > 0).alias("open"), high.alias("high"), digit.alias("digit"), "node", "low", "block", "path", F.explode(slots).alias("slot"))
    mine = F.col("slot") == F.col("low")  # the others only stand in
    member = F.struct("digit", "node", F.when(mine, F.col("block")).alias("block"), F.when(mine, F.col("path")).alias("path"))
    met = sent.groupBy("grp", "high", "slot").agg(F.first("n_blocks").alias("n_blocks"), F.first("open").alias("open"), F.sort_array(F.collect_list(member)).alias("met"))
    own = met.withColumn("own", F.explode(F.filter("met", lambda m: m["block"].isNotNull())))
    others = F.transform(F.filter("met", lambda m: m["digit"] != F.col("own.digit")), lambda m: m["node"])
    step_up = F.array(F.struct(F.col("own.digit").alias("pos"), others.alias("siblings")))
    return own.select(
        "grp", F.col("own.block").alias("block"), "n_blocks",
        F.when(F.col("open"), F.sha2(F.concat_ws("", F.col("met.node")), 256)).otherwise(F.col("own.node")).alias("node"),
        F.when(F.col("open"), F.concat("own.path", step_up)).otherwise(F.col("own.path")).alias("path"),
    )


def _steps(levels: list[list[str]], fanout: int) -> tuple[list[int], list[str], list[int]]:
    """Of every node but the root: its place in its run, and the others of the run."""
    pos, siblings, ends = [], [], [0]
    for nodes in levels[:-1]:
        for start in range(0, len(nodes), fanout):
            run = nodes[start : start + fanout]
            for i in range(len(run)):
                pos.append(i)
                siblings += run[:i] + run[i + 1 :]
                ends.append(len(siblings))
    return pos, siblings, ends


def _proofs(blocks: DataFrame, upper: DataFrame, fanout: int, most: int) -> DataFrame:
    """A row per leaf: what the blocks carry, and what ``upper`` has for the block (subroot, root, path), with the whole proof."""
    inside = blocks.schema["rows"].dataType.elementType
    names = [f.name for f in inside.fields if f.name != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inside.fields if f.name != "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                rows, above = one.column("rows").flatten(), one.column("path").flatten().cast(STEP_TYPE)
                content = dict(zip([f.name for f in rows.type], rows.flatten()))
                levels = _inner(content["leaf"].to_pylist(), one.column("total")[0].as_py(), fanout, most)
                pos, siblings, ends = _steps(levels, fanout)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(siblings, pa.string()))
                own = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), lists], fields=list(STEP_TYPE))
                steps = pa.concat_arrays([own, above])
                first = np.cumsum([0] + [len(x) for x in levels[:-1]])  # begin of each level, at last of the steps above
                leaf, span = np.arange(len(rows)), fanout ** np.arange(len(levels) - 1)
                index = np.concatenate([leaf[:, None] // span + first[:-1], np.broadcast_to(first[-1] + np.arange(len(above)), (len(rows), len(above)))], axis=1)
                width = index.shape[1]
                for a in range(0, len(rows), CHUNK):
                    part = index[a : a + CHUNK]
                    flat = steps.take(pa.array(part.ravel(), pa.int64()))
                    proof = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), flat)
                    same = [pa.array([one.column(c)[0].as_py()] * len(part), pa.string()) for c in ("subroot", "root")]
                    yield pa.RecordBatch.from_arrays([content[n].slice(a, CHUNK) for n in names] + same + [proof], [*names, "subroot", "root", "proof"])

    return blocks.join(upper, ["grp", "block"]).mapInArrow(run, f"{schema}, subroot string, root string, proof {PROOF}")


def manifest(rows: DataFrame, leaf: Column, group: str, order: str, carry: dict[str, Column] | None = None, fanout: int = 16,
             block_leaves: int = LEAVES) -> DataFrame:
    """A row per row of ``rows``: ``order``, ``carry``, leaf, subroot (root of its group), root and proof, from the leaf up: the
    place in each run and the digests of the run's others."""
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))  # null first
    carry = {name: c.alias(name) for name, c in (carry or {}).items()}
    leaves = rows.select(key.alias("grp"), F.col(f"`{order}`"), leaf.alias("leaf"), *carry.values())
    most = block_levels(fanout, block_leaves)
    blocks = _blocks(leaves, [order], fanout**most)
    state = butterfly(_block_roots(blocks, fanout, most), fanout)
    groups = _blocks(state.where("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("node").alias("leaf")), ["key"], fanout**most)
    top = butterfly(_block_roots(groups, fanout, most), fanout)
    roots = _proofs(groups, top.select("grp", "block", F.col("node").alias("subroot"), F.col("node").alias("root"), "path"), fanout, most)
    above = roots.select(F.col("key").alias("grp"), F.col("leaf").alias("subroot"), "root", F.col("proof").alias("above"))
    upper = state.join(above, "grp").select("grp", "block", "subroot", "root", F.concat("path", "above").alias("path"))
    return _proofs(blocks, upper, fanout, most)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_manifest(docs: DataFrame, fanout: int = 16, block_leaves: int = LEAVES) -> DataFrame:
    """Manifest of documents by lang and doc_id; ``tampered`` is the leaf of a row whose id 7 divides (CRC-32) with 1 added to n_chars."""
    rows = pick(docs, *FIELDS).select(*[F.col(n).cast("long") if n in ("doc_id", "n_chars") else F.col(n).cast("string") for n in FIELDS])
    hit = F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    tampered = F.when(hit, leaf_hash([F.col(n) + 1 if n == "n_chars" else F.col(n) for n in FIELDS]))
    return manifest(rows, leaf_hash([F.col(n) for n in FIELDS]), "lang", "doc_id", {"tampered": tampered}, fanout, block_leaves)


def checked(found: DataFrame) -> DataFrame:
    """Digests of a document manifest's proofs, and whether the (tampered) leaf leads to the root."""
    siblings = F.flatten(F.transform("proof", lambda s: s["siblings"]))
    found = found.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", siblings), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _sql_levels(name: str, leaves: str, count: int) -> str:
    """CTEs of the nodes (g, i, c, h) of each level, and of the way of each leaf: p, the siblings so far, and f, the folded digest."""
    out = [f"{name}0 AS MATERIALIZED (SELECT g, i, c, h FROM {leaves})", f"{name}w0 AS (SELECT id, g, i, c, f, '' AS p FROM {leaves})"]
    for k in range(count):
        out.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT g, i // 2 AS i, (c + 1) // 2 AS c, CASE WHEN c > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h "
            f"FROM {name}{k} GROUP BY g, i // 2, c)"
        )
        out.append(
            f"{name}w{k + 1} AS (SELECT id, w.g, w.i // 2 AS i, (w.c + 1) // 2 AS c, w.p || coalesce(s.h, '') AS p, CASE WHEN w.c = 1 THEN f "
            f"WHEN w.i % 2 = 0 THEN sha256(f || coalesce(s.h, '')) ELSE sha256(s.h || f) END AS f FROM {name}w{k} w LEFT JOIN {name}{k} s ON s.g = w.g AND s.i = xor(w.i, 1))"
        )
    return ", ".join(out)


def _sql_leaf(add: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST(n_chars + {add} AS VARCHAR)", "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


#: CRC-32 of an ASCII string, a bit at a time.
CRC_SQL = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({0}, ''), lambda ch: CAST(unicode(ch) AS BIGINT))), "
    "lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, e: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"
)
#: Levels are written out: enough for a million documents of a language and 256 languages.
SQL = f"""WITH r AS (SELECT *, {_sql_leaf("0")} AS h, coalesce('=' || lang, '') AS g, {CRC_SQL.format("CAST(doc_id AS VARCHAR)")} % 7 = 0 AS hit FROM documents),
l AS MATERIALIZED (SELECT doc_id, h, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS c,
    CASE WHEN hit THEN {_sql_leaf("1")} ELSE h END AS f, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, h) AS id FROM r),
{_sql_levels("a", "l", 20)},
t AS MATERIALIZED (SELECT g AS id, '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS c, h, h AS f FROM a20),
{_sql_levels("b", "t", 8)},
u AS (SELECT l.doc_id, l.h, w.f, w.p, t.id AS g, t.h AS subroot, t.i, t.c FROM l JOIN aw20 w USING (id) JOIN t ON t.id = l.g),
z0 AS (SELECT doc_id, h AS leaf, subroot, f, i, c, p FROM u),
{", ".join(
    f"z{k + 1} AS (SELECT doc_id, leaf, subroot, z.i // 2 AS i, (z.c + 1) // 2 AS c, z.p || coalesce(s.h, '') AS p, CASE WHEN z.c = 1 THEN f "
    f"WHEN z.i % 2 = 0 THEN sha256(f || coalesce(s.h, '')) ELSE sha256(s.h || f) END AS f FROM z{k} z LEFT JOIN b{k} s ON s.i = xor(z.i, 1))" for k in range(8)
)}
SELECT doc_id, leaf, subroot, b8.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = b8.h AS verified FROM z8, b8"""


@query("op11_merkle_manifest", SQL)
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return checked(document_manifest(table(spark, folder, "documents"), fanout=2))
