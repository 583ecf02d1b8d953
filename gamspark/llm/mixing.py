"""Mixing sources to target weights with a low-discrepancy schedule. DataFrame functions only.

Sources weigh 5, 2, 1, 5, ... in code point order and share ``share`` times all words. Each source is one shuffled stream of
words (documents in the order of a hash of their id), cut into blocks of equal words. A source's target gives its quota of
slots; quotas are laid side by side as cumulative weights, and the van der Corput sequence deals them out: slot ``i`` takes the
place that has the reversed bits of ``i``, places beyond the last quota are passed over. The place within the source's quota is
the rank of the slot in its source, and a rank takes the block of that number, once more from the start after the last.
No sort of slots, no window over a whole source: prefix sums go over buckets of the hash first.

Nulls and odd cases: a null or empty text has size 0 and takes no words; a null source is a source, the last; a null id sorts
as the empty string; rows with the same id are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, stored, table
from .registry import query

#: Weights of the sources in turn, and the share of all words that the mix takes.
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)
EPOCHS = 2
BLOCK_WORDS = 1024
BLOCKS_PER_SOURCE = 512
BUCKET_ROWS = 1024
CHUNK = 1 << 16


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` (null: 0)."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, "[\\x20\\x09-\\x0D]+"))).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) -> with pos, weight, target. One row per source, so windows over sources are small.

    Sources are taken in the order of limit over weight; one that its share would lift above its limit gets the limit, and
    what is left goes to the rest by weight.
    """
    over = Window.partitionBy(F.lit(0))
    by_name = over.orderBy(F.col("source").asc_nulls_last())
    before = over.orderBy("ratio", "pos").rowsBetween(Window.unboundedPreceding, -1)
    num, den = share
    return (
        sources.withColumn("pos", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("pos") - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left_words", num * F.sum("source_size").over(over) - den * F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(over) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", den * F.col("cap") * F.col("left_weight") <= F.col("weight") * F.col("left_words"))
        .withColumn("rest_words", F.max(F.when(~F.col("full"), F.struct(-F.col("ratio"), -F.col("pos"), "left_words", "left_weight"))).over(over))
        .withColumn(
            "target",
            F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
                (F.col("weight") * F.col("rest_words.left_words")).cast("double") / (den * F.col("rest_words.left_weight")).cast("double")
            ),
        )
        .select("source", "source_size", "pos", "weight", "target")
    )


def quotas(sources: DataFrame, block_words: int = BLOCK_WORDS, blocks: int = BLOCKS_PER_SOURCE, epochs: int = EPOCHS) -> DataFrame:
    """Adds block (words), n_blocks, quota (slots) and first (places of the sources before)."""
    first = Window.partitionBy(F.lit(0)).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("source_size") / blocks))).cast("long"))
        .withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
        .withColumn("quota", F.least(F.col("n_blocks") * epochs, F.floor(F.col("target") / F.col("block") + 0.5)).cast("long"))
        .withColumn("first", F.coalesce(F.sum("quota").over(first), F.lit(0)).cast("long"))
    )


def schedule(sources: DataFrame) -> DataFrame:
    """(pos, rank, block_no, slot): every slot of the mix. ``slot`` is the place's van der Corput index."""
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    bits = max(1, math.ceil(math.log2(max(total, 2))))
    chunks = sources.where("quota > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / CHUNK))))
    begin = F.col("chunk") * CHUNK
    ranks = chunks.repartition("pos", "chunk").withColumn(
        "rank", F.explode(F.sequence(begin, F.least(begin + (CHUNK - 1), F.col("quota") - 1)))
    )
    place = F.lpad(F.bin(F.col("first") + F.col("rank")), bits, "0")
    return ranks.select(
        "pos", "rank", (F.col("rank") % F.col("n_blocks")).alias("block_no"), F.conv(F.reverse(place), 2, 10).cast("long").alias("slot")
    )


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs: int = EPOCHS, block_words: int = BLOCK_WORDS, text_keys: bool = False) -> DataFrame:
    """(doc_id, text, source) -> doc_id, size, source_size, target, taken, source, first_slot; one row per input row.

    ``text_keys`` adds text_key, the text's MD5, to find a row's text again.
    """
    key = [F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("text_key")] if text_keys else []
    sized = stored(
        pick(docs, "doc_id", "text", "source").select(
            "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"), *key
        ),
        "mix",
    )
    rows = sized.count()
    digits = max(1, math.ceil(math.log(max(rows / BUCKET_ROWS, 1), 16)))
    source_rows = stored(quotas(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs), block_words, epochs=epochs), "mix")
    keyed = sized.withColumn("bucket", F.substring("key", 1, digits)).alias("d").join(
        source_rows.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))
    ).select("d.*", "pos", "source_size", "target", "block")
    within = Window.partitionBy("pos", "bucket").orderBy("key", F.col("doc_id"), "size")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("pos").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = keyed.groupBy("pos", "bucket").agg(F.sum("size").alias("words")).select(
        "pos", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("head")
    )
    laid = (
        keyed.withColumn("nth", F.row_number().over(within))
        .withColumn("inner", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .join(heads.hint("merge"), ["pos", "bucket"])
        .withColumn("start", F.col("head") + F.col("inner"))
    )
    end = F.col("start") + F.col("size")
    block_no = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((end - 1) / F.col("block"))))
    pieces = laid.withColumn("block_no", F.explode_outer(block_no)).withColumn(
        "words", F.least(end, (F.col("block_no") + 1) * F.col("block")) - F.greatest(F.col("start"), F.col("block_no") * F.col("block"))
    )
    uses = schedule(source_rows).groupBy("pos", "block_no").agg(F.count(F.lit(1)).alias("times"), F.min("slot").alias("first_slot"))
    same = ["doc_id", "size", "source_size", "target", "source", "pos", "bucket", "nth", *(["text_key"] if text_keys else [])]
    return (
        pieces.join(uses.hint("merge"), ["pos", "block_no"], "left")
        .groupBy(*same)
        .agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long").alias("taken"), F.min("first_slot").alias("first_slot"))
        .select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot", *(["text_key"] if text_keys else []))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each as often as the mix takes its words, rounded; those it does not take are left out.

    Rows with the same id and text share their copies evenly. Documents without words are not part of a mix by words: they stay.
    """
    taken = mix(docs, text_keys=True, **options)
    per_text = taken.groupBy(F.col("doc_id").alias("its_id"), F.col("text_key").alias("its_key")).agg(
        F.when(F.sum("size") == 0, 1).otherwise(F.round(F.sum("taken") / F.sum("size"))).cast("int").alias("copies")
    )
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("key"))
    kept = keyed.join(per_text.where("copies > 0").hint("merge"), F.col("id").eqNullSafe(F.col("its_id")) & (F.col("key") == F.col("its_key")))
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM s0),
s2 AS (SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s1),
s3 AS (SELECT *, CAST(3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER b, 0) AS BIGINT) AS left_words,
              CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS BIGINT) AS left_weight
       FROM s2 WINDOW b AS (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, 2 * cap * left_weight <= weight * left_words AS at_cap FROM s3),
rest AS (SELECT left_words, left_weight FROM s4 WHERE NOT at_cap ORDER BY cap / weight, pos LIMIT 1),
s5 AS (SELECT s4.source, source_size, pos,
              CASE WHEN at_cap THEN CAST(cap AS DOUBLE)
                   ELSE CAST(weight * (SELECT left_words FROM rest) AS DOUBLE) / CAST(2 * (SELECT left_weight FROM rest) AS DOUBLE) END AS target,
              greatest(1, least(1024, source_size // 512)) AS block FROM s4),
s6 AS (SELECT *, CAST(ceil(source_size / block) AS BIGINT) AS n_blocks FROM s5),
s7 AS (SELECT *, CAST(least(n_blocks * 2, floor(target / block + 0.5)) AS BIGINT) AS quota FROM s6),
laid AS (SELECT d.*, s.source_size, s.target, s.block, s.n_blocks, s.quota, s.pos,
                CAST(sum(size) OVER (PARTITION BY s.pos ORDER BY key, d.doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
         FROM sized d JOIN s7 s ON d.source IS NOT DISTINCT FROM s.source),
firsts AS (SELECT pos, CAST(sum(quota) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) - quota AS BIGINT) AS first FROM s7),
bits AS (SELECT greatest(1, CAST(ceil(log2(greatest(sum(quota), 2))) AS INTEGER)) AS m FROM s7),
slots AS (SELECT f.pos, k.rank % s.n_blocks AS block_no,
                 list_sum(list_transform(range(0, m), lambda b: CAST(((f.first + k.rank) >> b) & 1 AS BIGINT) << CAST(m - 1 - b AS INTEGER))) AS slot
          FROM s7 s JOIN firsts f USING (pos) CROSS JOIN bits, LATERAL (SELECT unnest(range(0, s.quota)) AS rank) k),
uses AS (SELECT pos, block_no, CAST(min(slot) AS BIGINT) AS slot FROM slots GROUP BY ALL),
first_slots AS (SELECT l.doc_id, l.start, l.pos, min(u.slot) AS first_slot FROM laid l JOIN uses u
                ON u.pos = l.pos AND u.block_no BETWEEN l.start // l.block AND (l.start + l.size - 1) // l.block WHERE l.size > 0 GROUP BY ALL)
SELECT l.doc_id, l.size, source_size, target,
       CAST(CASE WHEN quota >= n_blocks THEN size + greatest(0, least(l.start + size, (quota - n_blocks) * block) - l.start)
                 ELSE greatest(0, least(l.start + size, quota * block) - l.start) END AS BIGINT) AS taken,
       source, f.first_slot
FROM laid l LEFT JOIN first_slots f ON l.size > 0 AND f.pos = l.pos AND f.start = l.start AND f.doc_id IS NOT DISTINCT FROM l.doc_id
"""


@query("op3_source_mix", SQL)
def op3_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"))
