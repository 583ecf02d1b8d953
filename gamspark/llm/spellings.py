"""Spelling variants by a dictionary of trie-node pairs: words one edit apart, and the frequent form each variant hangs on.

1. Words are counted inside tasks, then by word.
2. Trie nodes are numbered: words are sorted over all tasks, so the nodes of a word that the word before does not share are new ones.
   At the border of two tasks the shared beginning keeps the number it got first: one row a task is chained, no word list. The
   same over the reversed words numbers the nodes of the endings. A node's number stands for a whole beginning or ending, so long
   words cost their length, not its square, and equality of numbers is equality of strings, without hashing.
3. Every word gives its pairs (node of a beginning, node of the rest): with one place skipped, and with none. Words that meet in a
   pair with a skipped place differ in that one; a word that meets them without a skip lacks it. Of a run of equal letters only
   the first skip meets the shorter word, so each pair of neighbours meets once. A pair names at most one word without a skip and
   one for each letter of the alphabet, so groups are bounded by the alphabet, and only counts and the best neighbour leave them.
4. Forms are followed to the last by doubling the steps; counts at least double with each, so few rounds are needed.

Nulls and odd cases: a null or empty text has no words; a null id is written as the empty string before the colon; repeated rows and ids
count as often as they stand there; very long texts and words are processed whole; of neighbours of equal count the smallest in
code-point order is the form; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Texts, pick, slices, small_batches, stored, table
from .registry import query

MIN_LENGTH, MIN_COUNT = 5, 3
TYPO_SHARE = 97
TASK_LETTERS = 1 << 22
TASK_BITS = 36
OUT_NODES = 1 << 18
HOLD_WORDS = 1 << 20
LONG_RUN = 64
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0xC3] = True


def runs(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the maximal runs of `[A-Za-z\\u00C0-\\u00FF]`. These letters beyond ASCII are the byte C3 and one more."""
    data = texts.data
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _LETTER[data]
    inside[2:-1] |= data[:-1] == 0xC3
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = np.unique(texts.offsets[(texts.offsets > 0) & (texts.offsets < len(data))])  # texts follow each other without a gap
    first[edges] = inside[1:-1][edges]
    last[edges - 1] = inside[1:-1][edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def crc_after(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of byte ranges that follow bytes whose CRC-32 is ``before``; a byte of all ranges at a time."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    state = before[order] ^ np.uint32(0xFFFFFFFF)
    at, lengths = starts[order], lengths[order]
    longest = int(min(lengths[0], LONG_RUN)) if len(order) else 0
    alive = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    for k, n in enumerate(alive.tolist()):
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + k]) & 0xFF] ^ (state[:n] >> 8)
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-lengths, -LONG_RUN, side="left"))):
        state[i] = zlib.crc32(data[at[i] + LONG_RUN : at[i] + lengths[i]].tobytes(), int(state[i]))
    out = np.empty_like(state)
    out[order] = state
    return out


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = data[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat)))


def slice_words(ids: list, texts: Texts, min_length: int = MIN_LENGTH, share: int = TYPO_SHARE) -> pa.Array:
    """All words of a slice, lower-cased in A-Z, some with a letter deleted (see ``word_counts``), of ``min_length`` letters or more."""
    data = LOWER[texts.data]
    starts, ends = runs(texts)
    doc = np.searchsorted(texts.offsets, starts, side="right") - 1
    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], dtype=np.uint32)
    crc = crc_after(data, starts, ends, heads[doc])
    seconds = np.concatenate([[0], np.cumsum(data == 0xC3)])
    letters = ends - starts - (seconds[ends] - seconds[starts])
    typo = crc % share == 0
    plain = ~typo & (letters >= min_length)
    out = [_strings(data, starts[plain], ends[plain])]
    changed = []
    for i in np.flatnonzero(typo & (letters > min_length)).tolist():
        word, at = data[starts[i] : ends[i]].tobytes().decode(), int(crc[i] % letters[i])
        changed.append(word[:at] + word[at + 1 :])
    return pa.concat_arrays([*out, pa.array(changed, pa.large_string())])


def _count(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, share: int = TYPO_SHARE) -> DataFrame:
    """(word, n) of words of at least ``min_length`` letters and ``min_count`` occurrences.

    Let h be the CRC-32 of `<doc_id>:<run>`; where ``share`` divides h, the run loses its letter h % length, as a typist would.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows, texts in slices(batches):
            found = pc.value_counts(slice_words(rows.column("doc_id").to_pylist(), texts, min_length, share))
            held.append(pa.table({"word": found.field("values"), "n": found.field("counts").cast(pa.int64())}))
            size += len(found)
            if size >= HOLD_WORDS:
                whole = _count(held)
                held, size = ([], 0) if len(whole) > HOLD_WORDS // 2 else ([whole], len(whole))
                if not held:
                    yield from whole.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches()
        if held:
            yield from _count(held).cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches()

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted words: node 0 is the empty beginning; nodes that the word before does not share get the next numbers."""
    task, seq, new, last, path = TaskContext.get().partitionId() << TASK_BITS, 0, 1, "", [TaskContext.get().partitionId() << TASK_BITS]
    for batch in batches:
        keys, words, nodes, held = [], [], [], 0
        for key, word in zip(batch.column("key").to_pylist(), batch.column("word").to_pylist()):
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            path = path[: shared + 1] + list(range(task + new, task + new + len(word) - shared))
            new += len(word) - shared
            last = word
            keys.append(key)
            words.append(word)
            nodes.append(path)
            held += len(path)
            if held >= OUT_NODES:
                yield _numbered(task + seq, keys, words, nodes)
                seq += len(keys)
                keys, words, nodes, held = [], [], [], 0
        if keys:
            yield _numbered(task + seq, keys, words, nodes)
            seq += len(keys)


def _numbered(first: int, keys: list, words: list, nodes: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(range(first, first + len(keys)), pa.int64()), pa.array(keys, pa.int64()), pa.array(words, pa.string()), pa.array(nodes, pa.list_(pa.int64()))],
        ["ord", "key", "word", "nodes"],
    )


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of tasks in order: the numbers that nodes on the way to a task's first word have from tasks before. Holds one word's way."""
    last, path = "", [0]
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            shared, most = 0, min(len(last), len(row["first"]))
            while shared < most and last[shared] == row["first"][shared]:
                shared += 1
            fixed = path[: shared + 1]
            first = row["task"] << TASK_BITS
            last, path = row["last"], [fixed[x - first] if x - first < len(fixed) else x for x in row["nodes"]]
            yield pa.RecordBatch.from_arrays([pa.array([row["task"]], pa.int64()), pa.array([fixed], pa.list_(pa.int64()))], ["task", "fixed"])


def trie_nodes(words: DataFrame, tasks: int) -> DataFrame:
    """(key, word), each word once -> (ord, key, word, nodes): numbers of the trie nodes of all beginnings, the empty one first; ``ord``
    grows with the word."""
    ranged = words.select("key", "word").repartitionByRange(tasks, "word").sortWithinPartitions("word")
    numbered = stored(ranged.mapInArrow(_number, "ord long, key long, word string, nodes array<long>"), "trie")
    task = F.shiftright("ord", TASK_BITS)
    ends = numbered.groupBy(task.alias("task")).agg(F.min_by("word", "ord").alias("first"), F.max_by("word", "ord").alias("last"), F.max_by("nodes", "ord").alias("nodes"))
    fixes = stored(ends.repartition(1).sortWithinPartitions("task").mapInArrow(_chain, "task long, fixed array<long>"), "borders")
    # The first word of a task has the nodes 0, 1, 2, ... of the task, so its shared beginning is the numbers below len(fixed).
    local = lambda x: x.bitwiseAND((1 << TASK_BITS) - 1)
    mended = F.transform("nodes", lambda x: F.when(local(x) < F.size("fixed"), F.get("fixed", local(x))).otherwise(x))
    return numbered.withColumn("task", task).join(fixes, "task").select("ord", "key", "word", mended.alias("nodes"))


SKIP, FIRST_SKIP, WHOLE = 1, 2, 0


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node pairs of each word: every place skipped, and every cut without a skip."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            yield from _pairs_of(batch.slice(a, 256))


def _pairs_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    words = [np.frombuffer(w.encode("utf-32-le"), "<u4") for w in batch.column("word").to_pylist()]
    length = np.array([len(w) for w in words], dtype=np.int64)
    nodes = np.asarray(batch.column("nodes").flatten())
    rest = np.asarray(batch.column("rest").flatten())
    begin = np.cumsum(length + 1) - (length + 1)  # of each word's nodes, one more than letters
    of = np.repeat(np.arange(len(words)), length)
    at = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
    letters = np.concatenate(words)
    kind = np.full(len(of), FIRST_SKIP, dtype=np.int32)
    kind[1:][(letters[1:] == letters[:-1]) & (at[1:] > 0)] = SKIP
    cut_of = np.repeat(np.arange(len(words)), length + 1)
    cut = np.arange(len(cut_of)) - begin[cut_of]
    left = np.concatenate([nodes[begin[of] + at], nodes[begin[cut_of] + cut]])
    right = np.concatenate([rest[begin[of] + length[of] - 1 - at], rest[begin[cut_of] + length[cut_of] - cut]])
    which = np.concatenate([of, cut_of])
    kinds = np.concatenate([kind, np.full(len(cut_of), WHOLE, dtype=np.int32)])
    ords, n = np.asarray(batch.column("ord")), np.asarray(batch.column("n"))
    for a in range(0, len(which), OUT_NODES):
        w = which[a : a + OUT_NODES]
        yield pa.RecordBatch.from_arrays(
            [pa.array(left[a : a + OUT_NODES]), pa.array(right[a : a + OUT_NODES]), pa.array(n[w]), pa.array(-ords[w]), pa.array(kinds[a : a + OUT_NODES])],
            ["left", "right", "n", "minus", "kind"],
        )


def neighbours(words: DataFrame, task_letters: int = TASK_LETTERS) -> DataFrame:
    """(word, n), each word once -> (ord, word, n, n_near, near): the number of words one edit apart, and (n, -ord) of the best of them."""
    words = stored(words.select("word", "n"), "words")
    letters = words.agg(F.sum(F.length("word"))).first()[0] or 0
    tasks = max(1, math.ceil(letters / task_letters))
    keyed = words.withColumn("key", F.lit(0).cast("long"))
    forward = trie_nodes(keyed, tasks).drop("key").join(words, "word")
    forward = stored(forward.select("ord", "word", "n", "nodes"), "forward")
    backward = trie_nodes(forward.select(F.col("ord").alias("key"), F.reverse("word").alias("word")), tasks)
    both = forward.join(backward.select(F.col("key").alias("ord"), F.col("nodes").alias("rest")), "ord")
    pairs = both.select("ord", "word", "n", "nodes", "rest").mapInArrow(_pairs, "left long, right long, n long, minus long, kind int")
    met = pairs.groupBy("left", "right").agg(F.sort_array(F.collect_list(F.struct("n", "minus", "kind")), asc=False).alias("met")).where(F.size("met") > 1)
    one = met.withColumn("own", F.explode("met"))

    def near(x):
        skipped = (x["kind"] > WHOLE) & (F.col("own.kind") > WHOLE) & (x["minus"] != F.col("own.minus"))
        longer = (x["kind"] == FIRST_SKIP) & (F.col("own.kind") == WHOLE)
        shorter = (x["kind"] == WHOLE) & (F.col("own.kind") == FIRST_SKIP)
        return skipped | longer | shorter

    found = one.select((-F.col("own.minus")).alias("ord"), F.filter("met", near).alias("near")).where(F.size("near") > 0)
    best = found.select("ord", F.size("near").alias("k"), F.col("near")[0]["n"].alias("n"), F.col("near")[0]["minus"].alias("minus"))
    best = best.groupBy("ord").agg(F.sum("k").cast("long").alias("n_near"), F.max(F.struct("n", "minus")).alias("near"))
    return forward.select("ord", "word", "n").join(best, "ord", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))


def last_forms(forms: DataFrame) -> DataFrame:
    """(ord, form) without circles -> (ord, root): the last of each way, by doubling steps until nothing moves."""
    ways = stored(forms.select("ord", F.col("form").alias("root")), "ways")
    while True:
        ahead = ways.select(F.col("ord").alias("root"), F.col("root").alias("next"))
        stepped = stored(ways.join(ahead, "root", "left").select("ord", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        ways = stepped.select("ord", "root")
        if not stepped.where("moved").limit(1).count():
            return ways


def spelling_groups(words: DataFrame, ratio: float = 2.0, task_letters: int = TASK_LETTERS) -> DataFrame:
    """(word, n) -> word, n, n_near, form, form_n, root: the best neighbour if it occurs ``ratio`` times as often, and the end of the way
    over such forms (the word itself without one)."""
    near = stored(neighbours(words, task_letters), "near")
    forms = near.where(F.col("near.n") >= ratio * F.col("n")).select("ord", (-F.col("near.minus")).alias("form"))
    names = near.select("ord", "word")
    ways = forms.join(last_forms(forms), "ord").join(names.select(F.col("ord").alias("form"), F.col("word").alias("form_word")), "form")
    ways = ways.join(names.select(F.col("ord").alias("root"), F.col("word").alias("root_word")), "root").select("ord", "form_word", "root_word")
    out = near.join(ways, "ord", "left")
    return out.select(
        "word", "n", "n_near", F.col("form_word").alias("form"), F.when(F.col("form_word").isNotNull(), F.col("near.n")).alias("form_n"),
        F.coalesce("root_word", "word").alias("root"),
    )


_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 a bit at a time over the UTF-8 bytes of letters below U+0100.
_CRC_SQL = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split({0}, ''), "
    "lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, unicode(ch) - 64] END))), "
    "lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, e: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"
)
SQL = f"""WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_LOWER_SQL}, '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
each AS (SELECT id, w, count(*) AS k FROM runs GROUP BY ALL),
coded AS (SELECT w, k, {_CRC_SQL.format("id || ':' || w")} AS h FROM each),
typed AS (SELECT k, CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w FROM coded),
words AS MATERIALIZED (SELECT w, CAST(sum(k) AS BIGINT) AS n FROM typed WHERE length(w) >= 5 GROUP BY w HAVING sum(k) >= 3),
skipped AS MATERIALIZED (SELECT w, n, left(w, i) AS a, substr(w, i + 2) AS b FROM (SELECT w, n, unnest(range(length(w))) AS i FROM words)),
near AS MATERIALIZED (SELECT x.w, y.w AS v, y.n FROM skipped x JOIN skipped y ON x.a = y.a AND x.b = y.b AND x.w <> y.w
    UNION SELECT s.w, c.w, c.n FROM skipped s JOIN words c ON c.w = s.a || s.b UNION SELECT c.w, s.w, s.n FROM skipped s JOIN words c ON c.w = s.a || s.b),
best AS (SELECT w, v, n, count(*) OVER (PARTITION BY w) AS n_near, row_number() OVER (PARTITION BY w ORDER BY n DESC, v) AS k FROM near),
forms AS MATERIALIZED (SELECT words.w, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * words.n THEN v END AS form, CASE WHEN best.n >= 2 * words.n THEN best.n END AS form_n
    FROM words LEFT JOIN best ON best.w = words.w AND k = 1),
ways AS (SELECT w, w AS root, 0 AS step FROM forms UNION ALL SELECT ways.w, forms.form, step + 1 FROM ways JOIN forms ON forms.w = ways.root WHERE forms.form IS NOT NULL)
SELECT w AS word, n, n_near, form, form_n, root FROM forms JOIN (SELECT w, arg_max(root, step) AS root FROM ways GROUP BY w) USING (w)"""


@query("op12_spelling_variants", SQL)
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_groups(word_counts(table(spark, folder, "documents")))
