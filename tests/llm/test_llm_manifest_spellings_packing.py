"""The Merkle manifest, spelling variants and packing against plain versions on whole small tables and odd inputs."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from gamspark.llm import merkle, packing, spellings
from gamspark.llm.common import pick
from helpers import odd_documents
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark)


def plain_rows(df):
    return [r.asDict() for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


# ---- Merkle manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, add=0):
    values = [r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + add, r["text"]]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(leaves, fanout):
    """Root, and per leaf the steps (place in its run, others of the run)."""
    nodes, steps, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, i in enumerate(at):
            run, p = runs[i // fanout], i % fanout
            steps[k].append((p, run[:p] + run[p + 1 :]))
        nodes, at = [h(*run) for run in runs], [i // fanout for i in at]
    return nodes[0], steps


def plain_manifest(rows, fanout):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: b"" if x is None else b"=" + x.encode())
    found, roots = [], []
    for lang in langs:
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        root, steps = plain_tree([plain_leaf(r) for r in own], fanout)
        roots.append(root)
        found.append((own, steps))
    top, above = plain_tree(roots, fanout)
    out = []
    for (own, steps), subroot, upper in zip(found, roots, above):
        for r, mine in zip(own, steps):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = plain_leaf(r, int(hit))
            for p, others in mine + upper:
                node = h(*others[:p], node, *others[p:])
            proof = h(*[x for _, others in mine + upper for x in others])
            out.append((r["doc_id"], plain_leaf(r), subroot, top, proof, node, node == top))
    return Counter(out)


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("fanout,block", [(2, 4096), (2, 2), (2, 8), (3, 3), (16, 16)])
def test_manifest_equals_plain_version(docs, fanout, block):
    found = rows_of(merkle.checked(merkle.document_manifest(docs, fanout, block)))
    assert found == plain_manifest(plain_rows(docs), fanout)
    assert 0 < sum(not r[-1] for r in found) < len(found) / 4


def test_manifest_of_odd_documents(odd):
    assert rows_of(merkle.checked(merkle.document_manifest(odd, 2, 2))) == plain_manifest(plain_rows(odd), 2)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 17, 33])
def test_butterfly_of_ragged_groups(spark, n):
    rows = spark.createDataFrame([(i, f"t{i}", "x" if i < n else "y", None, None) for i in range(n + 1)], SCHEMA)
    assert rows_of(merkle.checked(merkle.document_manifest(rows, 2, 2))) == plain_manifest(plain_rows(rows), 2)


def test_manifest_of_nothing_and_one(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.checked(merkle.document_manifest(none, 2)).count() == 0
    one = spark.createDataFrame([(7, "a", None, None, None)], SCHEMA)
    r = merkle.checked(merkle.document_manifest(one, 2)).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == h() and r["verified"]


# ---- Spelling variants


def plain_counts(rows, share=97):
    out = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            word = "".join(c.lower() if c < "\x80" else c for c in run)
            code = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{word}".encode())
            if code % share == 0:
                at = code % len(word)
                word = word[:at] + word[at + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def plain_groups(counts):
    skipped = {}
    for w in counts:
        for i in range(len(w)):
            skipped.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in counts}
    for (a, b), words in skipped.items():
        for w in words:
            near[w] |= words - {w}
            if a + b in counts:
                near[w].add(a + b)
                near[a + b].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 2 * counts[w]:
            form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, n, len(near[w]), form.get(w), counts.get(form.get(w)), root))
    return out


def groups_of(df):
    return {tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()}


@pytest.mark.parametrize("letters", [1 << 22, 3000])
def test_spellings_equal_plain_version(docs, letters):
    want = plain_groups(plain_counts(plain_rows(docs)))
    got = spellings.spelling_groups(spellings.word_counts(docs), task_letters=letters)
    assert groups_of(got) == want and sum(r[3] is not None for r in want) > 20
    assert got.count() == len(want)


def test_typos_and_words_at_borders(spark):
    rows = [(i, f"Straße×naïve cafés{'x' * i} HELLO hello Hello. tail", "de", None, None) for i in range(300)]
    rows += [(None, "hello hellos hellos hellos", "en", None, None), (1, None, None, None, None), (2, "", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["word"]: r["n"] for r in spellings.word_counts(df, share=3).collect()}
    assert got == plain_counts([dict(zip(("doc_id", "text"), r)) for r in rows], 3)


@pytest.mark.parametrize("alphabet,length,n", [("ab", 9, 300), ("abé", 6, 400), ("aaab", 12, 200)])
def test_neighbours_of_crowded_words(spark, alphabet, length, n):
    rng = random.Random(length)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(5, length))) for _ in range(n)}
    counts = {w: rng.randint(3, 60) for w in words} | {"a" * 3000: 5, "a" * 3001: 11, "a" * 2999 + "b": 5}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert groups_of(spellings.spelling_groups(df, task_letters=700)) == plain_groups(counts)


def test_forms_are_followed_to_the_end(spark):
    counts = {"a" * (5 + i): 3 * 2**i for i in range(20)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = groups_of(spellings.spelling_groups(df))
    assert {r[5] for r in got} == {"a" * 24} and got == plain_groups(counts)


def test_spellings_of_nothing(spark, odd):
    assert spellings.spelling_groups(spellings.word_counts(spark.createDataFrame([], SCHEMA))).count() == 0
    assert groups_of(spellings.spelling_groups(spellings.word_counts(odd))) == plain_groups(plain_counts(plain_rows(odd)))


# ---- Packing


def plain_ids(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    return [(r["doc_id"], [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in rows]


def check_packing(rows, placed, capacity):
    """Every document once, gapless and within its capacity; returns the number of sequences."""
    by_doc = {}
    for r in placed:
        by_doc.setdefault(r["doc_id"], []).append(r)
    want = {}
    for doc_id, ids in plain_ids(rows):
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.setdefault(doc_id, []).append((k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    got = {d: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rs) for d, rs in by_doc.items()}
    assert got == {d: sorted(x) for d, x in want.items()}
    spans = {}
    for r in placed:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for span in spans.values():
        at = 0
        for offset, length in sorted(span):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans)


def first_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        for i, gap in enumerate(gaps):
            if gap >= n:
                gaps[i] -= n
                break
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("capacity", [2048, 300])
def test_packing_round_trip(docs, capacity):
    pieces = packing.encode_pieces(docs.repartition(5), capacity).withColumn("ids_crc32", F.crc32("ids"))
    placed = packing.place(pieces.drop("ids"), capacity).collect()
    used = check_packing(plain_rows(docs), placed, capacity)
    lengths = [r["length"] for r in placed]
    assert -(-sum(lengths) // capacity) <= used <= first_fit_decreasing(lengths, capacity)
    whole = packing.sequences(packing.place(pieces, capacity)).collect()
    assert len(whole) == used
    for r in whole:
        for p in r["parts"]:
            own = r["ids"][4 * p["offset"] : 4 * (p["offset"] + p["length"])]
            assert any(x["ids_crc32"] == zlib.crc32(own) for x in placed if (x["sequence_id"], x["offset"]) == (r["sequence_id"], p["offset"]))


def test_packing_of_odd_documents(spark, odd):
    pieces = packing.encode_pieces(odd).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = packing.place(pieces).collect()
    check_packing(plain_rows(odd), placed, 2048)
    none = packing.encode_pieces(spark.createDataFrame([], SCHEMA))
    assert packing.place(none).count() == 0 and packing.sequences(packing.place(none)).count() == 0


def most_pairs(lengths, capacity):
    """Largest number of pairs that fit, by trying all."""
    best, lengths = 0, sorted(lengths)
    for k in range(len(lengths) // 2 + 1):  # the k smallest pairs: smallest 2k lengths, least with largest
        some = lengths[: 2 * k]
        if all(some[i] + some[-1 - i] <= capacity for i in range(k)):
            best = k
    return best


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([30, 100, 2048])
    counts = Counter(rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 3)), rng.randint(capacity // 3 + 1, capacity)]) for _ in range(rng.randint(1, 400)))
    if seed % 2:
        counts[capacity // 2] += 101
    plan = packing.plan_packing(counts, capacity)
    assert plan.placed == dict(counts)
    spans = {}
    for length, n in counts.items():
        steps = plan.steps[length]
        for rank in range(n):
            begin, first, each, at = next(s for s in reversed(steps) if s[0] <= rank)
            spans.setdefault(first + (rank - begin) // each, []).append((at + (rank - begin) % each * length, length))
    assert sorted(spans) == list(range(plan.sequences))
    pairs = 0
    for span in spans.values():
        at = 0
        for offset, length in sorted(span):
            assert offset == at
            at += length
        assert at <= capacity
        large = sum(3 * n > capacity for _, n in span)
        assert large <= 2
        pairs += large == 2
    items = [n for n, k in counts.items() for _ in range(k)]
    assert pairs == most_pairs([n for n in items if 3 * n > capacity], capacity)
    assert plan.sequences <= first_fit_decreasing(items, capacity) + 1


def test_plan_does_not_grow_with_the_documents():
    few = {n: 3 + n % 5 for n in range(1, 2049)}
    many = {n: k * 10**9 for n, k in few.items()}
    plan = packing.plan_packing(many, 2048)
    assert plan.placed == many and sum(map(len, plan.steps.values())) < 60_000
    assert plan.sequences < 1.01 * sum(n * k for n, k in many.items()) / 2048 + 1 or plan.sequences <= sum(k for n, k in many.items() if 2 * n > 2048)


# ---- What all three share


def test_columns_that_differ_in_case_only(spark, docs):
    df = docs.limit(60).cache()
    wide = df.toDF(*df.columns).select("*", F.lit("clash").alias("TEXT"), F.lit(3).alias("Doc_Id"), F.lit(None).cast("string").alias("LANG"), F.lit("s").alias("Source"), F.lit(1).alias("N_CHARS"))
    assert pick(wide, "doc_id", "text").columns == ["doc_id", "text"]
    assert rows_of(merkle.checked(merkle.document_manifest(wide, 2))) == plain_manifest(plain_rows(df), 2)
    assert groups_of(spellings.spelling_groups(spellings.word_counts(wide))) == plain_groups(plain_counts(plain_rows(df)))
    placed = packing.place(packing.encode_pieces(wide).withColumn("ids_crc32", F.crc32("ids")).drop("ids")).collect()
    check_packing(plain_rows(df), placed, 2048)
