"""Odd inputs, and the parts of the operators against plain versions."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import odd_documents, words
from pyspark.sql import functions as F

from gamspark.llm import decontaminate, fingerprints, groups, licences, lm, mixing, neardup, pages, repeats, tokens, toxicity
from gamspark.llm.common import as_texts, gram_hashes, hash_ranges, sliding_min
from gamspark.llm.wavelet import WaveletMatrix


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark).cache()


def empty(df):
    return df.where("false")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def items(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def test_words_and_hashes_of_slices():
    texts = ["a bb  ccc\n", None, "", "  x", "é ñandú " + "z" * 70 + " q", " ", "end", "next word"]
    own = as_texts(pa.array(texts)).words()
    got = [[own.word(j).decode() for j in range(own.bounds[i], own.bounds[i + 1])] for i in range(len(texts))]
    assert got == [words(t) for t in texts]
    assert len(set(own.hashes().tolist())) == len({w for t in texts for w in words(t)})
    x = np.arange(50, dtype=np.uint64)
    assert all(gram_hashes(x[i : i + 20], 20)[0] == h for i, h in enumerate(gram_hashes(x, 20)))
    y = np.array([5, 3, 4, 1, 9, 2, 8])
    assert sliding_min(y, 3).tolist() == [min(y[i : i + 3]) for i in range(5)]
    data = np.frombuffer(b"abcabc", np.uint8)
    assert len(set(hash_ranges(data, np.array([0, 3]), np.array([3, 6])).tolist())) == 1


def test_mix_bears_odd_rows(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert {r["taken"] for r in got if r["size"] == 0} == {0}
    per_source = collections.defaultdict(int)
    target = {}
    for r in got:
        per_source[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(per_source[s] - target[s]) <= 0.02 * target[s] + 2 for s in target)
    assert mixing.mix(empty(odd)).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mixed_documents(empty(odd)).count() == 0


def test_mix_targets_stop_at_twice_the_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 500)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20.0
    assert sum(got.values()) == pytest.approx(1.5 * 2510)
    assert all(got[s] <= 2 * n for s, n in (("a", 10), ("b", 1000), ("c", 1000), (None, 500)))


def test_schedule_spreads_every_source(spark):
    sources = mixing.quotas(mixing.targets(spark.createDataFrame([("a", 600_000), ("b", 300_000), ("c", 100_000)], "source string, source_size long")))
    slots = mixing.schedule(sources).collect()
    quota = {r["pos"]: r["quota"] for r in sources.collect()}
    assert len({r["slot"] for r in slots}) == len(slots) == sum(quota.values())
    order = sorted(slots, key=lambda r: r["slot"])
    for part in (0.25, 0.5, 0.75):
        seen = collections.Counter(r["pos"] for r in order[: int(part * len(order))])
        assert all(abs(seen[p] - part * q) <= 12 for p, q in quota.items())


def test_licences_bear_odd_rows(spark, odd):
    got = licences.scan(odd).collect()
    assert len(got) == odd.count()
    one = next(r for r in got if r["doc_id"] == 8)
    assert (one["n_words"], one["n_base"], one["first_word"], one["last_word"], one["base_labels"]) == (9, 2, 1, 5, "apache-2,mit")
    assert all(r["n_words"] == 0 and r["labels"] == "" and r["first_word"] is None for r in got if r["doc_id"] in (3, 4, 5))
    assert licences.scan(empty(odd)).count() == 0


def test_licence_places_overlap_and_repeat(spark):
    df = spark.createDataFrame([(1, "cc by nc cc by nc, CC-BY-NC"), (2, "under the mit"), (3, "!under the MIT license!")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_base"], r["first_word"], r["last_word"]) for r in licences.scan(df).collect()}
    assert got == {1: (3, 0, 6), 2: (0, None, None), 3: (1, 0, 0)}


def test_automaton_against_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    terms, begins, weak = ["idiot", "moron", "scum", "pathetic", "feeble"], ["lowe", "vequ"], frozenset(["feeble", "vequ"])
    automaton = toxicity.compile_automaton(terms, begins, weak)
    random.seed(1)
    tried = set()
    while len(tried) < 1500:
        w = list(random.choice([*terms, *begins, "loser"]))
        for _ in range(random.randint(0, 2)):
            k = random.randint(0, len(w))
            w[k : k + random.randint(0, 1)] = random.choice(["", "a", "e", "t"])
        if w:
            tried.add("".join(w))
    tried = sorted(tried)

    def want(w):
        strong = [t for t in terms if t not in weak]
        if w in strong or w.startswith("lowe") and len(w) > 4:
            return 1
        if any(len(t) >= toxicity.FUZZY_FROM and distance(w, t) == 1 for t in strong):
            return 2
        return 3 if w == "feeble" or w.startswith("vequ") and len(w) > 4 else 0

    texts = as_texts(pa.array(tried))
    assert automaton.run(texts.data, texts.offsets[:-1], texts.offsets[1:]).tolist() == [want(w) for w in tried]


def test_misspelled_words_below_a_beginning(spark):
    # The beginning stands in more toxic documents than each of its words.
    rows = [("idio", 4, 130, 0), ("idiot", 0, 90, 0), ("idiots", 0, 40, 0), ("idiot", 5, 40, 0), ("scumbag", 0, 30, 0), ("morons", 0, 35, 0), ("moron", 5, 50, 0), ("the", 0, 150, 850)]
    counted = spark.createDataFrame(rows, "term string, prefix int, t long, c long")
    words_, begins, weak = toxicity.learn_lexicon(counted, 150, 850)
    assert begins == ["idio", "moron"] and {"idiot", "idiots", "morons"} <= set(words_) and not weak
    assert toxicity.learn_lexicon(counted, 150, 850, 2)[0] == ["idiot", "idiots", "morons"]  # they take no other term's place
    automaton = toxicity.compile_automaton(words_, begins, weak)
    want = {"idiot": 1, "idiots": 1, "idiotic": 1, "1diot": 2, "idi0ts": 2, "idot": 2, "morons": 1, "moronic": 1, "m0ronic": 2, "mronic": 2, "m0r0nic": 0, "mo": 0, "idxxx": 0, "the": 0}
    texts = as_texts(pa.array(list(want)))
    got = automaton.run(texts.data, texts.offsets[:-1], texts.offsets[1:]).tolist()
    assert dict(zip(want, got)) == want


def test_toxicity_bears_odd_rows(spark, odd):
    none = toxicity.train(odd, labels(spark))
    got = toxicity.score(odd, none).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    one_kind = toxicity.train(odd, labels(spark, [(1, 1, 0), (2, None, None), (None, 1, 1)]))
    assert toxicity.score(empty(odd), one_kind).count() == 0
    assert toxicity.without_toxic(odd, one_kind).columns == odd.columns


def test_toxicity_context_and_spelling(spark):
    filler = ["calm green river", "quiet little house", "long winding road"]
    rows = [(i, f"{filler[i % 3]} you idiot {filler[(i + 1) % 3]} today") for i in range(0, 400, 2)] + [(i, f"{filler[i % 3]} you over {filler[(i + 1) % 3]} today") for i in range(1, 401, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, labels(spark, [(i, 1, int(i % 2 == 0)) for i, _ in rows]))
    tried = ["calm you idiot today", "calm you idoit today", "calm you idi0t today", 'he said "you idiot" and left', "calm river"]
    counts = model.counts(as_texts(pa.array(tried)))
    assert counts[:, :4].tolist() == [[1, 0, 0, 0], [0, 0, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 0]]
    p = model.scores(counts)
    assert p[0] > 0.5 > p[4] and p[0] > p[2] > p[4] and p[0] > p[3]


def test_repeats_bear_odd_rows(spark, odd):
    got = repeats.remove_repeats(odd).collect()
    assert len(got) == odd.count()
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    assert [r["n_removed"] for r in by_id[1]] == [0]
    assert [r["n_removed"] for r in by_id[2]] == [21, 21]
    assert [(r["n_words"], r["n_removed"]) for r in by_id[3] + by_id[4] + by_id[5]] == [(0, 0)] * 3
    assert {r["n_words"] for r in by_id[7]} == {1}
    assert repeats.remove_repeats(empty(odd)).count() == 0


def test_repeats_of_hot_and_self_overlapping_windows(spark):
    run = " ".join(["same"] * 50)
    rows = [(i, f"a{i} b{i} {run} c{i}") for i in range(300)]
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got[0] == 49  # all windows but the first
    assert all(got[i] == 50 for i in range(1, 300))


def test_sketch_never_estimates_too_low(spark):
    random.seed(2)
    rows = [(i, " ".join(random.choice("abcdefgh") * 3 for _ in range(60))) for i in range(300)]
    df = spark.createDataFrame(rows + [(i + 300, t) for i, t in rows[:50]], "doc_id long, text string").repartition(4)
    bits = 17
    bitmap = repeats.sketch(df, bits, 1 << 24)
    count, key_of = collections.Counter(), {}
    for _, t in df.collect():
        own, w = as_texts(pa.array([t])).words(), words(t)
        for start, key in zip(*(x.tolist() for x in repeats.window_keys(own, own.hashes()))):
            window = tuple(w[start : start + 20])
            count[window] += 1
            key_of[window] = key
    twice = np.array([key_of[w] for w, n in count.items() if n > 1], dtype=np.uint64)
    assert len(twice) and repeats._shows_two(bitmap, twice, bits).all()


def test_wavelet_matrix_answers():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 2048, 2049, 10_001):
        ids = (rng.zipf(1.4, n) % 50_257).astype(np.uint16)
        w = WaveletMatrix.build(ids, 16)
        w = WaveletMatrix.from_bytes(w.n, *w.to_bytes())
        assert (w.decode() == ids).all()
        if n:
            at = rng.integers(0, n, 50)
            assert (w.access(at) == ids[at]).all()
            for token in {*ids[:5].tolist(), 50_000}:
                assert w.locate(token).tolist() == np.flatnonzero(ids == token).tolist()
                assert w.count(token, n // 3, n) == (ids[n // 3 :] == token).sum()


def test_pieces_encode_like_whole_texts():
    encoder = tokens.PieceEncoder(tokens.default_tokenizer())
    texts = ["", "a  b\n c <|endoftext|> d<|endoftext|> 's 's  x  y　z q ", " lead", '(x) y!!z "a-b" O\'x don\'t i\'s.s é, È! Ñ× ×, ñ(a \n\nfoo\nbar,\n.a é\nb 1,2 a1 _x', "\t\t tab \r\n x", "ABC_def--- 12,345.6"]
    random.seed(4)
    texts += ["".join(random.choice(list("ab 1.,'!\n\té×“ _-")) for _ in range(40)) for _ in range(400)]
    ids, counts = encoder.encode(as_texts(pa.array(texts)))
    want = [[*e.ids, 0] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_tokens_bear_odd_rows(spark, odd, tmp_path):
    got = tokens.token_output(odd).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [1, 2, 2, 3, 4, 5, 6, 6, 7, 8, None]
    assert [r["n_tokens"] for r in got if r["doc_id"] in (3, 4)] == [1, 1]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    assert tokens.token_output(empty(odd)).count() == 0
    path = f"{tmp_path}/shards"
    tokens.write_shards(odd, path, tokens.default_tokenizer(), shard_tokens=1000)
    shards = tokens.read_shards(spark, path)
    assert tokens.count_token(shards, 0).first()["n"] == len(got)
    ends = sorted(r["start"] for r in tokens.find_token(shards, 0).collect())
    assert ends == [r["start"] + r["n_tokens"] - 1 for r in got]


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(30):
        a = [f"w{rng.integers(0, 60)}" for _ in range(200)]
        b = list(a)
        for _ in range(rng.integers(5, 60)):
            b[rng.integers(0, 200)] = f"w{rng.integers(0, 60)}"
        doc, hashes, weights = neardup.counted(*neardup.shingles(as_texts(pa.array([" ".join(a), " ".join(b)])).words(), 1))
        s = neardup.signatures(2, doc, hashes, weights)
        x, y = collections.Counter(a), collections.Counter(b)
        errors.append((s[0] == s[1]).mean() - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_near_duplicates_bear_odd_rows(spark, odd):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    of = collections.defaultdict(set)
    for r in got:
        of[r["doc_id"]].add(r["class_id"])
    assert of[2] == {1} and of[3] == of[4] == {3} and of[5] == {5}  # 17 of 19 shingles of the second text are all of the first's
    assert neardup.near_duplicates(empty(odd)).count() == 0
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 3, 5, 6, 6, 7, 8, None]))


def test_near_copies_in_a_large_group(spark):
    random.seed(6)
    base = [f"w{random.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        if i % 4:
            w[random.randrange(120)] = f"e{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"w{random.randrange(5000)}" for _ in range(120))) for i in range(50)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(400)} == {0}
    assert all(got[i] == i for i in range(1000, 1050))


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in groups.components(links).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (100, 101, 102)} == {100}
    assert groups.components(links.where("false")).count() == 0


def test_leaks_with_edits_and_odd_rows(spark, odd):
    random.seed(3)
    vocabulary = [f"v{i}" for i in range(3000)]
    tests = [(k, " ".join(random.choices(vocabulary, k=40))) for k in range(30)]
    rows = []
    for k, text in tests:
        w = [x for x in text.split() if random.random() > 0.05]
        w = [random.choice(vocabulary) if random.random() < 0.08 else x.upper() for x in w]
        rows.append((k, ". ".join(random.choices(vocabulary, k=50) + w + random.choices(vocabulary, k=30))))
    rows += [(100 + k, " ".join(random.choices(vocabulary, k=200))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items(spark, tests)).collect()}
    assert got == {(k, k) for k, _ in tests}
    assert decontaminate.without_leaks(docs, items(spark, tests)).count() == 200
    assert decontaminate.find_leaks(odd, items(spark, [(1, None), (None, ""), (2, "zzz yyy xxx www vvv")])).count() == 0
    assert decontaminate.find_leaks(odd, items(spark)).count() == 0
    assert decontaminate.find_leaks(empty(odd), items(spark, tests)).count() == 0
    assert decontaminate.without_leaks(odd, items(spark, tests)).columns == odd.columns
    clash = docs.withColumn("other", F.lit("other")).toDF("doc_id", "text", "TEXT")
    blocks = decontaminate.without_leaks(clash, items(spark, tests), block_items=7)
    assert sorted(r[0] for r in blocks.collect()) == [100 + k for k in range(200)] and blocks.columns == ["doc_id", "text", "TEXT"]
    first = " ".join("one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split())
    some = items(spark, [*tests, (77, first)])
    left = [sorted(map(str, decontaminate.without_leaks(odd, some, block_items=n).collect())) for n in (5, 1000)]
    assert left[0] == left[1] and len(left[0]) == odd.count() - 3


def test_alignment_against_full_matrix():
    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        best = 0
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        return best

    rng = np.random.default_rng(7)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 25))
        assert decontaminate.align(a, b)[0] == plain(a.tolist(), b.tolist())


def test_fingerprints_bear_odd_rows(spark, odd):
    got = fingerprints.compare_edits(odd).collect()
    assert len(got) == odd.count()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (3, 4)} == {""}
    assert fingerprints.compare_edits(empty(odd)).count() == 0
    alone = fingerprints.compare_edits(odd.where("doc_id = 1")).first()
    assert alone["near_next"] == 1.0


def test_anchors_grow_with_the_text_and_meet_in_a_shared_passage():
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefghijklmnop", k=random.randint(3, 9)))
    passage = " ".join(word() for _ in range(50))
    one, two = (" ".join([word() for _ in range(4000)] + [passage] + [word() for _ in range(4000)]) for _ in range(2))
    short = " ".join(word() for _ in range(30))
    texts = [one, two, short, one[:-200] + " ".join(word() for _ in range(30))]
    prints = fingerprints.fingerprints(fingerprints._texts([t.encode() for t in texts]))
    for text, got in zip(texts, prints):
        at, hashes = fingerprints.syncmers(fingerprints._texts([text.encode()]))
        first = {}
        for place, h in zip(at.tolist(), hashes.tolist()):
            first.setdefault(h, place)
        low = [h for h in first if h < fingerprints.SHARE]
        want = low if len(low) >= fingerprints.ANCHORS else sorted(first)[: fingerprints.ANCHORS]
        assert got == sorted(want, key=first.get)
    assert len(prints[0]) > 500 and len(prints[2]) <= fingerprints.ANCHORS
    assert set(prints[0]) & set(prints[1])
    assert 0 < fingerprints.likeness(prints[0], prints[1]) < 0.05
    assert 0.95 < fingerprints.likeness(prints[0], prints[3]) < 1.0
    assert fingerprints.likeness(prints[0], prints[2]) < 0.05


def test_likeness_of_short_texts_is_that_of_all_syncmers():
    assert fingerprints.likeness([5, 1, 9], [5, 1, 9, 7]) == 3 / 4
    assert fingerprints.likeness([5, 1, 9], [9, 1, 5]) == 1 / 3
    assert fingerprints.likeness([], [4]) == 0.0 and fingerprints.likeness([], []) == 1.0
    few = list(range(10, 10 + fingerprints.ANCHORS))  # complete up to SHARE, whatever the other one has beyond
    assert fingerprints.likeness(few, few[:32] + [fingerprints.SHARE + 3]) == 0.5


def test_marks_of_copies_are_dealt_to_all_areas():
    n = 4000
    ids, same = np.arange(n, dtype=np.int64), np.full(n, 1234567, dtype=np.int64)
    sizes = [len(m["ids"]) // 8 for m in repeats._by_area(ids, same, np.zeros(n, dtype=np.int64), 16)]
    assert len(sizes) == 16 and sum(sizes) == n and max(sizes) < 2 * n / 16


def test_syncmers_against_their_definition():
    from gamspark.llm.common import mix64

    def inner(b):
        return int(mix64(np.array([int.from_bytes(b, "little")], dtype=np.uint64))[0] >> np.uint64(32))

    random.seed(1)
    texts = ["".join(random.choice("abcé ") for _ in range(n)) for n in (0, 5, 15, 16, 40, 200)]
    own = as_texts(pa.array(texts))
    want = []
    for i, t in enumerate(texts):
        b = t.encode()
        for j in range(len(b) - fingerprints.K + 1):
            h = [inner(b[j + k : j + k + fingerprints.S]) for k in range(fingerprints.K - fingerprints.S + 1)]
            if min(h) in (h[0], h[-1]):
                want.append(int(own.offsets[i]) + j)
    assert fingerprints.syncmers(own)[0].tolist() == want


def test_lm_bears_odd_rows(spark, odd):
    got = lm.lm_scores(odd).collect()
    assert len(got) == odd.count()
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)
    assert [r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)] == [1, 1, 1]
    assert lm.lm_scores(empty(odd)).count() == 0


def test_lm_probabilities_add_up_to_one():
    """Over all leaves of the code, at any weights."""
    from gamspark.llm import mixing_model as M

    rng = np.random.default_rng(3)
    hashes = rng.integers(1, 2**63, 12).astype(np.uint64)
    code = M.Code.build(hashes, rng.integers(1, 50, 12), 7.0)
    tables = [rng.integers(0, 9, len(t)) for t in M.new_tables()]
    predictors = M.Predictors.build(tables, leave_out=False)
    weights, offsets = rng.normal(0.3, 0.2, (M.GATES, M.INPUTS)), rng.normal(0, 0.5, (M.GATES, M.BUCKETS))
    total = 0.0
    for symbol in range(13):
        own = np.array([code.hashes[symbol] if symbol < 12 else 5], dtype=np.uint64)
        e = M.events(code, np.array([symbol]), own, np.array([1]), 64)
        cost = M.mix(*predictors.inputs(e), e, 1, weights, offsets, 0.5)
        total += 10 ** float(cost.sum())
    assert total == pytest.approx(1.0, abs=1e-4)


def lm_documents():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choices(vocabulary, weights=range(60, 0, -1), k=rng.choice((0, 3, 40, 150))))) for i in range(60)]


def test_lm_scores_do_not_depend_on_the_split(spark):
    df = spark.createDataFrame(lm_documents(), "doc_id long, text string")
    got = [{r["doc_id"]: r["score"] for r in lm.lm_scores(df.repartition(n)).collect()} for n in (1, 8, 64)]
    got.append({r["doc_id"]: r["score"] for r in lm.lm_scores(df.orderBy(F.desc("doc_id")).coalesce(2)).collect()})
    for other in got[1:]:
        assert other == pytest.approx(got[0], rel=1e-6)


def test_lm_scores_against_a_plain_version(spark):
    """Counts in dictionaries, Newton sums and online mixing one decision after the other."""
    import zlib

    from gamspark.llm import mixing_model as M

    documents, coded = lm_documents(), 20
    tokens = {i: [int(h) for h in as_texts(pa.array([t])).words().hashes()] + [lm.END] for i, t in documents}
    train = [i for i, _ in documents if zlib.crc32(str(i).encode()) % 10]
    counts = collections.Counter(w for i in train for w in tokens[i])
    top = sorted(counts, key=lambda w: (-counts[w], w - 2**64 * (w >= 2**63)))[:coded]
    rest_n, rest_v = sum(counts.values()) - sum(counts[w] for w in top), len(counts) - len(top)
    code = M.Code.build(np.array(top, np.uint64), np.array([counts[w] for w in top]), rest_n)

    def decisions(i):
        own = np.array(tokens[i], np.uint64)
        e = M.events(code, code.symbols(own), own, np.array([len(own)]), lm.TURN_TOKENS)
        return [(int(e.bit[j]), float(e.prior[j]), [int(x[j]) for x in e.index]) for j in range(len(e.bit))], e.turns.tolist()

    seen = [collections.Counter() for _ in M.TABLE_BITS]
    for i in train:
        for bit, _, cells in decisions(i)[0]:
            for k, cell in enumerate(cells):
                seen[k][cell, bit] += 1

    def inputs(bit, prior, cells, without):
        x, sure = [prior], []
        for k, cell in enumerate(cells):
            zeros, ones = (seen[k][cell, b] - (without and b == bit) for b in (0, 1))
            x.append(math.log((ones + 0.4) / (zeros + 0.4)))
            sure.append((zeros + ones > 0) + (zeros + ones > 3) + (zeros + ones > 30))
        return np.array([*x, M.BIAS]), 4 * sure[0] + sure[1]

    def sigmoid(z):
        return 1 / (1 + math.exp(-z))

    def bucket(z):
        return min(int((z + M.LIMIT) * M.BUCKETS / (2 * M.LIMIT) * (1 - 1e-6)), M.BUCKETS - 1)

    weights, offsets = np.tile(M.START_WEIGHTS, (M.GATES, 1)), np.zeros((M.GATES, M.BUCKETS))
    costs, former = [], []
    for _ in range(lm.LEARN_PASSES):
        slope, curve, cost = np.zeros((M.GATES, M.INPUTS)), np.zeros((M.GATES, M.INPUTS, M.INPUTS)), np.zeros(M.GATES)
        off, bend = np.zeros_like(offsets), np.zeros_like(offsets)
        for i in train:
            for bit, prior, cells in decisions(i)[0]:
                x, g = inputs(bit, prior, cells, True)
                z = float(np.clip(weights[g] @ x, -M.LIMIT, M.LIMIT))
                p = sigmoid(z)
                cost[g] -= math.log(p if bit else 1 - p)
                slope[g] += (bit - p) * x
                curve[g] += p * (1 - p) * np.outer(x, x)
                b = bucket(z)
                p = sigmoid(z + offsets[g, b])
                off[g, b] += bit - p
                bend[g, b] += p * (1 - p)
        step = np.array([np.linalg.solve(curve[g] + M.PRIOR * np.eye(M.INPUTS), slope[g] + M.PRIOR * (M.START_WEIGHTS - weights[g])) for g in range(M.GATES)])
        after = weights + step
        if costs:
            after[cost > costs[-1]] = former[-1][cost > costs[-1]]
        costs.append(cost)
        former.append(weights)
        weights, offsets = after, offsets + np.clip((off - M.PRIOR * offsets) / (bend + M.PRIOR), -1, 1)

    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(spark.createDataFrame(documents, "doc_id long, text string"), coded=coded).collect()}
    for i, _ in documents:
        w, d = weights.copy(), offsets.copy()
        score = sum(math.log10((counts[t] + 0.1) / (rest_n + 0.1 * (rest_v + 1))) for t in tokens[i] if t not in top)
        found, turns = decisions(i)
        for a, b in zip(turns[:-1], turns[1:]):
            uses, moves, lifts = collections.Counter(), np.zeros_like(w), np.zeros_like(d)
            for bit, prior, cells in found[a:b]:
                x, g = inputs(bit, prior, cells, False)
                z = float(np.clip(w[g] @ x, -M.LIMIT, M.LIMIT))
                p = sigmoid(z + d[g, bucket(z)])
                score += math.log10(p if bit else 1 - p)
                lifts[g, bucket(z)] += M.REFINE_RATE * (bit - p)
                moves[g] += (bit - sigmoid(z)) * x
                uses[g] += 1
            for g, n in uses.items():
                w[g] += lm.DOCUMENT_RATE / (n + 50) * moves[g]
            d += lifts
        assert got[i] == pytest.approx(score, rel=1e-3), i


def test_lm_odds_of_often_seen_cells():
    from gamspark.llm import mixing_model as M

    def part(zeros, ones):
        cells = np.zeros(lm.SLICE_CELLS, dtype=np.int64)
        cells[:2] = zeros, ones
        one = {"tab": [0], "at": [0], "cells": pa.array([lm._pack(cells)], pa.binary())}
        return pa.table(one)

    for zeros, ones in ((1_000_000, 100_000), (100_000, 50_000), (2**33, 2**31), (200, 100)):
        merged = lm._add_cells(pa.concat_tables([part(zeros - 3, ones), part(3, 0)]))
        cells = lm._unpack(merged.column("cells")[0].as_py())
        assert cells[:2].tolist() == [zeros, ones]
        for leave_out in (False, True):
            odds = M.Predictors.build([cells], leave_out).odds[0]
            assert odds[0] == pytest.approx(math.log(ones / zeros), abs=0.01)


def test_pages_with_other_layouts():
    page = (
        "<body><div class=menu><a href=x>Home</a></div><div id=content><h2>Title</h2><p>Some text, with marks. More &amp; more.<p>Second one<br>here, ok."
        "<div class='comments'><p>Nice post, really. Thanks.</div></div><form>Search <input></form><script>if(a<b)</script><aside>Also read, this one.</aside>"
    )
    assert pages.main_text(page) == "Title Some text, with marks. More & more. Second one here, ok."
    article = "<main><article><header><h1>Head</h1></header><p>One,&nbsp;two.</p><div class='cookie-notice'>We use cookies.</div><p>Three.</article></main><footer>Foot.</footer>"
    assert pages.main_text(article) == "Head One, two. Three."
    assert [pages.main_text(x) for x in (None, "", "<p>", "<a b='", "plain text", "<!-- x")] == ["", "", "", "", "plain text", ""]


LONG_PARAGRAPHS = [f"Paragraph {i} of the story tells, at some length, what happened on that day; it has marks, clauses and an end." for i in range(6)]


@pytest.mark.parametrize("wrapper", ["wrap has-sidebar", "comment-free social-science", "story ad-free", "content-with-nav", "widget", "js-widget site-banner"])
@pytest.mark.parametrize("element", ["div", "form", "section"])
def test_pages_names_that_do_not_decide(wrapper, element):
    body = "".join(f"<p>{x}</p>" for x in LONG_PARAGRAPHS)
    page = f"<body><nav><a href=x>Home</a></nav><{element} class='{wrapper}'><h1>Head</h1>{body}<div class='ad'>Buy this, now.</div></{element}><footer>Foot.</footer></body>"
    assert pages.main_text(page) == " ".join(["Head", *LONG_PARAGRAPHS])


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<div id=story>", "</div>"), ("<main><div>", "</div></main>"), ("", "")])
def test_pages_scores_decide_inside_the_article(open_, close):
    body = "".join(f"<p id=p{i}>{x}</p>" for i, x in enumerate(LONG_PARAGRAPHS[:3])) + "<h2>Part</h2><p>Short.</p><ul><li>An item</ul>"
    body += "".join(f"<p>{x}</p>" for x in LONG_PARAGRAPHS[3:])
    noise = "<div>Buy our stuff now</div><ul class=tags><li><a href=a>Teaser one</a><li><a href=b>Teaser two</a></ul><div><div><span>Nice post</span></div><div>I agree</div><div>So do I</div></div>"
    page = f"<body><ul><li><a href=x>Home</a></ul>{open_}<h1>Head</h1>{body}{noise}{close}<footer>Foot.</footer></body>"
    assert pages.main_text(page) == " ".join(["Head", *LONG_PARAGRAPHS[:3], "Part", "Short.", "An item", *LONG_PARAGRAPHS[3:]])


def test_pages_longer_comments_than_article():
    comments = "".join(f"<div class='comment'><p>{x}</p></div>" for x in LONG_PARAGRAPHS)
    page = f"<body><div class=post><h1>Head</h1><p>{LONG_PARAGRAPHS[0]}</p></div><div id='comments'>{comments}</div></body>"
    assert pages.main_text(page) == "Head " + LONG_PARAGRAPHS[0]


def test_pages_bear_odd_rows(spark):
    rows = [(1, "u", None), (None, None, "<p>A text, here.</p>"), (2, "u", ""), (2, "u", "<p>" + "long text. " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = pages.extract(df).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 13, 549_999]
    assert pages.extract(df.where("false")).count() == 0
