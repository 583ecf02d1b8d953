"""The registered queries next to their SQL, or to a plain version on the whole small table."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from compare import compare, connect
from helpers import words

import __spark_entry__ as entry
from gamspark.llm import fingerprints, neardup, registry, tokens

NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def documents(sf):
    return connect(sf).execute("select doc_id, coalesce(text, '') from documents order by doc_id").fetchall()


def rows(spark, sf, name):
    return [r.asDict() for r in entry.queries()[name](spark, sf).collect()]


def test_one_query_for_each_operator():
    assert {re.match(r"op(\d+)_|(pipeline)", n)[0] for n in NAMES} == {f"op{n}_" for n in range(1, 14)} | {"pipeline"}
    assert set(registry.SQL) <= set(NAMES)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert compare(entry.queries()[name](spark, sf), connect(sf), registry.SQL[name]) == ""


def test_repeats_against_plain_version(spark, sf, documents):
    seen, want = set(), []
    for i, text in documents:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(spark, sf, "op10_repeats"))
    assert got == want
    assert sum(r[2] for r in want) > 0


def test_tokens_against_the_library(spark, sf, documents):
    tokenizer = tokens.PieceEncoder(tokens.default_tokenizer()).tokenizer
    start, want = 0, []
    for i, text in documents:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(spark, sf, "op6_token_output"))
    assert got == want


def test_fingerprints_of_edited_texts(spark, sf, documents):
    got = {r["doc_id"]: r for r in rows(spark, sf, "op2_fingerprints")}
    order = documents[::-1]
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        own, changed, other = fingerprints.fingerprints(fingerprints._texts([t.encode() for t in (text, edited, following)]))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == "".join(f"{h:08x}" for h in own)
        assert (r["near_edited"], r["near_next"]) == (fingerprints.likeness(own, changed), fingerprints.likeness(own, other))
    long = [r for r in got.values() if r["n_chars"] > 1000]
    assert 0.35 < np.mean([r["near_edited"] for r in long]) < 0.65
    assert np.mean([r["near_next"] for r in long]) < 0.05


def test_lm_counts_and_gain(spark, sf, documents):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = {i: [*words(t.translate(lower)), None] for i, t in documents}
    train = collections.Counter()
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            train.update(w)
    n, v = sum(train.values()), len(train)
    got = {r["doc_id"]: r for r in rows(spark, sf, "op4_lm_score")}
    assert got.keys() == texts.keys()
    for i, w in texts.items():
        r = got[i]
        base = sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(train[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def multiset_classes(documents, similarity=0.8):
    parent = {i: i for i, _ in documents}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    first, bags, places = {}, {}, collections.defaultdict(list)
    for i, text in documents:
        if text in first:
            join(i, first[text])
            continue
        first[text] = i
        w = words(text)
        bags[i] = collections.Counter([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else []))
        for s in bags[i]:
            places[s].append(i)
    for i, bag in bags.items():
        common = collections.Counter()
        for s, k in bag.items():
            for j in places[s]:
                if j < i:
                    common[j] += min(k, bags[j][s])
        for j, c in common.items():
            if c >= similarity * (sum(bag.values()) + sum(bags[j].values()) - c):
                join(i, j)
    return {i: find(i) for i, _ in documents}


def test_near_duplicates_against_all_pairs(spark, sf, documents):
    want = multiset_classes(documents)
    got = {r["doc_id"]: r["class_id"] for r in rows(spark, sf, "op8_near_duplicates")}
    assert got == want
    assert len(set(want.values())) < len(want)


def test_leaks_found_where_the_whole_item_stands(spark, sf, documents):
    def plain(text):
        return " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())) + " "

    items = connect(sf).execute("select item_id, text from benchmark").fetchall()
    texts = [(i, plain(t)) for i, t in documents]
    want = {(i, k) for k, item in items for i, t in texts if plain(item) in t}
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in rows(spark, sf, "op1_benchmark_leaks")}
    assert want and want <= got.keys()
    assert all(got[x] == 1.0 for x in want)
    assert len(got) <= 1.1 * len(want) + 1


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = dict(connect(sf).execute("select doc_id, toxic from labels").fetchall())
    got = [(labels[r["doc_id"]], r["score"]) for r in rows(spark, sf, "op7_toxicity") if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [s for y, s in got if y == 1], [s for y, s in got if y == 0]
    auc = np.mean([np.mean([(a > b) + 0.5 * (a == b) for b in clean]) for a in toxic])
    assert auc > 0.93
    assert np.mean([s >= 0.5 for s in clean]) < 0.01


def test_main_text_of_the_articles(spark, sf):
    import html

    pages = dict(connect(sf).execute("select page_id, html from pages").fetchall())
    for r in rows(spark, sf, "op9_main_text"):
        article = pages[r["page_id"]].split("<article>")[1].split("</article>")[0].replace("<b>", "").replace("<br>", " ")
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == " ".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("begin, end", [("<div>", "</div>"), ("<div class='x has-sidebar'><div>", "</div></div>"), ("", "")])
def test_main_text_without_an_article_element(sf, begin, end):
    from gamspark.llm.pages import main_text

    for (page,) in connect(sf).execute("select html from pages").fetchall():
        assert main_text(page.replace("<article>", begin).replace("</article>", end)) == main_text(page)


def test_pipeline_against_its_parts(spark, sf, documents):
    """The written documents are those that a plain version of the stages keeps; the token files hold their ids."""
    import corpus_pipeline as P
    from gamspark.llm import toxicity
    from gamspark.llm.common import table

    assert [k for k, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "source_mix", "token_output"]
    docs = table(spark, sf, "documents")
    names = docs.columns
    bad = {r["doc_id"] for r in rows(spark, sf, "op7_toxicity") if r["predicted"]}
    left = [(i, t) for i, t in documents if i not in bad]
    stage = P.drop_toxic(spark, docs, sf)
    assert stage.columns == names and sorted(r["doc_id"] for r in stage.collect()) == [i for i, _ in left]
    classes = multiset_classes(left)
    left = [(i, t) for i, t in left if classes[i] == i]
    stage = P.drop_near_duplicates(spark, stage, sf)
    assert stage.columns == names and sorted(r["doc_id"] for r in stage.collect()) == [i for i, _ in left]
    stage = P.drop_leaks(spark, stage, sf)
    leaked = {r["doc_id"] for r in rows(spark, sf, "op1_benchmark_leaks")}
    kept = sorted(r["doc_id"] for r in stage.collect())
    assert stage.columns == names and set(kept) <= {i for i, _ in left} and {i for i, _ in left} - set(kept) <= leaked
    mixed = P.mix_sources(spark, stage, sf)
    counts = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == names and set(counts) <= set(kept) and max(counts.values()) == 2
    tokenizer, text_of, start, want = tokens.PieceEncoder(tokens.default_tokenizer()).tokenizer, dict(documents), 0, []
    for i in sorted(counts.elements()):
        n = len(tokenizer.encode(text_of[i], add_special_tokens=False).ids) + 1
        want.append((i, start, n))
        start += n
    assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in rows(spark, sf, "pipeline")) == want
    assert isinstance(toxicity.PRIOR, np.ndarray) and neardup.SIMILARITY == 0.8
