"""Toxicity: a lexicon learned from labelled rows, matched by Levenshtein automata on a trie, weighed by its context.

1. Learn: in a bounded sample of labelled training documents (at most about TRAIN_ROWS, by a hash of the id) count in how many
   toxic and clean documents each word and each word beginning stands; those with a significant excess of toxic ones form the
   lexicon (at most MAX_TERMS). Strong words and beginnings of five letters or more may be misspelled by one edit; strong words
   stay in the lexicon for their misspellings when a beginning of theirs is in it, beyond MAX_TERMS.
2. Compile: the trie of the lexicon and the automaton for one edit are walked together; each set of positions reached becomes a
   state of one deterministic automaton over bytes.
3. Match: all words of a slice of texts step through the table at once; dead words drop out after a few bytes.
4. Weigh: a match between quotation marks or near a word of reporting counts as quoted. A logistic model on the numbers of own
   and quoted, exact and misspelled matches, fitted to the same sample, gives the score.

Labels, language, source and id are no inputs of the score. Nulls and odd cases: null or empty text gets the score of a text
without matches; null or missing labels teach nothing (without toxic or clean rows the score is the base rate); a document
labelled twice is toxic if one label says so; a null id counts as the empty text for the hold-out hash; rows with the same id
are separate; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, pick, slices, small_batches, table
from .registry import query

TRAIN_ROWS = 20_000
MAX_TERMS = 400
MIN_WORD, FUZZY_FROM = 3, 5
PREFIXES = (4, 5, 6)
SIGNIFICANCE = 18.0
LIFT = 4.0
#: A term is strong if its share of toxic documents is this high even with so many more documents of the base rate.
STRONG, SMOOTHING = 0.7, 5
WINDOW = 6
#: Words of reporting, and quotation marks.
CUES = frozenset(
    "said says say wrote writes called calls quote quoted quotes quoting word term slur insult insulted reported "
    "sagte schrieb nannte zitat wort dit écrit appelé mot citation dijo escribió llamó palabra cita".split()
)
OPENING, CLOSING = "\"“«„‹‘", "\"”»“›’"
#: Weights towards which the fit shrinks: own matches speak for toxicity, quoted and misspelled ones less.
PRIOR = np.array([3.0, 0.5, 0.5, 0.1, 1.5, 0.3, 0.2, 1.0, 0.3, 0.2])
SHRINK = 1.0


def held_out(doc_id: Column, parts: int) -> Column:
    """crc32(doc_id as text) mod parts is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 0


@dataclass
class Automaton:
    """Table of states by byte class; state 0 is dead. final: 0 no term, 1 strong term, 2 misspelled strong term, 3 weak term."""

    classes: np.ndarray
    step: np.ndarray
    final: np.ndarray
    hit: int

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), dtype=np.int8)
        live, state, at = np.arange(len(starts)), np.ones(len(starts), dtype=np.int32), 0
        while len(live):
            state = self.step[state, self.classes[data[starts[live] + at]]]
            at += 1
            over = (ends[live] - starts[live] == at) | (state == self.hit)
            out[live[over]] = self.final[state[over]]
            on = ~over & (state != 0)
            live, state = live[on], state[on]
        return out


#: Positions of words that have begun as a term says, strong and weak, and strong but misspelled.
HIT, WEAK_HIT, FUZZY_HIT = (-1, 0), (-1, 1), (-1, 2)


def compile_automaton(words: list[str], prefixes: list[str], weak: frozenset[str] = frozenset()) -> Automaton:
    """Deterministic automaton of whole words (strong ones of FUZZY_FROM letters or more with one edit) and word beginnings (the same)."""
    children: list[dict[int, int]] = [{}, {}]  # roots: 0 of words that may be misspelled, 1 of the others
    whole: dict[int, int] = {}
    begins: dict[int, tuple[int, int]] = {}

    def insert(term: str, root: int) -> int:
        node = root
        for byte in term.encode():
            if byte not in children[node]:
                children.append({})
                children[node][byte] = len(children) - 1
            node = children[node][byte]
        return node

    fuzzy = [w for w in words if len(w) >= FUZZY_FROM and w not in weak]
    for word in fuzzy:
        whole[insert(word, 0)] = 1
    fuzzy_begins = {insert(p, 0) for p in prefixes if len(p) >= FUZZY_FROM and p not in weak}
    fuzzy_nodes = {0, *range(2, len(children))}
    for word in set(words).difference(fuzzy):
        whole[insert(word, 1)] = 3 if word in weak else 1
    for prefix in prefixes:
        begins[insert(prefix, 1)] = WEAK_HIT if prefix in weak else HIT

    alphabet = sorted({b for edges in children for b in edges})
    classes = np.zeros(256, dtype=np.int32)
    classes[alphabet] = np.arange(1, len(alphabet) + 1)

    def closed(positions: set) -> frozenset:
        if HIT in positions:
            return frozenset([HIT])
        if FUZZY_HIT in positions:  # other misspellings say no more
            positions = {p for p in positions if p[0] < 0 or not p[1]}
        more = {(c, 1) for node, edits in positions if not edits and node in fuzzy_nodes for c in children[node].values()}
        return frozenset(positions | more) if FUZZY_HIT not in positions else frozenset(positions)

    def after(state: frozenset, byte: int | None) -> frozenset:
        out = set()
        for node, edits in state:
            if node < 0 or node in begins:
                out.add((node, edits) if node < 0 else begins[node])
            if node < 0:
                continue
            if edits and node in fuzzy_begins:
                out.add(FUZZY_HIT)
            if byte in children[node]:
                out.add((children[node][byte], edits))
            if not edits and node in fuzzy_nodes:
                out.add((node, 1))
                out.update((c, 1) for c in children[node].values())
        return closed(out)

    start = closed({(0, 0), (1, 0)})
    numbers, todo, rows = {frozenset(): 0, start: 1}, [start], {0: [0] * (len(alphabet) + 1)}
    while todo:
        state = todo.pop()
        row = []
        for byte in [None, *alphabet]:
            to = after(state, byte)
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            row.append(numbers[to])
        rows[numbers[state]] = row
    final = np.zeros(len(numbers), dtype=np.int8)
    for state, number in numbers.items():
        exact = {whole[n] for n, e in state if not e and n in whole} | {1 for p in state if p == HIT} | {3 for p in state if p == WEAK_HIT}
        final[number] = 1 if 1 in exact else 2 if FUZZY_HIT in state or any(e and n in whole for n, e in state if n >= 0) else 3 if exact else 0
    hit = numbers.get(frozenset([HIT]), -1)
    return Automaton(classes, np.array([rows[i] for i in range(len(rows))], dtype=np.int32), final, hit)


@dataclass
class Model:
    automaton: Automaton
    innocent: frozenset = frozenset()
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = -3.0

    def counts(self, texts: Texts) -> np.ndarray:
        """Per text: own and quoted matches of strong terms, misspelled ones, weak terms."""
        lowered = texts.lower()
        words = lowered.words(spaces=False)
        kind = self.automaton.run(lowered.data, words.starts, words.ends)
        out = np.zeros((len(texts), 6), dtype=np.int64)
        found = np.flatnonzero(kind)
        if not len(found):
            return out
        doc = np.searchsorted(words.bounds, found, "right") - 1
        for i, d in zip(found.tolist(), doc.tolist()):
            if kind[i] == 2 and words.word(i).decode(errors="replace") in self.innocent:
                continue
            first, last = max(words.bounds[d], i - WINDOW), min(words.bounds[d + 1], i + WINDOW + 1) - 1
            before = texts.data[words.starts[first] : words.starts[i]].tobytes().decode(errors="replace")
            behind = texts.data[words.ends[i] : words.ends[last]].tobytes().decode(errors="replace")
            out[d, 2 * (kind[i] - 1) + _quoted(before, behind)] += 1
        return out

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(features(counts) @ self.weights + self.bias)))


def _quoted(before: str, behind: str) -> int:
    """Whether a quotation opens before and closes behind, or a word of reporting is near."""
    opened = max((before.count(o) - (before.count(c) if c != o else 0)) % 2 if o == c else before.rfind(o) > before.rfind(c) for o, c in zip(OPENING, CLOSING))
    if opened and any(c in behind for c in CLOSING):
        return 1
    return int(not CUES.isdisjoint(re.findall(r"\w+", (before + " " + behind).lower())))


def features(counts: np.ndarray) -> np.ndarray:
    own, quoted, fuzzy, quoted_fuzzy, weak, quoted_weak = counts.T
    columns = [own > 0, np.log1p(own), quoted > 0, np.log1p(quoted), fuzzy > 0, np.log1p(fuzzy), quoted_fuzzy > 0, weak > 0, np.log1p(weak), quoted_weak > 0]
    return np.column_stack(columns).astype(float)


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of labelled documents that are not held out; at most about ``rows``, by a hash of the id."""
    known = (
        pick(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    share = rows / max(known.count(), rows)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in slices(batches):
        counts: Counter = Counter()
        words = texts.lower().words(spaces=False)
        for d, toxic in enumerate(rows.column("toxic").to_pylist()):
            own = {words.word(i) for i in range(words.bounds[d], words.bounds[d + 1])}
            own = {w for w in (x.decode(errors="replace") for x in own) if MIN_WORD <= len(w) <= 64}
            counts.update((w, 0, toxic) for w in own)
            counts.update({(w[:n], n, toxic) for w in own for n in PREFIXES if len(w) > n})
        keys = list(counts)
        yield pa.RecordBatch.from_pydict(
            {
                "term": pa.array([k[0] for k in keys], pa.string()), "prefix": pa.array([k[1] for k in keys], pa.int32()),
                "toxic": pa.array([k[2] for k in keys], pa.int32()), "n": pa.array([counts[k] for k in keys], pa.int64()),
            }
        )


def learn_lexicon(counted: DataFrame, toxic: int, clean: int, max_terms: int = MAX_TERMS) -> tuple[list[str], list[str], frozenset[str]]:
    """Whole words and word beginnings whose excess in toxic documents is significant (likelihood ratio), and the weak of them."""
    if not toxic or not clean:
        return [], [], frozenset()
    rate = toxic / (toxic + clean)
    a, b = F.col("t"), F.col("c")

    def part(x: Column, expected: float) -> Column:
        return F.when(x > 0, x * F.log(x / ((a + b) * expected))).otherwise(0.0)

    ranked = (
        counted.withColumn("g", 2 * (part(a, rate) + part(b, 1 - rate)))
        .where((a / (a + b) >= min(0.5, LIFT * rate)) & (F.col("g") >= SIGNIFICANCE))
        .orderBy(F.desc("g"), F.when(F.col("prefix") == 0, 100).otherwise(F.col("prefix")).desc(), "term")
        .limit(10 * max_terms)
        .collect()
    )
    words, begins, weak, under = [], [], set(), []
    for row in ranked:
        term = row["term"]
        below = [p for p in begins if term.startswith(p)]
        is_weak = (row["t"] + SMOOTHING * rate) / (row["t"] + row["c"] + SMOOTHING) < STRONG
        if below:
            # The beginning matches this word; its misspellings are the word's own. It takes no place of another term.
            if not row["prefix"] and len(term) >= FUZZY_FROM and not is_weak:
                under.append(term)
            continue
        if len(words) + len(begins) == max_terms or row["prefix"] and any(x.startswith(term) for x in words + begins):
            continue
        (begins if row["prefix"] else words).append(term)
        if is_weak:
            weak.add(term)
    return words + under, begins, frozenset(weak)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton steps; weights shrink towards PRIOR."""
    design = np.column_stack([x, np.ones(len(x))])
    prior, shrink = np.append(PRIOR, 0.0), np.append(np.full(len(PRIOR), SHRINK), 1e-6)
    beta = np.append(PRIOR, np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    for _ in range(30):
        p = 1 / (1 + np.exp(-(design @ beta)))
        gradient = design.T @ (y - p) - shrink * (beta - prior)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(shrink)
        move = np.linalg.solve(hessian, gradient)
        beta = beta + move
        if np.abs(move).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, max_terms: int = MAX_TERMS) -> Model:
    small_batches(docs.sparkSession)
    sample = training_sample(docs, labels, rows).persist()
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counted = (
        sample.mapInArrow(_terms, "term string, prefix int, toxic int, n long").groupBy("term", "prefix")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
        .persist()
    )
    automaton = compile_automaton(*learn_lexicon(counted, toxic, clean, max_terms))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, "term"):
            starts, ends = texts.offsets[:-1], texts.offsets[1:]
            kept = np.flatnonzero(automaton.run(texts.data, starts, ends) == 2)
            yield pa.RecordBatch.from_pydict({"term": pa.array([texts.text(i).decode() for i in kept.tolist()], pa.string())})

    # Words of clean documents that are, or begin, one edit from a term: words of the bounded sample.
    innocent = frozenset(r["term"] for r in counted.where("prefix = 0 AND c > 0 AND c >= t").select("term").mapInArrow(near, "term string").collect())
    model = Model(automaton, innocent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_, texts in slices(batches):
            c = model.counts(texts)
            yield pa.RecordBatch.from_pydict({"toxic": rows_.column("toxic").cast(pa.int32())} | {f"c{i}": pa.array(c[:, i], pa.int64()) for i in range(6)})

    # Equal counts are one row: the fit sees a small table of distinct rows with their numbers.
    got = sample.mapInArrow(count, "toxic int, c0 long, c1 long, c2 long, c3 long, c4 long, c5 long").collect() if toxic and clean else []
    sample.unpersist()
    counted.unpersist()
    if got:
        rows_ = np.array([tuple(r) for r in got], dtype=np.int64)
        model.weights, model.bias = fit_logistic(features(rows_[:, 1:]), (rows_[:, 0] == 1).astype(float))
    elif toxic + clean:
        model.bias = 3.0 if toxic else -3.0
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches, n_quoted. A narrow job over whole texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            counts = model.counts(texts)
            p = model.scores(counts)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": rows.column("doc_id"), "score": pa.array(p, pa.float64()), "predicted": pa.array((p >= 0.5).astype(np.int32), pa.int32()),
                    "n_matches": pa.array(counts.sum(axis=1), pa.int64()), "n_quoted": pa.array(counts[:, 1::2].sum(axis=1), pa.int64()),
                }
            )

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(run, "doc_id long, score double, predicted int, n_matches long, n_quoted long")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", "predicted", "n_matches", "n_quoted")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not call toxic, unchanged."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            yield rows.filter(pa.array(model.scores(model.counts(texts)) < 0.5))

    return docs.mapInArrow(run, docs.schema)


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score(docs, train(docs, table(spark, folder, "labels")))
