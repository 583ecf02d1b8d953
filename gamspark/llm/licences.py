"""Licence scan with a positional index of rare words. DataFrame functions only, no shuffle of texts.

One pass counts in how many files each licence word stands. The index maps, for every key phrase, its word of highest IDF to the
phrase and the place of the word in it. A file is looked up by those of its words that the index has; the phrase's second rarest
word must stand at its relative position, then the whole phrase is verified. A label needs all of its key phrases. The index is
as large as the list of phrases below, whatever the number of files.

Nulls and odd cases: a null or empty text has no words (n_words 0, first_word and last_word null, labels empty, score 0);
overlapping and repeated places all count; rows with the same id are separate; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table
from .registry import query

#: The labels whose places are counted, and further labels; each with its key phrases, all of them mandatory.
BASE = {"mit": ["under the mit license"], "apache-2": ["apache license version 2"], "cc-by-nc": ["cc by nc"]}
FURTHER = {
    "agpl-3": ["gnu affero general public license version 3"],
    "bsd-2-clause": ["redistribution and use in source and binary forms", "this list of conditions and the following disclaimer"],
    "bsd-3-clause": ["redistribution and use in source and binary forms", "neither the name of"],
    "cc-by": ["creative commons attribution"],
    "cc-by-sa": ["cc by sa"],
    "cc0": ["cc0 1 0 universal"],
    "epl-2": ["eclipse public license v 2 0"],
    "gpl-2": ["gnu general public license version 2"],
    "gpl-3": ["gnu general public license version 3"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose"],
    "lgpl": ["gnu lesser general public license"],
    "mit-text": ["permission is hereby granted free of charge", "this permission notice shall be included in all copies"],
    "mpl-2": ["mozilla public license version 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Phrase:
    number: int
    words: tuple[str, ...]
    anchor: int = 0
    second: int = 0


def phrases(labels: dict[str, list[str]]) -> list[Phrase]:
    return [Phrase(i, tuple(p.split())) for i, p in enumerate(dict.fromkeys(p for ps in labels.values() for p in ps))]


def split_words(docs: DataFrame) -> DataFrame:
    """doc_id, parts: the lower-cased text cut at gaps; the first and last part may be empty."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    return pick(docs, "doc_id", "text").select("doc_id", F.split(text, GAP).alias("parts"))


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Files that have each word: at most one row per word of the vocabulary comes back."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    hits = split_words(docs).select(F.explode(F.array_intersect("parts", known)).alias("word"))
    return {r["word"]: r["n"] for r in hits.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def anchored(found: list[Phrase], frequency: dict[str, int], files: int) -> list[Phrase]:
    """Phrases with the places of their two words of highest IDF."""

    def idf(word: str) -> float:
        return math.log((files + 1) / (frequency.get(word, 0) + 1))

    out = []
    for p in found:
        ranked = sorted(range(len(p.words)), key=lambda i: (-idf(p.words[i]), i))
        out.append(Phrase(p.number, p.words, ranked[0], ranked[min(1, len(ranked) - 1)]))
    return out


def postings(found: list[Phrase]) -> Column:
    """Map from a rare word to its phrases: number, place of the word, place of the second word less that, words."""
    by_word: dict[str, list[Phrase]] = {}
    for p in found:
        by_word.setdefault(p.words[p.anchor], []).append(p)
    entries = []
    for word, ps in by_word.items():
        rows = [
            F.struct(
                F.lit(p.number).alias("number"), F.lit(p.anchor).alias("at"), F.lit(p.second - p.anchor).alias("second_at"),
                F.lit(p.words[p.second]).alias("second"), F.array(*[F.lit(w) for w in p.words]).alias("words"),
            )
            for p in ps
        ]
        entries += [F.lit(word), F.array(*rows)]
    return F.create_map(*entries)


def scan(docs: DataFrame, base: dict[str, list[str]] | None = None, further: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places."""
    base, further = BASE if base is None else base, FURTHER if further is None else further
    labels = base | further
    found = phrases(labels)
    vocabulary = sorted({w for p in found for w in p.words})
    found = anchored(found, document_frequency(docs, vocabulary), pick(docs, "doc_id").count())
    number = {" ".join(p.words): p.number for p in found}
    base_numbers = sorted({number[" ".join(x.split())] for ps in base.values() for x in ps})
    index = postings(found)
    rare = sorted({p.words[p.anchor] for p in found})

    lead = F.when(F.element_at("parts", 1) == "", 1).otherwise(0)
    trail = F.when((F.size("parts") > 1) & (F.element_at("parts", -1) == ""), 1).otherwise(0)
    hits = F.array_compact(F.transform("parts", lambda w, i: F.when(w.isin(rare), i)))
    looked_up = split_words(docs).select("doc_id", "parts", lead.alias("lead"), (F.size("parts") - lead - trail).cast("long").alias("n_words"), hits.alias("hits"))

    def word(i: Column) -> Column:
        return F.get(F.col("parts"), i)

    def at_hit(i: Column) -> Column:
        fits = F.filter(
            F.element_at(index, word(i)),
            lambda p: (i >= p["at"])
            & (word(i + p["second_at"]) == p["second"])
            & (F.slice(F.col("parts"), i - p["at"] + 1, F.size(p["words"])) == p["words"]),
        )
        return F.transform(fits, lambda p: F.struct((i - p["at"] - F.col("lead")).cast("long").alias("start"), p["number"].alias("phrase")))

    placed = looked_up.select("doc_id", "n_words", F.flatten(F.transform("hits", at_hit)).alias("places"))
    ours = F.transform(F.filter("places", lambda x: x["phrase"].isin(base_numbers)), lambda x: x["start"])
    listed = placed.select("doc_id", "n_words", "places", F.array_sort(ours).alias("starts"), F.array_distinct(F.transform("places", lambda x: x["phrase"])).alias("there"))

    def has(phrase: str) -> Column:
        return F.array_contains("there", number[" ".join(phrase.split())])

    def label_list(which: dict[str, list[str]]) -> Column:
        given = [F.when(_all([has(p) for p in ps]), F.lit(label)) for label, ps in sorted(which.items())]
        return F.concat_ws(",", F.array_compact(F.array(*given))) if given else F.lit("")

    def share(ps: list[str]) -> Column:
        """Of a label's phrase words, those in phrases that are there."""
        got = sum((F.when(has(p), F.lit(len(p.split()))).otherwise(F.lit(0)) for p in ps), F.lit(0))
        return got.cast("double") / F.lit(float(sum(len(p.split()) for p in ps)))

    return listed.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.element_at(F.when(F.size("starts") > 0, F.col("starts")), 1).alias("first_word"),
        F.element_at(F.when(F.size("starts") > 0, F.col("starts")), -1).alias("last_word"),
        label_list(base).alias("base_labels"), label_list(labels).alias("labels"),
        F.greatest(F.lit(0.0), *[share(ps) for ps in labels.values()]).alias("score"), "places",
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def licence_sql(base: dict[str, list[str]], further: dict[str, list[str]]) -> str:
    """The same rows for DuckDB, from a search for each phrase."""

    def there(phrase: str) -> str:
        return f"contains(joined, ' {phrase} ')"

    def label_list(which: dict[str, list[str]]) -> str:
        given = [f"CASE WHEN {' AND '.join(there(p) for p in ps)} THEN '{label}' END" for label, ps in sorted(which.items())]
        return f"concat_ws(',', {', '.join(given)})"

    def share(ps: list[str]) -> str:
        got = " + ".join(f"CASE WHEN {there(p)} THEN {len(p.split())} ELSE 0 END" for p in ps)
        return f"CAST({got} AS DOUBLE) / {sum(len(p.split()) for p in ps)}.0"

    def starts(phrase: str) -> str:
        ws = phrase.split()
        same = " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(ws))
        return f"list_filter(range(0, greatest(0, len(words) - {len(ws) - 1})), lambda i: {same})"

    places = [starts(p) for ps in base.values() for p in ps]
    joined = places[0]
    for p in places[1:]:
        joined = f"list_concat({joined}, {p})"
    every = base | further
    return f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
    j AS (SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS joined FROM w),
    p AS (SELECT *, CASE WHEN {' OR '.join(there(x) for ps in base.values() for x in ps)} THEN {joined} ELSE [] END AS starts FROM j)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base, CAST(list_min(starts) AS BIGINT) AS first_word,
           CAST(list_max(starts) AS BIGINT) AS last_word, {label_list(base)} AS base_labels, {label_list(every)} AS labels,
           greatest(0.0, {', '.join(share(ps) for ps in every.values())}) AS score
    FROM p"""


@query("op5_licence_scan", licence_sql(BASE, FURTHER))
def op5_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents")).drop("places")
