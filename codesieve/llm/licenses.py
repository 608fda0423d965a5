"""Licence scan with a positional index of rare words, in built-in functions only.

Every template is a sequence of words with a mandatory key phrase.  Over all
documents the document frequency of each key word is counted; a template's
anchors are the ``anchors`` rarest words of its key phrase (highest inverse document
frequency, ties by word; beyond the first only words of few documents).  A template with a
key word that no document holds is left out: it can stand nowhere.  A document looks its
anchor words up in the postings (word -> template, offset in the key phrase);
postings that agree on ``position - offset`` vote for a template start.  The votes are
sorted; a start with the votes of all anchor places is a run of equal ones of that length, and is verified: the key phrase must
stand there word for word, and at least ``least`` of the template's words must
stand within ``shift`` words of their place (a notice may lack or add some words).
So no start that the verification would accept is lost by the votes.
For the exact phrases the key phrase is the whole template.

The postings and the word counts are bounded by the template texts, not by the data.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

Edge cases: a null or empty text has no words: counts 0, labels empty, score
0, first and last null.  Rows are independent; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm import common as C

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Exact phrases: label and phrase.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: Notices: label, notice, its mandatory key phrase.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("mit", "licensed under the terms of the mit license", "the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
                 "with the license", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met", "redistribution and use in source and binary forms"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation",
     "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license",
     "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license",
     "creative commons attribution sharealike"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("proprietary", "all rights reserved", "all rights reserved"),
]

#: A word that more than one in so many documents hold is an anchor only where the key phrase has no rarer one.
COMMON = 8

MATCHES = "array<struct<template:int,label:string,exact:boolean,start:bigint,score:double>>"


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


class Template:
    def __init__(self, label: str, text: str, key: str, exact: bool):
        self.label, self.words, self.exact = label, template_words(text), exact
        k = template_words(key)
        self.key_at = next(i for i in range(len(self.words)) if self.words[i:i + len(k)] == k)
        self.key = k


def templates(phrases=PHRASES, notices=NOTICES) -> list[Template]:
    return [Template(x, p, p, True) for x, p in phrases] + [Template(x, p, k, False) for x, p, k in notices]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def word_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents per vocabulary word over all ``docs``, and their number under "".
    At most ``len(vocabulary) + 1`` rows reach the driver."""
    listed = F.array(F.lit(""), *map(F.lit, vocabulary))
    seen = F.array_intersect(F.array_append(words_of(F.col("text")), F.lit("")), listed)
    return {r.w: r.n for r in docs.select(F.explode(seen).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}


def choose_anchors(known: list[Template], counts: dict[str, int], anchors: int) -> list[list[str]]:
    """Anchor words by template; none for a template whose key phrase the corpus cannot hold."""
    total = counts.get("", 0)
    idf = lambda w: math.log((total + 1) / (counts.get(w, 0) + 1))
    rarest = [sorted(set(t.key), key=lambda w: (-idf(w), w))[:anchors] for t in known]
    few = [[w for i, w in enumerate(ws) if not i or COMMON * counts.get(w, 0) <= total] for ws in rarest]
    return [ws if all(counts.get(w) for w in t.key) else [] for t, ws in zip(known, few, strict=True)]


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES, anchors: int = 3, least: float = 0.8, shift: int = 2,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, matches array<struct<template int, label, exact
    boolean, start long, score double>>) per document, by start and template."""
    docs, known = C.texts(docs, id_col, text_col), templates(phrases, notices)
    counts = word_counts(docs, sorted({w for t in known for w in t.key}))
    picked = choose_anchors(known, counts, anchors)
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, rare in enumerate(picked):
        for o, w in enumerate(known[t].key, known[t].key_at):
            if w in rare:
                postings.setdefault(w, []).append((t, o))
    if not postings:
        return docs.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"), F.from_json(F.lit("[]"), MATCHES).alias("matches"))
    listed = sorted(postings)
    array = lambda values: F.array(*map(F.lit, values))
    places = F.create_map(*[x for w in listed for x in (F.lit(w), F.array(*[
        F.struct(F.lit(t).alias("t"), F.lit(o).alias("o")) for t, o in postings[w]]))])
    needed = array([sum(w in rare for w in known[t].key) for t, rare in enumerate(picked)])
    bodies = F.array(*[array(t.words) for t in known])
    shifts = array(list(range(-shift, shift + 1)))
    keys, key_at = F.array(*[array(t.key) for t in known]), array([t.key_at for t in known])
    labels, exact = array([t.label for t in known]), array([t.exact for t in known])

    def matches(words: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(listed), i)), lambda i: i.isNotNull())
        votes = F.flatten(F.transform(hits, lambda i: F.transform(
            F.element_at(places, words[i]), lambda p: (i - p["o"]).cast("long") * len(known) + p["t"])))

        def enough(v, i, all_votes):
            """The first of a run of equal votes that is as long as its template needs."""
            first = F.coalesce(F.get(all_votes, i - 1) != v, F.lit(True))
            return (v >= 0) & first & (F.get(all_votes, i + needed[F.pmod(v, F.lit(len(known))).cast("int")] - 1) == v)

        def places_of(all_votes):
            starts = F.filter(F.transform(all_votes, lambda v, i: F.when(enough(v, i, all_votes), F.struct(
                F.pmod(v, F.lit(len(known))).cast("int").alias("t"), F.floor(v / len(known)).cast("int").alias("start")))), lambda v: v.isNotNull())
            return F.filter(starts, lambda v: F.slice(words, v["start"] + key_at[v["t"]] + 1, F.size(keys[v["t"]])) == keys[v["t"]])

        return C.bind(F.sort_array(votes), lambda all_votes: F.filter(F.transform(
            places_of(all_votes),
            lambda v: F.struct(
                v["t"].alias("template"), labels[v["t"]].alias("label"), exact[v["t"]].alias("exact"), v["start"].cast("long").alias("start"),
                (F.size(F.filter(F.transform(bodies[v["t"]], lambda w, i: F.exists(
                    shifts, lambda d: F.get(words, v["start"] + i + d) == w)), lambda same: same))
                 / F.size(bodies[v["t"]])).alias("score"))),
            lambda m: m["score"] >= least))

    found = C.bind(words_of(F.col("text")), lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.array_sort(matches(words), lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]))
                     .otherwise(F.signum(a["template"] - b["template"])).cast("int")).alias("matches")))
    return docs.select("doc_id", found.alias("f")).select("doc_id", "f.n_words", "f.matches")


def digest(scanned: DataFrame) -> DataFrame:
    """One flat row per document: places of the exact phrases and all labels."""
    base = F.filter("matches", lambda m: m["exact"])
    named = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), named(base).alias("base_labels"), named(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"))
