"""Licence scans: an exact set-similarity join of text blocks with licence templates.

A document's words are lower-case letters, digits and non-ASCII.  Its blocks for a
template of n words are the windows of 2n words, one from every word on, so every
run of up to 2n words lies within one, whatever lines it is wrapped to.  A
block matches a template if it holds at least ``THRESHOLD`` of the template's
distinct words (containment).  Template words are ordered by how many documents
hold them, rarest first, over the whole corpus; a template's prefix are its
|t| - ceil(threshold |t|) + 1 rarest words, of which every matching block must hold
one.  Blocks are found through these prefix words only: the stretches of text whose
blocks hold one pass the length filter (enough template words) and the positional
filter (enough still to come in the common order), and a running count of distinct
template words verifies every block in them.  Fixed phrases are looked for besides,
exactly.

The templates are a parameter list of bounded size, so they go to the tasks whole.

Defined cases: null and empty texts have no words, no label and score 0; repeated
rows get the same labels; texts of any length are scanned whole; an empty table
gives an empty result; columns beside id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import license_texts
from .common import with_text_columns

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label -> wordings: short notices as they stand in files, and whole texts.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", license_texts.APACHE_NOTICE],
    "mit": ["Released under the MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
            license_texts.MIT],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "bsd-2": [license_texts.BSD_2],
    "bsd-3": [license_texts.BSD_3],
    "isc": [license_texts.ISC],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3", license_texts.GPL_NOTICE],
    "lgpl-2.1": [license_texts.LGPL_NOTICE],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0"],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4.0": [license_texts.CC_BY_SA],
    "cc0-1.0": [license_texts.CC0],
    "unlicense": [license_texts.UNLICENSE],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}
THRESHOLD = 0.9
MAX_TEMPLATE_WORDS = 10_000

_WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32
               for c in range(256))


def words_of(text: bytes | None) -> list:
    return text.translate(_WORDS).split() if text else []


def phrase_places(text: bytes | None, phrases: dict) -> tuple:
    """(number of words, starts of every phrase as word numbers, their labels)."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    starts, found = [], set()
    for phrase, label in phrases.items():
        needle = b" " + phrase.encode() + b" "
        at = joined.find(needle)
        counted = blanks = 0
        while at >= 0:
            blanks += joined.count(b" ", counted, at + 1)  # on from the last place: linear in the text
            counted = at + 1
            starts.append(blanks - 1)
            found.add(label)
            at = joined.find(needle, at + 1)
    return len(words), starts, found


class Index:
    """Templates in the corpus's word order, with their prefix words."""

    def __init__(self, templates: dict, frequency: dict, threshold: float = THRESHOLD):
        texts = [(label, words_of(x.encode())) for label, xs in templates.items() for x in xs]
        texts = [(label, words) for label, words in texts if words]
        if sum(len(words) for _, words in texts) > MAX_TEMPLATE_WORDS:
            raise ValueError("the templates are too many to give to every task")
        vocabulary = {w for _, words in texts for w in words}
        order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(order)}
        self.templates = []   # (label, words, distinct words, needed, ranks ascending)
        self.prefix: dict = {}  # word -> its templates
        for label, words in texts:
            ranks = sorted(self.rank[w] for w in set(words))
            needed = math.ceil(threshold * len(ranks) - 1e-9)
            for r in ranks[:len(ranks) - needed + 1]:
                self.prefix.setdefault(order[r], []).append(len(self.templates))
            self.templates.append((label, len(words), len(ranks), needed, ranks))

    def candidates(self, words: list) -> list:
        """(template, start, end) of the stretches that the blocks with a word of the template's prefix cover."""
        found: dict = {}
        for at, w in enumerate(words):
            for t in self.prefix.get(w, ()):
                reach, stretches = 2 * self.templates[t][1] - 1, found.setdefault(t, [])
                if stretches and at - reach <= stretches[-1][1]:
                    stretches[-1][1] = at + reach + 1
                else:
                    stretches.append([max(0, at - reach), at + reach + 1])
        return [(t, start, end) for t, stretches in found.items() for start, end in stretches]

    def match(self, text: bytes | None) -> dict:
        """Label -> largest containment over the text's blocks, of those at the threshold."""
        best: dict = {}
        words = words_of(text)
        if self.prefix.keys().isdisjoint(words):
            return best
        for t, start, end in self.candidates(words):
            label, n, size, needed, ranks = self.templates[t]
            own = set(ranks)
            places = [(at, r) for at, w in enumerate(words[start:end]) if (r := self.rank.get(w)) in own]
            held = {r for _, r in places}
            if len(held) < needed:  # length
                continue
            position = next(i for i, r in enumerate(ranks) if r in held)
            if size - position < needed:  # position
                continue
            common = most_distinct(places, 2 * n)
            if common >= needed:
                best[label] = max(best.get(label, 0.0), common / size)
        return best


def most_distinct(places: list, width: int) -> int:
    """Largest number of distinct values in a window of ``width``, of (place, value) by ascending place."""
    held: Counter = Counter()
    most = first = 0
    for at, value in places:
        held[value] += 1
        while places[first][0] <= at - width:
            gone = places[first][1]
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
            first += 1
        most = max(most, len(held))
    return most


def word_frequency(documents: DataFrame, templates: dict, text_col: str = "text") -> dict:
    """In how many documents each template word occurs, over all documents (a bounded dictionary)."""
    vocabulary = {w for xs in templates.values() for x in xs for w in words_of(x.encode())}
    rows = with_text_columns(documents, text_col, [T.StructField("w", T.ArrayType(T.StringType()))],
                             lambda: lambda ts: [_batch_counts(ts, vocabulary)], keep=[])
    counted = (rows.select(F.explode("w").alias("w")).select(F.split("w", "=").alias("p")).groupBy(F.col("p")[0].alias("w"))
               .agg(F.sum(F.col("p")[1].cast("long")).alias("n")).collect())
    return {r["w"].encode(): r["n"] for r in counted}


def _batch_counts(texts: list, vocabulary: set) -> list:
    """Counts of a batch on its first row (``word=count``), so that few rows are shuffled."""
    total = Counter()
    for t in texts:
        total.update(vocabulary.intersection(words_of(t)))
    return [[f"{w.decode()}={n}" for w, n in total.items()]] + [[] for _ in texts[1:]]


def scan(documents: DataFrame, templates: dict | None = None, threshold: float = THRESHOLD,
         phrases: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, phrase places and labels, labels of matching templates, score.

    ``score`` is 1 for a fixed phrase, else the largest containment of a matching
    template, else 0.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    plain = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
    index = Index(templates, word_frequency(plain, templates, "_t"), threshold)
    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")]
    fields += [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
               T.StructField("score", T.DoubleType())]

    def one(text):
        n, starts, base = phrase_places(text, phrases)
        found = index.match(text)
        return (n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(base.union(found))), 1.0 if base else max(found.values(), default=0.0))

    return with_text_columns(plain, "_t", fields, lambda: lambda ts: list(zip(*map(one, ts), strict=True)),
                             keep=["doc_id"])
