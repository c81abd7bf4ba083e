"""License scan: an exact set-similarity join of text blocks with templates.

A document is cut into blocks: its lines, and the word sequence of the whole
text, across line ends; of what has more than ``BLOCK`` words, windows of
``BLOCK`` words, ``BLOCK / 2`` apart, so that every run of up to ``BLOCK / 2``
words lies whole in a block, however its lines are wrapped.  A block meets a template when it
has at least ``THRESHOLD`` of the template's distinct words.

The words of the templates are ordered by the number of documents that have
them, rarest first, counted over all documents.  A template of s words that
needs a of them must share one of its first s - a + 1 words (prefix filter) with
a block of at least a distinct words (length filter), and from the first shared
word on both sides must still hold a words (positional filter).  The templates
are a fixed list, so their index goes to every task and each document is read
once, in place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugroute.llm.common import ALNUM_TABLE, lean, prepare, slices

THRESHOLD = 0.8
BLOCK = 256

# Phrases with their labels, and notices of common licenses.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = {
    "apache": ["licensed under the apache license version 2.0",
               "you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"],
    "cc-by": ["this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4.0",
                 "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "gpl": ["this work is licensed under the gnu general public license version 3",
            "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted"],
    "mit": ["released under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2.0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split()


def _windows(first: int, words: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    if len(words) <= BLOCK:
        if words:
            yield first, words
    else:
        for at in range(0, len(words) - BLOCK // 2, BLOCK // 2):
            yield first + at, words[at:at + BLOCK]


def blocks_of(text: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(first word, words) of each block of the text, each once."""
    every, seen = [], set()
    for line in text.split(b"\n"):
        words = words_of(line)
        for first, block in _windows(len(every), words):
            seen.add((first, len(block)))
            yield first, block
        every += words
    for first, block in _windows(0, every):
        if (first, len(block)) not in seen:
            yield first, block


class TemplateIndex:
    """Templates as word ranks in the global order, and their prefixes."""

    def __init__(self, templates: dict[str, list[str]], counts: dict[bytes, int], threshold: float):
        sets = [(label, frozenset(words_of(t.encode()))) for label, texts in templates.items() for t in texts]
        order = sorted(set().union(*(s for _, s in sets)), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.templates = [(label, sorted(self.rank[w] for w in s), math.ceil(threshold * len(s) - 1e-9))
                          for label, s in sets]
        self.prefix: dict[int, list[int]] = {}
        for n, (_, ranks, need) in enumerate(self.templates):
            for r in ranks[:len(ranks) - need + 1]:
                self.prefix.setdefault(r, []).append(n)
        self.prefix_words = frozenset(order[r] for r in self.prefix)

    def search(self, words: list[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of every template that the block meets."""
        distinct = set(words)
        ranks = sorted(self.rank[w] for w in distinct if w in self.rank)
        found, seen = [], set()
        for at, r in enumerate(ranks):
            for n in self.prefix.get(r, ()):
                if n in seen:
                    continue
                seen.add(n)  # its first shared word: ranks come in order
                label, own, need = self.templates[n]
                if len(distinct) < need or min(len(own) - own.index(r), len(ranks) - at) < need:
                    continue
                shared = len(set(own).intersection(ranks))
                if shared >= need:
                    found.append((label, shared / len(own)))
        return found


def _count_rows(batches: Iterator[pa.RecordBatch], vocabulary: frozenset) -> Iterator[pa.RecordBatch]:
    sums = dict.fromkeys(vocabulary, 0)
    for batch in batches:
        for part in slices(batch, "text"):
            for text in part.column("text").cast(pa.binary()).to_pylist():
                for w in vocabulary.intersection(words_of(text or b"")):
                    sums[w] += 1
    yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in sums], pa.string()),
                                      pa.array(list(sums.values()), pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, templates: dict[str, list[str]], text_col: str = "text") -> dict[bytes, int]:
    """The number of documents that have each template word."""
    vocabulary = frozenset(w for texts in templates.values() for t in texts for w in words_of(t.encode()))
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    sums = rows.mapInArrow(lean(lambda b: _count_rows(b, vocabulary)), "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in sums.collect()}  # a row for each word of the fixed list


def _phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    places = []
    for i, w in enumerate(words):
        for phrase, label in phrases:
            if w == phrase[0] and words[i:i + len(phrase)] == phrase:
                places.append((i, label))
    return places


def _scan_rows(index: TemplateIndex, phrases: dict[str, str]):
    kinds = [([*p.encode().split()], label) for p, label in phrases.items()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[list] = [[] for _ in range(8)]
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    text = text or b""
                    words = words_of(text)
                    present = set(words)
                    places = (_phrase_places(words, kinds)
                              if any(present.issuperset(p) for p, _ in kinds) else [])
                    blocks = []
                    if not index.prefix_words.isdisjoint(present):
                        for first, block in blocks_of(text):
                            blocks += [(first, len(block), *f) for f in index.search(block)]
                    base = sorted({label for _, label in places})
                    labels = sorted({*base, *(b[2] for b in blocks)})
                    row = (len(words), len(places), min((p for p, _ in places), default=None),
                           max((p for p, _ in places), default=None), ",".join(base), ",".join(labels),
                           max([b[3] for b in blocks] + [1.0] * bool(places), default=0.0),
                           [dict(zip(("first_word", "n_words", "label", "containment"), b)) for b in blocks])
                    for c, v in zip(out, row):
                        c.append(v)
                block = pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()),
                                   ("containment", pa.float64())])
                types = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(block))
                names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types))],
                                                 names=["doc_id", *names])

    return rows


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES,
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score and the blocks found.

    Base columns tell where a phrase's words stand one after another; labels add
    those of the templates that a block meets; score is the largest containment
    (1 with a phrase, 0 with nothing).  Null and empty texts have no words, no
    labels and score 0; rows are judged one by one, so repeated rows are equal;
    an empty table gives no rows.  Other columns are never read.
    """
    prepare(docs.sparkSession)
    index = TemplateIndex(templates, word_counts(docs, templates, text_col), threshold)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        lean(_scan_rows(index, phrases)),
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, blocks array<struct<first_word:long,n_words:long,label:string,containment:double>>")
