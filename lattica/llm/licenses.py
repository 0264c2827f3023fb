"""License scan: exact set-similarity join of text blocks with license templates.

A template is a set of words, a block a window of words of one text, over its line ends, WINDOW
times as long as the template. The windows begin at each template word and so overlap; whatever
their place, the best one is among them. A block matches a template if it holds at least THRESHOLD
of the template's words (containment). Words are ordered by their frequency in the whole corpus,
rarest first; a matching block must hold one of a template's first |T| - ceil(THRESHOLD * |T|) + 1
words (prefix filter), have enough template words (length filter), and at the first of them that it
holds, enough of the template must be left (positional filter). What passes is verified by counting.
An inverted index from prefix words to templates names the pairs of a text and a template that are looked
at, so the work follows the texts' rare words and not the number of templates.
The templates are a short list; only counts of their own words reach the driver.

Apart from the sets, phrases are found where their words stand one after the other.

Defined cases: a null or empty text has no words, no labels and score 0; an empty table gives an
empty result; repeated rows are scanned each; a null doc_id is carried along; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import text as tx
from lattica.session import ship

THRESHOLD = 0.8
WINDOW = 2  # words of a block for each word of the template
#: Phrases that give a label by themselves (fixed values).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Sentences from license texts and notices (fixed values).
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial license", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("creative commons attribution sharealike license", "cc-by-sa"),
)


def hashed(phrases: list[str]) -> list[np.ndarray]:
    """The hashes of each phrase's words, in order."""
    w = tx.words(pa.array(phrases, pa.string()), tx.NOT_ALNUM, lower=True)
    h = w.hashes()
    return [h[i:j] for i, j in zip(w.word_at[:-1], w.word_at[1:], strict=True)]


def _vocabulary(templates, phrases) -> np.ndarray:
    return np.unique(np.concatenate(hashed([t for t, _ in (*templates, *phrases)])))


def _counts(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for b in tx.slices(batches):
            h = tx.words(b["text"], tx.NOT_ALNUM, lower=True).hashes()
            i = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            total += np.bincount(i[vocabulary[i] == h], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["word", "n"])

    return run


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of the templates stands in the whole corpus."""
    out = np.zeros(len(vocabulary), dtype=np.int64)
    for r in docs.select("text").mapInArrow(_counts(vocabulary), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out


class _Scan:
    def __init__(self, vocabulary: np.ndarray, frequency: np.ndarray, templates, phrases, threshold: float) -> None:
        self.vocabulary = vocabulary
        rank = np.empty(len(vocabulary), dtype=np.int64)
        rank[np.lexsort((vocabulary, frequency))] = np.arange(len(vocabulary))
        self.rank = rank
        place = lambda hs: np.searchsorted(vocabulary, hs)
        self.templates = []
        index: list[list[int]] = [[] for _ in range(len(vocabulary))]  # by a word's rank, the templates in whose prefix it stands
        for k, (hs, (_, label)) in enumerate(zip(hashed([t for t, _ in templates]), templates, strict=True)):
            ordered = np.unique(rank[place(hs)])
            need = math.ceil(threshold * len(ordered) - 1e-9)
            self.templates.append((ordered, need, WINDOW * len(hs), label))
            for r in ordered[: len(ordered) - need + 1].tolist():
                index[r].append(k)
        self.index_at = np.concatenate([[0], np.cumsum([len(x) for x in index])]).astype(np.int64)
        self.index = np.array([k for x in index for k in x], dtype=np.int64)
        self.phrases = [(rank[place(hs)], label) for hs, (_, label) in zip(hashed([t for t, _ in phrases]), phrases, strict=True)]

    def candidates(self, ranks: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Pairs of a text and a template of whose prefix it holds a word: the texts' words looked up in the index."""
        if not len(ranks):
            return np.zeros((0, 2), dtype=np.int64)
        words = np.unique(of * len(self.vocabulary) + ranks)
        text, word = words // len(self.vocabulary), words % len(self.vocabulary)
        n = np.diff(self.index_at)[word]
        ends = np.cumsum(n)
        template = self.index[np.repeat(self.index_at[word] - ends + n, n) + np.arange(ends[-1])]
        pairs = np.unique(np.repeat(text, n) * len(self.templates) + template)
        return np.stack([pairs // len(self.templates), pairs % len(self.templates)], axis=1)

    def blocks(self, ranks: np.ndarray, at: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, str, float]]:
        """Text, label and containment of each window that matches, given the template words' ranks, places and texts."""
        pairs = self.candidates(ranks, of)
        begins, stops = np.searchsorted(of, pairs[:, 0]), np.searchsorted(of, pairs[:, 0], side="right")
        for (text, template), lo, hi in zip(pairs.tolist(), begins.tolist(), stops.tolist(), strict=True):
            ordered, need, length, label = self.templates[template]
            size = len(ordered)
            if hi - lo < need:
                continue
            p = np.minimum(np.searchsorted(ordered, ranks[lo:hi]), size - 1)
            own = np.flatnonzero(ordered[p] == ranks[lo:hi])
            p, place = p[own], at[lo:hi][own]
            end = np.searchsorted(place, place + length)
            begin = np.arange(len(own))
            prefix = np.concatenate([[0], np.cumsum(p <= size - need)])
            for i in np.flatnonzero((end - begin >= need) & (prefix[end] > prefix[begin])).tolist():
                held = np.unique(p[i : end[i]])
                if size - held[0] >= need and len(held) >= need:
                    yield text, label, len(held) / size

    def run(self, texts: pa.Array) -> list[list]:
        w = tx.words(texts, tx.NOT_ALNUM, lower=True)
        h, of = w.hashes(), w.text_of_word()
        i = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        hit = np.flatnonzero(self.vocabulary[i] == h) if len(h) else np.zeros(0, dtype=np.int64)
        ranks = self.rank[i[hit]] if len(hit) else hit
        every = np.full(len(h), -1, dtype=np.int64)
        every[hit] = ranks
        n = len(texts)
        places: list[list[int]] = [[] for _ in range(n)]
        labels: list[set] = [set() for _ in range(n)]
        base: list[set] = [set() for _ in range(n)]
        score = np.zeros(n)
        for seq, label in self.phrases:
            at = hit[ranks == seq[0]]
            at = at[at + len(seq) <= len(h)]
            for d in range(1, len(seq)):
                at = at[every[at + d] == seq[d]]
            at = at[of[at] == of[at + len(seq) - 1]] if len(at) else at
            for a in at.tolist():
                t = of[a]
                places[t].append(a - int(w.word_at[t]))
                base[t].add(label)
                score[t] = 1.0
        for t, label, c in self.blocks(ranks, hit, of[hit]):
            labels[t].add(label)
            score[t] = max(score[t], c)
        rows = []
        for t in range(n):
            rows.append([int(w.counts[t]), len(places[t]), min(places[t], default=None), max(places[t], default=None), ",".join(sorted(base[t])), ",".join(sorted(base[t] | labels[t])), float(score[t])])
        return rows


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    ship(docs.sparkSession)
    vocabulary = _vocabulary(templates, phrases)
    scan = _Scan(vocabulary, frequencies(docs, vocabulary), templates, phrases, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches):
            cols = list(zip(*scan.run(b["text"]), strict=True))
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True))], ["doc_id", *_NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
