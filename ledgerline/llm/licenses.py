"""Licence scan: base phrases, and an exact set-similarity join of text blocks with licence templates.

Words are lower-cased runs of letters and digits.  A template of m words is
compared with blocks of 2w words, w the power of two not below m, begun every
w words, so that any passage as long as the template lies whole in a block.
A block matches if it holds at least ``CONTAINMENT`` of the template's word
set, and all of it if the set has fewer than ``SHORT`` words: in a short
template each word tells licences apart.  The join is exact:

* tokens are ordered by how many blocks of the whole corpus hold them (one
  pass, summed by Spark; only template words are counted, a bounded table);
* prefix filter: a block that reaches an overlap of a must hold one of the
  |T| - a + 1 rarest tokens of the template, so only blocks around those
  tokens are looked at;
* length filter: the block must have a template words at least;
* positional filter: the rarest shared token's places in both ordered sets
  bound the overlap left; what passes is counted in full.

The templates are a fixed list, their index a few kilobytes in each task;
texts are read twice and never shuffled.

Cases: null or empty text has no words, no labels, score 0 and null places;
repeated rows are scanned one by one; words of any length and texts of any
length are scanned whole; a table without rows gives none; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LETTERS, hash_words, lower_ascii, texts_of, word_bounds, word_hashes

CONTAINMENT = 0.8
SHORT = 10

#: Base phrases and their labels (fixed values of the contract).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices of public licences, as their authors ask to have them stated (fixed values).
TEMPLATES = {
    "apache-2.0-notice": "licensed under the apache license version 2.0 you may not use this file except in compliance with the "
                         "license you may obtain a copy of the license at",
    "apache-2.0-terms": "unless required by applicable law or agreed to in writing software distributed under the license is "
                        "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2.0-short": "licensed under the apache license version 2.0",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                  "license as published by the free software foundation",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
                    "warranty of merchantability or fitness for a particular purpose",
    "gpl-short": "this work is licensed under the gnu general public license version",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                 "documentation files to deal in the software without restriction",
    "mit-short": "released under the mit license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
                 "provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
                      "following conditions are met",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-nc-short": "licensed under cc by nc",
    "public-domain-notice": "this is free and unencumbered software released into the public domain",
}


def words_of(text: str) -> list[str]:
    b = lower_ascii(np.frombuffer(text.encode(), np.uint8))
    return [b[s:e].tobytes().decode() for s, e in zip(*word_bounds(b, LETTERS), strict=True)]


class Index:
    """Templates over a global token order (rarest first)."""

    def __init__(self, templates: dict[str, str], containment: float, frequency: dict[str, int] | None = None) -> None:
        split = {k: words_of(t) for k, t in templates.items()}
        vocabulary = sorted({w for ws in split.values() for w in ws})
        n = frequency or {}
        # place of a token in the order; ties by the token itself
        self.words = sorted(vocabulary, key=lambda w: (n.get(w, 0), w))
        place = {w: i for i, w in enumerate(self.words)}
        h = hash_words(self.words)
        self.by_hash = np.argsort(h)
        self.hashes = h[self.by_hash]
        self.templates = []
        for label, ws in split.items():
            tokens = sorted({place[w] for w in ws})
            least = math.ceil(containment * len(tokens) - 1e-9) if len(tokens) >= SHORT else len(tokens)
            width = 1 << (len(ws) - 1).bit_length()
            prefix = np.zeros(len(self.words), dtype=bool)
            prefix[tokens[:len(tokens) - least + 1]] = True
            self.templates.append((label, tokens, {t: i for i, t in enumerate(tokens)}, least, width, prefix))

    def tokens(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text and in the order of the template words in a text."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        where = np.flatnonzero(self.hashes[at] == h)
        return where, self.by_hash[at[where]]

    def matches(self, where: np.ndarray, token: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, containment) of each matching block."""
        out = []
        for label, tokens, rank, least, width, prefix in self.templates:
            rare = where[prefix[token]]
            if not len(rare):
                continue
            block = np.unique(np.concatenate([rare // width, rare // width - 1]))
            for k in block[block >= 0].tolist():
                lo, hi = np.searchsorted(where, [k * width, (k + 2) * width])
                if hi - lo < least:  # length filter, before the set is made
                    continue
                have = np.unique(token[lo:hi]).tolist()
                shared = [(i, rank[t]) for i, t in enumerate(have) if t in rank]
                if not shared:
                    continue
                i, j = shared[0]
                if 1 + min(len(have) - i - 1, len(tokens) - j - 1) < least:  # positional filter
                    continue
                if len(shared) >= least:
                    out.append((label, k * width, (k + 2) * width, len(shared) / len(tokens)))
        return out


def token_frequency(docs: DataFrame, words: list[str], text: str = "text", block: int = 64) -> dict[str, int]:
    """How many blocks of all texts hold each of ``words``; one row per word comes to the driver."""
    index = Index({"": " ".join(words)}, 1.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(index.words), dtype=np.int64)
        for b in batches:
            for raw in texts_of(b.column(0)):
                low = lower_ascii(raw)
                where, token = index.tokens(word_hashes(low, *word_bounds(low, LETTERS)))
                if len(where):
                    n += np.bincount(np.unique((where // block) * len(n) + token) % len(n), minlength=len(n))
        yield pa.RecordBatch.from_pydict({"word": index.words, "n": n})

    found = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    return {r["word"]: r["n"] for r in found.where("n > 0").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _phrase_places(h: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    k = len(phrase)
    if len(h) < k:
        return np.empty(0, dtype=np.int64)
    ok = h[:len(h) - k + 1] == phrase[0]
    for j in range(1, k):
        ok &= h[j:len(h) - k + 1 + j] == phrase[j]
    return np.flatnonzero(ok)


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "blocks array<struct<label:string,first_word:long,end_word:long,containment:double>>")


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None,
         templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """Phrase places, labels, matching blocks and the best containment of each document."""
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    frequency = token_frequency(docs, sorted({w for t in templates.values() for w in words_of(t)}), text)
    index = Index(templates, containment, frequency)
    coded = [(hash_words(words_of(p)), label) for p, label in phrases.items()]
    block = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())])
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(block)]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in types[1:]]
            for raw in texts_of(b.column(1)):
                low = lower_ascii(raw)
                h = word_hashes(low, *word_bounds(low, LETTERS))
                places = [(p, label) for p, label in ((_phrase_places(h, c), label) for c, label in coded) if len(p)]
                found = index.matches(*index.tokens(h))
                base = {label for _, label in places}
                row = [len(h), sum(len(p) for p, _ in places), min((int(p[0]) for p, _ in places), default=None),
                       max((int(p[-1]) for p, _ in places), default=None), ",".join(sorted(base)),
                       ",".join(sorted(base | {m[0] for m in found})),
                       1.0 if base else max((m[3] for m in found), default=0.0),
                       [{"label": m[0], "first_word": m[1], "end_word": min(m[2], len(h)), "containment": m[3]} for m in found]]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types[1:], strict=True)]],
                                             names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(look, SCHEMA)
