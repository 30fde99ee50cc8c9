"""License scan: a trained paragraph classifier, calibrated, and confirmed by comparison with templates.

Consecutive lines with words form a paragraph, so that a hard-wrapped notice is read as a whole.  Lines and paragraphs of
more than WINDOW words are read in windows of WINDOW words, half overlapping, so that a notice inside long text is not
diluted: the windows of each line, and those of each paragraph that reach over a line break.  The classes are the
families of TEMPLATES and `unknown`.

* Features: hashed word 1- to 3-grams, BUCKETS of them; the score of a paragraph is the sum of their weights over the
  square root of their number.
* Training, on the driver, of bounded size: variants of the templates (other words around them, words left out), the same
  words in random order and windows of the corpus as `unknown`: SAMPLE_WINDOWS at most, from anywhere in the whole texts of
  SAMPLE_DOCS documents at most.  Both are chosen by hashes over the whole table, so that the model does not change with
  the layout of its files.  These bounds hold for training only.  Multinomial logistic regression with L2 penalty.
* Calibration: every fifth example is held out; one temperature and one offset of `unknown` minimise its log loss there.
* A window is a candidate when its calibrated probability of a family is LEAST or more.  A candidate is compared with the
  templates of every family, since it may hold several notices and the probabilities of one window add up to 1.
* A family is confirmed when the window shares CONFIRM of a template's trigrams, or a template holds CONFIRM of the
  window's, and DECIDE of the template's own trigrams (no other family has them) or DECIDE of what was shared is its own:
  words that several families have in common, as at the head of GPL and AGPL notices, name none of them.  They only
  lengthen a confirmed span of the family that they overlap.
* A span is the window, or in one that reaches over a line break the words from the first to the last shared trigram.
* n_paragraphs counts windows, n_unconfirmed candidates that are in no reported span.

Whole texts of all documents are classified.  Defined results: null text counts as empty; repeated rows are reported
alike; other columns do not matter; with an empty table nothing is trained on it and nothing is returned.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nsmallest

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, LongType, StringType, StructField, StructType,
)

from linderos.llm.common import id_type, smallest_keys, with_id

# Notices of license families as their publishers word them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Licensed under the MIT license.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without permission of the publisher.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
    ),
}
UNKNOWN = "unknown"
FAMILIES = (*TEMPLATES, UNKNOWN)

WINDOW = 24
BUCKETS = 1 << 16
ORDERS = 3
VARIANTS = 30
SAMPLE_DOCS = 400
SAMPLE_WINDOWS = 2_000
EPOCHS = 50
STEP = 8.0
PENALTY = 1e-5
LEAST = 0.1
CONFIRM = 0.6
DECIDE = 0.5
SEED = 5

_TOKEN = re.compile(r"\w+|\n")
_WORD = re.compile(r"\w+")
_CACHED = 200_000
_ids: dict[str, int] = {}


def word_ids(words: list[str]) -> np.ndarray:
    """64-bit hashes of words; 0 for a line break."""
    if len(_ids) > _CACHED:
        _ids.clear()
    try:
        return np.array([_ids[w] for w in words], dtype=np.uint64)
    except KeyError:
        _ids["\n"] = 0
        for w in words:
            if w not in _ids:
                _ids[w] = xxhash.xxh3_64_intdigest(w) | 1
        return np.array([_ids[w] for w in words], dtype=np.uint64)


def buckets(ids: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram of `order` words that begins at each place; shorter by order - 1."""
    total = np.full(len(ids) - order + 1, order, dtype=np.uint64)
    for k in range(order):
        total = (total ^ ids[k:len(ids) - order + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return (total % np.uint64(BUCKETS)).astype(np.int64)


def paragraphs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of each paragraph in the words of a text (line breaks have id 0)."""
    breaks = np.flatnonzero(ids == 0)
    first, end = np.r_[0, breaks + 1], np.r_[breaks, len(ids)]
    first, end = first[end > first], end[end > first]
    half = WINDOW // 2
    windows = np.maximum(1, -(-(end - first - half) // half))
    windows[end - first <= WINDOW] = 1
    which = np.repeat(np.arange(len(first)), windows)
    number = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = first[which] + number * half
    return start, np.where(windows[which] == 1, end[which], np.minimum(start + WINDOW, end[which]))


def windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words without the breaks inside paragraphs, and first and end of each window among them.

    A line without words ends a paragraph.  Windows of a line have the same n-grams in the joined words.
    """
    breaks = ids == 0
    kept = ~breaks | np.r_[breaks[1:], True]
    at, number = np.flatnonzero(kept), np.cumsum(kept) - 1
    first, last = paragraphs(ids)
    start, end = paragraphs(ids[at])
    across = at[end - 1] - at[start] > end - 1 - start
    return at, np.r_[number[first], start[across]], np.r_[number[last - 1] + 1, end[across]]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # BUCKETS x families
    bias: np.ndarray
    temperature: float
    offset: float  # added to `unknown` after the temperature

    def scores(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total, n = np.zeros((len(start), len(FAMILIES))), np.zeros(len(start))
        for order in range(1, ORDERS + 1):
            if len(ids) < order:
                continue
            sums = np.zeros((len(ids) - order + 2, len(FAMILIES)))
            np.cumsum(self.weights[buckets(ids, order)], axis=0, out=sums[1:])
            last = np.maximum(end - order + 1, start)
            total += sums[np.minimum(last, len(sums) - 1)] - sums[np.minimum(start, len(sums) - 1)]
            n += last - start
        return total / np.sqrt(np.maximum(n, 1))[:, None] + self.bias

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        z = scores / self.temperature
        z[:, -1] += self.offset
        return softmax(z)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def examples(lines: list[list[str]]) -> tuple[list[list[str]], np.ndarray]:
    """Words and class of the training paragraphs; `lines` are paragraphs of the corpus."""
    rng = random.Random(SEED)
    known = {tuple(words_of(t)) for texts in TEMPLATES.values() for t in texts}
    grams = {g for words in known for g in trigrams(list(words))}
    plain = [w for w in lines if w and not (trigrams(w) & grams)] or [["text"]]
    out, classes = [], []
    for number, (family, texts) in enumerate(TEMPLATES.items()):
        for text in texts:
            words = words_of(text)
            for v in range(VARIANTS):
                some = list(words)
                if v % 3 == 1 and len(some) > 6:
                    some = [w for w in some if rng.random() > 0.08]
                if v % 2:
                    before, behind = rng.choice(plain), rng.choice(plain)
                    room = rng.randint(0, WINDOW - min(WINDOW, len(some)))
                    cut = rng.randint(0, room)
                    some = before[:cut] + some + behind[:room - cut]
                out.append(some)
                classes.append(number)
                if v % 6 == 0:
                    out.append(rng.sample(words, len(words)))
                    classes.append(len(FAMILIES) - 1)
    out += plain
    classes += [len(FAMILIES) - 1] * len(plain)
    return out, np.array(classes)


def trigrams(words: list[str]) -> set[tuple[str, ...]]:
    width = min(3, len(words))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if words else set()


def _sparse(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of the examples' features."""
    rows, cols, values = [], [], []
    for r, words in enumerate(texts):
        ids = word_ids(words)
        own = np.concatenate([buckets(ids, k) for k in range(1, ORDERS + 1) if len(ids) >= k] or [np.zeros(0, dtype=np.int64)])
        rows.append(np.full(len(own), r))
        cols.append(own)
        values.append(np.full(len(own), 1 / np.sqrt(max(1, len(own)))))
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


def train(lines: list[list[str]]) -> Model:
    texts, classes = examples(lines)
    rows, cols, values = _sparse(texts)
    used, cols = np.unique(cols, return_inverse=True)
    families, n = len(FAMILIES), len(texts)
    held = np.arange(n) % 5 == 0
    target = np.eye(families)[classes]
    weight = 1 / np.bincount(classes, minlength=families)[classes]
    weight = np.where(held, 0, weight * n / families / n)
    w, bias = np.zeros((len(used), families)), np.zeros(families)
    speed = np.zeros_like(w)

    by_column = np.argsort(cols, kind="stable")
    row_starts, column_starts = (np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) for a in (rows, cols[by_column]))

    def forward() -> np.ndarray:  # every example has features, every bucket in use has examples
        return np.add.reduceat(w[cols] * values[:, None], row_starts, axis=0) + bias

    for _ in range(EPOCHS):
        error = (softmax(forward()) - target) * weight[:, None]
        gradient = np.add.reduceat((error[rows] * values[:, None])[by_column], column_starts, axis=0)
        speed = 0.9 * speed - STEP * (gradient + PENALTY * w)
        w += speed
        bias -= STEP * 0.1 * error.sum(axis=0)
    scores = forward()[held]
    temperature, offset = calibrate(scores, classes[held])
    weights = np.zeros((BUCKETS, families))
    weights[used] = w
    return Model(weights, bias, temperature, offset)


def calibrate(scores: np.ndarray, classes: np.ndarray) -> tuple[float, float]:
    """Temperature and offset of `unknown` with the least log loss."""
    best = (np.inf, 1.0, 0.0)
    for temperature in np.geomspace(0.2, 5, 25):
        for offset in np.linspace(-8, 8, 65):
            z = scores / temperature
            z[:, -1] += offset
            loss = -np.log(np.maximum(softmax(z)[np.arange(len(z)), classes], 1e-12)).mean()
            best = min(best, (loss, float(temperature), float(offset)))
    return best[1], best[2]


_TEMPLATE_GRAMS = {family: [trigrams(words_of(t)) for t in texts] for family, texts in TEMPLATES.items()}
_OTHERS = {
    family: set().union(*(g for other, texts in _TEMPLATE_GRAMS.items() if other != family for g in texts)) for family in TEMPLATES
}


def likenesses(words: list[str]) -> dict[str, tuple[float, bool, int, int]]:
    """Families of which a template is alike: the largest share, whether trigrams of their own decide for them, and the
    first word and end of what is shared.

    The share is that of a template's trigrams that the window has, or of the window's that a template has.
    """
    width = min(3, len(words))
    listed = [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]
    own = set(listed)
    found: dict[str, tuple[float, bool, int, int]] = {}
    for family, texts in _TEMPLATE_GRAMS.items():
        for grams in texts:
            common = own & grams
            alike = max(len(common) / len(grams), len(common) / len(own) if len(own) >= 4 else 0.0)
            if alike < CONFIRM:
                continue
            only = len(common - _OTHERS[family])
            decided = only > 0 and only >= DECIDE * min(len(common), len(grams - _OTHERS[family]))
            shared = [i for i, g in enumerate(listed) if g in common]
            best, before, first, end = found.get(family, (0.0, False, len(words), 0))
            found[family] = (max(best, alike), before or decided, min(first, shared[0]), max(end, shared[-1] + width))
    return found


SPAN = StructType([
    StructField("family", StringType()), StructField("start", LongType()), StructField("end", LongType()),
    StructField("probability", DoubleType()), StructField("likeness", DoubleType()),
])
RESULT = StructType([
    StructField("doc_id", StringType()), StructField("n_paragraphs", LongType()), StructField("n_unconfirmed", LongType()),
    StructField("spans", ArrayType(SPAN)),
])


def scan(texts: list[str], model: Model) -> list[tuple[int, int, list[tuple]]]:
    """(windows, unconfirmed candidates, confirmed spans) of each text; all texts are scored together."""
    tokens = [_TOKEN.findall(t.lower() + "\n\n") for t in texts]
    ids = word_ids([w for words in tokens for w in words])
    ends = np.cumsum([len(words) for words in tokens])
    at, start, end = windows(ids)
    owner = np.searchsorted(ends, at[start], side="right")
    p = model.probabilities(model.scores(ids[at], start, end))
    likely = np.flatnonzero(p[:, :-1].max(axis=1) >= LEAST)
    candidates, counts = (np.bincount(d, minlength=len(texts)).tolist() for d in (owner[likely], owner))
    spans: list[list[tuple]] = [[] for _ in texts]
    for k in likely:
        d = int(owner[k])
        places = at[start[k]:end[k]] - (int(ends[d - 1]) if d else 0)
        across = places[-1] - places[0] >= len(places)
        for family, (alike, decided, a, b) in likenesses([tokens[d][i] for i in places]).items():
            if not across:
                a, b = 0, len(places)
            spans[d].append((family, int(places[a]), int(places[b - 1]), float(p[k, FAMILIES.index(family)]), alike, decided, {int(k)}))
    out = []
    for d, some in enumerate(spans):
        if some:
            places = [m.span() for m in _TOKEN.finditer(texts[d])]
            some = joined([(f, places[a][0], places[b][1], *rest) for f, a, b, *rest in some])
        confirmed = set().union(*(span[6] for span in some))
        out.append((counts[d], candidates[d] - len(confirmed), [span[:5] for span in some]))
    return out


def joined(spans: list[tuple]) -> list[tuple]:
    """Spans of one family that overlap as one, with the best probability and likeness, where one of them is decided."""
    out: list[tuple] = []
    for span in sorted(spans, key=lambda s: s[:3]):
        if out and out[-1][0] == span[0] and span[1] < out[-1][2]:
            f, a, b, q, s, decided, among = out.pop()
            span = (f, a, max(b, span[2]), max(q, span[3]), max(s, span[4]), decided or span[5], among | span[6])
        out.append(span)
    return sorted((s for s in out if s[5]), key=lambda s: (s[1], s[0]))


def text_windows(text: str) -> list[list[str]]:
    """Words of every window of a whole text."""
    tokens = _TOKEN.findall(text.lower() + "\n\n")
    at, start, end = windows(word_ids(tokens))
    return [[tokens[i] for i in at[a:b]] for a, b in zip(start, end)]


def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SAMPLE_WINDOWS windows of each text at most, numbered in the order of a hash of the document and their words."""
    for pdf in batches:
        for key, text in zip(pdf["key"], pdf["text"]):
            ranked = [(xxhash.xxh3_64_intdigest(" ".join(words), seed=key & (1 << 64) - 1) >> 1, words) for words in text_windows(text)]
            some = nsmallest(SAMPLE_WINDOWS, ranked)
            if some:
                yield pd.DataFrame({"number": range(len(some)), "hash": [h for h, _ in some], "words": [words for _, words in some]})


def corpus_windows(docs: DataFrame) -> list[list[str]]:
    """Windows of documents chosen by a hash of id and text over the whole table: the same rows give the same windows,
    however they are stored.  Each document gives one window before any gives its next."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    keyed = texts.where(F.col("text").isNotNull()).select(F.xxhash64("doc_id", "text").alias("key"), "text")
    found = smallest_keys(keyed, SAMPLE_DOCS).mapInPandas(sampled, "number long, hash long, words array<string>")
    return [list(r["words"]) for r in found.orderBy("number", "hash", "words").limit(SAMPLE_WINDOWS).collect()]


def scan_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_paragraphs, n_unconfirmed, spans of every row; trains a model unless one is given."""
    model = model or train(corpus_windows(docs))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first in range(0, len(pdf), 200):
                some = pdf.iloc[first:first + 200]
                found = scan(some["text"].to_list(), sent.value)
                yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy(), "n_paragraphs": [f[0] for f in found],
                                    "n_unconfirmed": [f[1] for f in found], "spans": [f[2] for f in found]})

    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return with_id(source.mapInPandas(classify, RESULT), id_type(docs, "doc_id"))
