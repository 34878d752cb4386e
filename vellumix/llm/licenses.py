"""Licence scans with a positional index of rare words.

Templates of licence notices are split into words; a word's weight is its inverse
document frequency in the whole corpus, counted in a pass of its own.  The index
holds each template's RARE words of highest weight with their places.  A file's words among these are looked up; postings of one
template that agree on where it would begin support it there.  Where enough of a
template's weight lines up, its mandatory key phrases must stand near that place;
then the file carries its label.  All such places are tried, best first, so a
sibling's notice hides no other.  Short phrases that name a licence outright are
found exactly, as the base.  The score is the greatest share of a template's weight
that lines up, over the templates of the labels carried.

Nulls and ties: a null text is empty and carries no label.  Of equal scores the
greatest counts once.  Words of equal weight go by their order in the template.  A
row is judged by its text and the weights, so repeated rows get equal results.
Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellumix.llm.tokens import NOT_ALNUM, doc_groups, hash_words, text_buffers, word_spans
from vellumix.session import ship

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label, notice, and the phrases that must stand near a match.
TEMPLATES = (
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge",)),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("bsl", "Permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining a copy",)),
    ("zlib", "This software is provided as is without any express or implied warranty In no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("isc", "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("bsd-2-clause", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("apache", "Licensed under the Apache License Version 2 0 the License you may not use this file except in compliance with the License you may obtain a copy of the License", ("apache license",)),
    ("apache", "Licensed under the Apache License Version 2 0", ("apache license",)),
    ("gpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license",)),
    ("gpl", "This work is licensed under the GNU General Public License version 3", ("gnu general public license",)),
    ("agpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2 0", ("eclipse public license",)),
    ("lgpl", "This library is free software you can redistribute it and or modify it under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License v 2 0", ("mozilla public license",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4 0 International License", ("creative commons attribution 4",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4 0 International License", ("attribution sharealike",)),
    ("cc-by-sa", "Licensed under CC BY SA 4 0", ("cc by sa",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4 0 International License", ("attribution noncommercial",)),
    ("cc-by-nc", "Licensed under CC BY NC 4 0", ("cc by nc",)),
    ("cc0", "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("reserved", "All rights reserved", ("all rights reserved",)),
)
SUPPORT, SLIP = 0.6, 3
RARE = 16


def words_of(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), NOT_ALNUM)
    return hash_words(data, starts, ends, True)


def _number(text: str) -> tuple[int, ...]:
    return tuple(int(h) for h in words_of(text.encode()))


class Index:
    """Postings of each template's words of highest weight."""

    def __init__(self, weight: dict[int, float] | None = None, templates=TEMPLATES):
        texts = [_number(notice) for _, notice, _ in templates]
        weight = weight or {}
        self.weight = {h: weight.get(h, math.log(2)) for words in texts for h in words}
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.total, self.size = [], [len(words) for words in texts]
        for t, words in enumerate(texts):
            rare = set(sorted(dict.fromkeys(words), key=lambda h: -self.weight[h])[:RARE])
            for at, h in enumerate(words):
                if h in rare:
                    self.postings[h].append((t, at))
            self.total.append(sum(self.weight[h] for h in words if h in rare))
        self.labels = [label for label, _, _ in templates]
        self.mandatory = [[_number(p) for p in phrases] for _, _, phrases in templates]
        self.rare = np.array(sorted(self.postings), np.uint64)

    def scan(self, words: np.ndarray, places: np.ndarray) -> tuple[dict[str, float], dict[str, float]]:
        """Labels of one file with their scores, and each label's greatest support anywhere; places are those of its indexed words."""
        votes: dict[int, Counter] = defaultdict(Counter)
        for at in places:
            h = int(words[at])
            for t, own in self.postings[h]:
                votes[t][int(at) - own] += self.weight[h]
        found: dict[str, float] = {}
        support: dict[str, float] = {}
        stands: dict[tuple[int, ...], np.ndarray] = {}
        for t, starts in votes.items():
            scores = [(min(1.0, sum(starts.get(s + d, 0.0) for d in range(-SLIP, SLIP + 1)) / self.total[t]), -s) for s in starts]
            label = self.labels[t]
            support[label] = max(support.get(label, 0.0), max(scores)[0])
            for score, start in sorted((x for x in scores if x[0] >= SUPPORT and x[0] > found.get(label, 0)), reverse=True):
                lo, hi = max(0, -start - SLIP), -start + self.size[t] + 2 * SLIP
                if all(self._stands(p, words, lo, hi, stands) for p in self.mandatory[t]):
                    found[label] = score
                    break
        return found, support

    @staticmethod
    def _stands(phrase: tuple[int, ...], words: np.ndarray, lo: int, hi: int, known: dict) -> bool:
        """Whether a phrase stands whole in words[lo:hi]; known keeps its places in the file."""
        if phrase not in known:
            at = np.flatnonzero(words[: len(words) - len(phrase) + 1] == np.uint64(phrase[0])) if len(words) >= len(phrase) else np.zeros(0, np.int64)
            for j in range(1, len(phrase)):
                at = at[words[at + j] == np.uint64(phrase[j])]
            known[phrase] = at
        at = known[phrase]
        i = int(np.searchsorted(at, lo))
        return i < len(at) and int(at[i]) + len(phrase) <= hi


_SCHEMA = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64())]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, n): in how many texts of the batches each template word stands; word 0 counts the texts."""
    vocabulary = np.array(sorted(Index().weight), np.uint64)
    seen, rows = np.zeros(len(vocabulary), np.int64), 0
    for batch in batches:
        rows += batch.num_rows
        data, offsets = text_buffers(batch.column("text"))
        for lo, hi in doc_groups(offsets):
            part = data[offsets[lo] : offsets[hi]]
            starts, ends, first = word_spans(part, offsets[lo : hi + 1] - offsets[lo], NOT_ALNUM)
            words = hash_words(part, starts, ends, True)
            owner = np.repeat(np.arange(hi - lo), np.diff(first))
            at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
            known = vocabulary[at] == words
            pairs = np.unique(owner[known] * len(vocabulary) + at[known])
            seen += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(vocabulary, np.uint64(0)).view(np.int64)), pa.array(np.append(seen, rows))], names=["word", "n"])


def weights(docs: DataFrame) -> dict[int, float]:
    """Inverse document frequencies of the templates' words in all rows."""
    ship(docs.sparkSession)
    counts = docs.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {int(np.int64(r.word).view(np.uint64)): r.n for r in counts}
    rows = n.pop(0, 0)
    return {word: math.log((rows + 2) / (count + 1)) for word, count in n.items()}


def _scan(weight: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(weight)
        yield from _scan_with(index, batches)

    return run


def _scan_with(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases = [(np.array(_number(p), np.uint64), label) for p, label in PHRASES.items()]
    known = np.zeros(1 << 16, bool)
    known[(index.rare & np.uint64(0xFFFF)).astype(np.intp)] = True
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        rows: dict[str, list] = {name: [] for name, _ in _SCHEMA}
        for lo, hi in doc_groups(offsets):
            part = data[offsets[lo] : offsets[hi]]
            starts, ends, first = word_spans(part, offsets[lo : hi + 1] - offsets[lo], NOT_ALNUM)
            words = hash_words(part, starts, ends, True)
            owner = np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(first))
            base: dict[int, list[tuple[int, str]]] = defaultdict(list)
            for phrase, label in phrases:
                at = np.flatnonzero(words == phrase[0])
                at = at[at + len(phrase) <= len(words)]
                for j in range(1, len(phrase)):
                    at = at[(words[at + j] == phrase[j]) & (owner[at + j] == owner[at])]
                for x in at:
                    base[int(owner[x])].append((int(x), label))
            maybe = np.flatnonzero(known[(words & np.uint64(0xFFFF)).astype(np.intp)])
            maybe = maybe[np.isin(words[maybe], index.rare)]
            cuts = np.searchsorted(maybe, first)
            for i in range(hi - lo):
                own = base.get(i, [])
                a, b = int(first[i]), int(first[i + 1])
                places = maybe[cuts[i] : cuts[i + 1]] - a
                found, support = index.scan(words[a:b], places) if len(places) else ({}, {})
                exact = {label for _, label in own}
                score = max([*found.values(), *[support.get(label, 0.0) for label in exact]], default=0.0)
                at = [x - a for x, _ in own]
                values = (b - a, len(own), min(at, default=None), max(at, default=None), sorted(exact), sorted(exact | set(found)), score)
                for (name, _), value in zip(_SCHEMA, values):
                    rows[name].append(value)
        arrays = [batch.column("doc_id")] + [pa.array(rows[name], kind) for name, kind in _SCHEMA]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *rows])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays) and score, a row for each row of docs."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan(weights(docs)), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double")
