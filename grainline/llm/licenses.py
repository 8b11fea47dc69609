"""Licence scans: winnowed template fingerprints pick candidates, banded alignment confirms."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytetext import NOT_ALNUM, blocks, gram_hashes, span_hashes, word_bounds

#: Words of a fingerprint, fingerprints of a winnowing window, half width of the
#: alignment band (a quarter of a shorter template), least share of a template's words that must match.
GRAM, WINNOW, BAND, COVERAGE = 3, 2, 8, 0.8
#: Where the narrow band of a short template has no match, a band for words put in; templates of fewer
#: words than SHORT, where one word can break all fingerprints, are also looked up by single words.
WIDE, SHORT = 4, 8
COMMON = frozenset("a all an and by for in is of or the this to under work".split())

# Fixed template texts (public licence notices).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MIT": "Released under the MIT License",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "all-rights-reserved": "All rights reserved",
}


def words_of(text: str) -> np.ndarray:
    parts = [span_hashes(d, *word_bounds(o, d, NOT_ALNUM)[:2]) for _, _, o, d in blocks(pa.array([text]))]
    return np.concatenate([np.empty(0, np.uint64), *parts])


def winnow(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of fingerprints: the least of each WINNOW neighbouring grams of a row (one, if fewer)."""
    if not len(grams):
        return np.empty(0, np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    best = np.arange(len(grams))
    for step in range(1, WINNOW):
        other = np.minimum(np.arange(len(grams)) + step, len(grams) - 1)
        better = (row[other] == row) & (grams[other] < grams[best])
        best = np.where(better, other, best)
    # a window that would pass the row's end is covered by the ones before
    room = first[row + 1] - np.arange(len(grams)) >= np.minimum(WINNOW, np.diff(first)[row])
    return np.unique(best[room])


@dataclass
class Index:
    """The inverted index of the templates' fingerprints."""

    names: list[str]
    words: list[np.ndarray]
    hashes: np.ndarray = field(init=False)
    template: np.ndarray = field(init=False)
    place: np.ndarray = field(init=False)
    texts: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        rows = []
        for k, words in enumerate(self.words):
            grams, first = gram_hashes(words, np.array([0, len(words)]), GRAM)
            # all grams of a template are indexed; only the documents' are winnowed
            rows += [(h, k, i) for i, h in enumerate(grams.tolist())]
        rows.sort()
        self.hashes = np.array([r[0] for r in rows], np.uint64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)
        # templates shorter than a winnowing window and its gram are looked up at every place
        short = np.isin(self.template, [k for k, w in enumerate(self.words) if len(w) < GRAM + WINNOW])
        self.short = np.zeros(1 << 16, bool)
        self.short[(self.hashes[short] & np.uint64(65535)).astype(int)] = True
        # a match lacks no more words than the anchors of its template are, less one
        anchors = []
        for k, text in enumerate(self.texts):
            size, plain = len(self.words[k]), re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
            if size < SHORT:
                by_rarity = sorted(range(size), key=lambda i: (plain[i].lower() in COMMON, -len(plain[i]), i))
                anchors += [(h, k, i) for i in by_rarity[: size - math.ceil(COVERAGE * size) + 1] for h in [int(self.words[k][i])]]
        self.anchors = sorted(anchors)
        self.anchor_hashes = np.array([a[0] for a in self.anchors], np.uint64)
        self.anchor_slots = np.zeros(1 << 16, bool)
        self.anchor_slots[(self.anchor_hashes & np.uint64(65535)).astype(int)] = True
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.hashes & np.uint64(65535)).astype(int)] = True


def build_index(templates: dict[str, str]) -> Index:
    kept = {name: words for name, text in sorted(templates.items()) if len(words := words_of(text))}
    return Index(list(kept), list(kept.values()), texts=[templates[name] for name in kept])


def banded_alignment(template: np.ndarray, words: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Best matched words of a template within ``band`` of a diagonal: matched, start, end.

    Row i of the template may meet words i + shift - band to i + shift + band. The
    aligned words are as many as possible and, of those, the shortest span.
    """
    m, n = len(template), len(words)
    none = (0, 0, 0)  # matched, -start, -end: larger is better
    before: dict[int, tuple] = {}
    for i in range(m):
        now: dict[int, tuple] = {}
        reach = none
        for j in range(max(0, i + shift - band), min(n, i + shift + band + 1)):
            best = max(before.get(j, none), reach)
            if words[j] == template[i]:
                matched, start, _ = before.get(j - 1, none)
                best = max(best, (matched + 1, start if matched else -j, -(j + 1)))
            now[j] = reach = best
        before = {j: max(now.get(j, none), before.get(j, none)) for j in {*now, *before}}
        # what was reached at j stays reached further right
        run = none
        for j in sorted(before):
            run = before[j] = max(run, before[j])
    matched, start, end = max(before.values(), default=none)
    return matched, -start, -end


def scan_words(index: Index, words: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """(template, start, end, matched) of each row's matches, by place."""
    found: list[list] = [[] for _ in range(len(first) - 1)]
    grams, gram_first = gram_hashes(words, first, GRAM)
    slots = (grams & np.uint64(65535)).astype(int)
    places = winnow(grams, gram_first)
    places = np.union1d(places[index.seen[slots[places]]], np.flatnonzero(index.short[slots]))
    low, high = np.searchsorted(index.hashes, grams[places], "left"), np.searchsorted(index.hashes, grams[places], "right")
    rows = np.searchsorted(gram_first, places, "right") - 1
    # (row, template, shift) of what fingerprints and then single words suggest
    hits = []
    for place, row, a, b in zip(places[high > low].tolist(), rows[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
        at = place - int(gram_first[row])
        hits += [(row, int(index.template[k]), at - int(index.place[k])) for k in range(a, b)]
    spots = np.flatnonzero(index.anchor_slots[(words & np.uint64(65535)).astype(int)])
    low, high = np.searchsorted(index.anchor_hashes, words[spots], "left"), np.searchsorted(index.anchor_hashes, words[spots], "right")
    spots, low, high = spots[high > low], low[high > low], high[high > low]
    spot_rows = np.searchsorted(first, spots, "right") - 1
    for place, row, a, b in zip(spots.tolist(), spot_rows.tolist(), low.tolist(), high.tolist(), strict=True):
        hits += [(row, t, place - int(first[row]) - i) for _, t, i in index.anchors[a:b]]
    done: dict[tuple[int, int], list] = {}
    for row, t, shift in hits:
        own = words[first[row] : first[row + 1]]
        tried = done.setdefault((row, t), [])
        size = len(index.words[t])
        narrow = min(BAND, max(1, size // 4))
        if any(abs(shift - s) <= (0 if size < SHORT else narrow // 2) for s in tried):
            continue
        tried.append(shift)
        for band in (narrow, WIDE) if narrow < WIDE else (narrow,):
            begin = max(0, shift - band)
            part = own[begin : shift + size + band + 1]
            matched, start, end = banded_alignment(index.words[t], part, shift - begin, band)
            if matched >= COVERAGE * size:
                found[row].append((t, begin + start, begin + end, matched))
                break
    for matches in found:
        # of a template's overlapping matches only the best stays
        matches.sort(key=lambda x: (-x[3], x[2] - x[1], x[1], x[0]))
        kept: list[tuple] = []
        for x in matches:
            if not any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in kept):
                kept.append(x)
        matches[:] = sorted(kept, key=lambda x: (x[1], x[2], x[0]))
    return found


MATCHES = "array<struct<template:string,coverage:double,start:long,end:long>>"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, n_words, matches`` for each whole text.

    A match names a template, the share of its words found in order within the
    band, and the [start, end) words it spans. Documents are winnowed so that any
    run of GRAM + WINNOW - 1 common words meets the index; a template of under
    SHORT words is met by so many of its words that no match lacks all. A match
    needs COVERAGE of the template; up to WIDE words may be put in or left out. Null and empty texts have none; rows may repeat. One pass
    without a shuffle; the templates, a fixed list, go with the code.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build_index(TEMPLATES if templates is None else templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        kind = pa.list_(pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            counts, matches = [np.zeros(0, np.int64)], []
            for _, _, offsets, data in blocks(batch.column(1)):
                starts, ends, first = word_bounds(offsets, data, NOT_ALNUM)
                counts.append(np.diff(first))
                found = scan_words(index, span_hashes(data, starts, ends), first) if len(index.names) else [[] for _ in range(len(first) - 1)]
                matches += [[{"template": index.names[t], "coverage": n / len(index.words[t]), "start": a, "end": b} for t, a, b, n in row] for row in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts), pa.int64()), pa.array(matches, kind)], names=["doc_id", "n_words", "matches"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_words long, matches {MATCHES}")
