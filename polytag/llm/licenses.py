"""License scans: winnowed fingerprints, an inverted index of templates, banded alignment.

Texts and templates are normalised to runs of lower-case ASCII letters and digits with single spaces between.  Of the hashes of all
``GRAM``-byte substrings, winnowing keeps the smallest of every ``WINDOW`` neighbours, so any shared passage of
GRAM + WINDOW - 1 bytes shares a kept hash.  The templates' kept hashes form an inverted index (hash -> template, word), broadcast:
the template list is a parameter, at most ``MOST_TEMPLATE_BYTES`` in all.  A document's kept hashes are looked up; every
diagonal with a hit of a template is a candidate, and the template's words are aligned with the words around it in a band of ``BAND``
words on either side of the diagonal (match +2, substitution -1, gap -1, free ends in the document); what lies before and
after the best alignment is aligned again, so copies closer than the band are all found.  Reported are
alignments that cover at least ``COVERAGE`` of the template's words, with their span in code points of the original text; of
reports that overlap, the one with more matched words stays.

Every document is one row's work and nothing is shuffled.  Cases: null and empty texts report nothing; repeated rows and null
ids are scanned like any other; a template found several times is reported for each place; equal templates: the first by id.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from .text import LOWER, RangeHash, chunks, runs

GRAM, WINDOW = 12, 6
BAND = 8
COVERAGE = 0.75
MOST_TEMPLATE_BYTES = 1 << 20

#: fixed values: public license notices, by SPDX id
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
}

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


class Normal:
    """Normalised words of all rows of a chunk: bytes ``flat`` with one space after every word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.first = runs(_ALNUM[data], offsets)
        size = self.ends - self.starts
        self.at = np.concatenate(([0], np.cumsum(size + 1))).astype(np.int64)
        n = int(self.at[-1])
        self.flat = np.full(n, 32, np.uint8)
        word = np.repeat(np.arange(len(size)), size + 1)
        inside = np.arange(n) - self.at[word]
        real = inside < size[word]
        self.flat[real] = LOWER[data[self.starts[word[real]] + inside[real]]]
        self.word = word
        self.hashes = RangeHash(self.flat)(self.at[:-1], self.at[1:] - 1) if n else np.zeros(0, np.uint64)

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, byte position) of the winnowed grams; grams may cross rows, which the caller's positions tell."""
        n = len(self.flat) - GRAM + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pos = np.arange(n)
        h = RangeHash(self.flat)(pos, pos + GRAM)
        w = min(WINDOW, n)
        low = h[: n - w + 1].copy()
        for j in range(1, w):
            np.minimum(low, h[j : n - w + 1 + j], out=low)
        # a gram is kept if it is the smallest of any window that holds it
        best = np.zeros(n, np.uint64)
        for j in range(w):
            np.maximum(best[j : j + len(low)], low, out=best[j : j + len(low)])
        at = np.flatnonzero(best == h)
        return h[at], at


class Index:
    """The templates' words and the inverted index of their kept hashes."""

    def __init__(self, templates: dict[str, tuple[str, ...]]):
        self.names = [(k, i) for k in sorted(templates) for i in range(len(templates[k]))]
        assert sum(len(t.encode()) for v in templates.values() for t in v) <= MOST_TEMPLATE_BYTES, "template list too large"
        self.words: list[np.ndarray] = []
        post: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, (k, i) in enumerate(self.names):
            raw = np.frombuffer(templates[k][i].encode(), np.uint8)
            one = Normal(raw, np.array([0, len(raw)]))
            self.words.append(one.hashes)
            pos = np.arange(max(0, len(one.flat) - GRAM + 1))
            # every gram of a template is indexed, so whichever of a document's grams winnowing keeps is found
            for h, p in zip(RangeHash(one.flat)(pos, pos + GRAM).tolist(), pos.tolist(), strict=True):
                post[h].append((n, int(one.word[p])))
        self.post = dict(post)
        self.keys = np.array(sorted(post), np.uint64)


def align(doc: np.ndarray, template: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Best banded alignment of the whole template around diagonal ``shift`` (doc word of template word 0).

    -> (matched words, first and one past the last matched doc word).  Rows are template words; offset o faces doc word i + shift + o - band.
    """
    width = 2 * band + 1
    low = -(10**6)
    score = np.zeros(width, np.int64)  # free beginning anywhere in the band
    hits, begin = np.zeros(width, np.int64), np.full(width, -1, np.int64)
    best = (0, 0, 0, 0)
    for i in range(len(template)):
        face = np.arange(width) + i + shift - band
        real = (face >= 0) & (face < len(doc))
        same = np.zeros(width, bool)
        same[real] = doc[face[real]] == template[i]
        diag = score + np.where(same, 2, -1)
        d_hits, d_begin = hits + same, np.where(same & (begin < 0), face, begin)
        # a template word without a partner: came from the next offset of the row above
        up = np.append(score[1:] - 1, low)
        take = up > diag
        score = np.where(take, up, diag)
        hits = np.where(take, np.append(hits[1:], 0), d_hits)
        begin = np.where(take, np.append(begin[1:], -1), d_begin)
        # doc words without a partner: along the row
        for o in range(1, width):
            if score[o - 1] - 1 > score[o]:
                score[o], hits[o], begin[o] = score[o - 1] - 1, hits[o - 1], begin[o - 1]
        o = int(score.argmax())
        if same.any():
            at = np.flatnonzero(same)
            o = int(at[score[at].argmax()])
            if (score[o], hits[o]) > best[:2] and begin[o] >= 0:
                best = (int(score[o]), int(hits[o]), int(begin[o]), int(face[o]) + 1)
    return best[1:]


_FOUND = "doc_id long, license_id string, template int, start long, end long, matched_words long, template_words long, coverage double"


def _around(words_: np.ndarray, template: np.ndarray, diagonal: int) -> Iterator[tuple[int, int, int]]:
    """All alignments near a diagonal: the best one, then the best in what lies before and after it, and so on -> (first doc word, one past the last, matched)."""
    least = COVERAGE * len(template)
    rest = [(max(0, diagonal - 2 * BAND), min(len(words_), diagonal + len(template) + 2 * BAND))]
    while rest:
        lo, hi = rest.pop()
        region = words_[lo : max(lo, hi)]
        # too few words, or too few of the template's words, for any alignment to be reported
        if len(region) < least or np.isin(template, region).sum() < least:
            continue
        matched, a, b = align(region, template, diagonal - lo)
        if not matched:
            continue
        if matched >= least:
            yield lo + a, lo + b, matched
        rest += [(lo, lo + a), (lo + b, hi)]


def _row_matches(words_: np.ndarray, hits: list[tuple[int, int, int]], index: Index) -> list[tuple[int, int, int, int]]:
    """hits (template, template word, doc word) of one document -> (template, first doc word, one past the last, matched)."""
    diagonals = sorted({(t, dw - tw) for t, tw, dw in hits})
    found = {(t, a, b, matched) for t, d in diagonals for a, b, matched in _around(words_, index.words[t], d)}
    # kept reports do not overlap, so the only ones that can meet a new one are its neighbours by start
    kept: list[tuple[int, int, int, int]] = []
    for m in sorted(found, key=lambda m: (-m[3], m[1], m[0], m[2])):
        at = bisect(kept, m[1], key=lambda k: k[1])
        if (at == 0 or kept[at - 1][2] <= m[1]) and (at == len(kept) or m[2] <= kept[at][1]):
            kept.insert(at, m)
    return kept


def _scan(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for lo, _, data, offs in chunks(batch.column(1)):
            text = Normal(data, offs)
            h, at = text.kept()
            known = index.keys[np.minimum(np.searchsorted(index.keys, h), len(index.keys) - 1)] == h if len(h) else np.zeros(0, bool)
            hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
            for x, p in zip(h[known].tolist(), at[known].tolist(), strict=True):
                w = int(text.word[p])
                row = int(np.searchsorted(text.first, w, "right")) - 1
                if int(text.word[p + GRAM - 1]) < text.first[row + 1]:
                    hits[row] += [(t, tw, w - int(text.first[row])) for t, tw in index.post[x]]
            for row, mine in hits.items():
                first = int(text.first[row])
                for t, a, b, matched in _row_matches(text.hashes[first : int(text.first[row + 1])], mine, index):
                    head, s, e = int(offs[row]), int(text.starts[first + a]), int(text.ends[first + b - 1])
                    start = len(bytes(data[head:s]).decode())
                    out.append((batch.column(0)[lo + row].as_py(), index.names[t][0], index.names[t][1], start, start + len(bytes(data[s:e]).decode()),
                                matched, len(index.words[t]), matched / len(index.words[t])))
        cols = list(zip(*out, strict=True)) if out else [()] * 8
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in _FOUND.split(", ")])


def licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """documents -> one row per license passage: doc_id, license_id, template, start, end, matched_words, template_words, coverage."""
    index = docs.sparkSession.sparkContext.broadcast(Index(templates))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _scan(it, index.value), _FOUND)
