"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle
containment verifies them.

A text's words (lower-cased letters and digits) give hashed 5-word shingles; shorter templates are
one shingle of their own width. A template of m shingles belongs to the power of two s >= m. Windows
of 2s shingles step by s, so that any s neighbours lie within one window; minima over blocks are
folded from one size to the next. A window and a template meet if any of ``BANDS`` minima agree. If
0.8 of the template is in a window, their similarity is over 0.8 m / (2s + 0.2 m) >= 0.19, so that
one band in 40 agrees with probability over 0.9997. Texts that meet a template are verified in
full: spans of at most s shingles that hold ``CONTAINMENT`` of its distinct shingles.

Defined results: null and empty texts have no matches; templates without words are left out, and
without any template nothing matches; repeated rows are scanned each by itself; an empty table gives no
rows; a very long text is a piece of its own and scanned whole; where spans of one template overlap, the
first that is long enough counts, and spans of different templates all count; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import arrow_map, byte_texts, mix64

WIDTH, BANDS, CONTAINMENT, MOST_TEMPLATES = 5, 40, 0.8, 5000
#: Notices that public licenses ask for or that name them, and the texts of short ones.
_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_BSD_CONDITIONS = """Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_FREE = """This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} General
Public License as published by the Free Software Foundation"""
_NO_FITNESS = """This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more
details."""
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", """Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("mit", "Released under the MIT License."),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files, to deal in the Software without restriction"""),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation"""),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met"""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("mit", """The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software. """ + _NO_WARRANTY),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software."""),
    ("zlib", """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
        alter it and redistribute it freely, subject to the following restrictions"""),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("bsd", _BSD_CONDITIONS),
    ("bsd", _BSD_WARRANTY),
    ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission."""),
    ("bsd-4-clause", """All advertising materials mentioning features or use of this software must display the following
        acknowledgement"""),
    ("gpl", _NO_FITNESS.format(what="program", name="")),
    ("lgpl", _FREE.format(what="library", name="Lesser")),
    ("lgpl", _NO_FITNESS.format(what="library", name="Lesser")),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("agpl", _FREE.format(what="program", name="Affero")),
    ("agpl", _NO_FITNESS.format(what="program", name="Affero")),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at"""),
    ("epl-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License
        2.0 which is available at"""),
    ("cc0-1.0", "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
)
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SEEDS = mix64(np.arange(1, BANDS + 1)) | np.uint64(1)  # odd factors permute 64-bit hashes
_NONE = np.uint64((1 << 64) - 1)
_B = np.uint64(0x9E3779B97F4A7C15)
_OUT = "doc_id long, licenses array<string>, n_matches long, matches array<struct<license:string,first:int,last:int,containment:double>>"


class _Numbers(dict):
    """A word's number is its XXH64, so that tasks agree without sharing anything."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        out = self[word] = xxh64_intdigest(word)
        return out


def shingles(ids: np.ndarray, width: int = WIDTH) -> np.ndarray:
    width = min(width, len(ids))
    n = len(ids) - width + 1
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * _B + ids[j : n + j]
    return mix64(out) >> np.uint64(1)  # the blank value stays free


def numbered(text: bytes, numbers: _Numbers) -> np.ndarray:
    words = text.translate(_TABLE).split()
    return np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))


def index(templates, numbers: _Numbers) -> list[tuple[int, int, str, np.ndarray, np.ndarray]]:
    """For each template: width, s, license, sorted distinct shingles, a key for each band."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    out = []
    for name, text in templates:
        ids = numbered(text.encode(), numbers)
        if len(ids):
            own = np.unique(shingles(ids))
            out.append((min(WIDTH, len(ids)), 1 << (len(own) - 1).bit_length(), name, own, (own[:, None] * _SEEDS).min(0)))
    return out


class Bands:
    """Templates of one width and size by their band keys: sorted, so that a window is looked up and not
    compared with each template."""

    def __init__(self, size: int, members: list[tuple[int, np.ndarray]]):
        self.size = size
        of, keys = np.array([k for k, _ in members]), np.stack([v for _, v in members])
        order = keys.argsort(0, kind="stable")
        self.keys, self.of = np.take_along_axis(keys, order, 0).T, of[order].T
        self.seen = np.zeros((len(self.keys), 1 << 16), bool)  # low bits of the keys, to pass most windows by
        for band, own in enumerate(self.keys):
            self.seen[band][own.astype(np.uint16)] = True

    def meet(self, window: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the window, template) of all that agree in a band."""
        keys, at = self.keys[band], np.flatnonzero(self.seen[band][window.astype(np.uint16)])
        low = np.searchsorted(keys, window[at])
        n = np.searchsorted(keys, window[at], "right") - low
        return np.repeat(at, n), self.of[band][np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)]


def banded(templates, width: int) -> list[Bands]:
    """The band tables of the templates of one width, by rising size."""
    by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
    for k, t in enumerate(templates):
        if t[0] == width:
            by_size.setdefault(t[1], []).append((k, t[4]))
    return [Bands(size, members) for size, members in sorted(by_size.items())]


def retrieve(h: np.ndarray, tables: list[Bands]) -> dict[int, np.ndarray]:
    """template -> starts of windows of 2s shingles that share a band with it."""
    pad = -len(h) % (2 * tables[-1].size)
    h = np.concatenate((h, np.full(pad, _NONE)))
    found: list[np.ndarray] = []
    for band, seed in enumerate(_SEEDS):
        low, s = h * seed, 1
        for table in tables:
            while s < table.size:
                low, s = np.minimum(low[::2], low[1::2]), 2 * s
            place, template = table.meet(np.minimum(low[:-1], low[1:]), band)
            if len(place):
                found.append(np.stack((template, place * table.size)))
    if not found:
        return {}
    pairs = np.unique(np.concatenate(found, 1), axis=1)
    cut = np.flatnonzero(np.diff(pairs[0], prepend=-1))
    return {int(pairs[0][a]): starts for a, starts in zip(cut, np.split(pairs[1], cut[1:]), strict=True)}


def verify(h: np.ndarray, template) -> list[tuple[str, int, int, float]]:
    """(license, first word, last word, containment): spans of at most s shingles of one text that
    hold enough of the template's distinct shingles; the next span begins after the last."""
    width, s, name, own, _ = template
    at = np.flatnonzero(np.isin(h, own))
    found, i = [], 0
    while i < len(at):
        j = int(np.searchsorted(at, at[i] + s))
        share = len(np.unique(h[at[i:j]])) / len(own)
        if share >= CONTAINMENT:
            found.append((name, int(at[i]), int(at[j - 1]) + width - 1, share))
            i = j
        else:
            i += 1
    return found


def scan(texts: list[np.ndarray], templates, tables: dict[int, list[Bands]] | None = None) -> list[list[tuple[str, int, int, float]]]:
    """Matches of each text, given as word numbers. Texts are hashed end to end; shingles that
    cross an end are blanked, and verification looks at one text at a time."""
    out: list[list] = [[] for _ in texts]
    ids = np.concatenate([*texts, np.zeros(0, np.uint64)])
    ends = np.cumsum([len(t) for t in texts])
    tables = tables or {width: banded(templates, width) for width in {t[0] for t in templates}}
    for width in sorted(tables):
        if len(ids) < width:
            continue
        h = shingles(ids, width)
        for j in range(1, width):
            over = ends - j
            h[over[(over >= 0) & (over < len(h))]] = _NONE
        for k, starts in retrieve(h, tables[width]).items():
            size = 2 * templates[k][1]
            first, last = np.searchsorted(ends, starts, "right"), np.searchsorted(ends, starts + size - 1, "right")
            near = {d for a, b in zip(first.tolist(), last.tolist(), strict=True) for d in range(a, min(b + 1, len(texts)))}
            for d in sorted(near):
                a = int(ends[d]) - len(texts[d])
                out[d] += verify(h[a : max(a, int(ends[d]) - width + 1)], templates[k])
    return [sorted(set(m)) for m in out]


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """A row for each document: its licenses in order, and where in its words they were found."""
    templates = tuple(templates)

    def make():
        numbers = _Numbers()
        known = index(templates, numbers)
        tables = {width: banded(known, width) for width in {t[0] for t in known}}

        def work(batch):
            names, matches = [], []
            texts = [numbered(t, numbers) for t in byte_texts(batch["text"])]
            for got in scan(texts, known, tables):
                names.append(sorted({g[0] for g in got}))
                matches.append([dict(zip(("license", "first", "last", "containment"), g, strict=True)) for g in got])
            kind = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("containment", pa.float64())]))
            counts = pa.array([len(m) for m in matches], pa.int64())
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.list_(pa.string())), counts, pa.array(matches, kind)],
                ["doc_id", "licenses", "n_matches", "matches"])

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, _OUT)
