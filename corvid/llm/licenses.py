"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment.

Words are runs of ASCII letters, digits and non-ASCII bytes, lower-cased. The hashes of a template's word trigrams
are winnowed (the least of every three in a row), which any shared run of five words hits. A document's trigrams
are looked up in the index (the templates are few and fixed); hits of a template on nearby diagonals make a
candidate, however few, which is aligned word by word within a band around them. Matches that cover enough of the
template are reported with their place in the text, of overlapping ones of a template the best. Short notices (of a
few words) match as they stand only: a changed word may be the license's name.

Defined cases: a null text is empty and has no matches; the same template may match at several places; a long text
is taken whole, looked up in overlapping pieces; repeated rows each get their matches; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.suffixes import PIECE, Hashes, pair

COVERAGE = 0.8
GRAM, RUN = 3, 3
OVERLAP = 4096
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IS_WORD = np.array([bool(_WORD.match(bytes([b]))) for b in range(256)])
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Texts of public licenses and of usual notices.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-line": "Released under the MIT License.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def words_of(text: str) -> tuple[bytes, list[tuple[int, int]]]:
    """The lower-cased bytes and the words' places in them."""
    data = text.encode().translate(_LOWER)
    return data, [m.span() for m in _WORD.finditer(data)]


def gram_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the word trigrams of a buffer, with the first byte of each and the byte after it."""
    buffer = np.frombuffer(data, np.uint8)
    inside = np.r_[False, _IS_WORD[buffer], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if len(start) < GRAM:
        return np.empty(0, np.uint64), start[:0], end[:0]
    h = Hashes(buffer).of(start, end)
    n = len(h) - GRAM + 1
    return pair(pair(h[:n], h[1 : n + 1]), h[2 : n + 2]), start[:n], end[2 : n + 2]


class Index:
    """Inverted index of the templates' winnowed trigrams."""

    def __init__(self, templates: dict[str, str]):
        self.words: dict[str, list[bytes]] = {}
        self.postings: dict[tuple[bytes, ...], list[tuple[str, int]]] = defaultdict(list)
        keys = []
        for name, text in templates.items():
            data, spans = words_of(text)
            words = self.words[name] = [data[a:b] for a, b in spans]
            h, *_ = gram_hashes(data)
            picked = sorted({int(np.argmin(h[k : k + RUN])) + k for k in range(max(1, len(h) - RUN + 1))}) if len(h) else []
            keys += [int(h[k]) for k in picked]
            for k in picked:
                self.postings[tuple(words[k : k + GRAM])].append((name, k))
        self.keys = np.unique(np.array(keys, np.uint64))

    def hit(self, texts: list[bytes]) -> set[int]:
        """Which of the lower-cased texts have a trigram of the index."""
        found: set[int] = set()
        parts, owner, size = [], [], 0

        def flush():
            nonlocal parts, owner, size
            if parts:
                h, first, last = gram_hashes(b" ".join(parts))
                at = np.flatnonzero(self.keys[np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)] == h)
                begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
                a, b = np.searchsorted(begin, first[at], "right") - 1, np.searchsorted(begin, last[at] - 1, "right") - 1
                found.update(owner[k] for k in a[a == b])
            parts, owner, size = [], [], 0

        for k, text in enumerate(texts):
            for at in range(0, len(text), PIECE - OVERLAP):
                part = text[at : at + PIECE]
                if size + len(part) + 1 > PIECE + OVERLAP:
                    flush()
                parts.append(part)
                owner.append(k)
                size += len(part) + 1
        flush()
        return found


def align(template: list[bytes], words: list[bytes], low: int, high: int) -> tuple[int, int, int]:
    """Local alignment within diagonals ``low`` to ``high`` (word minus template word): matches, first word, last word."""
    nothing = (0, 0, -1, -1)
    best, above = nothing, [nothing] * (high - low + 1)
    for i, t in enumerate(template):
        row = []
        for d in range(low, high + 1):
            j, k = i + d, d - low
            if not 0 <= j < len(words):
                row.append(nothing)
                continue
            score, n, first, last = above[k]
            if words[j] == t:
                cell = (score + 2, n + 1, first if n else j, j)
            else:
                cell = (score - 1, n, first, last)
            if k + 1 < len(above) and above[k + 1][0] - 1 > cell[0]:  # a template word is missing
                score, n, first, last = above[k + 1]
                cell = (score - 1, n, first, last)
            if row and row[-1][0] - 1 > cell[0]:  # a further word in the text
                score, n, first, last = row[-1]
                cell = (score - 1, n, first, last)
            if cell[0] <= 0:
                cell = nothing
            elif cell[0] > best[0]:
                best = cell
            row.append(cell)
        above = row
    return best[1:]


def matches(text: str, index: Index, least: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, first character, character after) of each match in a text."""
    data, spans = words_of(text)
    words = [data[a:b] for a, b in spans]
    hits: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for j in range(len(words) - GRAM + 1):
        for name, k in index.postings.get(tuple(words[j : j + GRAM]), ()):
            hits[name].append((j - k, j))
    out = set()
    for name, at in hits.items():
        template = index.words[name]
        band = 2 + len(template) // 8
        groups: list[list[tuple[int, int]]] = []
        for d, j in sorted(at):  # nearby diagonals
            if groups and d - groups[-1][-1][0] <= band and d - groups[-1][0][0] <= 4 * band:
                groups[-1].append((d, j))
            else:
                groups.append([(d, j)])
        found = []
        for g in groups:
            n, first, last = align(template, words, g[0][0] - band, g[-1][0] + band)
            if n >= least * len(template):
                found.append((-n, first, last))
        taken: list[tuple[int, int]] = []
        for n, first, last in sorted(set(found)):  # of overlapping matches the best one
            if any(first <= b and a <= last for a, b in taken):
                continue
            taken.append((first, last))
            a, b = spans[first][0], spans[last][1]
            start = len(data[:a].decode())
            out.add((name, round(-n / len(template), 6), -n, start, start + len(data[a:b].decode())))
    return sorted(out, key=lambda m: (m[3], m[0], m[4]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """Rows (doc_id, template, coverage, n_matched, start_char, end_char)."""
    schema = "doc_id long, template string, coverage double, n_matched long, start_char long, end_char long"
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                out = [(ids[k], *m) for k in sorted(index.hit([t.encode().translate(_LOWER) for t in texts])) for m in matches(texts[k], index, least)]
                if out:
                    kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
