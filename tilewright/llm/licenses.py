"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Each template is cut into words (letters and digits, lower case); hashes of its word 3-grams are winnowed
(the least of every window of three) into an inverted index from hash to templates and places. A text's
3-grams look the index up; hits on one template that lie near one diagonal (place in the text less place
in the template, within ``band``, or half the template where that is less) form a candidate region. The region is aligned with the template by
dynamic programming in a band around the diagonal; matched words give the coverage, the first and last
matched words the span in code points. A match counts from ``least`` of the template's words on.

Matches of one template that overlap are merged by keeping the better; a region that two templates claim
stays with the one that matches more words (ties: the name first in the alphabet).

Defined results: a null or empty text has no match and gives no row; repeated rows agree; an empty table
gives an empty table; other columns are ignored; texts are scanned whole.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

GRAM, WINDOW, BAND, LEAST = 3, 3, 12, 0.75
WORD = re.compile(r"[^\W_]+")

#: Texts of public licenses and notices that are looked for (fixed values; public texts, more can be passed).
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def gram_hashes(words: list[str]) -> list[int]:
    if len(words) < GRAM:
        return [zlib.crc32(" ".join(words).encode())] if words else []
    return [zlib.crc32(" ".join(words[i : i + GRAM]).encode()) for i in range(len(words) - GRAM + 1)]


def winnow(hashes: list[int], window: int = WINDOW) -> set[int]:
    """Places of the least hash (the last of equals) in every window."""
    if len(hashes) <= window:
        return {min(range(len(hashes)), key=lambda i: (hashes[i], -i))} if hashes else set()
    return {min(range(s, s + window), key=lambda i: (hashes[i], -i)) for s in range(len(hashes) - window + 1)}


class Index:
    """Inverted index of the templates' winnowed fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [WORD.findall(templates[n].lower()) for n in self.names]
        self.places: dict[int, list[tuple[int, int]]] = {}
        self.firsts: dict[str, set[str]] = {}
        for t, words in enumerate(self.words):
            hashes = gram_hashes(words)
            for p in winnow(hashes):
                self.places.setdefault(hashes[p], []).append((t, p))
                self.firsts.setdefault(words[p], set()).add(words[p + 1] if p + 1 < len(words) else "")


def align(text: list[str], template: list[str], diagonal: int, band: int = BAND) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) of the longest common subsequence within ``band`` of the diagonal."""
    n, wide = len(template), 2 * band + 1
    first = diagonal - band
    best = [[0] * (wide + 1)]  # from the end: best[n - j][k] is of the template from j on and the text from place j + first + k
    for j in range(n - 1, -1, -1):
        word, at, below, row = template[j], j + first, best[-1], [0] * (wide + 1)
        for k in range(wide - 1, -1, -1):
            i = at + k
            # below[k]: both move on; below[k - 1]: the template alone; row[k + 1]: the text alone
            here = below[k] + 1 if 0 <= i < len(text) and text[i] == word else 0
            alone = below[k - 1] if k else 0
            row[k] = max(here, alone, row[k + 1])
        best.append(row)
    best.reverse()
    pairs, j, k = [], 0, 0
    while j < n and k <= 2 * band:
        i = j + first + k
        if 0 <= i < len(text) and text[i] == template[j] and best[j][k] == best[j + 1][k] + 1:
            pairs.append((i, j))
            j += 1
        elif best[j][k] == best[j][k + 1]:
            k += 1
        else:
            j, k = j + 1, k - 1
            if k < 0:
                break
    return pairs


def matches(index: Index, text: str, least: float = LEAST) -> list[tuple[str, int, int, int, float]]:
    """(name, start, end, matched words, coverage) by start, of one text."""
    low = text.lower()
    if len(low) != len(text):  # rare characters grow in lower case; offsets then follow a fold of single characters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = list(WORD.finditer(low))
    words = [m[0] for m in found]
    hits: dict[int, list[tuple[int, int]]] = {}
    for i, w in enumerate(words):
        follow = index.firsts.get(w)
        if follow is None or (i + 1 < len(words) and words[i + 1] not in follow and "" not in follow):
            continue
        for t, p in index.places.get(zlib.crc32(" ".join(words[i : i + GRAM]).encode()), ()):
            hits.setdefault(t, []).append((i - p, i))
    out = []
    for t, own in hits.items():
        own.sort()
        template, done = index.words[t], -1
        band = min(BAND, len(template) // 2)  # copies one after another lie a template's length apart
        groups: list[list[tuple[int, int]]] = []
        for d, i in sorted(own, key=lambda x: x[1]):
            if groups and abs(d - groups[-1][-1][0]) <= band and i - groups[-1][0][1] <= len(template) + band:
                groups[-1].append((d, i))
            else:
                groups.append([(d, i)])
        for group in groups:
            diagonal = sorted(d for d, _ in group)[len(group) // 2]
            if diagonal + len(template) <= done:
                continue
            pairs = align(words, template, diagonal, band)
            if pairs and len(pairs) >= least * len(template):
                s, e = pairs[0][0], pairs[-1][0]
                out.append((len(pairs), index.names[t], s, e, len(pairs) / len(template)))
                done = e
    kept: list[tuple[int, str, int, int, float]] = []
    taken: list[tuple[int, int]] = []  # spans of what is kept, apart from each other, by start
    for m in sorted(out, key=lambda m: (-m[0], m[1], m[2])):
        at = bisect.bisect_right(taken, (m[3], len(words)))
        if at == 0 or taken[at - 1][1] < m[2]:
            taken.insert(at, (m[2], m[3]))
            kept.append(m)
    return sorted(((name, found[s].start(), found[e].end(), n, share) for n, name, s, e, share in kept), key=lambda m: m[1])


@functools.cache
def index_of(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(templates))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """A row (doc_id, license, start, end, n_words, coverage) for each match in each whole text."""
    own = tuple(sorted((templates or TEMPLATES).items()))  # templates are a parameter, so of bounded size

    def run(batches):
        index = index_of(own)
        for batch in slices(batches, "text"):
            rows = [(i, *m) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for m in matches(index, t, least)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "license", "start", "end", "n_words", "coverage"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, license string, start bigint, end bigint, n_words bigint, coverage double")
