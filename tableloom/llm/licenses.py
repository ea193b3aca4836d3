"""License texts in documents.

Winnowed fingerprints of the templates form an inverted index. Every word gram
of a document is looked up in it; where grams put a template into a document, a
banded alignment of the words reports how much of the template is there and
where. The index and the templates are parameters of the caller, so their size
does not grow with the documents.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3  # words in a fingerprint
WINDOW = 3  # grams of which the one with the smallest hash is a fingerprint
SHORT = 20  # words up to which every gram of a template is a fingerprint
COVERAGE = 0.7  # least share of a template's words
# A longer text around a shorter one, such as three clauses around two, may lack this share of its words.
NEARLY = 0.05
# Points of an alignment.
MATCH, OTHER, GAP = 2, -1, -1

# Parts that several license texts share.
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_AS_IS_UPPER = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
_ISC_TAIL = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
# License texts and, of the long licenses, their standard notices, by their SPDX names.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
    "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD
    + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission. "
    + _BSD_TAIL,
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
    "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to "
    "prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following "
    "disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies "
    "or derivative works are solely in the form of machine-executable object code generated by a source language processor. " + _AS_IS_UPPER +
    "FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE "
    "LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
    "THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies. " + _ISC_TAIL,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_TAIL,
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
    "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software. " + _AS_IS_UPPER + "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
    "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
    "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
    "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
    "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
    "under copyright law. " + _AS_IS_UPPER + "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
    "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
    "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "all-rights-reserved": "All rights reserved.",
}

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACED = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_WORD = re.compile("[^" + re.escape((_PUNCTUATION + b" \t\n\r\x0b\x0c").decode()) + "]+")


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space and punctuation, with A-Z lower-cased."""
    return text.encode().lower().translate(_SPACED).split()


class Index:
    """Templates as word numbers, and their winnowed grams with the templates and places that have them."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW):
        self.gram = gram
        self.names = sorted(n for n, t in templates.items() if words_of(t))
        lists = {n: words_of(templates[n]) for n in self.names}
        self.numbers = {w: k for k, w in enumerate(sorted({w for ws in lists.values() for w in ws}), start=1)}
        self.templates = {n: np.array([self.numbers[w] for w in ws]) for n, ws in lists.items()}
        self.base = len(self.numbers) + 1
        if self.base ** gram >= 1 << 63:
            raise ValueError("the templates have too many different words for one index; scan them in parts")
        found = defaultdict(list)
        for name in self.names:
            # Of a short notice every gram counts: one changed word may leave only one.
            for at, code in self._winnowed(lists[name], self.templates[name], window if len(lists[name]) > SHORT else 1):
                found[code].append((name, at))
        self.places = dict(found)
        self.codes = np.array(sorted(found), dtype=np.int64)

    def grams(self, numbers: np.ndarray) -> np.ndarray:
        """The code of each gram; texts shorter than a gram are one gram."""
        if len(numbers) < self.gram:
            numbers = np.concatenate([numbers, np.zeros(self.gram - len(numbers), dtype=numbers.dtype)])
        n = len(numbers) - self.gram + 1
        code = np.zeros(n, dtype=np.int64)
        for k in range(self.gram):
            code = code * self.base + numbers[k : k + n]
        return code

    def _winnowed(self, words: list[bytes], numbers: np.ndarray, window: int) -> list[tuple[int, int]]:
        codes = self.grams(numbers).tolist()
        # By the words, so that the choice does not depend on other templates.
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + self.gram])) for k in range(len(codes))]
        picked = set()
        for k in range(max(1, len(codes) - window + 1)):
            here = range(k, min(k + window, len(codes)))
            picked.add(min(here, key=lambda j: (hashes[j], -j)))
        return [(k, codes[k]) for k in sorted(picked)]

    def candidates(self, numbers: np.ndarray) -> dict[str, list[int]]:
        """For each template the places in a document where one of its fingerprints puts its first word."""
        if not len(numbers) or not len(self.codes):
            return {}
        codes = self.grams(numbers)
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        found = defaultdict(list)
        for k in np.flatnonzero((self.codes[at] == codes) & (codes > 0)).tolist():
            for name, place in self.places[int(codes[k])]:
                found[name].append(k - place)
        return found


def align(template: np.ndarray, words: np.ndarray, band: int) -> tuple[int, int, int]:
    """The best local alignment near the diagonal: matched words, first and one past the last matched word of ``words``.

    ``words[band]`` stands where the template would start; a cell more than
    ``band`` away from that diagonal is not looked at.
    """
    width, n = 2 * band + 1, len(words)
    points = np.zeros((len(template) + 1, width + 2), dtype=np.int32)
    steps = np.arange(width + 2)
    for i, word in enumerate(template, start=1):
        last = points[i - 1]
        d = steps[1 : max(1, min(width, n - i + 1) + 1)]  # words[i + d - 2] exists
        if not len(d):
            break
        own = np.maximum(last[d] + np.where(words[i + d - 2] == word, MATCH, OTHER), last[d + 1] + GAP)
        # A gap along the row: the best start of it, less one gap for each step.
        own = np.maximum(own, 0) - GAP * d
        points[i, d] = np.maximum.accumulate(own) + GAP * d
    i, d = (int(x) for x in np.unravel_index(points.argmax(), points.shape))
    matched, first, end = 0, 0, 0
    while i > 0 and points[i, d] > 0:
        j = i + d - 2
        same = words[j] == template[i - 1]
        if points[i, d] == points[i - 1, d] + (MATCH if same else OTHER):
            if same:
                matched += 1
                first = j
                end = end or j + 1
            i -= 1
        elif points[i, d] == points[i - 1, d + 1] + GAP:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return matched, first, end


def matches(text: str, index: Index, coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """``license, coverage, matched words, start, end`` (code points) of every template occurrence in a text."""
    get = index.numbers.get
    numbers = np.array([get(w, 0) for w in words_of(text)], dtype=np.int64)
    found = []
    for name, starts in index.candidates(numbers).items():
        template = index.templates[name]
        band = max(1, len(template) // 3)
        reached = -1
        for start in _clusters(sorted(starts), band):
            low = start - band
            words = numbers[max(low, 0) : start + len(template) + band + 1]
            words = np.concatenate([np.zeros(max(-low, 0), dtype=np.int64), words])
            matched, first, end = align(template, words, band)
            if matched >= coverage * len(template) and low + first > reached:
                found.append((name, matched / len(template), matched, low + first, low + end))
                reached = low + end - 1
    found = [f for f in found if not any(_better(other, f) for other in found)]
    if not found:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    return sorted(((n, c, m, spans[a][0], spans[b - 1][1]) for n, c, m, a, b in found), key=lambda r: (r[3], r[0]))


def _better(one: tuple, than: tuple) -> bool:
    """Whether a match lies over another, with a higher coverage and no fewer words, or with more words and nearly its coverage."""
    over = one[3] < than[4] and than[3] < one[4]
    return over and ((one[1] > than[1] and one[2] >= than[2]) or (one[2] > than[2] and one[1] >= than[1] - NEARLY))


def _clusters(starts: list[int], band: int) -> list[int]:
    """One start for each run of starts that one band covers: the one that most grams name."""
    runs, here = [], []
    for s in starts:
        if here and s - here[0] > band:
            runs.append(here)
            here = []
        here.append(s)
    if here:
        runs.append(here)
    return [max(set(r), key=lambda s: (r.count(s), -s)) for r in runs]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, license, coverage, n_words, start, end`` of every license text in ``docs``, in code points of the text.

    Null, empty or clean documents give no rows; repeated rows give their rows
    again; other columns are not read. Templates may overlap; one is left out
    where another covers the same words better. A very long text is looked up
    once from end to end; only bands around the places named by fingerprints
    are aligned, each bounded by the length of its template.
    """
    index = Index(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "license", "coverage", "n_words", "start", "end"]
        types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.is_valid:
                    rows += [(doc_id, *m) for m in matches(text.as_py(), index, coverage)]
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = "doc_id bigint, license string, coverage double, n_words bigint, start bigint, end bigint"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)
