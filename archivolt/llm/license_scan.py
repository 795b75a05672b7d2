"""License texts in documents: MinHash bands over overlapping windows retrieve templates, exact containment verifies."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from archivolt.llm.common import GOLDEN, Words, mix64, packed, slices, texts_of

#: Fixed texts: wording of licenses, bodies where they are short, notices and unmistakable paragraphs where they are long.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version."
GNU_TWO = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation; either version {n} of the License, or (at your option) any later version."
TEXTS = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "MIT": [f"{MIT_GRANT} {MIT_WARRANTY}", MIT_GRANT, MIT_WARRANTY],
    "BSD": [BSD_TWO, BSD_WARRANTY, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-2-Clause": [f"{BSD_TWO} {BSD_WARRANTY}"],
    "BSD-3-Clause": [f"{BSD_TWO} {BSD_THIRD} {BSD_WARRANTY}", BSD_THIRD],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"],
    "GPL-2.0": [GNU_TWO.format(kind="General Public License", n=2), "You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty"],
    "GPL-3.0": [GNU.format(kind="General Public License", n=3), "The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    "LGPL-2.1": [GNU_TWO.format(kind="Lesser General Public License", n="2.1")],
    "LGPL-3.0": [GNU.format(kind="Lesser General Public License", n=3)],
    "AGPL-3.0": [GNU.format(kind="Affero General Public License", n=3), "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "reserved": ["All rights reserved"],
}
#: Fixed names: what lines call the licenses.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "MIT": ["MIT License", "MIT license terms", "MIT"],
    "BSD": ["BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"],
    "ISC": ["ISC License", "ISC"],
    "Zlib": ["zlib License", "Zlib"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "BSL-1.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPL-2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPL-3.0", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"],
    "Apache": ["Apache License"],
    "GPL": ["GNU General Public License", "GNU GPL"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL"],
    "AGPL": ["GNU Affero General Public License", "GNU AGPL"],
    "MPL": ["Mozilla Public License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "EPL-2.0"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"],
}
#: How lines put a name.
LEADS = ["licensed under", "licensed under the", "licensed under a", "released under the", "distributed under the", "available under the", "under the terms of the", "SPDX-License-Identifier:"]
TEMPLATES = {k: TEXTS.get(k, []) + [f"{lead} {name}" for name in NAMES.get(k, []) for lead in LEADS] for k in [*TEXTS, *(k for k in NAMES if k not in TEXTS)]}


@dataclass(frozen=True)
class LicenseScan:
    """hashes: bands of one MinHash each. width: words in a shingle (three, as license lines are short).
    base: shingles in the smallest block. containment: least part of a template's shingles that must be there.

    Windows are two blocks of s shingles, s a power of two times base, moving by one block. A template
    of more than s / 2 and at most s shingles lies whole in one of them, so it makes up over a quarter of that window:
    a band agrees with probability over 1/4, none of 48 with probability under (3/4)^48 = 1e-6; with a fifth of the
    template gone it is (4/5)^48 = 2e-5.
    """

    hashes: int = 48
    width: int = 3
    base: int = 2
    containment: float = 0.8


_PART = re.compile(r"[^\W_]+")


def word_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of letters or digits in lower case, the word that holds it), so that marks don't matter."""
    found = [_PART.findall(w) for w in pc.utf8_lower(words.dictionary).to_numpy(zero_copy_only=False).tolist()]
    number = np.fromiter(map(len, found), np.int64, len(found))
    known = np.fromiter((xxhash.xxh3_64_intdigest(x) for parts in found for x in parts), np.uint64, int(number.sum()))
    many = number[words.codes]
    first = (np.cumsum(number) - number)[words.codes]
    at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    return known[at], np.repeat(np.arange(len(words.codes)), many)


def shingle_keys(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of each run of width words within one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[: n] == doc[width - 1 :])
    key = np.zeros(len(at), np.uint64)
    for j in range(width):
        key = key * np.uint64(0x100000001B3) + hashes[at + j]
    return at, mix64(key + GOLDEN)


class Templates:
    """The templates' shingles, and for each block size and hash the values that retrieve them."""

    def __init__(self, templates: dict[str, list[str]], p: LicenseScan):
        self.names, self.sets, sizes = [], [], []
        for name, texts in templates.items():
            for text in texts:
                h = word_hashes(Words(pa.array([text])))[0]
                keys = np.unique(shingle_keys(h, np.zeros(len(h), np.int64), p.width)[1])
                if len(keys):
                    size = p.base
                    while size < len(keys):
                        size *= 2
                    self.names.append(name)
                    self.sets.append(keys)
                    sizes.append(size)
        self.sizes = np.array(sizes)
        self.levels = sorted(set(sizes))
        self.salt = mix64(np.arange(1, p.hashes + 1).astype(np.uint64) * GOLDEN) | np.uint64(1)
        #: (level, hash) -> 65,536 flags of the value's upper bits, sorted values, template of each
        self.bands = {}
        for size in self.levels:
            own = np.flatnonzero(self.sizes == size)
            for k in range(p.hashes):
                values = np.array([self.permuted(self.sets[t], k).min() for t in own])
                order = np.argsort(values)
                flags = np.zeros(1 << 16, bool)
                flags[(values >> np.uint64(48)).astype(np.int64)] = True
                self.bands[size, k] = flags, values[order], own[order]

    def permuted(self, keys: np.ndarray, k: int) -> np.ndarray:
        x = keys * self.salt[k]
        return x ^ (x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


def candidates(key: np.ndarray, doc: np.ndarray, known: Templates, p: LicenseScan) -> set[tuple[int, int, int]]:
    """(template, first shingle, end shingle) of each window that shares a band with a template."""
    out: set[tuple[int, int, int]] = set()
    if not len(key):
        return out
    levels = []  # the blocks of each size: first shingle, text
    place = np.arange(len(key)) - np.searchsorted(doc, doc)
    size = p.base
    while size <= known.levels[-1]:
        head = np.flatnonzero(place % size == 0)
        levels.append((size, head, doc[head]))
        size *= 2
    folds = [np.flatnonzero(np.isin(small[1], large[1], assume_unique=True)) for small, large in zip(levels, levels[1:])]
    pairs = [np.append(of[1:] == of[:-1], False) for _, _, of in levels]
    for k in range(p.hashes):
        low = np.minimum.reduceat(known.permuted(key, k), levels[0][1])
        for i, (size, head, _) in enumerate(levels):
            if i:
                low = np.minimum.reduceat(low, folds[i - 1])
            if (size, k) not in known.bands:
                continue
            flags, values, which = known.bands[size, k]
            both = np.where(pairs[i], np.minimum(low, np.append(low[1:], low[-1])), low)
            some = np.flatnonzero(flags[(both >> np.uint64(48)).astype(np.int64)])
            a, b = values.searchsorted(both[some], "left"), values.searchsorted(both[some], "right")
            for j in np.flatnonzero(a < b).tolist():
                w = int(some[j])
                end = w + 1 + bool(pairs[i][w])
                stop = int(head[end]) if end < len(head) else len(key)
                out.update((int(t), int(head[w]), stop) for t in which[a[j] : b[j]])
    return out


def stretches(place: np.ndarray, key: np.ndarray, size: int, p: LicenseScan) -> list[tuple[int, int, float]]:
    """(first place, last place, containment) of the stretches of a run of hits that hold enough of a template of `size` shingles.

    A stretch is at most a quarter longer than the template, so that wording it shares with its surroundings isn't drawn in. The
    one with most of the template is taken first, the shortest of those; then what lies on either side of it.
    """
    out, todo = [], [(0, len(place))]
    while todo:
        lo, hi = todo.pop()
        if len(set(key[lo:hi].tolist())) < p.containment * size:
            continue
        held: dict[int, int] = {}
        left, best = lo, (0, 0, lo, lo)
        for right in range(lo, hi):
            k = int(key[right])
            held[k] = held.get(k, 0) + 1
            while held[int(key[left])] > 1 or place[right] - place[left] > size * 1.25 + 2:
                gone = int(key[left])
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                left += 1
            best = max(best, (len(held), int(place[left] - place[right]), left, right))
        many, _, left, right = best
        if many >= p.containment * size:
            out.append((int(place[left]), int(place[right]), many / size))
            todo += [(lo, left), (right + 1, hi)]
    return out


def license_spans(texts: pa.Array, known: Templates, p: LicenseScan, retrieve=candidates) -> list[list[tuple[str, int, int, float]]]:
    """Per text (license, start, end, containment) in code points. Where matches overlap, the longest stays, then the fullest.

    retrieve: gives the (template, first shingle, end shingle) to verify.
    """
    words = Words(texts)
    hashes, real = word_hashes(words)
    doc = words.doc[real]
    at, key = shingle_keys(hashes, doc, p.width)
    of = doc[at]
    found: dict[int, list[tuple[float, int, int, str]]] = {}
    for t, a, b in retrieve(key, of, known, p):
        slack = len(known.sets[t])  # a changed copy may reach past the window
        a0, b0 = max(a - slack, 0), min(b + slack, len(key))
        own = known.sets[t]
        inside = a0 + np.flatnonzero((own[np.minimum(own.searchsorted(key[a0:b0]), len(own) - 1)] == key[a0:b0]) & (of[a0:b0] == of[a]))
        if not len(inside):
            continue
        # hits no further apart than the template is long, cut down to the stretches that hold it
        for run in np.split(inside, np.flatnonzero(np.diff(inside) > slack) + 1):
            for first, last, part in stretches(run, key[run], len(own), p):
                found.setdefault(int(of[a]), []).append((part, int(real[at[first]]), int(real[at[last] + p.width - 1]), known.names[t]))
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in range(len(texts))]
    for d, hits in found.items():
        places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[d].as_py())]
        base = int(words.starts[d])
        taken: list[tuple[int, int]] = []
        for part, first, last, name in sorted(set(hits), key=lambda h: (h[1] - h[2], -h[0], h[3], h[1])):
            if all(last < a or first > b for a, b in taken):
                taken.append((first, last))
                out[d].append((name, places[first - base][0], places[last - base][1], part))
        out[d].sort(key=lambda s: (s[1], s[0]))
    return out


@cache
def known_templates(templates: tuple[tuple[str, tuple[str, ...]], ...], p: LicenseScan) -> Templates:
    """Made once in a Python worker."""
    return Templates({name: list(texts) for name, texts in templates}, p)


def _scanned(templates: dict[str, list[str]], p: LicenseScan, text_at: int):
    fixed = tuple((name, tuple(texts)) for name, texts in templates.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_templates(fixed, p)
        for batch in batches:
            for part in slices(batch, text_at):
                spans = license_spans(texts_of(part, text_at), known, p)
                names = [",".join(sorted({s[0] for s in x})) for x in spans]
                told = [",".join(f"{n}:{a}:{b}" for n, a, b, _ in x) for x in spans]
                least = [min((s[3] for s in x), default=None) for x in spans]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(names, pa.string()), pa.array(told, pa.string()), pa.array(least, pa.float64())], ["row", "licenses", "spans", "containment"])

    return run


def scan_licenses(docs: DataFrame, p: LicenseScan = LicenseScan(), text_col: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """docs packed as `row`, with licenses (names, sorted, comma-joined), spans (name:start:end in code points, by start) and
    containment (the least of the spans; null where there are none).

    Words are runs of letters and digits in lower case. Texts are taken whole, however long, over all their
    windows; null, empty and shorter texts have no license. Of matches that overlap the longest is told. Repeated rows are scanned
    each. Other columns stay in `row`, whatever their names; an empty table gives no rows.
    """
    rows, at = packed(docs, text_col)
    kind = T.StructType([rows.schema["row"], T.StructField("licenses", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("containment", T.DoubleType())])
    return rows.mapInArrow(_scanned(templates or TEMPLATES, p, at), kind)
