"""License scan by patience alignment of texts with templates.

A template is held against the stretches of a text that could hold it.  The alignment matches the common head and tail of the two
word sequences, anchors on words that occur once in both, keeps the longest increasing subsequence of the anchors, and
goes on in the gaps between them.  Coverage is the share of the template's words that it matches; a stretch of MIN_COVERAGE or more is
reported, and the scan goes on behind it, so that every copy is found.

A stretch may hold foreign words besides the template's, slack of the template's length at most (a parameter; a template that is
spread further counts as not there).  Spans do not overlap: of those that would, the one that matches the most words stays, then the
one of the better coverage, the lesser name, the earlier start.  Built-in templates are notices, short licenses and the headers of
long ones; read_templates() takes the full texts of a folder.

Words are runs of [0-9a-z.-] of the ASCII-lower-cased text without edge dots and dashes.  Null texts count as empty and have
no licenses. Rows are scanned one by one, so repeated rows and ids repeat their results; other columns are ignored, an empty
table gives an empty result.  Whole texts are scanned, in time linear in their length (but for sorting the spans found) for a given
set of templates, however many notices a text has.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.arrays import slices

MIN_COVERAGE = 0.8
SLACK = 0.25  # foreign words in a stretch, as a share of the template's
_WORD = re.compile(r"[0-9A-Za-z](?:[0-9A-Za-z.-]*[0-9A-Za-z])?")

#: Wordings of notices and licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "All-rights-reserved": "All rights reserved.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT-warranty": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-warranty": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE.""",
    "BSD-third-clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.""",
    "ISC-warranty": """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any
source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and
to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all
subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this
restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative
works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a
source language processor.""",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
}


def read_templates(folder: str) -> dict[str, str]:
    """Templates of a local folder of license texts, by file name without extension; files of no words are left out."""
    out = {}
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                text = f.read()
            if _WORD.search(text):
                out[os.path.splitext(name)[0]] = text
    return out



@dataclass(frozen=True)
class Found:
    start: int  # code points
    end: int
    license: str
    coverage: float


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """(lower-cased words, their spans)."""
    spans = [m.span() for m in _WORD.finditer(text)]
    return [text[a:b].lower() for a, b in spans], spans


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for k, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            at.append(k)
        else:
            tops[pile], at[pile] = v, k
        back[k] = at[pile - 1] if pile else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        where = {w: p for p, w in enumerate(b[k:m], k) if in_b[w] == 1}
        anchors = [(p, where[w]) for p, w in enumerate(a[i:j], i) if in_a[w] == 1 and w in where]
        anchors = [anchors[p] for p in increasing([q for _, q in anchors])]
        out += anchors
        if anchors:
            begin = [(i, k), *((p + 1, q + 1) for p, q in anchors)]
            end = [*anchors, (j, m)]
            todo += [(*x, *y) for (x, y) in (((p0, p1), (q0, q1)) for (p0, q0), (p1, q1) in zip(begin, end, strict=True)) if x[0] < x[1] and y[0] < y[1]]
    return sorted(out)


class Scanner:
    """Templates in words, and what a text must hold of each."""

    def __init__(self, templates: dict[str, str], min_coverage: float = MIN_COVERAGE, slack: float = SLACK):
        self.min_coverage, self.slack = min_coverage, slack
        self.templates = {k: words(t)[0] for k, t in templates.items()}
        if any(not t for t in self.templates.values()):
            raise ValueError("a template has no words")
        self.counts = {k: Counter(t) for k, t in self.templates.items()}
        self.all = {w for t in self.templates.values() for w in t}
        common = Counter(w for c in self.counts.values() for w in c)
        # without more than this many of its words a template can't be covered, so one of any missable + 1 must occur
        self.seeds = {}
        for k, c in self.counts.items():
            missable = int((1 - min_coverage) * len(self.templates[k]) + 1e-9)
            chosen, held = {}, 0
            for w in sorted(c, key=lambda w: (common[w], -len(w), w)):
                chosen[w] = self.templates[k].index(w)
                held += c[w]
                if held > missable:
                    break
            self.seeds[k] = chosen

    def scan(self, text: str) -> list[Found]:
        """Stretches that cover a template, by start; of those that overlap, the one that matches the most words."""
        low = text.lower()
        likely = [k for k, c in self.counts.items() if any(w in low for w in self.seeds[k]) and sum(n for w, n in c.items() if w in low) >= self.min_coverage * len(self.templates[k]) - 1e-9]
        if not likely:
            return []
        found, spans = words(text)
        places: dict[str, list[int]] = {}
        for p, w in enumerate(found):
            if w in self.all:
                places.setdefault(w, []).append(p)
        out = []
        for name in likely:
            template = self.templates[name]
            n, count = len(template), self.counts[name]
            if sum(min(c, len(places.get(w, ()))) for w, c in count.items()) < self.min_coverage * n - 1e-9:
                continue
            slack, behind = int(self.slack * n) + 2, 0
            for p, w in sorted((p, w) for w in self.seeds[name] for p in places.get(w, ())):
                if p < behind:
                    continue
                begin = max(behind, p - self.seeds[name][w])
                best: tuple[int, list] = (0, [])
                for a in {begin, max(behind, begin - slack)}:
                    matched = align(found[a : begin + n + slack], template)
                    if len(matched) > best[0]:
                        best = (len(matched), [a + x for x, _ in matched])
                if best[0] >= self.min_coverage * n - 1e-9:
                    behind = best[1][-1] + 1
                    out.append((-best[0], Found(spans[best[1][0]][0], spans[behind - 1][1], name, best[0] / n)))
        kept: list[tuple[int, int, Found]] = []  # by start; they do not overlap, so only neighbours can be in the way
        for _, f in sorted(out, key=lambda x: (x[0], -x[1].coverage, x[1].license, x[1].start)):
            k = bisect_left(kept, f.start, key=lambda x: x[0])
            if (k == 0 or kept[k - 1][1] <= f.start) and (k == len(kept) or f.end <= kept[k][0]):
                insort(kept, (f.start, f.end, f), key=lambda x: x[0])
        return [f for _, _, f in kept]


def license_spans(df: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_licenses, license (of the best coverage, then the longest, then by name; null without one), coverage, and spans
    as name:start:end in code points by start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates or TEMPLATES, min_coverage, slack)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found = [scanner.scan(t) if t else [] for t in batch.column(1).to_pylist()]
            best = [min(f, key=lambda x: (-x.coverage, x.start - x.end, x.license)) if f else None for f in found]
            columns = [
                pa.array([len(f) for f in found], pa.int64()),
                pa.array([b and b.license for b in best], pa.string()),
                pa.array([b.coverage if b else 0.0 for b in best], pa.float64()),
                pa.array([",".join(f"{x.license}:{x.start}:{x.end}" for x in f) for f in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    names = [id_col, "n_licenses", "license", "coverage", "spans"]
    source = df.select(F.col(id_col), F.col(text_col))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_licenses long, license string, coverage double, spans string")
