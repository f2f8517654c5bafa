"""License scans by patience alignment of texts with license templates.

Regions of a text that hold enough words of a template, short ones first, are aligned with it: words that occur once in each are anchors, their longest
increasing subsequence is kept, and the gaps between anchors are aligned in the same way. Coverage is the share of the template's
words that are aligned, density the share of the place's words that are.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import BYTE_BASE, Words, slices, span_hashes, text_buffer

#: Notices and license texts by name; fixed values.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "MIT text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        'and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "BSD-2-Clause text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
}
#: Bytes that the templates of a table may have in all: they go to every task.
TEMPLATE_BYTES = 64 << 20
#: Least share of aligned words among the words of a place.
DENSITY = 1 / 3

#: A-Z to a-z; ASCII that is neither letter nor digit to a space.
_FOLD = np.arange(256, dtype=np.uint8)
for _c in range(128):
    _FOLD[_c] = ord(chr(_c).lower()) if chr(_c).isalnum() else 0x20


def folded_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of letters, digits and other non-ASCII characters, without regard to ASCII case, and their hashes."""
    w = Words(_FOLD[data], offsets)
    return w, span_hashes(w.data, w.starts, w.ends, BYTE_BASE)


def longest_increasing(seq: Sequence[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    below = [-1] * len(seq)
    for i, x in enumerate(seq):
        k = bisect.bisect_left(tops, x)
        below[i] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(x)
            at.append(i)
        else:
            tops[k], at[k] = x, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Aligned pairs (i, j) with a[i] == b[j], increasing in both.

    Equal ends of a range are aligned first. In what is left, words unique to both sides are anchors; ranges without anchors stay unaligned.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i >= n or j >= m:
            continue
        once = lambda seq, lo, hi: {x for x, c in Counter(seq[lo:hi]).items() if c == 1}
        unique = once(a, i, n) & once(b, j, m)
        place = {b[y]: y for y in range(j, m) if b[y] in unique}
        pairs = [(x, place[a[x]]) for x in range(i, n) if a[x] in unique]
        anchors = [pairs[k] for k in longest_increasing([y for _, y in pairs])]
        if not anchors:
            continue
        for (x0, y0), (x1, y1) in zip([(i - 1, j - 1), *anchors], [*anchors, (n, m)]):
            todo.append((x0 + 1, x1, y0 + 1, y1))
        out += anchors
    return sorted(out)


def longest_run(places: Sequence[int], least: float, density: float) -> tuple[int, int] | None:
    """First and last index of the most of ``places`` in a row, ``least`` or more, that are ``density`` or more of the words they reach over; the densest, then leftmost of equals.

    Words of a template that stray before or after an occurrence are so left out of it.
    """
    at = np.asarray(places)
    for size in range(len(at), max(1, int(np.ceil(least - 1e-9))) - 1, -1):
        reach = at[size - 1 :] - at[: len(at) - size + 1] + 1
        i = int(np.argmin(reach))
        if size >= density * reach[i] - 1e-9:
            return i, i + size - 1
    return None


def scan(words: np.ndarray, template: np.ndarray, cover: float, density: float = DENSITY) -> list[tuple[float, int, int]]:
    """(coverage, first word, end word) of each occurrence of the template in a text, none overlapping, from left to right.

    First windows of 1.25 template lengths that hold enough of its words are aligned. What they leave free is aligned in windows twice as
    long each time, begun at every half of their length, until half a window is as long as the words of a place may reach at that density.
    Memory grows with the text alone, not with text times template.
    """
    t, n = len(template), len(words)
    goal = template.tolist()
    known, times = np.unique(template, return_counts=True)
    place = np.minimum(np.searchsorted(known, words), len(known) - 1)
    # known words by position; one counts in a stretch unless the template's number of its like lie before it there, that is from ``earlier`` on
    pos = np.flatnonzero(known[place] == words)
    kind = place[pos]
    order = np.argsort(kind, kind="stable")
    back = np.arange(len(pos)) - times[kind[order]]
    same = (back >= 0) & (kind[order][np.maximum(back, 0)] == kind[order])
    earlier = np.full(len(pos), -1)
    earlier[order[same]] = pos[order[back[same]]]

    def shared(begin: int, end: int) -> int:
        """Words that a stretch of the text and the template share: no alignment has more pairs."""
        low, high = np.searchsorted(pos, [begin, end])
        return int((earlier[low:high] < begin).sum())

    def all_shared(span: int) -> np.ndarray:
        """``shared`` of every window of ``span`` words, the last ones ending with the text."""
        change = np.zeros(n + 1, dtype=np.int64)
        np.add.at(change, np.maximum(earlier + 1, np.maximum(pos - span + 1, 0)), 1)
        np.add.at(change, pos + 1, -1)
        return np.cumsum(change[:n])

    found: list[tuple[float, int, int]] = []

    def align(low: int, high: int) -> bool:
        pairs = patience(words[low:high].tolist(), goal)
        run = longest_run([i for i, _ in pairs], cover * t, density)
        if run is None:
            return False
        found.append(((run[1] - run[0] + 1) / t, low + pairs[run[0]][0], low + pairs[run[1]][0] + 1))
        return True

    span = t + t // 4 + 1
    common = all_shared(span)
    dense = np.flatnonzero(common >= cover * t)
    free = k = 0
    failed = None
    while k < len(dense):
        begin = max(free, int(dense[k]))
        # the densest window among those that begin within a template's length
        near = dense[k : np.searchsorted(dense, begin + t, side="right")]
        best = int(near[np.argmax(common[near])])
        region = max(free, best - t // 4), min(len(words), best + span + t // 4)
        if region != failed and align(*region):
            free = found[-1][2]
            k = int(np.searchsorted(dense, free))
        else:
            failed = region
            k += 1
    while True:
        span *= 2
        common = all_shared(span)
        edges = [0, *(x for _, a, z in sorted(found, key=lambda f: f[1]) for x in (a, z)), n]
        for low, high in zip(edges[::2], edges[1::2]):
            at = low
            while at < high:
                end = min(high, at + span)
                if common[at] >= cover * t and shared(at, end) >= cover * t and align(at, end):
                    at = found[-1][2]
                elif end == high:
                    break
                else:
                    at += span // 2
        if span >= min(n, 2 * t / density):
            return sorted(found, key=lambda f: f[1])


def templates_of(table: DataFrame, name_col: str = "name", text_col: str = "text") -> dict[str, str]:
    """Templates from a table, in order of name; of a repeated name the least text counts, null names or texts and texts without words are none."""
    rows = table.where(F.col(name_col).isNotNull() & F.col(text_col).rlike("[0-9A-Za-z]|[^\\x00-\\x7f]")).groupBy(F.col(name_col).alias("name")).agg(F.min(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"templates of {size} bytes; {TEMPLATE_BYTES} at most")
    return {r["name"]: r["text"] for r in rows.orderBy("name").collect()}


def scan_licenses(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] | DataFrame = TEMPLATES, cover: float = 0.8, density: float = DENSITY
) -> DataFrame:
    """(id_col, license, coverage, density, start_byte, end_byte, matched): each place where a template's coverage is ``cover`` or more and ``density`` or more of the place's words are aligned.

    ``templates``: text by name, or a table (name, text). ``matched`` is the text from the first to the last aligned word, at UTF-8 byte
    offsets. Places of one template do not overlap; where places of several do, the one with most aligned words counts, of equal ones that of the
    greater coverage, then the leftmost: so a license is not taken for a longer one that holds it.
    Foreign words inside a place, two for each aligned one, and left-out ones up to 1 - ``cover`` do not hide it; words of a notice that
    stand farther apart are no place of it. Windows that hold enough of the
    template's words are aligned, ever wider ones until they hold any place whole, and only after a failed window does the search move on, by one window at
    first and by half a window in the wider ones. Whole texts are read, however long. Null and empty texts and an empty table have no rows;
    repeated rows give theirs each, ids may be null or repeat, extra columns are not read. A map, with no exchange.
    """
    if isinstance(templates, DataFrame):
        templates = templates_of(templates)
    names = list(templates)
    goals = []
    for text in templates.values():
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        goals.append(folded_words(raw, np.array([0, len(raw)]))[1])
    counted = [np.unique(g, return_counts=True) for g in goals]
    vocabulary, times = [c[0] for c in counted], [c[1] for c in counted]

    def run(batches):
        for batch in batches:
            for b in slices(batch, "__text"):
                data, offsets = text_buffer(b.column(1))
                words, h = folded_words(data, offsets)
                maybe: dict[int, list[int]] = {}
                for k, (goal, known) in enumerate(zip(goals, vocabulary)):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    # texts that have as many of the template's words as a place needs
                    there = np.flatnonzero(known[at] == h)
                    rows = np.searchsorted(words.first, there, side="right") - 1
                    many = np.flatnonzero(np.bincount(rows, minlength=len(words.first) - 1) >= cover * len(goal))
                    for row in many:
                        low, high = np.searchsorted(rows, [row, row + 1])
                        counts = np.bincount(at[there[low:high]], minlength=len(known))
                        if np.minimum(counts, times[k]).sum() >= cover * len(goal):
                            maybe.setdefault(int(row), []).append(k)
                out: dict[str, list] = {"row": [], "license": [], "coverage": [], "density": [], "start": [], "end": [], "matched": []}
                for row, which in sorted(maybe.items()):
                    base = int(words.first[row])
                    own = h[base : words.first[row + 1]]
                    hits = [(round(hit[0] * len(goals[k])), k, *hit) for k in which for hit in scan(own, goals[k], cover, density)]
                    taken: list[tuple[int, int]] = []
                    for many, k, share, a, z in sorted(hits, key=lambda x: (-x[0], -x[2], x[3])):
                        if any(a < y and x < z for x, y in taken):
                            continue
                        taken.append((a, z))
                        start, end = int(words.starts[base + a]), int(words.ends[base + z - 1])
                        for name, v in (("row", row), ("license", names[k]), ("coverage", share), ("density", many / (z - a)), ("start", start - offsets[row]), ("end", end - offsets[row]), ("matched", data[start:end].tobytes())):
                            out[name].append(v)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(out["row"], pa.int64())),
                        pa.array(out["license"], pa.string()),
                        pa.array(out["coverage"], pa.float64()),
                        pa.array(out["density"], pa.float64()),
                        pa.array(out["start"], pa.int64()),
                        pa.array(out["end"], pa.int64()),
                        pa.array(out["matched"], pa.binary()).cast(pa.string()),
                    ],
                    names=[id_col, "license", "coverage", "density", "start_byte", "end_byte", "matched"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, license string, coverage double, density double, start_byte long, end_byte long, matched string")
