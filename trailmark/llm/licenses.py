"""License scans: a generalised suffix automaton of license templates gives matching statistics of a token stream; long matches
are chained into covered template spans.

The automaton holds all templates; each state knows all end positions of its string in every template. A document's tokens go
through it once. Only runs of min_match or more tokens that occur in some template can hold a long match, so the rest is passed
over by table lookup. At each end of a match of min_match or more tokens every occurrence in each template becomes an anchor;
anchors of a template that go on in text and template with gaps of at most max_gap are a chain, and each anchor takes the way that covers most; a chain that covers min_cover of its template is a finding:
template, words from and to, coverage. Of chains of a template that share words of the text the one that covers most counts.

Where the words of a finding lie within those of one of another label that covers more words, only the latter stands.

Phrases (whole-word sequences) are found at all places and give their labels whatever the automaton says.

Cases: null text is empty: no words, no labels, score 0; very long texts are scanned whole, in memory of their own size; null and
repeated ids give a row each; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns_or

#: Phrases that name a license, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: What a phrase alone says.
PHRASE_WEIGHT = 0.5

#: Usual notices of licenses, label and wording.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Released under the BSD License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("python", "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"),
]

# ASCII letters in lower case; what separates words becomes a space
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class _Vocabulary(dict):
    def __missing__(self, word):
        return -1


class SuffixAutomaton:
    """Of several token sequences. ends[state] has (sequence, end position) of all occurrences of the state's strings."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, tokens in enumerate(sequences):
            last = 0
            for at, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].add((number, at))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def _state(self, length: int, next_: dict[int, int], link: int) -> int:
        self.next.append(next_)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _clone(self, p: int, token: int, q: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, token, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, token, q)
        return new

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """For each token the length of the longest template string that ends there, and its state."""
        out, state, length = [], 0, 0
        for t in tokens:
            while state and t not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if t in self.next[state]:
                state, length = self.next[state][t], length + 1
            out.append((length, state))
        return out


@dataclass(frozen=True)
class Finding:
    label: str
    template: int
    first: int
    last: int
    coverage: float


@dataclass
class Scanner:
    templates: list[tuple[str, str]] = field(default_factory=lambda: TEMPLATES)
    phrases: dict[str, str] = field(default_factory=lambda: PHRASES)
    min_match: int = 3
    max_gap: int = 8
    min_cover: float = 0.7

    def __post_init__(self):
        worded = [words_of(t) for _, t in self.templates]
        self.vocabulary = _Vocabulary()
        for w in [w for x in worded for w in x] + [w for p in self.phrases for w in words_of(p)]:
            self.vocabulary.setdefault(w, len(self.vocabulary))
        self.sizes = [len(x) for x in worded]
        self.automaton = SuffixAutomaton([[self.vocabulary[w] for w in x] for x in worded])
        self.phrase_ids = [([self.vocabulary[w] for w in words_of(p)], label) for p, label in self.phrases.items()]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[Finding]]:
        """Number of words, (first word, label) of each phrase, and the findings."""
        words = words_of(text)
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words))
        base = []
        for phrase, label in self.phrase_ids:
            n = len(phrase)
            if len(ids) >= n:
                hit = ids[: len(ids) - n + 1] == phrase[0]
                for k in range(1, n):
                    hit = hit & (ids[k : len(ids) - n + 1 + k] == phrase[k])
                base += [(int(i), label) for i in np.flatnonzero(hit)]
        inside = np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])
        change = np.diff(inside)
        starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        long = ends - starts >= self.min_match
        anchors: dict[int, list[tuple[int, int, int]]] = {}  # of a template: text end, template end, length
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            stats = self.automaton.statistics(ids[a:b].tolist())
            for i, (length, state) in enumerate(stats):
                if length >= self.min_match and (i + 1 == len(stats) or stats[i + 1][0] <= length):
                    for number, at in self.automaton.ends[state]:
                        anchors.setdefault(number, []).append((a + i, at, length))
        found = sorted((f for number, own in anchors.items() for f in self._chain(number, own)), key=lambda f: (-f.coverage * self.sizes[f.template], f.template, f.first))
        # of findings of different labels on the same words the one that covers more stands
        findings: list[Finding] = []
        for f in found:
            own = f.coverage * self.sizes[f.template]
            if not any(g.first <= f.first and f.last <= g.last and g.label != f.label and g.coverage * self.sizes[g.template] > own for g in findings):
                findings.append(f)
        return len(words), base, findings

    def _chain(self, number: int, anchors: list[tuple[int, int, int]]) -> list[Finding]:
        best: list[tuple[int, int]] = []  # of the chain that covers most up to each anchor: tokens covered, first word
        for k, (end, at, length) in enumerate(anchors):
            covered, first = length, end - length + 1
            for j in range(k - 1, -1, -1):
                before, there, _ = anchors[j]
                if end - before > length + self.max_gap:
                    break
                if end > before and 0 < at - there <= length + self.max_gap:
                    total = best[j][0] + min(length, at - there, end - before)
                    if total > covered:
                        covered, first = total, best[j][1]
            best.append((covered, first))
        full = [(covered, first, anchors[k][0]) for k, (covered, first) in enumerate(best) if covered >= self.min_cover * self.sizes[number]]
        taken: list[tuple[int, int, int]] = []  # first, last, covered, in order and apart
        for covered, first, last in sorted(full, key=lambda x: (-x[0], x[1], x[2])):
            i = bisect_left(taken, (first,))
            if (i == 0 or taken[i - 1][1] < first) and (i == len(taken) or last < taken[i][0]):
                taken.insert(i, (first, last, covered))
        return [Finding(self.templates[number][0], number, first, last, min(1.0, covered / self.sizes[number])) for first, last, covered in taken]


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """Per document doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (how much speaks for a license:
    1 - (1 - best coverage of a finding) * (1 - PHRASE_WEIGHT, with a phrase)), and with_spans the findings."""
    scanner = scanner or Scanner()
    given = columns_or(docs, doc_id=id_col, text=text_col)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double" + ", spans array<struct<label:string,first:int,last:int,coverage:double>>" * with_spans
    kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    if with_spans:
        kinds.append(("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("coverage", pa.float64())]))))

    def run(batches):
        for b in batches:
            rows = []
            for d, t in zip(b.column(0), b.column(1), strict=True):
                n, base, findings = scanner.scan(t.as_py())
                at = [i for i, _ in base]
                own = {label for _, label in base}
                score = 1 - (1 - max((f.coverage for f in findings), default=0.0)) * (1 - PHRASE_WEIGHT * bool(base))
                row = [d.as_py(), n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {f.label for f in findings})), score]
                rows.append(row + [[{"label": f.label, "first": f.first, "last": f.last, "coverage": f.coverage} for f in findings]] * with_spans)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    return given.mapInArrow(run, schema)
