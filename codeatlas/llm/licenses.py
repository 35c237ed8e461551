"""License scans: patience alignment of texts with license templates."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced, utf8

#: Notices, grants and whole short licenses as they are printed. A name may have several templates.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
#: ASCII bytes that are neither letters nor digits part words; other bytes belong to them.
_PARTS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: A region ends where this many words in a row are in no template.
GAP = 12
#: A notice that covers so much of its template, up to its last word, does not compete with others of the same template that begin inside it.
SURE = 0.95
#: Words that tell a template from its siblings: all that a template has must be matched, and no RIVALS that it lacks may stand between.
NAMING = frozenset(b"mit apache general mozilla cc by nc nd sa lesser affero later 1 2 3 4".split())
#: Those of them that prose holds too: they name a template only if its license's name has them.
COMMON = frozenset(b"by later 1 2 3 4".split())
RIVALS = frozenset(b"lesser affero nc nd sa".split())


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_PARTS).split()


def rising(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence (patience piles)."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(ends[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _zeros(a: list, b: list) -> Iterator[int]:
    """Per word of a, bits of which zeros mark where the longest common subsequence with b so far grows by one (bit-parallel)."""
    places: dict = defaultdict(int)
    for j, w in enumerate(b):
        places[w] |= 1 << j
    full = v = (1 << len(b)) - 1
    for w in a:
        same = v & places.get(w, 0)
        v = ((v + same) | (v - same)) & full
        yield v


def common_length(a: list, b: list) -> int:
    """The length of a longest common subsequence."""
    v = (1 << len(b)) - 1
    for v in _zeros(a, b):
        pass
    return len(b) - v.bit_count()


def common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists, as pairs of places."""
    rows = [(1 << len(b)) - 1, *_zeros(a, b)]
    out, i, j = [], len(a), len(b)
    while i and j:
        below = (1 << j) - 1
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif (rows[i - 1] & below).bit_count() == (rows[i] & below).bit_count():
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def common_with(a: list, b: list, heavy: frozenset) -> list[tuple[int, int]]:
    """Of the common subsequences of two lists one with the most heavy words, and of those one of the longest, as pairs of places."""
    weight = {w: 1 + (len(b) + 1) * (w in heavy) for w in b}
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, under = best[i], best[i + 1]
        same = weight.get(a[i])
        for j in range(len(b) - 1, -1, -1):
            row[j] = max(under[j + 1] + same, under[j], row[j + 1]) if same and a[i] == b[j] else max(under[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j] and best[i][j] == best[i + 1][j + 1] + weight[b[j]]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience alignment: the pairs (i, j), rising in both, of equal words a[i] and b[j].

    Words that occur once in a and once in b are anchors; a longest increasing subsequence of
    them stands, and the gaps before, between and after them are aligned alike. A gap without
    anchors falls to the longest common subsequence.
    """
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a[w] == 1}
        once = [(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if w in at]
        if once:
            anchors = [once[k] for k in rising([j for _, j in once])]
            out += anchors
            for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
                work.append((i + 1, k, j + 1, m))
        else:
            out += [(a0 + i, b0 + j) for i, j in common(a[a0:a1], b[b0:b1])]
    return sorted(out)


class Scanner:
    """The templates, and what a stretch of text must hold to cover one."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float = 0.8) -> None:
        self.templates = [(name, words_of(text.encode())) for name, text in templates]
        self.counts = [Counter(words) for _, words in self.templates]
        own = [set(words_of(name.encode())) for name, _ in templates]
        self.naming = [Counter(w for w in words if w in NAMING and (w not in COMMON or w in said)) for (_, words), said in zip(self.templates, own)]
        self.heavy = [frozenset(n) for n in self.naming]
        self.rivals = [RIVALS - h for h in self.heavy]
        self.need = [math.ceil(least * len(words) - 1e-9) for _, words in self.templates]
        # The first word matched leaves need - 1 words behind it, so it is one of these.
        self.starts = [frozenset(words[: len(words) - need + 1]) for (_, words), need in zip(self.templates, self.need)]
        self.vocabulary = {w for _, words in self.templates for w in words}

    def regions(self, words: list[bytes]) -> list[list[int]]:
        """Places of template words, cut where more than GAP others stand between two."""
        places = [i for i, w in enumerate(words) if w in self.vocabulary]
        cuts = [k for k in range(1, len(places)) if places[k] - places[k - 1] > GAP]
        return [places[a:b] for a, b in zip([0, *cuts], [*cuts, len(places)]) if b > a]

    def scan(self, text: bytes) -> list[tuple[int, float, int, int, int]]:
        """(template, coverage, first word, last word, matched words) of every notice that covers enough of its template.

        A region is read once, from left to right, and stretches little longer than the template before longer ones. The first notice met competes with those
        that begin inside it: the one with most matched words by coverage stands, what it leaves
        before it is looked over again, and reading goes on behind it.
        """
        words = words_of(text)
        found = []
        foes = [i for i, w in enumerate(words) if w in RIVALS]
        for places in self.regions(words):
            have = [words[i] for i in places]
            region = Counter(have)
            enough = [k for k, counts in enumerate(self.counts) if len(have) >= self.need[k] and sum(min(n, region[w]) for w, n in counts.items()) >= self.need[k]]
            runs = sorted((a, k, b) for k in enough for a, b in self._runs(words, places, have, foes, k))
            refused: dict[tuple[int, int], int] = {}
            last_refused: dict[int, tuple[int, int, int]] = {}
            work = [(0, len(have))]
            while work:
                begin, end = work.pop()
                best = None
                for x in range(bisect_left(runs, (begin,)), len(runs)):
                    a, k, b = runs[x]
                    if a >= end or best and a > best[1]:
                        break
                    if best and (len(self.templates[k][1]) <= best[2][0] or k == best[3] and best[7]):
                        continue  # it can win no more
                    stop = min(b, end)
                    if refused.get((a, k), -1) >= stop:
                        continue
                    before, reach, short = last_refused.get(k, (len(have), 0, 0))
                    if before <= a and stop - reach < short:  # what lies in a refused stretch is refused, and each further word matches one at most
                        refused[a, k] = stop
                        continue
                    near = bisect_left(places, places[a] + 5 * len(self.templates[k][1]) // 4 + GAP, a, stop)
                    pairs, short = self._pairs(have, a, near, k)
                    if not pairs and near < stop:
                        pairs, short = self._pairs(have, a, stop, k)
                    if not pairs:
                        refused[a, k] = stop
                        last_refused[k] = a, stop, short
                        continue
                    cover, first, last = len(pairs) / len(self.templates[k][1]), pairs[0][0], pairs[-1][0]
                    rank = (len(pairs) * cover, cover, -k, places[first] - places[last], -first)
                    if best is None or rank > best[2]:
                        best = (first, last if best is None else max(best[1], last), rank, k, cover, last, len(pairs), cover >= SURE and pairs[-1][1] == len(self.templates[k][1]) - 1)
                if best:
                    first, _, _, k, cover, last, n, _ = best
                    found.append((k, cover, places[first], places[last], n))
                    work += [(last + 1, end), (begin, first)]
        return sorted(found, key=lambda f: (f[2], f[0]))

    def _runs(self, words: list[bytes], places: list[int], have: list[bytes], foes: list[int], k: int) -> Iterator[tuple[int, int]]:
        """Stretches of a region to align: from each word that a notice can begin with, as far as one may reach and up to the next rival, if enough of its words are in it."""
        counts, starts, span, need = self.counts[k], self.starts[k], 2 * len(self.templates[k][1]) + GAP, self.need[k]
        own = [i for i in foes if words[i] in self.rivals[k]]
        inside: Counter = Counter()
        met = b = foe = 0
        for a, w in enumerate(have):
            while foe < len(own) and own[foe] < places[a]:
                foe += 1
            limit = own[foe] if foe < len(own) else len(words)
            b = max(a, b)
            while b < len(have) and places[b] - places[a] < span and places[b] < limit:
                inside[have[b]] += 1
                met += inside[have[b]] <= counts[have[b]]
                b += 1
            if b > a:
                if met >= need and w in starts and all(inside[x] >= n for x, n in self.naming[k].items()):
                    yield a, b
                met -= inside[w] <= counts[w]
                inside[w] -= 1

    def _pairs(self, have: list[bytes], a: int, b: int, k: int) -> tuple[list[tuple[int, int]], int]:
        """The matched words of a notice within have[a:b]: by patience alignment, or where that falls short by the common subsequence with most naming words, which tells
        whether there is any. If there is none, how many further words it would take at least."""
        template, need, naming = self.templates[k][1], self.need[k], self.naming[k]
        stretch = have[a:b]
        length = common_length(stretch, template)
        if length < need:
            return [], need - length
        told = lambda pairs: Counter(template[j] for _, j in pairs if template[j] in naming) == naming
        pairs = align(stretch, template)
        if len(pairs) < need or not told(pairs):
            pairs = common_with(stretch, template, self.heavy[k])
            if not told(pairs):
                return [], next((i for i in range(b, len(have)) if have[i] in naming), len(have)) - b + 1
            if len(pairs) < need:
                return [], need - len(pairs)
        return [(a + i, j) for i, j in pairs], 0


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find the license notices in every whole text of docs.

    A notice has `least` of a template's words in their order, all words that name it, and no rival's name between them, within a stretch of
    twice the template's words and GAP more; over GAP words in a row that are in no template end it.

    Returns a row per row of docs: id, n_notices, license (that of the notice with most
    matched words, on a tie the greater coverage, then the first; null if none), coverage (matched words by the
    template's), n_matched, first_word and last_word (places of the notice's ends among the
    text's words) and licenses (the names of all notices, sorted, without repeats). Null texts count as empty; null
    ids stay null; repeated rows are scanned each; other columns are not read; an empty table
    gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_notices bigint, license string, coverage double, n_matched bigint, first_word bigint, last_word bigint, licenses array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for b in sliced(batches):
            columns = defaultdict(list)
            for text in utf8(b.column(1)):
                found = scanner.scan(text or b"")
                top = max(found, key=lambda f: (f[4], f[1], -f[2]), default=None)
                columns["n_notices"].append(len(found))
                columns["license"].append(scanner.templates[top[0]][0] if top else None)
                for name, i in (("coverage", 1), ("n_matched", 4), ("first_word", 2), ("last_word", 3)):
                    columns[name].append(top[i] if top else None)
                columns["licenses"].append(sorted({scanner.templates[f[0]][0] for f in found}))
            types = {"n_notices": pa.int64(), "license": pa.string(), "coverage": pa.float64(), "n_matched": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "licenses": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(columns[k], t) for k, t in types.items())], names=["id", *types])

    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
