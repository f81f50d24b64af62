"""License scans by patience alignment (operator 9).

A template is a license text or notice as words.  A whole text is met window by window: a window holds one and a half template
lengths and starts every half length, so each copy of a template lies whole in at least one window, however often it stands in the
text.  In a window the words that stand once both there and in the template are anchors; their longest increasing subsequence is
kept, and the gaps between kept anchors, less their equal ends, are aligned the same way until a gap has no anchor.  The
share of the template's words that are aligned is the coverage; a window of ``SHARE`` or more is a find.

Only windows that cannot reach ``SHARE`` are passed over without alignment: no more words can be aligned than the window and the template
have in common, counted with repeats.  Nothing leaves a row, so there is no shuffle; the templates are broadcast.

Words are runs of ASCII letters and digits and of bytes above 127, in lower case.  Of overlapping finds of one template the one with more
aligned words stays, then the earlier; a text's ``license`` is that of its find with most aligned words, then the higher coverage,
then the smaller name.

Defined results: a null or empty text, and one without a find, has a null ``license``, coverage 0, ``n_found`` 0 and ``found`` empty.
Repeated rows get equal results; other columns are never read.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.llm import textbytes as tb

#: A find aligns this share of a template's words at least.
SHARE = 0.9
_FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licenses")

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_CLEAN = np.where(_WORD, tb.LOWER, 0x20).astype(np.uint8)

_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

NOTICES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. """ + _NO_WARRANTY,
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": f"{_BSD} {_BSD_END}",
    "BSD-3-Clause": f"""{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. {_BSD_END}""",
}


def templates() -> dict[str, str]:
    """The notices above and the whole texts of the folder ``licenses``."""
    out = dict(NOTICES)
    for name in sorted(os.listdir(_FOLDER)):
        with open(os.path.join(_FOLDER, name), encoding="utf-8") as f:
            out[name.removesuffix(".txt")] = f.read()
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the bounds of the texts among them."""
    data = _CLEAN[data]
    starts, ends, text = tb.words(data, offsets)
    return tb.span_hashes(data, starts, ends), np.searchsorted(text, np.arange(len(offsets)))


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence."""
    tails, places, before = [], [], []
    for at, v in enumerate(values):
        k = bisect.bisect_left(tails, v)
        before.append(places[k - 1] if k else -1)
        tails[k:k + 1], places[k:k + 1] = [v], [at]
    out, at = [], places[-1] if places else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def _once(words: list[int], low: int, high: int) -> dict[int, int]:
    """Words that stand once in the range, with their place."""
    seen: dict[int, int] = {}
    for i in range(low, high):
        seen[words[i]] = -1 if words[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned places of both; the number -1 stands for words that the template does not hold."""
    out, gaps = [], [(0, len(text), 0, len(template))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        left, right = _once(text, a0, a1), _once(template, b0, b1)
        anchors = sorted((i, right[w]) for w, i in left.items() if w in right)
        kept = [anchors[k] for k in _increasing([b for _, b in anchors])]
        if not kept:
            continue
        out += kept
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)]):
            if k > i + 1 and m > j + 1:
                gaps.append((i + 1, k, j + 1, m))
    return sorted(out)


class Scanner:
    """Templates as numbers of their words."""

    def __init__(self, texts: Mapping[str, str], share: float = SHARE) -> None:
        self.names = sorted(texts)
        raw = [texts[n].encode() for n in self.names]
        data = np.frombuffer(b"".join(raw), np.uint8)
        hashes, bounds = word_hashes(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
        self.known, numbers = np.unique(hashes, return_inverse=True)
        self.words = [numbers[bounds[i]:bounds[i + 1]] for i in range(len(self.names))]
        self.counts = [np.bincount(w, minlength=len(self.known)) for w in self.words]
        self.least = [int(np.ceil(share * len(w) - 1e-9)) for w in self.words]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word; -1 for words of no template."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, -1)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
        """For each text its finds: template, aligned words, first and last aligned word of the text."""
        hashes, bounds = word_hashes(data, offsets)
        numbers, sizes = self.numbers(hashes), np.diff(bounds)
        out = [[] for _ in sizes]
        for t, (words, count, least) in enumerate(zip(self.words, self.counts, self.least)):
            if not len(words):
                continue
            hits = np.concatenate([[0], np.cumsum(np.append(count > 0, False)[numbers])])  # number -1 reads the last
            rich = np.flatnonzero(hits[bounds[1:]] - hits[bounds[:-1]] >= least)
            step = -(-len(words) // 2)
            many = -(-sizes[rich] // step)
            owner = np.repeat(rich, many)
            low = bounds[owner] + step * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
            high = np.minimum(low + len(words) + step, bounds[owner + 1])
            template, found = words.tolist(), {}
            for w in np.flatnonzero(hits[high] - hits[low] >= least):
                part = numbers[low[w]:high[w]]
                if np.minimum(np.bincount(part[part >= 0], minlength=len(count)), count).sum() < least:
                    continue
                pairs = align(np.where(count[part] > 0, part, -1).tolist(), template)
                if len(pairs) >= least:
                    first = int(low[w] - bounds[owner[w]])
                    found.setdefault(int(owner[w]), []).append((-len(pairs), first + pairs[0][0], first + pairs[-1][0]))
            for i, finds in found.items():
                kept: list[tuple[int, int, int]] = []
                for n, first, last in sorted(finds):
                    at = bisect.bisect(kept, (first,))  # kept finds do not overlap, so only the neighbours can
                    if (at == 0 or kept[at - 1][1] < first) and (at == len(kept) or last < kept[at][0]):
                        kept.insert(at, (first, last, -n))
                out[i] += [(t, n, first, last) for first, last, n in kept]
        return out

    def rows(self, texts: pa.Array) -> pa.StructArray:
        license_, coverage, number, found = [], [], [], []
        for _, _, data, offsets in tb.text_chunks(texts):
            for finds in self.scan(data, offsets):
                best = min(finds, key=lambda f: (-f[1], len(self.words[f[0]]), self.names[f[0]]), default=None)
                license_.append(self.names[best[0]] if best else None)
                coverage.append(best[1] / len(self.words[best[0]]) if best else 0.0)
                number.append(len(finds))
                found.append(",".join(f"{self.names[t]}:{n}:{a}:{b}" for t, n, a, b in sorted(finds, key=lambda f: (f[2], f[3], f[0]))))
        return pa.StructArray.from_arrays([pa.array(license_, pa.string()), pa.array(coverage, pa.float64()), pa.array(number, pa.int64()),
                                           pa.array(found, pa.string())], ["license", "coverage", "n_found", "found"])


def licenses(docs: DataFrame, text: Column, texts: Mapping[str, str] | None = None, share: float = SHARE) -> Column:
    """Struct (license, coverage, n_found, found) for each whole text; found is name:aligned words:first word:last word."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates() if texts is None else texts, share))

    def run(values: pa.Array) -> pa.Array:
        return shared.value.rows(values)

    return F.arrow_udf(run, "struct<license:string,coverage:double,n_found:bigint,found:string>")(text)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: Mapping[str, str] | None = None, share: float = SHARE) -> DataFrame:
    """Per row of ``docs``: id, license, coverage, n_found, found."""
    return docs.select(F.col(id_col), licenses(docs, F.col(text_col), texts, share).alias("f")).select(id_col, "f.*")
