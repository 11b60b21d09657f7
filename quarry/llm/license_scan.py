"""License scans: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans.

Every template's word k-grams are winnowed into an inverted index; a document's k-grams that the index has give
(template, diagonal) votes. Votes that lie close on diagonals are one candidate if they are VOTES of the template's
fingerprints or more (for short templates: one). A banded local alignment of words then decides it: coverage is the share
of the template's words that are matched, the span its words in the document. A candidate needs coverage of COVERAGE. The
band grows with the template, BAND words and one for each DRIFT words of it. It is wider than short templates, so what is
found is masked and the band aligned again until coverage fails: notices that stand close are all found. Of overlapping
spans the one that matches more words is reported.
The templates are notices, headers and whole license texts (names that end in -text; those in the folder ``licenses`` are
read on the driver). They are a fixed list of some 200 KB, so the index that executors get is small by construction.
Nulls: a null text has no words and gives no rows, as do empty texts and empty tables. Extra columns are ignored.
Repeated rows give repeated results; ties between templates go to the first in name order. Texts of any length are
scanned whole.
"""

from __future__ import annotations

import bisect
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.textcore import Words, gram_hash, text_chunks, tidied, winnow

GRAM, RUN = 3, 2
BAND, DRIFT = 8, 200
COVERAGE, VOTES = 0.8, 0.1

#: Standard notices (fixed values, public texts).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-notice": "Released under the BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT-notice": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-text": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def templates() -> dict[str, str]:
    """TEMPLATES and the whole texts of the folder ``licenses``."""
    whole = {p.name.removesuffix(".txt") + "-text": p.read_text("utf-8") for p in files("quarry.llm").joinpath("licenses").iterdir() if p.name.endswith(".txt")}
    return TEMPLATES | whole


def align(template: list[bytes], text: list[bytes | None], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched, start, end) of the best local alignment of template[i] near text[i + diagonal].

    A match scores 2, a mismatch or gap -1; of equal scores the one that ends first is taken. No alignment crosses a
    word that is None."""
    width = 2 * band + 1
    last = [(0, 0, 0)] * width  # score, matched, start
    best = (0, 0, 0, 0)
    for i, word in enumerate(template):
        now = [(0, 0, 0)] * width
        for k in range(width):
            j = i + diagonal + k - band
            if not 0 <= j < len(text) or text[j] is None:
                continue
            score, matched, start = last[k]
            if not score:
                matched, start = 0, j
            hit = text[j] == word
            cell = (score + 2, matched + 1, start) if hit else (score - 1, matched, start)
            if k + 1 < width and last[k + 1][0] - 1 > cell[0]:
                cell = (last[k + 1][0] - 1, *last[k + 1][1:])
            if k and now[k - 1][0] - 1 > cell[0]:
                cell = (now[k - 1][0] - 1, *now[k - 1][1:])
            if cell[0] > 0:
                now[k] = cell
                if cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], j + 1)
        last = now
    return best[1], best[2], best[3]


class Index:
    def __init__(self, templates: dict[str, str], gram: int = GRAM, run: int = RUN):
        self.gram, self.names = gram, sorted(templates)
        data = [templates[n].encode() for n in self.names]
        w = Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        self.words = [w.doc_words(k) for k in range(len(data))]
        g, ok = gram_hash(w.hash, w.doc, gram)
        at = winnow(g, ok, run)
        at = at[np.argsort(g[at], kind="stable")]
        self.keys, self.template, self.place = g[at], w.doc[at], at - w.first[w.doc[at]]
        self.least = np.maximum(1, VOTES * np.bincount(w.doc[at], minlength=len(data)))
        self.band = [BAND + len(x) // DRIFT for x in self.words]

    def candidates(self, words: Words):
        """document -> template -> {diagonal: votes}."""
        g, ok = gram_hash(words.hash, words.doc, self.gram)
        lo, hi = np.searchsorted(self.keys, g, "left"), np.searchsorted(self.keys, g, "right")
        at = np.flatnonzero(ok & (hi > lo))
        n = (hi - lo)[at]
        k = np.repeat(lo[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        p = np.repeat(at, n)
        d = words.doc[p]
        votes = np.stack([d, self.template[k], p - words.first[d] - self.place[k]])
        out: dict[int, dict[int, dict[int, int]]] = {}
        if votes.shape[1]:
            each, count = np.unique(votes, axis=1, return_counts=True)
            for (doc, t, x), c in zip(each.T.tolist(), count.tolist()):
                out.setdefault(doc, {}).setdefault(t, {})[x] = c
        return out

    def scan(self, words: Words):
        """(document, template name, coverage, matched, start, end) of each reported span."""
        for d, votes in self.candidates(words).items():
            text, found = words.doc_words(d), []
            for t, counts in votes.items():
                diagonals, band, last = sorted(counts), self.band[t], None
                upto = np.concatenate([[0], np.cumsum([counts[x] for x in diagonals])])
                for x in diagonals:
                    if last is not None and x - last <= band // 2:
                        continue
                    if upto[bisect.bisect_right(diagonals, x + band)] - upto[bisect.bisect_left(diagonals, x - band)] < self.least[t]:
                        continue
                    last = x
                    masked: list[tuple[int, list[bytes]]] = []
                    while True:
                        matched, a, b = align(self.words[t], text, x, band)
                        if matched < COVERAGE * len(self.words[t]):
                            break
                        found.append((-matched, self.names[t], a, b, matched / len(self.words[t])))
                        masked.append((a, text[a:b]))
                        text[a:b] = [None] * (b - a)
                    for a, own in masked:
                        text[a : a + len(own)] = own
            taken: list[tuple[int, int]] = []  # in order, none overlap
            for m, name, a, b, cover in sorted(set(found)):
                k = bisect.bisect_left(taken, (a, b))
                if (not k or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
                    taken.insert(k, (a, b))
                    yield d, name, cover, -m, a, b


ROWS = "doc_id long, license string, coverage double, matched_words long, start_word long, end_word long"


def _scanner(shared):
    def scan(batches):
        index = shared.value
        for rows, buf, off in text_chunks(batches):
            got = sorted(index.scan(Words(buf, off)), key=lambda r: (r[0], r[4]))
            ids = rows.column("doc_id").to_pylist()
            cols = list(zip(*got)) if got else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([ids[d] for d in cols[0]], *cols[1:]), kinds)], ["doc_id", "license", "coverage", "matched_words", "start_word", "end_word"])

    return scan


def license_scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """One row for each license notice found: doc_id, license, coverage, matched_words, start_word, end_word."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(texts or templates()))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(_scanner(shared)), ROWS)
