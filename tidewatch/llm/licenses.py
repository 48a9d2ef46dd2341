"""Licence scans: Dice coefficient over word bigrams against templates.

A match is a run of words, inside a line or over many, whose word pairs agree with a template's. Only runs
that begin and end with a pair of the template can be best, a template's size bounds their length, and a
place with too few of its pairs within that length is passed over.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_DICE = 0.8
_WORD = re.compile(r"[a-z0-9][a-z0-9.+-]*")

_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Public licence notices, as their authors ask for them to be quoted.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-use": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause-notice": "Released under the BSD 2-Clause License.",
    "BSD-use": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0-notice": "This work is released into the public domain under CC0 1.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD
    + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    + _BSD_TAIL,
    "All-rights-reserved": "All rights reserved.",
}
#: Whole licence texts, one file each.
FULL_TEXTS = Path(__file__).parent / "licence_texts"
#: Cells of the table of runs that are scored at a time.
CELLS = 500_000


@cache
def default_templates() -> dict[str, str]:
    """The notices above and the whole texts. Read on the driver; tasks are given the result."""
    return TEMPLATES | {p.stem: p.read_text(encoding="utf-8") for p in sorted(FULL_TEXTS.glob("*.txt"))}


def words_of(text: str) -> list[str]:
    """Lower-case words without surrounding punctuation."""
    return [w.rstrip(".+-") for w in _WORD.findall(text.lower())]


def bigrams(words: list[str]) -> Counter[tuple[str, str]]:
    """Word pairs with repeats."""
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum(min(n, b[k]) for k, n in a.items() if k in b) / total if total else 0.0


@dataclass(frozen=True, order=True)
class Match:
    first_word: int
    last_word: int
    licence: str
    first_line: int
    last_line: int
    score: float


class Scanner:
    """Finds runs of words that match a template with a Dice coefficient of ``least`` or more."""

    def __init__(self, templates: dict[str, str] | None = None, least: float = MIN_DICE) -> None:
        self.least = least
        self.names = sorted(templates or default_templates())
        pairs = [bigrams(words_of((templates or default_templates())[name])) for name in self.names]
        self.sizes = [sum(p.values()) for p in pairs]
        #: Dice >= least allows at most this ratio between the numbers of pairs
        self.ratio = (2 - least) / least
        self.ids = {w: i for i, w in enumerate(sorted({w for p in pairs for k in p for w in k}))}
        rows = sorted((self._code(*map(self.ids.__getitem__, k)), t, n) for t, p in enumerate(pairs) for k, n in p.items())
        code, self.template, self.count = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
        self.codes, self.first, self.held = np.unique(code, return_index=True, return_counts=True)

    def _code(self, a: int, b: int) -> int:
        return a * len(self.ids) + b

    def hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place, index of its code) of the word pairs that some template has."""
        get = self.ids.get
        own = np.array([get(w, -1) for w in words], dtype=np.int64)
        at = np.flatnonzero((own[:-1] >= 0) & (own[1:] >= 0))
        code = self._code(own[at], own[at + 1])
        near = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        known = self.codes[near] == code
        return at[known], near[known]

    def runs(self, t: int, place: np.ndarray, code: np.ndarray, allowed: np.ndarray) -> list[tuple[float, int, int]]:
        """(score, first place, last place): for each start the best run of a template's pairs, if it scores enough."""
        n, k = self.sizes[t], len(place)
        longest = int(n * self.ratio + 1e-9)
        end = np.searchsorted(place, place + longest)
        starts = np.flatnonzero(end - np.arange(k) >= n / self.ratio - 1e-9)
        if not len(starts):
            return []
        # a pair adds to the score unless the run already has as many of it as the template
        order = np.lexsort((np.arange(k), code))
        nth = np.arange(k) - np.searchsorted(code[order], code[order])
        before = np.full(k, -1)
        full = nth >= allowed[order]
        before[order[full]] = order[np.flatnonzero(full) - allowed[order][full]]
        width = int((end - np.arange(k))[starts].max())
        found = []
        for at in range(0, len(starts), max(1, CELLS // width)):
            a = starts[at : at + max(1, CELLS // width), None]
            j = np.minimum(a + np.arange(width), k - 1)
            inside = a + np.arange(width) < end[a]
            shared = np.cumsum((before[j] < a) & inside, axis=1)
            score = np.where(inside, 2 * shared / (n + place[j] - place[a] + 1), 0.0)
            best = score.argmax(axis=1)
            top = score[np.arange(len(a)), best]
            good = np.flatnonzero(top >= self.least - 1e-12)
            found += zip(top[good].tolist(), place[a[good, 0]].tolist(), place[j[good, best[good]]].tolist(), strict=True)
        return found

    def matches(self, text: str) -> list[Match]:
        """Of overlapping runs the one with the highest score stays (ties: the earliest, then the longest, then by name)."""
        words = words_of(text)
        place, code = self.hits(words) if len(words) > 1 else ([], [])
        if not len(place):
            return []
        times = self.held[code]
        row = np.repeat(self.first[code] - np.cumsum(times) + times, times) + np.arange(times.sum())
        place, code, template, allowed = np.repeat(place, times), np.repeat(code, times), self.template[row], self.count[row]
        found = []
        for t in np.unique(template).tolist():
            own = template == t
            if own.sum() >= self.sizes[t] / self.ratio - 1e-9:
                found += [(-score, a, -b, self.names[t]) for score, a, b in self.runs(t, place[own], code[own], allowed[own])]
        kept: list[tuple[int, int, str, float]] = []
        for score, a, b, name in ((x, a, -b, name) for x, a, b, name in sorted(found)):
            i = bisect_left(kept, (a,))
            if (i == 0 or kept[i - 1][1] + 1 < a) and (i == len(kept) or b + 1 < kept[i][0]):
                insort(kept, (a, b, name, -score))
        if not kept:
            return []
        ends = np.cumsum([len(_WORD.findall(x)) for x in text.lower().split("\n")])
        line = lambda w: int(np.searchsorted(ends, w, side="right"))
        return [Match(a, b + 1, name, line(a), line(b + 1), score) for a, b, name, score in kept]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = MIN_DICE) -> DataFrame:
    """doc_id, licence, first_line, last_line, dice: a row for each match in a document.

    Of runs that overlap the one with the highest score counts (ties: the earliest, then the longest,
    then by name). Null and empty texts and texts without a match give no rows; a very long text, of few
    or of many lines, costs in proportion to its length; repeated rows give their matches each; a null
    doc_id stays null; an empty table gives no rows; other columns are not read.
    """
    common.short_batches(docs.sparkSession)
    known = dict(templates or default_templates())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.drop_worker_cache()
        scanner = Scanner(known, least)
        for b in batches:
            rows = [(doc, m.licence, m.first_line, m.last_line, m.score) for doc, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if x for m in scanner.matches(x)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "licence", "first_line", "last_line", "dice"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, licence string, first_line int, last_line int, dice double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.read_table(spark, sf_dir, "documents"))
