"""License scans: text against licence templates by Dice coefficient over word bigrams.

Text and templates are normalised alike (ASCII letters in lower case and digits
stay, everything else separates words, bytes of other characters belong to
words) and become sets of adjacent word pairs. The whole text, each paragraph
(between blank lines) and each line is compared, and so are runs of adjacent
sentences over lines and paragraphs, so that a notice inside a line and a licence
of several paragraphs inside other text are found. Dice 2 |A and B| / (|A| + |B|)
can't reach a threshold t unless |A| lies between |B| t / (2 - t) and
|B| (2 - t) / t, so a unit is only compared with templates of such sizes, and
only with those that share a pair with it. A run is sought only for templates of
which the text holds |B| t / (2 - t) pairs, from each sentence that holds one of
them to where |A| leaves the bounds: no run at or over the threshold is left out.

Defined results: null and empty texts and units of fewer than two words match
nothing; of templates with equal likeness the first in the list names a unit;
repeated lines are reported each; of runs that overlap the likest of a template
and then the one that shares most pairs is reported, and none of whose pairs the
reported units hold more than half.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastebud.llm.common import small_batches

THRESHOLD = 0.8
# Public licence notices and short licence texts (fixed values): (licence, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
     associated documentation files (the "Software"), to deal in the Software without restriction, including without
     limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
     Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
     The above copyright notice and this permission notice shall be included in all copies or substantial portions of
     the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
     NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
     EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
     ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
     OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
     compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
     Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
     on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
     the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License v3.0."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
     Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
     any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
     without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
     Public License for more details."""),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
     the following conditions are met:"""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
     granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
     MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("proprietary", "All rights reserved."),
)

MATCHES = T.ArrayType(T.StructType([
    T.StructField("unit", T.StringType()),  # text, paragraph, line or run
    T.StructField("start", T.LongType()),   # code points; end exclusive
    T.StructField("end", T.LongType()),
    T.StructField("license", T.StringType()),
    T.StructField("dice", T.DoubleType()),
]))
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
             for b in range(256))
_BLANK = re.compile(r"\n[ \t\r]*\n\s*")
_PIECE = re.compile(r"\n|(?<=[.!?])[ \t]+")
# Whole licences, kept as files; the AGPL's is missing.
BODIES = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0")


def all_templates() -> tuple[tuple[str, str], ...]:
    folder = resources.files("tastebud.llm") / "license_texts"
    return TEMPLATES + tuple((name, (folder / f"{name}.txt").read_text("utf-8")) for name in BODIES)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:], strict=False))


class Templates:
    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.sets = [(name, bigrams(words_of(text))) for name, text in templates]
        self.by_pair: dict[tuple[bytes, bytes], list[int]] = {}
        for k, (_, pairs) in enumerate(self.sets):
            for p in pairs:
                self.by_pair.setdefault(p, []).append(k)
        self.sizes = sorted(len(p) for _, p in self.sets if p)
        self.ratio = (2 - threshold) / threshold

    def best(self, words: list[bytes]) -> tuple[str, float] | None:
        """The likest template within the size bounds, if it reaches the threshold."""
        if not self.sizes or len(words) < 2 or (len(words) - 1) * self.ratio < self.sizes[0]:
            return None
        pairs = bigrams(words)
        size = len(pairs)
        lo = bisect.bisect_left(self.sizes, size / self.ratio - 1e-9)
        if lo == len(self.sizes) or self.sizes[lo] > size * self.ratio + 1e-9 or self.by_pair.keys().isdisjoint(pairs):
            return None
        shared = Counter(k for p in pairs & self.by_pair.keys() for k in self.by_pair[p])
        found = None
        for k in sorted(shared):
            dice = 2.0 * shared[k] / (size + len(self.sets[k][1]))
            if dice >= self.threshold and (found is None or dice > found[1]):
                found = self.sets[k][0], dice
        return found


def units(text: str) -> Iterator[tuple[str, int, int]]:
    """The whole text, its paragraphs and its lines, each place once, by (unit, start, end)."""
    yield "text", 0, len(text)
    seen, at = {(0, len(text))}, 0
    for m in [*_BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        if (at, end) not in seen and end > at:
            seen.add((at, end))
            yield "paragraph", at, end
        at = m.end() if m else end
    at = 0
    for line in text.split("\n"):
        if line and (at, at + len(line)) not in seen:
            yield "line", at, at + len(line)
        at += len(line) + 1


def pieces(text: str) -> Iterator[tuple[int, int]]:
    """The sentences of each line, by (start, end)."""
    at = 0
    for m in _PIECE.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def firsts_from(before: np.ndarray, at: int, most: int) -> tuple[np.ndarray, bool]:
    """Places from ``at`` on of pairs new since ``at``, more than ``most`` or all of them, and whether these are all."""
    length = 2 * most
    while True:
        places = np.flatnonzero(before[at:at + length] < at) + at
        if len(places) > most or at + length >= len(before):
            return places, at + length >= len(before)
        length *= 4


def runs(text: str, words: list[bytes], templates: Templates, found: list[dict]) -> list[dict]:
    """Runs of adjacent sentences that reach the threshold, beside the units ``found``."""
    pairs = list(zip(words, words[1:], strict=False))
    shared = Counter(k for p in templates.by_pair.keys() & pairs for k in templates.by_pair[p])
    able = [k for k, n in shared.items() if n >= len(templates.sets[k][1]) / templates.ratio - 1e-9]
    if not able:
        return []
    places, piece = [], []  # of sentences with words; the sentence of each word
    for start, end in pieces(text):
        if n := len(words_of(text[start:end])):
            piece += [len(places)] * n
            places.append((start, end))
    piece = np.array(piece)
    steps, (starts, ends) = np.zeros(len(places) + 1, np.int64), zip(*places, strict=True)
    for m in found:  # sentences that a reported unit holds
        steps[bisect.bisect_right(ends, m["start"])] += 1
        steps[bisect.bisect_left(starts, m["end"])] -= 1
    held = (np.cumsum(steps) > 0)[piece]
    inside = held[:-1] & held[1:]
    begins = np.searchsorted(piece, np.arange(len(places)))
    last, before = {}, np.empty(len(pairs), np.int64)  # the same pair's place before
    for i, p in enumerate(pairs):
        before[i] = last.get(p, -1)
        last[p] = i

    chosen = []
    for k in able:
        name, wanted = templates.sets[k]
        most = int(len(wanted) * templates.ratio + 1e-9)
        hit = np.fromiter((p in wanted for p in pairs), bool, len(pairs))
        likely = []
        for first in np.unique(piece[:-1][hit]).tolist():
            new, whole = firsts_from(before, int(begins[first]), most)
            ends = piece[new + 1]
            # Sentences are taken whole: the last new pair of each, as far as |A| stays within its bounds.
            stops = np.flatnonzero(np.append(ends[1:] != ends[:-1], whole))
            stops = stops[stops < most]
            if len(stops):
                common = np.cumsum(hit[new])[stops]
                dice = 2.0 * common / (stops + 1 + len(wanted))
                best = int(dice.argmax())
                if dice[best] >= templates.threshold:
                    new = new[:stops[best] + 1]
                    if 2 * np.count_nonzero(hit[new] & inside[new]) <= common[best]:
                        likely.append((-float(dice[best]), first, int(ends[stops[best]]), -int(common[best]), k, name))
        chosen += apart(sorted(likely))
    return [{"unit": "run", "start": places[first][0], "end": places[end][1], "license": name, "dice": -dice}
            for dice, first, end, _, _, name in sorted(apart(sorted(chosen, key=lambda r: (r[3], r[0], r[4], r[1]))), key=lambda r: r[1])]


def apart(ordered: list[tuple]) -> list[tuple]:
    """Those of the runs that overlap none taken before them."""
    out, starts = [], []
    for r in ordered:
        i = bisect.bisect_right(starts, r[1])
        if (i == 0 or out[i - 1][2] < r[1]) and (i == len(out) or r[2] < out[i][1]):
            starts.insert(i, r[1])
            out.insert(i, r)
    return out


def scan(text: str | None, templates: Templates) -> list[dict]:
    out = []
    if not text:
        return out
    words = words_of(text)
    for unit, start, end in units(text):
        if found := templates.best(words if unit == "text" else words_of(text[start:end])):
            out.append({"unit": unit, "start": start, "end": end, "license": found[0], "dice": found[1]})
    return out + runs(text, words, templates, out)


def with_licenses(docs: DataFrame, text_col: str = "text", out: str = "matches", templates=None,
                  threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with an array ``out`` of the units and runs that match a template, row by row without a shuffle.

    Without ``templates`` these are the notices and the whole licences.
    """
    small_batches(docs.sparkSession)
    templates = all_templates() if templates is None else templates

    @F.pandas_udf(MATCHES)
    def matches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Templates(templates, threshold)
        for texts in batches:
            yield texts.map(lambda t: scan(t, known), na_action=None)

    return docs.withColumn(out, matches(F.col(text_col)))
