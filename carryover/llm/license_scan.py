"""Licence notices and texts found by Dice coefficient over word bigrams.

Texts and templates are normalised to lower-case words of letters and digits. The units
of a text are its lines, the whole text, and, where a unit is longer than a template
may match, every window of the template's length. A unit of s bigrams can reach the
``threshold`` t only with templates of t / (2 - t) * s to (2 - t) / t * s bigrams, which prunes the
templates, and only if that same share of its bigrams belongs to some template, which
prunes nearly all units before any set is built. Neighbouring windows differ by the bigram that
enters and the one that leaves, so the sizes of their sets and of what these share with a
template are running sums: the work is linear in the text. Of matches that share words only
the closest stays: a notice of one licence resembles those of its relatives.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover.llm import grams

# Wording of public licences and of the notices that refer to them.
TEMPLATES: dict[str, list[str]] = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE."""],
    "ISC": ["Released under the ISC License.", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD
        TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
        OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""],
    "BSD": ["Released under the BSD License.", "Licensed under the 3-Clause BSD License.", "Licensed under the 2-Clause BSD License.", """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in
        binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution."""],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a
        copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
        under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License."""],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.",
            "Released under the GNU General Public License.", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be
        useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details."""],
    "LGPL": ["This work is licensed under the GNU Lesser General Public License, version 3.", """
        This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the
        Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it
        will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser
        General Public License for more details.""", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the
        Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will
        be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser
        General Public License for more details."""],
    "AGPL": ["This work is licensed under the GNU Affero General Public License, version 3.", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the
        Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will
        be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero
        General Public License for more details."""],
    "MPL-2.0": ["Licensed under the Mozilla Public License, Version 2.0.", """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
        obtain one at https://mozilla.org/MPL/2.0/."""],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-SA": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
_WORDS = grams.alphanumeric()


def bigram_sets(texts: list[str]) -> list[np.ndarray]:
    """Distinct word bigrams of each text (one word alone stands for itself)."""
    found, text = grams.ngrams(*grams.words(*grams.binary_parts(pa.array(texts, pa.string())), _WORDS), 2, whole_when_short=True)
    return [np.unique(found[text == i]) for i in range(len(texts))]


def _neighbours(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the previous, of the next) equal code; -1 and a place behind everything where there is none."""
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    before, after = np.full(len(code), -1), np.full(len(code), 1 << 62)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


# Windows of a run of which all templates are bounded at once.
SHORT = 2000


class Scanner:
    def __init__(self, templates: Mapping[str, list[str]], threshold: float):
        names = [(name, text) for name, texts in templates.items() for text in texts]
        sets = bigram_sets([t for _, t in names])
        order = sorted((i for i in range(len(names)) if len(sets[i])), key=lambda i: len(sets[i]))
        self.names, sets = [names[i][0] for i in order], [sets[i] for i in order]
        self.sizes = np.array([len(s) for s in sets])
        self.union = np.unique(np.concatenate(sets))
        # [template, bigram of the union]; the last column stands for bigrams of no template
        self.holds = np.zeros((len(sets), len(self.union) + 1), bool)
        for i, s in enumerate(sets):
            self.holds[i, np.searchsorted(self.union, s)] = True
        self.threshold, self.part = threshold, threshold / (2 - threshold)

    def _whole(self, spot: np.ndarray, code: np.ndarray, edges: np.ndarray, units: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(dice, first bigram, bigrams, template) of units that match as they stand."""
        size = edges[units + 1] - edges[units]
        at = np.repeat(edges[units] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        owner = np.repeat(np.arange(len(units)), size)
        _, first = np.unique(owner * (int(code.max(initial=0)) + 1) + code[at], return_index=True)  # each bigram of a unit once
        owner, spot = owner[first], spot[at[first]]
        distinct = np.bincount(owner, minlength=len(units))
        for t in range(len(self.sizes)):
            dice = 2 * np.bincount(owner[self.holds[t, spot]], minlength=len(units)) / (distinct + self.sizes[t])
            hit = np.flatnonzero(dice >= self.threshold)
            yield dice[hit], edges[units[hit]], size[hit], np.full(len(hit), t)

    def _windows(self, spot: np.ndarray, code: np.ndarray, edges: np.ndarray, hits: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """The same of windows of long units that can match a template at all."""
        size, hit = np.diff(edges), hits[edges[1:]] - hits[edges[:-1]]
        for m in np.unique(self.sizes).tolist():
            units = np.flatnonzero((size > m) & (hit >= self.part * m - 1e-9))
            if not len(units):
                continue
            many = size[units] - m + 1
            begin = np.repeat(edges[units] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            owner = np.repeat(units, many)
            likely = hits[begin + m] - hits[begin] >= self.part * m - 1e-9
            begin, owner = begin[likely], owner[likely]
            # windows of a unit that lie near each other are measured together, with those between them
            cuts = np.flatnonzero((np.diff(begin) > 4 * m + 200) | (np.diff(owner) > 0)) + 1
            for run in np.split(begin, cuts):
                if len(run):
                    yield from self._run(spot, code, int(run[0]), int(run[-1] - run[0]) + 1, m)

    def _run(self, spot: np.ndarray, code: np.ndarray, start: int, windows: int, m: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Windows of ``m`` bigrams that begin at ``start`` and at the places after it."""
        part, spot = code[start:start + windows + m - 1], spot[start:start + windows + m - 1]
        before, after = _neighbours(part)
        place = np.arange(windows)
        # a window counts a bigram at its first place in it: what leaves was the last of its kind, what enters is the first
        leaves, enters = after[:windows - 1] >= place[:-1] + m, before[m:] < place[1:]
        first = before[:m] < 0

        def counted(flags: np.ndarray) -> np.ndarray:
            step = (enters & flags[m:]).astype(np.int64) - (leaves & flags[:windows - 1])
            return int((first & flags[:m]).sum()) + np.concatenate(([0], np.cumsum(step)))

        distinct = counted(np.ones(len(part), bool))
        low, high = np.searchsorted(self.sizes, [self.part * distinct.min() - 1e-9, distinct.max() / self.part + 1e-9])
        templates = np.arange(low, high)
        if windows < SHORT:  # no window holds more of a template than the run does, which rules most of them out
            held = self.holds[low:high][:, spot].sum(axis=1)
            templates = templates[2 * held >= self.threshold * (distinct.min() + self.sizes[low:high]) - 1e-9]
        for t in templates.tolist():
            dice = 2 * counted(self.holds[t, spot]) / (distinct + self.sizes[t])
            hit = np.flatnonzero(dice >= self.threshold)
            if len(hit):
                yield dice[hit], start + hit, np.full(len(hit), m), np.full(len(hit), t)

    @staticmethod
    def closest(matches: list[tuple[float, int, int, str]]) -> dict[str, float]:
        """Best coefficient per licence of the matches (dice, begin, end, name) that overlap no closer one."""
        out: dict[str, float] = {}
        taken: list[tuple[int, int]] = []  # disjoint, in order
        for dice, begin, end, name in sorted(matches, key=lambda m: (-round(m[0], 9), m[1] - m[2], m[1], m[3])):
            at = bisect_right(taken, (begin, end))
            if (at == 0 or taken[at - 1][1] <= begin) and (at == len(taken) or end <= taken[at][0]):
                insort(taken, (begin, end))
                out[name] = max(dice, out.get(name, 0))
        return out

    def scan(self, column: pa.Array) -> list[dict[str, float]]:
        data, offsets = grams.binary_parts(column)
        matches: dict[int, list[tuple[float, int, int, str]]] = {}
        lines = np.union1d(offsets, np.flatnonzero(data == 10) + 1)
        owner = np.searchsorted(offsets, lines[:-1], "right") - 1
        words, line_words = grams.words(data, lines, _WORDS)
        texts = len(offsets) - 1
        for first_word, owners in ((line_words, owner), (line_words[np.searchsorted(lines, offsets)], np.arange(texts))):
            found, unit = grams.ngrams(words, first_word, 2, whole_when_short=True)
            edges = np.searchsorted(unit, np.arange(len(first_word)))
            spot = np.minimum(np.searchsorted(self.union, found), len(self.union) - 1)
            known = self.union[spot] == found
            spot = np.where(known, spot, len(self.union))
            hits = np.concatenate(([0], np.cumsum(known)))
            size, hit = np.diff(edges), hits[edges[1:]] - hits[edges[:-1]]
            units = np.flatnonzero((hit >= self.part * size - 1e-9) & (size > 0))
            if not len(units) and not (hit >= self.part * self.sizes[0] - 1e-9).any():
                continue
            code = np.unique(found, return_inverse=True)[1]
            for dice, begin, long, template in (*self._whole(spot, code, edges, units), *self._windows(spot, code, edges, hits)):
                of = np.searchsorted(edges, begin, "right") - 1
                for d, b, n, t, u in zip(dice.tolist(), begin.tolist(), long.tolist(), template.tolist(), of.tolist()):
                    word = int(first_word[u]) + b - int(edges[u])
                    matches.setdefault(int(owners[u]), []).append((d, word, word + n + 1, self.names[t]))
        return [self.closest(matches.get(i, [])) for i in range(texts)]


def _scan(templates: Mapping[str, list[str]], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 500):
                found += scanner.scan(batch.column(1).slice(at, 500))
            first = [max(f, key=lambda n: (f[n], n)) if f else None for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([",".join(sorted(f)) for f in found]), pa.array([len(f) for f in found], pa.int64()),
                 pa.array(first, pa.string()), pa.array([f[b] if b else 0.0 for f, b in zip(found, first)], pa.float64())],
                names=["doc_id", "licenses", "n_licenses", "best_license", "best_dice"])

    return run


def license_texts(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """More templates: one text file per licence below ``path``, a folder the driver can read, named as the licence is."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.(?:txt|md))?$", 1).alias("name"), "value")
    out: dict[str, list[str]] = {}
    for r in sorted(files.collect()):  # as many rows as there are licences
        out.setdefault(r.name, []).append(r.value)
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: Mapping[str, list[str]] = TEMPLATES,
                 threshold: float = 0.8) -> DataFrame:
    """(doc_id, licenses, n_licenses, best_license, best_dice) for every row of ``docs``.

    ``templates`` are wordings by name; the given ones hold notices and short texts, and :func:`license_texts`
    reads longer ones. ``licenses`` are the comma-joined names, sorted, of all licences found; the best is the one with
    the largest coefficient, of equal ones the last by name.

    * Null and empty texts and texts without words hold no licence (best null, coefficient 0).
    * Texts are scanned whole, in time that grows with their length. Every row gives a row; null and repeated ids are passed on.
    * An empty table gives an empty result. Other columns are not looked at.
    """
    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(_scan(dict(templates), threshold), "doc_id bigint, licenses string, n_licenses bigint, best_license string, best_dice double"))
