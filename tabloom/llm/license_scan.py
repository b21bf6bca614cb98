"""Licence scan: a text against licence templates by the Dice coefficient of word bigrams.

With ``windows``, every run of words of the text counts, over line ends too. The
best run for a template starts and ends with a bigram of it that the run has
once, so only those are looked at, in texts with enough of the template's
bigrams, and each only as far as the template's size allows. A text of n words
takes at most n steps per template bigram.

Else units count. Units are the lines, the paragraphs (between blank lines) and the whole text.
A unit matches a template if 2 |A and B| / (|A| + |B|) over the sets of word
bigrams reaches ``MIN_DICE``. That needs |A| between d / (2 - d) and (2 - d) / d
of |B|, so most templates fall out by the size of a unit alone, and units with
too few template bigrams are never looked at. Words are runs of ASCII letters,
digits and non-ASCII characters, A-Z lower-cased; punctuation and spacing play
no part.

Null and empty texts, and units with fewer than two words, match nothing. Equal
values of two templates are settled by name. Repeated rows are judged alike. A
text is scanned whole. Without ``windows``, a licence inside a line or paragraph
of other words is found only as far as the unit as a whole is like the template.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabloom.llm.base import coded, flat, per_row, with_arrow

MIN_DICE = 0.8

# Licence texts and notices, by SPDX-like name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this "
        "program. If not, see https://www.gnu.org/licenses/."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

SEPARATORS = r"[\x00-/:-`{-\x7f]+"


def normal_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    words, rows = flat(pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATORS))
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), rows[full.to_numpy(zero_copy_only=False)]


def neighbours(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the value's occurrences before (or -1) and after (or the end) each one."""
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    before, after = np.full(len(values), -1), np.full(len(values), len(values))
    before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
    return before, after


def best_run(before: np.ndarray, after: np.ndarray, hits: np.ndarray, size: int, least: float) -> float:
    """The largest dice of a run of bigrams against a template of ``size`` bigrams, at positions ``hits``; 0 if below ``least``."""
    mine = np.zeros(len(before), bool)
    mine[hits] = True
    need, most = int(np.ceil(size * least / (2 - least) - 1e-9)), size * (2 - least) / least + 1e-9
    # A run from a hit has ``need`` hits at least, and all bigrams up to there that the text has for the first time.
    fresh = np.concatenate([[0], np.cumsum(before < 0)])
    start, end = hits[: len(hits) - need + 1], hits[need - 1 :]
    best = 0.0
    for left in start[fresh[end + 1] - fresh[start] <= most].tolist():
        step = int(2 * most) + 1
        while True:
            stop = min(left + step, int(after[left]))
            new = before[left:stop] < left
            total = np.cumsum(new)
            if stop == after[left] or total[-1] > most:
                break
            step *= 2
        shared = np.cumsum(new & mine[left:stop])
        best = max(best, float((2.0 * shared / (total + size)).max()))
        if best == 1.0:
            break
    return best if best >= least else 0.0


class Templates:
    """The templates' bigrams, by name in order, ready for many units."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.names = sorted(texts)
        words, rows = normal_words(pa.array([texts[n] for n in self.names], pa.string()))
        codes, names = coded(words)
        self.words = {w: i for i, w in enumerate(names.to_pylist())}
        self.base = len(self.words) + 1
        inside = rows[1:] == rows[:-1]
        pairs = (codes[:-1].astype(np.int64) * self.base + codes[1:])[inside]
        kinds = np.unique(np.stack([pairs, rows[1:][inside]]), axis=1)
        self.sizes = np.bincount(kinds[1], minlength=len(self.names))
        # For each bigram of any template, a row of flags of the templates that have it.
        self.bigrams, at = np.unique(kinds[0], return_inverse=True)
        self.has = np.zeros((len(self.bigrams), len(self.names)), bool)
        self.has[at, kinds[1]] = True

    def _hits(self, codes: np.ndarray, names: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of template bigrams (of their first words), and which bigrams they are."""
        known = np.array([self.words.get(w, -1) for w in names.to_pylist()], np.int64)[codes]
        at = np.flatnonzero((rows[1:] == rows[:-1]) & (known[1:] >= 0) & (known[:-1] >= 0))
        pairs = known[at] * self.base + known[at + 1]
        place = np.searchsorted(self.bigrams, pairs)
        hit = (place < len(self.bigrams)) & (self.bigrams[np.minimum(place, len(self.bigrams) - 1)] == pairs)
        return at[hit], place[hit]

    def windows(self, texts: pa.Array, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, template, dice) of the best run of words for every template that matches."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        words, rows = normal_words(texts)
        if len(words) < 2:
            return none
        codes, names = coded(words)
        at, place = self._hits(codes, names, rows)
        if not len(at):
            return none
        kinds = np.unique(rows[at] * np.int64(len(self.bigrams)) + place)
        of, bigram = kinds // len(self.bigrams), kinds % len(self.bigrams)
        chosen, first = np.unique(of, return_index=True)
        shared = np.add.reduceat(self.has[bigram].astype(np.int64), first, axis=0)
        enough = shared >= self.sizes[None, :] * least / (2 - least) - 1e-9
        found = []
        for i in np.flatnonzero(enough.any(axis=1)).tolist():
            begin, end = np.searchsorted(rows, chosen[i]), np.searchsorted(rows, chosen[i], side="right")
            own = codes[begin:end].astype(np.int64)
            before, after = neighbours(own[:-1] * (len(names) + 1) + own[1:])
            low, high = np.searchsorted(at, (begin, end))
            for template in np.flatnonzero(enough[i]).tolist():
                hits = at[low:high][self.has[place[low:high], template]] - begin
                dice = best_run(before, after, hits, int(self.sizes[template]), least)
                if dice >= least:
                    found.append((chosen[i], template, dice))
        return tuple(np.array(x) for x in zip(*found)) if found else none

    def match(self, units: pa.Array, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, template, dice) of every match."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        words, rows = normal_words(units)
        if len(words) < 2:
            return none
        low, high = self.sizes.min() * least / (2 - least), self.sizes.max() * (2 - least) / least
        codes, names = coded(words)
        at, place = self._hits(codes, names, rows)
        # Distinct template bigrams of each unit, and the units that have enough of them for the smallest template.
        kinds = np.unique(rows[at] * np.int64(len(self.bigrams)) + place)
        of, bigram = kinds // len(self.bigrams), kinds % len(self.bigrams)
        units_hit, first, found = np.unique(of, return_index=True, return_counts=True)
        enough = found >= low
        if not enough.any():
            return none
        shared = np.add.reduceat(self.has[bigram].astype(np.int64), first, axis=0)[enough]
        chosen = units_hit[enough]
        # A unit's size is the number of its distinct bigrams, counted for these units only.
        mine = np.isin(rows, chosen)
        own, own_rows = codes[mine].astype(np.int64), rows[mine]
        inner = own_rows[1:] == own_rows[:-1]
        pair = (own[:-1] * (len(names) + 1) + own[1:])[inner]
        pair = np.unique(pair, return_inverse=True)[1]
        every = np.unique(own_rows[1:][inner] * np.int64(pair.max() + 1) + pair) // (pair.max() + 1)
        sizes = np.bincount(np.searchsorted(chosen, every), minlength=len(chosen))
        fits = (sizes >= low) & (sizes <= high)
        # Size bounds per template, then the coefficient.
        ratio = self.sizes[None, :] * least / (2 - least), self.sizes[None, :] * (2 - least) / least
        possible = fits[:, None] & (sizes[:, None] >= ratio[0] - 1e-9) & (sizes[:, None] <= ratio[1] + 1e-9)
        dice = 2.0 * shared / (sizes[:, None] + self.sizes[None, :])
        unit, template = np.nonzero(possible & (dice >= least))
        return chosen[unit], template, dice[unit, template]


FIELDS = [
    T.StructField("license", T.StringType()),
    T.StructField("dice", T.DoubleType()),
    T.StructField("licenses", T.ArrayType(T.StringType())),
    T.StructField("n_lines", T.LongType()),
]


def scan_texts(texts: pa.Array, templates: Templates, least: float, windows: bool = False) -> list[pa.Array]:
    n, texts = len(texts), pc.fill_null(texts, "")
    rows, kinds, values = [], [], []
    n_lines = np.zeros(n, np.int64)
    if windows:
        row, kind, dice = templates.windows(texts, least)
        rows.append(row)
        kinds.append(kind)
        values.append(dice)
    # All units are runs of words, so beside windows only lines are looked at, for their number.
    for pattern in ("\n",) if windows else ("\n", r"\n[ \t\r]*\n", None):
        units, of = (texts, np.arange(n)) if pattern is None else flat(
            pc.split_pattern(texts, pattern) if pattern == "\n" else pc.split_pattern_regex(texts, pattern)
        )
        unit, kind, dice = templates.match(units, least)
        rows.append(of[unit])
        kinds.append(kind)
        values.append(dice)
        if pattern == "\n":
            n_lines = per_row(of[np.unique(unit)], n)
    rows, kinds, values = np.concatenate(rows), np.concatenate(kinds), np.concatenate(values)
    order = np.lexsort((kinds, -values, rows))
    best: list[str | None] = [None] * n
    top: list[float | None] = [None] * n
    names: list[list[str]] = [[] for _ in range(n)]
    for i in order.tolist():
        row, name = rows[i], templates.names[kinds[i]]
        if best[row] is None:
            best[row], top[row] = name, float(values[i])
        if name not in names[row]:
            names[row].append(name)
    return [
        pa.array(best, pa.string()), pa.array(top, pa.float64()),
        pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array(n_lines, pa.int64()),
    ]


def scan(
    df: DataFrame, text: str = "text", templates: dict[str, str] | None = None, min_dice: float = MIN_DICE,
    keep: list[str] | None = None, windows: bool = False,
) -> DataFrame:
    """``df`` with the best ``license`` and its ``dice`` (null if none), all matching ``licenses`` by name, and the
    number of matching lines. ``windows``: over all runs of words, not units only. No shuffle."""
    texts = dict(TEMPLATES if templates is None else templates)

    def prepare():
        own = Templates(texts)
        return lambda values: scan_texts(values, own, min_dice, windows)

    return with_arrow(df, text, FIELDS, prepare, keep=keep)
