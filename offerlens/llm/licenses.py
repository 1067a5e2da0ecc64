"""Operator 10, license scans by patience alignment.

A document's words are compared with license templates. A region is located by chaining the words that a template has
once, in the template's order; what stands between two of them costs the logarithm of its length, so a foreign passage of any length
may stand in a long template, but not between the words of a line. The region is
aligned with the template: words that occur once in both are anchors, the longest increasing subsequence of their
places is kept, and the gaps between them are aligned in the same way; gaps without anchors match their common
beginnings and ends. Coverage is the share of the template's words that are aligned; a license is found if it is at
least LEAST. What is left on both sides of a region is searched again.

Names and numbers of a template tell licenses apart: each must be aligned, and other names or numbers that are left over in
the document beside them (GNU *Lesser* General, BY-*ND*, 2.*1*) are a conflict, whatever the coverage.

Screen, without loss: a template with a coverage of LEAST or more has, of any floor((1 - LEAST) * n) + 1 of its words,
at least one in the document; only documents with one of its longest words are aligned.

Defined cases: null and empty texts have no license. Words are runs of ASCII letters and digits, in lower case. Very long
texts are scanned whole. Of several licenses, the best is that with the highest coverage, then most words, then the first place, then the name. Rows that
repeat a doc_id are scanned each. An empty table gives an empty result. Extra columns are never read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table, slices

LEAST = 0.8
#: Words that name licenses; of a template, these and its numbers distinguish it.
NAMES = frozenset("mit apache gnu general public lesser library affero bsd isc mozilla eclipse eupl boost cc by nc nd sa attribution noncommercial sharealike noderivatives noderivs unencumbered".split())
_WORD = re.compile(r"[A-Za-z0-9]+")

_GNU = """This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
#: Notices and texts of public licenses.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GNU.format(":", "General Public License", ",", 3)],
    "GPL-2.0": [_GNU.format(";", "General Public License", ";", 2)],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", _GNU.format(":", "Lesser General Public License", ",", 3)],
    "LGPL-2.1": [_GNU.format(";", "Lesser General Public License", ";", "2.1")],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", _GNU.format(":", "Affero General Public License", ",", 3)],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "BSD-2-Clause": [_BSD],
    "BSD-3-Clause": [_BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "ISC": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def distinguishing(template: list[str]) -> set[str]:
    return {w for w in template if w.isdigit() or (w in NAMES and (w != "by" or "cc" in template))}


def agrees(words: list[str], template: list[str], pairs: list[tuple[int, int]]) -> bool:
    """Whether all distinguishing words are aligned and no others stand beside them."""
    own = distinguishing(template)
    if not own <= {template[j] for _, j in pairs}:
        return False
    for (i, j), (k, m) in zip(pairs, pairs[1:]):
        if template[j] in own or template[m] in own:
            if any((w.isdigit() and w != "0") or (w in NAMES and w not in ("by", "public", "general")) for w in words[i + 1 : k]):
                return False
    return True


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(places)
    for i, x in enumerate(places):
        k = bisect_left(tops, x)
        before[i] = piles[k - 1] if k else -1
        if k == len(tops):
            tops.append(x)
            piles.append(i)
        else:
            tops[k], piles[k] = x, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def chains(at: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Of (place in the text, place in the template) pairs, by place in the text, chains of indices that rise in both, the one worth most first.

    A pair is worth 1; words that stand between two pairs beyond what the template has there cost log2(1 + their number).
    Of the chains that end at a place of the template, the one that is worth most by now is kept. Each pair has one best chain that ends
    with it; from the best pair on, these are followed back to where another chain has taken them, so each pair is in one chain: time is in proportion to the pairs.
    """
    worth: dict[int, tuple[float, int]] = {}  # by place in the template: what its chain is worth, its last pair
    before, values = [-1] * len(at), [1.0] * len(at)
    for x, (i, j) in enumerate(at):
        value, own = 1.0, -1
        for m, (w, y) in worth.items():
            if m < j and w + 1 > value:
                w += 1 - math.log2(1 + max(0, i - at[y][0] - (j - m)))
                if w > value:
                    value, own = w, y
        before[x], values[x] = own, value
        if (old := worth.get(j)) is None or value >= old[0] - math.log2(1 + i - at[old[1]][0]):
            worth[j] = (value, x)
    taken = bytearray(len(at))
    for x in sorted(range(len(at)), key=lambda x: (-values[x], x)):
        out = []
        while x >= 0 and not taken[x]:
            taken[x] = 1
            out.append(x)
            x = before[x]
        if out:
            yield out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (i, j) of equal words, increasing in both, by patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i >= k or j >= m:
            continue
        in_a, in_b = Counter(a[i:k]), Counter(b[j:m])
        at = {w: y for y, w in enumerate(b[j:m], j) if in_b[w] == 1}
        found = [(x, at[w]) for x, w in enumerate(a[i:k], i) if in_a[w] == 1 and w in at]
        kept = [found[x] for x in increasing([y for _, y in found])]
        out += kept
        for (x, y), (x2, y2) in zip([(i - 1, j - 1), *kept], [*kept, (k, m)]) if kept else ():
            if x + 1 < x2 and y + 1 < y2:
                todo.append((x + 1, x2, y + 1, y2))
    return sorted(out)


@dataclass(frozen=True)
class Match:
    name: str
    coverage: float
    first: int  # words of the document: [first, behind)
    behind: int
    n_words: int


class Scanner:
    def __init__(self, templates: dict[str, list[str]] | None = None, least: float = LEAST):
        self.least = least
        self.templates = [(name, w) for name, texts in (templates or TEMPLATES).items() for t in texts if (w := words_of(t))]
        self.sets = [set(w) for _, w in self.templates]
        self.counts = [Counter(w) for _, w in self.templates]
        self.places = [{w: j for j, w in enumerate(t) if n[w] == 1} for (_, t), n in zip(self.templates, self.counts)]
        needed = [sorted(w, key=lambda x: (-len(x), x))[: int((1 - least) * len(w) + 1e-9) + 1] for _, w in self.templates]
        self.screen = sorted({x for n in needed for x in n}, key=lambda x: (-len(x), x))
        self.screen_sets = [set(n) for n in needed]

    def find(self, text: str) -> list[Match]:
        low = text.lower()
        if not any(w in low for w in self.screen):
            return []
        words = words_of(text)
        count = Counter(words)
        out = []
        for (name, template), have, places, needed in zip(self.templates, self.counts, self.places, self.screen_sets):
            if needed.isdisjoint(count) or sum(min(n, count[w]) for w, n in have.items()) < self.least * len(template):
                continue
            out += self._in_text(name, template, words, places)
        return self._best_apart(out)

    def _in_text(self, name: str, template: list[str], words: list[str], places: dict[str, int]) -> list[Match]:
        """Matches of one template: around the chains of its single words, the best first, each in what no better one took."""
        out, n = [], len(template)
        least = max(1, len(places) - int((1 - self.least) * n + 1e-9))  # of the single words, so many are in any sufficient match
        at = [(i, places[w]) for i, w in enumerate(words) if w in places]
        done: list[tuple[int, int]] = []  # parts of the text that were looked at, by place
        for chain in chains(at):
            if len(chain) < least:
                continue
            for piece in [list(own) for _, own in groupby(chain, key=lambda x: self._beside(done, at[x][0]))]:
                if len(piece) < least:
                    continue
                (i, j), (k, m) = at[piece[0]], at[piece[-1]]
                y, inside = self._beside(done, i)
                if inside:
                    continue
                slack = n // 4
                i = max(done[y - 1][1] if y else 0, i - j - slack)
                k = min(done[y][0] if y < len(done) else len(words), k + n - m + slack)
                part = words[i:k]
                pairs = align(part, template)
                if len(pairs) >= self.least * n and agrees(part, template, pairs):
                    i, k = i + pairs[0][0], i + pairs[-1][0] + 1
                    out.append(Match(name, len(pairs) / n, i, k, n))
                else:
                    i, k = at[piece[0]][0], at[piece[-1]][0] + 1
                insort(done, (i, k))
        return out

    @staticmethod
    def _beside(done: list[tuple[int, int]], i: int) -> tuple[int, bool]:
        """How many of the parts begin at or before place i, and whether it is in one."""
        y = bisect_right(done, (i, math.inf))
        return y, y > 0 and i < done[y - 1][1]

    @staticmethod
    def _best_apart(found: list[Match]) -> list[Match]:
        """The best matches that don't overlap, best first."""
        out: list[Match] = []
        for m in sorted(found, key=lambda m: (-m.coverage, -m.n_words, m.first, m.name)):
            if all(m.behind <= x.first or x.behind <= m.first for x in out):
                out.append(m)
        return out


def templates_of(table: DataFrame, most: int = 10_000) -> dict[str, list[str]]:
    """Templates of a table (name, text) of at most `most` rows; more raise, as each worker holds all."""
    rows = table.where("name is not null and text is not null").select("name", "text").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates")
    out: dict[str, list[str]] = {}
    for r in sorted(rows):
        out.setdefault(r.name, []).append(r.text)
    return out


def scanned(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, license, coverage, first_word, behind_word, licenses) of each row of docs(doc_id, text); licenses: all that were found, by name."""
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("behind_word", pa.int64()), ("licenses", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column(1).to_pylist():
                    found = scanner.find(text) if text else []
                    best = found[0] if found else None
                    rows.append((best.name, best.coverage, best.first, best.behind, ",".join(sorted({m.name for m in found}))) if best else (None, 0.0, None, None, ""))
                columns = zip(*rows) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, schema.types[1:]))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, coverage double, first_word long, behind_word long, licenses string")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLES: dict[str, str] = {}
