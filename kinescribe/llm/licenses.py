"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment.

Texts are read as words of letters, digits and bytes over 127, without regard to case. Each template's
3-word grams are winnowed (the least hash of every two neighbours); an index from those hashes to
(template, position) is built from the templates alone, and its size depends on nothing else. A
document's grams found in the index are seeds. Seeds of one template that go on in both texts, with at most GAP
words skipped in either, are chained; the alignment follows the chain: between two seeds, and beyond its ends
within BAND words of its diagonal, words are matched by their longest common subsequence. So words may be
inserted, dropped or changed anywhere. A chain that covers enough of its template, and has the template's
telling words, is reported with its coverage and span.

Templates are notices and the operative clauses of licenses: a coverage of 1 means that text, not every line
of the license.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinescribe.llm.common import pieces, text_column
from kinescribe.llm.hashing import gram_hashes, word_hashes

GRAM, BAND, GAP = 3, 8, 64
_GAPS = np.ones(256, bool)
_GAPS[48:58] = _GAPS[65:91] = _GAPS[97:123] = _GAPS[128:] = False

# Statements, notices and clauses of public licenses, and the words that tell each from its relatives.
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons {name} {version} International License."
TEMPLATES = (
    ("MIT", "Released under the MIT License.", "MIT License"),
    ("MIT", _MIT, "sublicense"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "with or without fee"),
    ("BSD-2-Clause", _BSD, "in binary form must reproduce"),
    ("BSD-3-Clause", _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "endorse or promote products"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "alter it and redistribute it freely"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software", "any person or organization"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "Apache License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "GNU General Public License version 2"),
    ("GPL-2.0", _GNU.format(name="GNU General Public License", version=2), "version 2 of the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License version 3"),
    ("GPL-3.0", _GNU.format(name="GNU General Public License", version=3), "the GNU General Public License as"),
    ("LGPL-2.1", _GNU.format(name="GNU Lesser General Public License", version=2.1), "version 2.1 of the License"),
    ("LGPL-3.0", _GNU.format(name="GNU Lesser General Public License", version=3), "Lesser General Public License as"),
    ("AGPL-3.0", _GNU.format(name="GNU Affero General Public License", version=3), "Affero General Public License as"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.", "neighboring rights"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "CC BY 4.0"),
    ("CC-BY-4.0", _CC.format(name="Attribution", version="4.0"), "Attribution 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "CC BY SA 4.0"),
    ("CC-BY-SA-4.0", _CC.format(name="Attribution-ShareAlike", version="4.0"), "Attribution ShareAlike 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "CC BY NC 4.0"),
    ("CC-BY-NC-4.0", _CC.format(name="Attribution-NonCommercial", version="4.0"), "Attribution NonCommercial 4.0"),
    ("CC-BY-NC-SA-4.0", _CC.format(name="Attribution-NonCommercial-ShareAlike", version="4.0"), "NonCommercial ShareAlike 4.0"),
    ("CC-BY-ND-4.0", _CC.format(name="Attribution-NoDerivatives", version="4.0"), "Attribution NoDerivatives 4.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Eclipse Public License 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.", "changing it is allowed"),
)


def words_of(text: str) -> np.ndarray:
    return word_hashes(np.frombuffer(text.encode(), np.uint8), lower=True, gaps=_GAPS)[0]


def build_index(templates) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]]]:
    """Sorted winnowed gram hashes, and where each stands: (template, position)."""
    where: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for t, (_, text, _) in enumerate(templates):
        grams = gram_hashes(words_of(text), GRAM)
        if len(grams):
            left = np.arange(len(grams) - 1) if len(grams) > 1 else np.zeros(0, int)
            chosen = set(np.where(grams[left] <= grams[left + 1], left, left + 1).tolist()) or {0}
            for i in sorted(chosen):
                where[int(grams[i])].append((t, i))
    return np.array(sorted(where), np.uint64), dict(where)


def common(a: np.ndarray, b: np.ndarray, shift: int, band: int) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b) of a longest common subsequence, within `band` of the diagonal at shift (a
    place in b less the one in a)."""
    rows = [[0] * (len(b) + 1)]
    for i, word in enumerate(a.tolist()):
        above, row = rows[-1], [0] * (len(b) + 1)
        low = min(len(b), max(0, i + shift - band))
        high = max(low, min(len(b), i + shift + band + 1))
        row[: low + 1] = above[: low + 1]
        for j in range(low, high):
            row[j + 1] = above[j] + 1 if b[j] == word else max(above[j + 1], row[j])
        row[high + 1 :] = [max(row[high], x) for x in above[high + 1 :]]
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def align(template: np.ndarray, words: np.ndarray, chain: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Matched pairs (place in the template, place in the words) along a chain of seeds (place in the words, place in
    the template): equal words on the seeds' diagonals, and the best match of what lies between and beyond."""
    at, i = chain[0]
    low = max(0, at - i - BAND)
    out = common(template[:i], words[low:at], at - i - low, BAND)
    out = [(x, y + low) for x, y in out]
    for (at, i), after in zip(chain, [*chain[1:], None]):
        if after is None:
            rest = words[at : at + len(template) - i + BAND]
            out += [(x + i, y + at) for x, y in common(template[i:], rest, 0, BAND)]
        elif after[0] - at == after[1] - i:
            same = np.flatnonzero(template[i : after[1]] == words[at : after[0]])
            out += [(int(x) + i, int(x) + at) for x in same]
        else:
            gap = abs((after[0] - at) - (after[1] - i))
            out += [(x + i, y + at) for x, y in common(template[i : after[1]], words[at : after[0]], 0, gap + BAND)]
    return out


def chains(seeds: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Chains of one template's seeds (place in the words, place in the template), sorted: each seed goes on from the
    best one at most GAP words before it in both. Seeds are taken by the longest chains first. The look back
    covers GAP words, so work grows with the number of seeds."""
    best: list[int] = []
    back: list[int] = []
    first = 0
    for n, (at, i) in enumerate(seeds):
        while seeds[first][0] < at - GAP:
            first += 1
        top, via = 0, -1
        for m in range(first, n):
            a, j = seeds[m]
            if a < at and j < i and i - j <= GAP:
                # what two overlapping grams share counts once; a change of diagonal costs a little
                gain = best[m] + 4 * min(GRAM, i - j, at - a) - (at - a != i - j)
                if gain >= top:
                    top, via = gain, m
        best.append(max(top, 4 * GRAM))
        back.append(via if top >= 4 * GRAM else -1)
    used = [False] * len(seeds)
    out = []
    for n in sorted(range(len(seeds)), key=lambda n: (-best[n], n)):
        chain = []
        while n >= 0 and not used[n]:
            used[n] = True
            chain.append(seeds[n])
            n = back[n]
        if chain:
            out.append(chain[::-1])
    return out


def holds(words: np.ndarray, phrase: np.ndarray) -> bool:
    n = len(words) - len(phrase) + 1
    return n > 0 and bool(np.all([words[k : k + n] == x for k, x in enumerate(phrase)], axis=0).any())


def find(words: np.ndarray, index: np.ndarray, where: dict, templates: list[tuple[np.ndarray, np.ndarray]], least: float) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, end) of each stretch with a coverage of at least `least` that has the
    template's telling words. templates: words and telling words of each."""
    grams = gram_hashes(words, GRAM)
    seeds = np.flatnonzero(index[np.minimum(np.searchsorted(index, grams), len(index) - 1)] == grams) if len(grams) and len(index) else []
    places: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for at in seeds:
        for t, i in where[int(grams[at])]:
            places[t].append((int(at), i))
    out = []
    for t, found in places.items():
        template, telling = templates[t]
        for chain in chains(sorted(found)):
            pairs = align(template, words, chain)
            first, end = pairs[0][1], pairs[-1][1] + 1
            if len(pairs) >= least * len(template) and holds(words[first:end], telling):
                out.append((t, len(pairs), first, end))
    return sorted(set(out), key=lambda x: (x[2], x[0]))


def outermost(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Without stretches that lie in another one with more matched words. A stretch is within a bounded distance of
    all that can reach over it, so the look back ends there."""
    out: list[tuple[int, int, int, int]] = []
    reach = max((x[3] - x[2] for x in found), default=0)
    for x in sorted(found, key=lambda x: (x[2], -x[3], -x[1], x[0])):
        near = itertools.takewhile(lambda y: y[2] >= x[2] - reach, reversed(out))  # noqa: B023
        if not any(y[3] >= x[3] and y[1] > x[1] for y in near):
            out.append(x)
    return sorted(out, key=lambda x: (x[2], x[0]))


SCHEMA = "doc_id long, n_licenses long, licenses string, coverage double, spans string"


def license_spans(docs: DataFrame, templates: tuple[tuple[str, str, str], ...] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """One row a document: n_licenses (different ones), licenses (sorted, comma-joined), coverage (the best;
    0 without any) and spans: id:start:end:coverage for each matched stretch, in code points, end
    exclusive, comma-joined by start. A stretch inside a longer one isn't listed (the two clauses that one license
    shares with another). Null and empty texts have none; repeated rows have the same; rows without doc_id are
    scanned like others; other columns are not read. One pass over whole texts, nothing is shuffled; time and
    memory follow the text and the number of its seeds. templates: license, text, telling words."""
    names = [n for n, _, _ in templates]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, where = build_index(templates)
        known = [(words_of(text), words_of(telling)) for _, text, telling in templates]
        for batch, data, at in pieces(batches, "__bytes"):
            hashes, start, size = word_hashes(data, lower=True, gaps=_GAPS)
            bound = np.searchsorted(start, at)
            grams = gram_hashes(hashes, GRAM)
            some = np.zeros(batch.num_rows, bool)
            if len(grams) and len(index):
                seeds = np.flatnonzero(index[np.minimum(np.searchsorted(index, grams), len(index) - 1)] == grams)
                some[np.searchsorted(bound, seeds, "right") - 1] = True
            rows = []
            for i in range(batch.num_rows):
                if not some[i]:
                    rows.append((0, "", 0.0, ""))
                    continue
                a, b = int(bound[i]), int(bound[i + 1])
                found = find(hashes[a:b], index, where, known, least)
                found = outermost(found)
                # code points before each byte
                points = np.concatenate(([0], np.add.accumulate((data[at[i] : at[i + 1]] & 0xC0) != 0x80, dtype=np.int64))) if found else []
                spans = []
                for t, count, first, end in found:
                    s, e = int(start[a + first] - at[i]), int(start[a + end - 1] + size[a + end - 1] - at[i])
                    spans.append((names[t], int(points[s]), int(points[e]), count / len(known[t][0])))
                ids = sorted({x[0] for x in spans})
                rows.append((len(ids), ",".join(ids), max((x[3] for x in spans), default=0.0), ",".join(f"{n}:{s}:{e}:{c:.3f}" for n, s, e, c in spans)))
            n, ids, best, spans = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(best, pa.float64()), pa.array(spans, pa.string())], names=["doc_id", "n_licenses", "licenses", "coverage", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("__bytes")).mapInArrow(run, SCHEMA)
