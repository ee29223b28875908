"""Op 8: licence scan by Dice coefficient over word bigrams.

Texts and templates are normalised alike (lower case, words of letters and
digits). A unit of a document - the whole text, each line, each sentence of a
longer line - is compared with a template by 2 * shared / (a + b) over their
multisets of word bigrams. Besides, every window of the whole word sequence is
compared, wherever it begins and however its lines are wrapped: per template and
place the window of highest coefficient stands, of windows of several templates
that overlap by more than half the one with most shared bigrams, weighted by the
coefficient. A window inside a matched unit of its own licence adds nothing.

A unit or window that reaches the threshold t holds at least t / (2 - t) of the
template's bigrams, so a document without that many is passed over at once; the
best window starts and ends on bigrams of the template and is no longer than
(2 - t) / t times the template.

Edge cases: null and empty texts, and units of a single word, match nothing;
equal scores go to the template that comes first by name; in a document of very
many notices a window is compared with those around it only; repeated rows repeat
their result; an empty table gives an empty one; only id and text are read.
Windows that lie within one line are reported on request (``inline``; the query
asks for them): without it a line is judged as a line and by its sentences.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from churnforge.llm.common import text_slices
from churnforge.session import map_in_arrow

# Short forms and openings of public licences. The folder ``licences`` adds whole notices
# and whole licence texts (NAME.KIND.txt), with their disclaimers.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                     "License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
                     "License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "all-rights-reserved": ["All rights reserved."],
}

for _file in sorted(files("churnforge.llm").joinpath("licences").iterdir(), key=lambda f: f.name):
    TEMPLATES.setdefault(_file.name.rsplit(".", 2)[0], []).append(_file.read_text(encoding="utf-8"))

_WORD = re.compile(r"[a-z0-9]+")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(text: str) -> list[tuple[str, str]]:
    words = words_of(text)
    return list(zip(words, words[1:]))


def word_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each word in the text as given."""
    low = text.lower()
    spans = [m.span() for m in _WORD.finditer(low)]
    if len(low) == len(text):
        return spans
    origin = [i for i, c in enumerate(text) for _ in c.lower()]       # some capitals lower to two characters
    return [(origin[a], origin[b - 1] + 1) for a, b in spans]


class LicenceScanner:
    def __init__(self, templates: dict[str, list[str]], threshold: float, inline: bool = False):
        self.threshold, self.inline = threshold, inline
        self.ratio = threshold / (2 - threshold)
        self.names: list[str] = []
        self.sizes: list[int] = []
        # bigram -> (template, its count there)
        self.index: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)
        for name in sorted(templates):
            for t in templates[name]:
                grams = Counter(bigrams(t))
                for g, n in grams.items():
                    self.index[g].append((len(self.names), n))
                self.names.append(name)
                self.sizes.append(grams.total())
        self.index = dict(self.index)

    def shared(self, grams: list[tuple[str, str]]) -> dict[int, int]:
        """Bigrams in common with each template (as multisets)."""
        out: dict[int, int] = defaultdict(int)
        index = self.index
        for g, n in Counter([g for g in grams if g in index]).items():
            for t, k in index[g]:
                out[t] += n if n < k else k
        return out

    def score(self, grams: list[tuple[str, str]]) -> tuple[str, float] | None:
        """Best template at or over the threshold for a unit's bigrams."""
        best = None
        for t, both in sorted(self.shared(grams).items()):
            value = 2 * both / (len(grams) + self.sizes[t])
            if value >= self.threshold and (best is None or value > best[1]):
                best = self.names[t], value
        return best

    def windows_of(self, template: int, grams: list[tuple[str, str]]) -> list[tuple[int, int, int, float]]:
        """(first bigram, last bigram, shared, dice) of the template's best
        windows: highest coefficient first, none overlapping another."""
        size, index = self.sizes[template], self.index
        pos, before, seen = [], [], defaultdict(list)
        for i, g in enumerate(grams):
            count = next((n for t, n in index.get(g, ()) if t == template), 0)
            if count:
                # a hit counts from a start after the count-th hit of the same bigram before it
                places = seen[g]
                before.append(places[-count] if len(places) >= count else -1)
                places.append(len(pos))
                pos.append(i)
        at, back = np.array(pos), np.array(before)
        reach = np.searchsorted(at, at + int(size / self.ratio + 1e-9), "left")

        def best(i: int, limit: int) -> tuple[float, int, int, int] | None:
            end = min(int(reach[i]), limit)
            both = np.cumsum(back[i:end] < i)
            value = 2 * both / (size + at[i:end] - at[i] + 1)
            j = int(value.argmax())
            return (-float(value[j]), i, i + j, int(both[j])) if value[j] >= self.threshold else None

        least = size * self.ratio - 1e-9
        heap = [w for i in np.flatnonzero(reach - np.arange(len(at)) >= least) if (w := best(int(i), len(at)))]
        heapq.heapify(heap)
        starts: list[int] = []
        ends: list[int] = []
        out = []
        while heap:
            value, i, j, both = heapq.heappop(heap)
            k = bisect_right(starts, i)
            if k and ends[k - 1] >= i:
                continue
            if k < len(starts) and starts[k] <= j:             # runs into a better window: as far as that
                if again := best(i, starts[k]):
                    heapq.heappush(heap, again)
                continue
            starts.insert(k, i)
            ends.insert(k, j)
            out.append((int(at[i]), int(at[j]), both, -value))
        return out

    def windows(self, grams: list[tuple[str, str]], candidates: list[int]) -> list[tuple[int, int, str, float]]:
        """(first bigram, last bigram, licence, dice) of the windows that stand."""
        found = [(-both * value, t, a, b, value) for t in candidates for a, b, both, value in self.windows_of(t, grams)]
        kept: list[tuple[int, int, str, float]] = []
        spans: list[tuple[int, int]] = []          # of the kept windows, by place
        widest = 0
        for _, t, a, b, value in sorted(found):
            # only windows that begin less than the widest one before it, or inside it, can meet this one
            near = spans[bisect_left(spans, (a - widest, -1)):bisect_right(spans, (b, b + widest + 1))]
            if all(2 * (min(b, d) - max(a, c) + 1) <= b - a + 1 for c, d in near):
                kept.append((a, b, self.names[t], value))
                insort(spans, (a, b))
                widest = max(widest, b - a + 1)
        return kept

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, licence, dice) of the matching units and windows, by place."""
        words = words_of(text)
        grams = list(zip(words, words[1:]))
        candidates = sorted(t for t, n in self.shared(grams).items() if n >= self.sizes[t] * self.ratio - 1e-9)
        if not candidates:
            return []
        out, at = {}, 0
        lines = text.split("\n")
        for line in lines:
            line_grams = bigrams(line)
            if not self.index.keys().isdisjoint(line_grams):
                if found := self.score(line_grams):
                    out[at, at + len(line)] = found
                parts = _SENTENCE.split(line)
                place = at
                for p in parts if len(parts) > 1 else ():
                    place = text.index(p, place)
                    if found := self.score(bigrams(p)):
                        out[place, place + len(p)] = found
            at += len(line) + 1
        if len(lines) > 1 and (found := self.score(grams)):
            out[0, len(text)] = found
        units = [(a, b, name) for (a, b), (name, _) in out.items()]
        spans = word_spans(text)
        for first, last, name, value in self.windows(grams, candidates):
            a, b = spans[first][0], spans[last + 1][1]
            if (self.inline or "\n" in text[a:b]) and not any(c <= a and b <= d and name == n for c, d, n in units):
                out.setdefault((a, b), (name, value))
        return [(a, b, *found) for (a, b), found in sorted(out.items())]


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: dict[str, list[str]] | None = None, threshold: float = 0.8,
                  inline: bool = False) -> DataFrame:
    """(id, matches array<struct<start, end, licence, dice>>) per row of docs.
    Map-only; the templates are the caller's and small."""
    templates = TEMPLATES if templates is None else templates
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                     T.StructField("licence", T.StringType()), T.StructField("dice", T.DoubleType())]))
    schema = T.StructType([docs.schema[id_col], T.StructField("matches", kind)])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("licence", pa.string()),
                                ("dice", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenceScanner(templates, threshold, inline)
        for batch, texts in text_slices(batches, 1):
            found = [[dict(zip(("start", "end", "licence", "dice"), m)) for m in scanner.scan(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow)], names=schema.names)

    return map_in_arrow(docs.select(id_col, text_col), run, schema)
