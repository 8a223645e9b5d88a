"""Licence scan with a generalised suffix automaton over the words of licence templates.

The automaton holds every run of words of every template.  A file's words stream through it and give the matching
statistics: at each word the longest run that ends there and stands in some template.  Runs of ``SEED`` words or more are
chained, in template order and with small gaps, into the template spans they cover.  Short naming phrases are
templates too: a phrase stands wherever its state is on the suffix path of the current one.

Defined results: a null or empty text has no words, no places, null first and last words, empty labels and score 0.
The score is 1 where a phrase stands, else the share of the template that the best chain covers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersely.llm.common import raw, table

#: Words that a run must have to take part in a chain, words between chained runs, and the share that names a licence.
SEED, GAP, COVERED = 5, 40, 0.3

# Naming phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices of well-known licences, by label.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "cc-by": """This work is licensed under a Creative Commons Attribution 4.0 International License.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
}

#: ASCII letters in lower case, digits and bytes of other characters stand; all else separates words.
_WORDS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


@dataclass
class State:
    length: int
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    ends: list[tuple[int, int]] = field(default_factory=list)  # (template, words of it up to here)
    phrases: tuple = ()  # (label, words) of the phrases that end here


class Automaton:
    """Generalised suffix automaton over word ids."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.states = [State(0)]
        self.ids: dict[bytes, int] = {}
        self.labels, self.sizes = list(templates), []
        for k, text in enumerate(templates.values()):
            self.sizes.append(self._add(text, k))
        named = {p: self._add(p, None) for p in phrases}
        order = sorted(range(1, len(self.states)), key=lambda s: self.states[s].length)
        for s in reversed(order):
            self.states[self.states[s].link].ends += self.states[s].ends
        own: dict[int, list] = {}
        for p, label in phrases.items():
            s = 0
            for w in words(p.encode()):
                s = self.states[s].next[self.ids[w]]
            own.setdefault(s, []).append((label, named[p]))
        for s in order:
            self.states[s].phrases = self.states[self.states[s].link].phrases + tuple(own.get(s, ()))

    def _add(self, text: str, template: int | None) -> int:
        last = 0
        found = words(text.encode())
        for n, w in enumerate(found, 1):
            last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
            if template is not None:
                self.states[last].ends.append((template, n))
        return len(found)

    def _copy(self, q: int, length: int) -> int:
        states = self.states
        states.append(State(length, states[q].link, dict(states[q].next)))
        return len(states) - 1

    def _extend(self, p: int, c: int) -> int:
        states = self.states
        if (q := states[p].next.get(c)) is not None:
            if states[q].length == states[p].length + 1:
                return q
            new = self._copy(q, states[p].length + 1)
            states[q].link = new
            while p >= 0 and states[p].next.get(c) == q:
                states[p].next[c] = new
                p = states[p].link
            return new
        states.append(State(states[p].length + 1))
        new = len(states) - 1
        while p >= 0 and c not in states[p].next:
            states[p].next[c] = new
            p = states[p].link
        if p < 0:
            states[new].link = 0
        elif states[q := states[p].next[c]].length == states[p].length + 1:
            states[new].link = q
        else:
            twin = self._copy(q, states[p].length + 1)
            states[new].link = states[q].link = twin
            while p >= 0 and states[p].next.get(c) == q:
                states[p].next[c] = twin
                p = states[p].link
        return new

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
        """Phrase places ``(start, label)`` and the longest runs ``(last word, words, state)`` that can't go on."""
        states = self.states
        ids = np.fromiter(map(self.ids.get, found, repeat(-1)), np.int64, len(found))
        known = np.flatnonzero(ids >= 0)
        places: list[tuple[int, str]] = []
        runs: list[tuple[int, int, int]] = []
        if not len(known):
            return places, runs
        s, length, last = 0, 0, -2
        for i, c in zip(known.tolist(), ids[known].tolist()):
            if i != last + 1:
                if length >= SEED:
                    runs.append((last, length, s))
                s = length = 0
            elif length >= SEED and c not in states[s].next:
                runs.append((last, length, s))
            last = i
            while s and c not in states[s].next:
                s = states[s].link
                length = states[s].length
            s = states[s].next.get(c, 0)
            length = length + 1 if s else 0
            for label, n in states[s].phrases:
                if n <= length:
                    places.append((i - n + 1, label))
        if length >= SEED:
            runs.append((last, length, s))
        return places, runs

    def chains(self, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """``(template, first word, last word, share of the template covered)`` of chained runs."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for end, length, s in runs:
            for t, n in self.states[s].ends:
                by.setdefault(t, []).append((end, length, n))
        out = []
        for t, matches in by.items():
            # best[n]: words covered, first word, last word of the best open chain that ends at word n of the template
            best: dict[int, tuple[int, int, int]] = {}
            for end, length, n in sorted(set(matches)):
                start = end - length + 1
                for k in [k for k, c in best.items() if start - c[2] > GAP]:
                    covered, a, b = best.pop(k)
                    out.append((t, a, b, covered / self.sizes[t]))
                before = [c for k, c in best.items() if k <= n - length and c[2] < start]
                covered, a, _ = max(before, default=(0, start, 0))
                best[n] = max(best.get(n, (0, 0, 0)), (covered + length, a, end))
            out += [(t, a, b, covered / self.sizes[t]) for covered, a, b in best.values()]
        return sorted(set(out))


def _scan(batches: Iterable[pa.RecordBatch], spans: bool) -> Iterator[pa.RecordBatch]:
    automaton = Automaton(TEMPLATES, PHRASES)
    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = words(text.as_py())
            places, runs = automaton.scan(found)
            chains = automaton.chains(runs) if runs else []
            good = [c for c in chains if c[3] >= COVERED]
            if spans:
                rows += [(doc, automaton.labels[t], a, b, share) for t, a, b, share in good]
                continue
            base = sorted({label for _, label in places})
            labels = sorted({*base, *(automaton.labels[c[0]] for c in good)})
            starts = [i for i, _ in places]
            score = 1.0 if base else max((min(c[3], 1.0) for c in chains), default=0.0)
            rows.append((doc, len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score))
        schema = SPANS if spans else SCANNED
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


SCANNED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
SPANS = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), raw(text_col).alias("raw"))


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word and phrase counts, labels and score."""
    return _rows(docs, id_col, text_col).mapInArrow(lambda b: _scan(b, False), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, label, first_word, last_word, covered`` of every template span that covers enough of its template."""
    return _rows(docs, id_col, text_col).mapInArrow(lambda b: _scan(b, True), "doc_id long, label string, first_word long, last_word long, covered double")


def op2_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
