"""License scans by template markup, compiled into token automata.

A template is text with two kinds of markup:
  <<optional>> ... <</optional>>     wording that may be there or not (it may nest)
  <<var:lo-hi>> or <<var:lo-hi|a b c>>   a replaceable region of lo to hi words, or of lo to hi words out of a list
Everything else is mandatory. Compiled, it is an automaton over words: states are positions, each with arcs on one
word, on any word, or on a set of words. A place matches when the automaton gets from its start to its end, so texts
match only if their mandatory wording is exactly the template's. Base phrases are templates without markup.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanespan.llm.common import alnum_words

# The phrases and labels of the query's contract.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wordings of licenses, with regions that may be left out or replaced. A text may match several.
TEMPLATES = {
    "mit": [
        "<<optional>>licensed<</optional>> <<optional>>released<</optional>> under the <<optional>>terms of the<</optional>> mit license",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this <<var:1-4>> and associated documentation
        files (the <<var:1-4>>), to deal in the <<var:1-4>> without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the <<var:1-4>>, and to permit persons to whom the
        <<var:1-4>> is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        <<optional>>(including the next paragraph)<</optional>> shall be included in all copies or substantial portions of the <<var:1-4>>.
        THE <<var:1-4>> IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var:1-12>> BE LIABLE FOR
        ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE <<var:1-4>> OR THE USE OR OTHER DEALINGS IN THE <<var:1-4>>""",
    ],
    "apache-2": [
        "licensed under the apache license <<optional>>version<</optional>> 2 <<optional>>0<</optional>>",
        "apache license version <<var:0-1|v>> 2",
        """Licensed under the Apache License, Version 2.0 (the <<var:1-3>>); you may not use <<var:1-4>> except in compliance with the License.
        You may obtain a copy of the License at <<optional>>http<</optional>> <<optional>>https<</optional>> www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License""",
    ],
    "cc-by-nc": ["<<optional>>licensed under<</optional>> cc by nc <<optional>>4 0<</optional>>", "creative commons attribution noncommercial <<var:1-2>> <<optional>>international<</optional>> license"],
    "gpl-3": [
        "gnu general public license <<optional>>as published by the free software foundation<</optional>> <<var:0-2|either>> version 3",
        """is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation, either version 3 of the License, or (at your option) any later version""",
    ],
    "gpl-2": [
        "gnu general public license <<optional>>as published by the free software foundation<</optional>> <<var:0-2|either>> version 2",
        """is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation; either version 2 of the License, or (at your option) any later version""",
    ],
    "bsd": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: <<optional>>1.<</optional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. <<optional>>2.<</optional>> Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        <<optional>><<optional>>3.<</optional>> Neither the name of <<var:1-12>> nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission.<</optional>> THIS SOFTWARE IS PROVIDED BY <<var:1-12>> "AS IS" AND ANY EXPRESS OR
        IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED""",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ],
    "isc": [
        """Permission to use, copy, modify, and<<optional>>/or<</optional>> distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var:1-8>>
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE""",
    ],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "mpl-2": [
        "mozilla public license <<optional>>version<</optional>> <<optional>>v<</optional>> 2 0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at <<optional>>http<</optional>> <<optional>>https<</optional>> mozilla.org/MPL/2.0""",
    ],
}

MARKUP = re.compile(r"<<(/?optional|var:\d+-\d+(?:\|[^>]*)?)>>")


class Automaton:
    """States are numbers; arcs[state] maps a word to next states, anything[state] are next states on any word, free[state] those without a word."""

    def __init__(self, template: str):
        self.words: dict[int, dict[bytes, set[int]]] = defaultdict(lambda: defaultdict(set))
        self.anything: dict[int, set[int]] = defaultdict(set)
        self.free: dict[int, set[int]] = defaultdict(set)
        self.mandatory: set[bytes] = set()
        now, n, opened = 0, 1, []
        for k, part in enumerate(MARKUP.split(template)):
            if k % 2 == 0:
                for w in alnum_words(part.encode()):
                    self.words[now][w].add(n)
                    if not opened:
                        self.mandatory.add(w)
                    now, n = n, n + 1
            elif part == "optional":
                opened.append(now)
            elif part == "/optional":
                self.free[opened.pop()].add(now)
            else:
                bounds, _, some = part[4:].partition("|")
                lo, hi = map(int, bounds.split("-"))
                begun, skips = now, []
                for i in range(hi):
                    if i >= lo:
                        skips.append(now)
                    for w in alnum_words(some.encode()):
                        self.words[now][w].add(n)
                    if not some:
                        self.anything[now].add(n)
                    now, n = n, n + 1
                for s in skips or ([begun] if hi == 0 else []):
                    if s != now:
                        self.free[s].add(now)
        if opened:
            raise ValueError(f"optional region without an end: {template}")
        self.end = now
        self.first = self.closed({0})

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.free.get(todo.pop(), ()):
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    def starts(self) -> set[bytes] | None:
        """Words that a match can begin with; None if any can."""
        return None if any(self.anything.get(s) for s in self.first) else {w for s in self.first for w in self.words.get(s, ())}

    def match_at(self, words: list[bytes], at: int) -> int:
        """The end of the shortest match from word `at`, or -1."""
        states = self.first
        while states and self.end not in states:
            if at >= len(words):
                return -1
            w = words[at]
            states = self.closed({t for s in states for t in (*self.words.get(s, {}).get(w, ()), *self.anything.get(s, ()))})
            at += 1
        return at if states else -1


class Scanner:
    def __init__(self, base: dict[str, str], templates: dict[str, list[str]]):
        self.base = [(tuple(alnum_words(p.encode())), label) for p, label in base.items()]
        self.own = [(Automaton(t), label) for label, ts in templates.items() for t in ts]
        self.by_word: dict[bytes, list] = defaultdict(list)
        for a, label in self.own:
            if a.starts() is None or not a.mandatory:
                raise ValueError("a template begins with mandatory or optional wording, and has some that is mandatory")
            for w in a.starts():
                self.by_word[w].append((a, label))
        self.phrases: dict[bytes, list] = defaultdict(list)
        for p, label in self.base:
            self.phrases[p[0]].append((p, label))
        # Each match holds all mandatory words of its template, so a text without the longest of them cannot have one.
        self.needles = {max(a.mandatory, key=lambda w: (len(w), w)) for a, _ in self.own} | {max(p, key=lambda w: (len(w), w)) for p, _ in self.base}

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = alnum_words(text)
        there = set(words)
        n, first, last, base, labels, covered = 0, None, None, set(), set(), 0
        if not self.needles.isdisjoint(there):
            own = {w: [(a, x) for a, x in entries if a.mandatory <= there] for w, entries in self.by_word.items() if w in there}
            own = {w: x for w, x in own.items() if x}
            phrases = {w: x for w, x in self.phrases.items() if w in there}
            for at, w in enumerate(words) if own or phrases else ():
                for p, label in phrases.get(w, ()):
                    if tuple(words[at : at + len(p)]) == p:
                        n, first, last = n + 1, at if first is None else first, at
                        base.add(label)
                        covered += len(p)
                for a, label in own.get(w, ()):
                    if (end := a.match_at(words, at)) >= 0:
                        labels.add(label)
                        covered += end - at
        labels |= base
        return len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), covered / (covered + 4.0)


def license_scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, list[str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is m / (m + 4) for m matched words, counted once for each match. Null texts count as empty: no words, no
    labels (empty strings), first_word and last_word null, score 0. Rows are independent, so ids may be null or repeat;
    other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(base, templates)
        for b in batches:
            found = [s.scan(t or b"") for t in b.column(1).to_pylist()]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], names=NAMES)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
