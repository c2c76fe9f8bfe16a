"""License scans: matching statistics of documents against a generalised suffix automaton of licence words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairnlink.llm.tokens import ALNUM, find_words, sliced, window_hashes

#: Label and phrase; each place where a phrase stands is counted.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

#: Label and wording of public licence notices.
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
]

SEED = 3  # words: the shortest match that is followed up; no phrase or template is shorter


def words_of(text: str) -> list[bytes]:
    found = find_words(pa.array([text]), ALNUM, lower=True)
    return [found.word(i) for i in range(len(found.start))]


@dataclass
class Automaton:
    """A suffix automaton of several word sequences, with the places that each state stands for."""

    follow: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def add(self, number: int, words: list[bytes]) -> None:
        last = 0
        for at, word in enumerate(words):
            last = self._extend(last, word)
            self.ends[last].append((number, at))

    def _state(self, length: int, follow: dict[bytes, int], link: int) -> int:
        self.follow.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, parent: int, word: bytes) -> int:
        """The state of the strings of ``parent`` followed by ``word`` that are no longer than length[parent] + 1."""
        target = self.follow[parent][word]
        if self.length[target] == self.length[parent] + 1:
            return target
        twin = self._state(self.length[parent] + 1, dict(self.follow[target]), self.link[target])
        self.link[target] = twin
        while parent >= 0 and self.follow[parent].get(word) == target:
            self.follow[parent][word] = twin
            parent = self.link[parent]
        return twin

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.follow[last]:
            return self._split(last, word)
        new, parent = self._state(self.length[last] + 1, {}, 0), last
        while parent >= 0 and word not in self.follow[parent]:
            self.follow[parent][word] = new
            parent = self.link[parent]
        self.link[new] = self._split(parent, word) if parent >= 0 else 0
        return new

    def finish(self) -> None:
        """Hand the places of each state on to the states of its suffixes."""
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                known = set(self.ends[self.link[state]])
                self.ends[self.link[state]] += [x for x in self.ends[state] if x not in known]

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Matching statistics: for each word the state and length of the longest match that ends there."""
        state = long = 0
        for word in words:
            while state and word not in self.follow[state]:
                state = self.link[state]
                long = self.length[state]
            if word in self.follow[state]:
                state, long = self.follow[state][word], long + 1
            else:
                state = long = 0
            yield state, long


class Scanner:
    """Licence labels of one batch of texts after another."""

    def __init__(self, phrases: list[tuple[str, str]], templates: list[tuple[str, str]], anchor: int, gap: int, cover: float) -> None:
        self.texts = [(label, words_of(text), True) for label, text in phrases] + [(label, words_of(text), False) for label, text in templates]
        if any(len(words) < SEED for _, words, _ in self.texts):
            raise ValueError(f"a phrase or template has fewer than {SEED} words")
        self.anchor, self.gap, self.cover = anchor, gap, cover
        self.automaton = Automaton()
        for number, (_, words, _) in enumerate(self.texts):
            self.automaton.add(number, words)
        self.automaton.finish()
        self.whole = self._phrase_ends()
        seeds = []
        for _, words, _ in self.texts:
            column = pa.array([" ".join(w.decode() for w in words)])
            seeds.append(window_hashes(find_words(column, ALNUM).hashes(), SEED))
        self.seeds = np.unique(np.concatenate(seeds))
        self.likely = np.zeros(1 << 16, bool)
        self.likely[self.seeds >> np.uint64(48)] = True

    def _phrase_ends(self) -> list[list[tuple[str, int]]]:
        """For each state the label and length of the phrases that its strings, if long enough, end with."""
        links, lengths = self.automaton.link, self.automaton.length
        found: list[list[tuple[str, int]]] = [[] for _ in links]
        for state in sorted(range(1, len(links)), key=lambda s: lengths[s]):
            found[state] = list(found[links[state]])
            for number, end in self.automaton.ends[state]:
                label, words, counted = self.texts[number]
                if counted and end == len(words) - 1 and lengths[links[state]] < len(words) <= lengths[state]:
                    found[state].append((label, len(words)))
        return found

    def _runs(self, hashes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, first word, word after) of each run of words whose every SEED words in a row stand in a template."""
        windows = window_hashes(hashes, SEED)
        hit = np.flatnonzero(self.likely[windows >> np.uint64(48)])
        hit = hit[np.isin(windows[hit], self.seeds) & (doc[hit] == doc[hit + SEED - 1])]
        if len(hit):
            fresh = np.flatnonzero(np.append(True, (np.diff(hit) > 1) | (np.diff(doc[hit]) > 0)))
            for low, high in zip(fresh, np.append(fresh[1:], len(hit))):
                yield int(doc[hit[low]]), int(hit[low]), int(hit[high - 1]) + SEED

    def scan(self, texts: pa.Array) -> dict[str, list]:
        found = find_words(texts, ALNUM, lower=True)
        n, doc = len(texts), found.doc
        places: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        anchors: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n)]
        for text, low, high in self._runs(found.hashes(), doc):
            words, at = [found.word(i) for i in range(low, high)], low - int(found.first[text])
            steps = list(self.automaton.stream(words))
            for i, (state, long) in enumerate(steps):
                for label, size in self.whole[state]:
                    if long >= size:
                        places[text].append((at + i - size + 1, label))
                if long >= self.anchor and (i + 1 == len(steps) or steps[i + 1][1] <= long):
                    anchors[text] += [(number, at + i - long + 1, end - long + 1, long) for number, end in self.automaton.ends[state] if not self.texts[number][2]]
        spans = [self._chain(sorted(x)) for x in anchors]
        base = [sorted({label for _, label in x}) for x in places]
        return {
            "n_words": np.diff(found.first).tolist(),
            "n_base": [len(x) for x in places],
            "first_word": [min((at for at, _ in x), default=None) for x in places],
            "last_word": [max((at for at, _ in x), default=None) for x in places],
            "base_labels": base,
            "labels": [sorted({*b, *(s["label"] for s in x)}) for b, x in zip(base, spans)],
            "score": [1.0 if b else max((s["covered"] for s in x), default=0.0) for b, x in zip(base, spans)],
            "spans": spans,
        }

    def _chain(self, anchors: list[tuple[int, int, int, int]]) -> list[dict]:
        """Spans of templates covered well enough by matches that follow one another in text and template.

        For each template the chains of most covered words are taken first, as long as they share no words of the text.
        """
        spans: list[dict] = []
        for number in sorted({x[0] for x in anchors}):
            label, words, _ = self.texts[number]
            rows, size = [x[1:] for x in anchors if x[0] == number], len(words)
            best, back = [long for *_, long in rows], [-1] * len(rows)
            for i, (at, place, long) in enumerate(rows):
                for j in range(i - 1, -1, -1):
                    at_j, place_j, long_j = rows[j]
                    if at - at_j > self.gap + size:  # no match is longer than the template
                        break
                    ahead, along = at - at_j - long_j, place - place_j - long_j
                    if max(ahead, along) <= self.gap and ahead + long > 0 and along + long > 0 and at > at_j and place > place_j:
                        value = best[j] + long - max(0, -ahead, -along)
                        if value > best[i]:
                            best[i], back[i] = value, j
            used = set()
            for end in sorted(range(len(rows)), key=lambda i: (-best[i], rows[i][0])):
                chain, i = [], end
                while i >= 0 and i not in used:
                    chain.append(i)
                    i = back[i]
                if i >= 0 or best[end] < self.cover * size:
                    continue
                first, last = rows[chain[-1]][0], rows[end][0] + rows[end][2]
                if all(x["end"] <= first or last <= x["first"] for x in spans if x["label"] == label):
                    used.update(chain)
                    spans.append({"label": label, "first": first, "end": last, "covered": min(1.0, best[end] / size)})
        return sorted(spans, key=lambda x: (x["first"], x["end"], x["label"]))


SCAN_TYPE = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<label:string,first:long,end:long,covered:double>>"


def scan_licenses(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, anchor: int = 4, gap: int = 8, cover: float = 0.6
) -> DataFrame:
    """Label every text with the licences whose wording it holds; one row for each row of ``docs``.

    Texts are lower-cased in A-Z and cut into runs of ASCII letters, digits and non-ASCII characters. Matches of
    ``anchor`` words or more, found as matching statistics of a suffix automaton of all phrases and templates, are
    chained over gaps of up to ``gap`` words; a chain that covers ``cover`` of a template gives its label and a span.
    n_base counts every place of a phrase, overlapping ones too. Words that are in no seed of three licence
    words are not streamed; no match of three words or more is lost by that. Memory: the templates and 4 MB of text.

    Null and empty texts have no words and no labels (empty lists, score 0, null first_word and last_word); very long
    texts are scanned whole; repeated rows give repeated results; an empty table gives an empty result. Other columns are
    not read, whatever their names; ids keep their type and may be null.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates, anchor, gap, cover)
        for batch in sliced(batches):
            found = scanner.scan(batch.column("text"))
            span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))
            types = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), span]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(v, t) for v, t in zip(found.values(), types))], names=[id_column, *found])

    return docs.selectExpr(f"`{id_column}` as id", f"cast(`{text_column}` as string) as text").mapInArrow(run, f"`{id_column}` {kind}, {SCAN_TYPE}")
