"""License scan: TF-IDF cosine of notices to templates, then inheritance from the nearest licensed directory.

Words and word pairs are weighted by their rarity among all documents; what is compared with a template is each span of words of a text, up to
twice as long as the template and whatever the line breaks and comment marks in it, so that prose and names around a notice
don't count. All of a text is looked at: a sparse product of its terms, block by block, with the templates' bounds the cosine of
any span in the block, and only blocks that can't reach ``least`` with any template are left out. A span must have all words
of a short template that are in the templates of few licenses (names and versions): "the Foo License" isn't MIT. Of the
templates that reach ``least``, longer ones go before parts of them: a text in three clauses isn't one in two. The chosen span
and template are the file's notice; at ``least`` or more its license is the file's. A file named like a license file, or of
which the notice is at least half, gives its license to its directory; a file without one takes that of the nearest directory
above it that has one, by a join of each directory's ancestors with the licensed directories.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHash, column_of, materialize, slices, small_batches, window_hashes

_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_NOTICE_KEPT = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons {} 4.0 International License."
#: Short notices, headers and texts of common licenses.
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL v3.", _GNU.format("Affero General Public License", "3")],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0.", "Apache License, Version 2.0", "Licensed under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Licensed under the simplified BSD license.", _CONDITIONS, f"{_CONDITIONS}: {_NOTICE_KEPT}"],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        f"{_CONDITIONS}: {_NOTICE_KEPT} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.", "Released under the Boost Software License 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", _CC.format("Attribution")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", _CC.format("Attribution-NonCommercial")],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", _CC.format("Attribution-NoDerivatives")],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", _CC.format("Attribution-ShareAlike")],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License, Version 2.0.", "Released under the Eclipse Public License v2."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GPL v2.", "The code is under the GNU GPL version 2.", _GNU.format("General Public License", "2")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GPL v3.", "The code is under the GNU GPL version 3.", _GNU.format("General Public License", "3")],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the LGPL v2.1.", _GNU.format("Lesser General Public License", "2.1")],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the LGPL v3.", _GNU.format("Lesser General Public License", "3")],
    "MIT": [
        "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Licensed under the MIT license.", "MIT licensed.", "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "Zlib": ["Released under the zlib license.", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
}
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
#: How the texts of licenses begin.
BEGINNINGS = {
    "AGPL-3.0": f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 {_VERBATIM} Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "GPL-2.0": f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 {_VERBATIM} Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software",
    "GPL-3.0": f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_VERBATIM} Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "LGPL-2.1": f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 {_VERBATIM} This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1.",
    "LGPL-3.0": f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_VERBATIM} This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "MPL-2.0": "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
}
TEMPLATES = {name: [*texts, *([BEGINNINGS[name]] if name in BEGINNINGS else []), *(f"{x} {name}" for x in ("SPDX-License-Identifier:", "License:", "Licensed under", "Released under"))] for name, texts in TEMPLATES.items()}
LEAST = 0.7
#: Texts are looked at in blocks of twice so many words, each of which begins in the middle of the one before. Where a template has over half
#: as many words, blocks have four times its words: a span of twice the longest template's words always lies in one of them.
SPAN = 340
#: What a doubling of a template's words is worth, among templates that reach LEAST.
LONGER = 0.1
#: Templates of at most so many words need all their words that at most one in FEW licenses has.
SHORT, FEW = 15, 4
#: Weights of the most frequent terms go to all tasks; those of rarer ones are joined to the notices that have them.
HOT_TERMS = 100_000
#: Terms that are in no notice are mostly kept from the count by a table of bits.
BITS = 1 << 20
#: Words; "-only" and "-or-later" are no part of the name before them, so GPL-3.0-or-later names GPL-3.0.
_word = re.compile(r"\w+(?:[.-](?!(?:only|or-later)\b)\w+)*")
FILE_NAMES = r"(?i)^(un)?(licen[sc]e|copying|notice)([.-].*)?$"


class _Hashes(WordHash):
    def __missing__(self, word: str) -> int:
        value = super().__missing__(word.encode())
        self.pop(word.encode(), None)
        if len(word) <= 32:
            self[word] = value
        return value


_hashes = _Hashes()


def _hash(words: list[str]) -> np.ndarray:
    """Hashes of the words, then of the word pairs."""
    h = np.fromiter(map(_hashes.__getitem__, words), U64, len(words))
    return np.concatenate([h, window_hashes(h, 2)])


def _terms(text: str) -> Counter:
    return Counter(_hash(_word.findall(text.lower())).tolist())


def _repeats(ids: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of places of one term, the first one first, and its squared weight."""
    order = np.argsort(ids, kind="stable")
    by, out, lag = ids[order], [], 1
    while lag < len(by) and len(at := np.flatnonzero(by[lag:] == by[:-lag])):
        out.append((order[at], order[at + lag]))
        lag += 1
    first, second = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*out, strict=True) if out else ((), ())))
    return first, second, square[first]


class Templates:
    """Templates under the weights of a corpus of ``size`` texts, of which ``df`` [term] have a term; without, of the templates."""

    def __init__(self, templates: dict[str, list[str]], df: dict[int, int] | None = None, size: int = 0) -> None:
        docs = [(name, _terms(t)) for name, texts in sorted(templates.items()) for t in texts]
        if df is None:
            df, size = Counter(t for _, terms in docs for t in terms), len(docs)
        self.size = size
        self.weight = {t: self.rarity(n) for t, n in df.items()}
        self.other = self.rarity(0)
        self.names = [name for name, _ in docs]
        self.words = [len(_word.findall(t)) for _, texts in sorted(templates.items()) for t in texts]
        self.span = max([SPAN, *(2 * n for n in self.words)])
        own = Counter(t for texts in templates.values() for t in set().union(*map(_terms, texts)))
        words = [_hash(_word.findall(t.lower())).tolist()[:n] for t, n in zip((t for _, texts in sorted(templates.items()) for t in texts), self.words, strict=True)]
        self.needed = [{t for t in x if FEW * own[t] <= len(templates)} if len(x) <= SHORT else set() for x in words]
        self.rows: dict[int, list[tuple[int, float]]] = {}
        for k, (_, terms) in enumerate(docs):
            norm = self._norm(terms)
            for t, n in terms.items():
                self.rows.setdefault(t, []).append((k, n * self.weight.get(t, self.other) / norm))
        # the same, as arrays: of each term the templates that have it and its share of their squared norms
        self.terms = np.array(sorted(self.rows), U64)
        rows = [self.rows[t] for t in self.terms.tolist()]
        self.ends = np.cumsum([0, *map(len, rows)])
        self.of = np.array([k for r in rows for k, _ in r])
        self.square = np.array([x * x for r in rows for _, x in r])

    def rarity(self, n: int) -> float:
        return log((1 + self.size) / (1 + n)) + 1

    def _norm(self, terms: Counter) -> float:
        return sqrt(sum((n * self.weight.get(t, self.other)) ** 2 for t, n in terms.items())) or 1.0

    def best(self, text: str) -> tuple[float, str | None]:
        """The best cosine of a text as a whole."""
        terms = _terms(text)
        dot: dict[int, float] = {}
        for t, n in terms.items():
            for k, x in self.rows.get(t, ()):
                dot[k] = dot.get(k, 0.0) + n * self.weight.get(t, self.other) * x
        if not dot:
            return 0.0, None
        k = min(dot, key=lambda k: (-round(dot[k], 12), k))
        return min(1.0, dot[k] / self._norm(terms)), self.names[k]

    def _reach(self, found: np.ndarray) -> float:
        """At most the squared cosine of any span with these terms (their numbers, any of them several times)."""
        found = np.unique(found)
        size = self.ends[found + 1] - self.ends[found]
        at = np.arange(size.sum()) + np.repeat(self.ends[found] - np.cumsum(size) + size, size)
        return float(np.bincount(self.of[at], self.square[at]).max(initial=0.0))

    def runs_of(self, text: bytes | None) -> tuple[int, list[str]]:
        """Words of a text (0 if it has no notice), and the runs of words that may hold one, joined by spaces."""
        words = _word.findall(text.decode().lower()) if text else []
        if not words:
            return 0, []
        ids, m = _hash(words), len(words)
        at = np.minimum(np.searchsorted(self.terms, ids), len(self.terms) - 1)
        hit = self.terms[at] == ids
        least = LEAST * LEAST - 1e-9
        if not hit.any() or self._reach(at[hit]) < least:
            return 0, []
        runs: list[list[int]] = []
        for a in _blocks(words, self.span):
            b = min(m, a + 2 * self.span)
            own = np.concatenate([at[a:b][hit[a:b]], at[m + a : m + b - 1][hit[m + a : m + b - 1]]])
            if len(own) and self._reach(own) >= least:
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
        return (m if runs else 0), [" ".join(words[a:b]) for a, b in runs]

    def order(self, cosine: float, k: int) -> tuple[bool, float, int]:
        """What makes a span and template better than others: see the module's text; ties go to the first license by name."""
        good = cosine >= LEAST - 1e-12
        return good, round(cosine + (LONGER * log2(self.words[k]) if good else 0.0), 9), -k

    def best_span(self, words: list[str], more: dict[int, float] | None = None) -> tuple[float, str | None, int, tuple]:
        """The cosine of the best span of the words, its license, the words in it, and its place in the order. ``more``: weights of
        further terms."""
        top: tuple = (0.0, None, 0, (False, 0.0, -len(self.names)))
        for at in _blocks(words, self.span):
            floor = [min(LEAST, top[0])]
            for k, ends, cosine in self._spans(_hash(words[at : at + 2 * self.span]), more or {}, self.other, floor):
                i, j = divmod(int(np.argmax(np.round(cosine, 12))), len(ends))
                c = min(1.0, float(cosine[i, j]))
                if c > 0 and (place := self.order(c, k)) > top[3]:
                    top = c, self.names[k], int(ends[j] - ends[i] + 1), place
                    floor[0] = min(LEAST, c)
        return top

    def open_terms(self, words: list[str], cosine: float, place: tuple) -> set[int]:
        """Terms in no template that are in spans which, as a term weighs 1 at least, may come before one of that cosine and place
        in the order."""
        out: set[int] = set()
        good = place[0]
        least = [max(LEAST, place[1] - LONGER * log2(n)) if good else cosine for n in self.words]
        for at in _blocks(words, self.span):
            ids = _hash(words[at : at + 2 * self.span])
            m = (len(ids) + 1) // 2
            cover = np.zeros((2, m + 1), np.int64)  # of words, of word pairs
            for k, ends, cosines in self._spans(ids, {}, 1.0, [min(least) - 1e-9]):
                i, j = np.nonzero(cosines >= max(least[k] - 1e-9, 1e-9))
                np.add.at(cover[0], ends[i], 1), np.add.at(cover[0], ends[j] + 1, -1)
                np.add.at(cover[1], ends[i], 1), np.add.at(cover[1], ends[j], -1)
            within = np.cumsum(cover, axis=1) > 0
            out |= set(ids[np.concatenate([within[0, :m], within[1, : len(ids) - m]])].tolist()) - self.rows.keys()
        return out

    def _spans(self, ids: np.ndarray, more: dict[int, float], other: float, floor: list[float]) -> Iterator[tuple]:
        """Template, positions, and [start, end] cosines of the spans between those, for templates that can reach ``floor``."""
        m = (len(ids) + 1) // 2
        terms, place = np.unique(ids, return_inverse=True)
        bound: dict[int, float] = {}  # a span's cosine is at most the norm of what the template shares with all the words
        shares: dict[int, list] = {}
        for i, t in enumerate(terms.tolist()):
            for k, x in self.rows.get(t, ()):
                bound[k] = bound.get(k, 0.0) + x * x
                shares.setdefault(k, []).append((i, t, x))
        w = None
        for k in sorted(bound, key=lambda k: (-round(bound[k], 12), k)):
            if sqrt(bound[k]) < floor[0] - 1e-12:
                return
            if not self.needed[k] <= {t for _, t, _ in shares[k]}:
                continue
            if w is None:
                w = np.array([self.weight.get(t) or more.get(t, other) for t in terms.tolist()])[place]
                up, up2 = (np.concatenate([[0.0], np.cumsum(x * x)]) for x in (w[:m], w[m:]))
                # a repeated term adds twice its square for each pair of its places
                a1, b1, s1 = _repeats(ids[:m], w[:m] ** 2)
                a2, b2, s2 = _repeats(ids[m:], w[m:] ** 2)
                first, second, twice = np.concatenate([a1, a2]), np.concatenate([b1, b2 + 1]), np.concatenate([s1, s2])  # a word pair ends a word later
            share = np.zeros(len(terms))
            share[[i for i, _, _ in shares[k]]] = [x for _, _, x in shares[k]]
            v = share[place] * w
            ends = np.flatnonzero(v[:m])  # a best span starts and ends with words of the template
            if not len(ends):
                continue
            y = np.concatenate([[0.0], np.cumsum(v[m:])])
            x = np.concatenate([[0.0], np.cumsum(v[:m])])
            dot = (x[1:] + y)[ends][None, :] - (x[:-1] + y)[ends][:, None]
            length = ends[None, :] - ends[:, None] + 1
            fits = (length > 0) & (length <= 2 * self.words[k])
            for t in self.needed[k]:
                seen = np.concatenate([[0], np.cumsum(ids[:m] == U64(t))])
                fits &= seen[ends + 1][None, :] > seen[ends][:, None]
            n = len(ends)
            a, b = np.searchsorted(ends, first, "right") - 1, np.searchsorted(ends, second)
            inside = (a >= 0) & (b < n)
            pairs = np.bincount(a[inside] * n + b[inside], 2 * twice[inside], n * n).reshape(n, n)
            pairs = np.cumsum(np.cumsum(pairs, axis=1)[::-1], axis=0)[::-1]  # places at or after the start, at or before the end
            squares = (up[1:] + up2)[ends][None, :] - (up[:-1] + up2)[ends][:, None] + pairs
            yield k, ends, np.where(fits, dot, 0.0) / np.sqrt(np.where(length > 0, squares, 1.0))


def _blocks(words: list[str], span: int) -> range:
    return range(0, max(1, len(words) - span), span)


def _long(terms: list[int] | set[int]) -> list[int]:
    return np.array(sorted(terms), U64).view(np.int64).tolist()


def frequencies(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, n: how many of all texts have it, for the terms ``wanted``; only what may be one of these is shuffled."""
    on = wanted.select(F.col("term").bitwiseAND(F.lit(BITS - 1)).cast("int").alias("bit")).distinct().toArrow().column(0).to_numpy()
    bits = np.zeros(BITS, bool)
    bits[on] = True
    packed = np.packbits(bits).tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        for whole in batches:
            for batch in slices(whole, "text"):
                got = [np.empty(0, U64)]
                for text in column_of(batch, "text"):
                    if text:
                        h = _hash(_word.findall(text.decode().lower()))
                        got.append(np.unique(h[bits[h & U64(BITS - 1)]]))
                terms, n = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    counted = small_batches(base.select("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return materialize(counted.join(wanted.withColumnRenamed("term", "w").hint("merge"), F.col("term") == F.col("w"), "left_semi"), "frequencies")


def _counts(df: DataFrame) -> dict[int, int]:
    got = df.select("term", "n").toArrow()
    return dict(zip(got["term"].to_numpy().astype(np.int64).view(U64).tolist(), got["n"].to_pylist(), strict=True))


def best_notices(base: DataFrame, templates: dict[str, list[str]], hot_terms: int = HOT_TERMS) -> DataFrame:
    """doc_id, path, cosine, found (license or null), mostly (whether the notice is at least half of the text's words).

    Frequencies of the templates' terms come first. They give most notices their best span, whatever the other terms weigh; only
    for the others the terms that may decide are counted too.
    """
    result = f"doc_id {base.schema[0].dataType.simpleString()}, path string, cosine double, found string, mostly boolean"
    todo = "words long, runs array<string>, open array<long>"
    spark = base.sparkSession
    size = base.where(F.octet_length("text") > 0).count()
    own = spark.createDataFrame([(t,) for t in _long({t for texts in templates.values() for x in texts for t in _terms(x)})], "term long")
    counts = _counts(frequencies(base, own))
    first = Templates(templates, counts, size)

    def best(known: Templates, words: int, runs: list[str], more: dict[int, float]) -> tuple[float, str | None, bool, tuple]:
        top = max((known.best_span(run.split(" "), more) for run in runs), key=lambda x: x[3], default=(0.0, None, 0, (False, 0.0, 0)))
        return top[0], top[1], bool(top[1]) and 2 * top[2] >= words, top[3]

    def table(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.float64(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "path", "cosine", "found", "mostly", "words", "runs", "open"])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for words, runs in map(first.runs_of, column_of(batch, "text")):
                    *got, place = best(first, words, runs, {})
                    terms = set().union(*(first.open_terms(run.split(" "), got[0], place) for run in runs))
                    rows.append((*got, words, runs, _long(terms)) if terms else (*got, None, None, None))
                yield table(batch, rows)

    notices = materialize(small_batches(base).mapInArrow(begin, f"{result}, {todo}"), "notices")
    done, left = notices.where("open is null"), notices.where("open is not null")
    wanted = materialize(left.select(F.explode("open").alias("term")).distinct(), "terms")
    df = frequencies(base, wanted) if wanted.count() else wanted.withColumn("n", F.lit(0).cast("long"))
    hot = _counts(df.orderBy(F.desc("n"), "term").limit(hot_terms))
    known = Templates(templates, counts | hot, size)
    every = len(hot) < hot_terms

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for words, runs, terms in zip(*(batch.column(c).to_pylist() for c in ("words", "runs", "open")), strict=True):
                rare = [] if every else [t for t in terms if t % (1 << 64) not in hot]
                rows.append((0.0, None, False, words, runs, rare) if rare else (*best(known, words, runs, {})[:3], None, None, None))
            yield table(batch, rows)

    more = small_batches(left).mapInArrow(go_on, f"{result}, {todo}")
    names = ["doc_id", "path", "cosine", "found", "mostly"]
    if every:
        return done.select(*names).unionByName(more.select(*names))
    # equal notices are as many as have their rarest term, so no key is a crowd
    more = materialize(more, "rare").withColumn("key", F.sha2(F.array_join("runs", "\n"), 256))
    rest = more.where("open is not null")
    keyed = rest.select("key", F.explode("open").alias("t")).distinct()
    weights = keyed.join(df.hint("merge"), F.col("t") == F.col("term")).groupBy("key").agg(F.collect_list("term").alias("terms"), F.collect_list("n").alias("ns"))
    joined = rest.join(weights.withColumnRenamed("key", "k").hint("merge"), F.col("key") == F.col("k")).select("doc_id", "path", "words", "runs", "terms", "ns")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for words, runs, terms, ns in zip(*(batch.column(c).to_pylist() for c in ("words", "runs", "terms", "ns")), strict=True):
                weights = {t % (1 << 64): known.rarity(n) for t, n in zip(terms, ns, strict=True)}
                rows.append((*best(known, words, runs, weights)[:3], None, None, None))
            yield table(batch, rows)

    last = small_batches(joined).mapInArrow(finish, f"{result}, {todo}")
    return done.select(*names).unionByName(more.where("open is null").select(*names)).unionByName(last.select(*names))


def scan(df: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, least: float = LEAST, hot_terms: int = HOT_TERMS) -> DataFrame:
    """doc_id, path, license, cosine (of its own best notice), how (notice, file, inherited or null), from_dir.

    A null or empty text has no notice; a null path is in no directory, so it gives and inherits nothing; ties go to the first
    license by name, between files of a directory to the higher cosine; null ids stay null; repeated rows each give a row;
    other columns are ignored; an empty table gives an empty result.
    """
    base = df.select(df[id_col].alias("doc_id"), path.cast("string").alias("path"), df[text_col].cast("string").alias("text"))
    files = materialize(best_notices(base, templates or TEMPLATES, hot_terms), "licenses")  # narrow, and used three times below
    files = files.withColumn("own", F.when(F.col("cosine") >= least, F.col("found"))).withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))
    is_file = F.col("own").isNotNull() & (F.coalesce(F.regexp_extract("path", r"[^/]*$", 0).rlike(FILE_NAMES), F.lit(False)) | F.col("mostly")) & F.col("path").isNotNull()
    licensed = files.where(is_file).groupBy("dir").agg(F.min_by("own", F.struct(-F.round("cosine", 9), F.col("own"))).alias("given")).withColumnRenamed("dir", "at")
    dirs = files.where("own is null and path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    ups = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("up"))
    near = ups.join(licensed, F.col("up") == F.col("at")).groupBy("dir").agg(F.max_by(F.struct("given", "up"), F.length("up")).alias("from")).withColumnRenamed("dir", "d")
    out = files.join(near, F.col("own").isNull() & F.col("path").isNotNull() & (F.col("dir") == F.col("d")), "left")
    how = F.when(is_file, "file").when(F.col("own").isNotNull(), "notice").when(F.col("from").isNotNull(), "inherited")
    return out.select("doc_id", "path", F.coalesce("own", "from.given").alias("license"), F.round("cosine", 9).alias("cosine"), how.alias("how"), F.when(is_file, F.col("dir")).when(F.col("own").isNull(), F.col("from.up")).alias("from_dir"))
