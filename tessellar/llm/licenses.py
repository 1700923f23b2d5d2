"""License scans: patience alignment of license texts and notices with documents.

Words that occur once in both texts anchor an alignment; the longest increasing run of anchors is kept, and the gaps
between them are aligned in the same way (after taking equal words at a gap's ends). Coverage is the share of the
template's words that are aligned.

A document is aligned in windows from its words that are telling for a template (in it, and not a common word) on. They
grow to the whole text, so text in between does not hide a license. Every place that reaches ``MIN_COVERAGE`` is
reported in ``places``, of every template, and the other columns have the best of them.

Results in the odd cases: null and empty texts have no license (null, coverage 0); of equal coverage the longer
template wins, then its name; every row is reported, rows that repeat too; an empty table gives an empty table; other
columns are never read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, small_batches, texts

MIN_COVERAGE = 0.8
DROP = b".,;:!?\"'()[]{}*#_<>`-"
FOLD = bytes(32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))
# fixed values: public license texts and notices
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
COMMON = frozenset(b"a an and any are as at be by do for from in is it may no not of on or other that the this to under use with you work all but either more see".split())
OUT = "doc_id bigint, license string, coverage double, n_matched bigint, n_words bigint, first_word bigint, last_word bigint, places array<struct<license:string,coverage:double,n_matched:bigint,n_words:bigint,first_word:bigint,last_word:bigint>>"


def folded(text: bytes) -> list[bytes]:
    return text.translate(FOLD, DROP).split()


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (in order of their first number) whose second number increases."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(y)
            piles.append(i)
        else:
            tops[k], piles[k] = y, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matched (position in a, position in b), both increasing. Gaps wait on a stack, so depth is no limit."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a.get(w) == 1}
        anchors = increasing([(i, once[w]) for i, w in enumerate(a[a0:a1], a0) if w in once])
        if anchors:
            out += anchors
            for (p, q), (r, s) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
                todo.append((p + 1, r, q + 1, s))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], min_coverage: float):
        self.min_coverage = min_coverage
        self.templates = {n: folded(t.encode()) for n, t in templates.items() if t.split()}
        self.telling: dict[bytes, list[str]] = {}
        for name, t in self.templates.items():
            for w in set(t) - COMMON or set(t):
                self.telling.setdefault(w, []).append(name)
        self.bags = {n: Counter(t) for n, t in self.templates.items()}
        self.known = {w for t in self.templates.values() for w in t}
        self.least = {n: max(1, sum(w not in COMMON for w in t) - int((1 - min_coverage) * len(t) + 1e-9)) for n, t in self.templates.items()}

    def candidates(self, name: str, words: list[bytes], at: list[int], reach: int) -> Iterator[tuple[int, ...]]:
        """(-matched, span, first, last, low, high) of alignments that reach the coverage, in windows of `reach` words
        from a telling word on and a template's length before it. Wide windows overlap by seven eighths."""
        t, least, bag, last = self.templates[name], self.least[name], self.bags[name], None
        for k in range(len(at) - least + 1):
            if at[k + least - 1] - at[k] >= reach or (last is not None and reach > 2 * len(t) and at[k] - last < reach // 8):
                continue
            last = at[k]
            low, high = max(0, at[k] - len(t)), at[k] + reach
            part = words[low:high]
            if (Counter(part) & bag).total() >= self.min_coverage * len(t):
                got = align(part, t)
                if len(got) >= self.min_coverage * len(t):
                    yield -len(got), got[-1][0] - got[0][0], low + got[0][0], low + got[-1][0], low, high

    def widened(self, name: str, words: list[bytes], at: list[int], place: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The place, or an alignment of more words: around it, as far as telling words are no further apart than the template is long."""
        t, (low, high) = self.templates[name], (place[0][0], place[-1][0])
        i, j = bisect_left(at, low), bisect_right(at, high)
        while i and low - at[i - 1] <= len(t):
            i -= 1
            low = at[i]
        while j < len(at) and at[j] - high <= len(t):
            high = at[j]
            j += 1
        low = max(0, low - len(t))
        got = align(words[low : high + len(t) + 1], t)
        return [(x + low, y) for x, y in got] if len(got) > len(place) else place

    def places(self, text: bytes) -> list[tuple]:
        """(name, coverage, matched, words, first, last) of every place of every template, best first.

        Windows grow from a place's usual length to the whole text, so a license that other text interrupts is found
        too; words of a place are taken out before the next window is looked at.
        """
        words, out = folded(text), []
        where: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            for n in self.telling.get(w, ()):
                where.setdefault(n, []).append(i)
        bag = Counter(w for w in words if w in self.known)
        for name, at in where.items():
            t, least = self.templates[name], self.least[name]
            if len(at) < least or (bag & self.bags[name]).total() < self.min_coverage * len(t):
                continue
            own, reach = words.copy(), len(t) + len(t) // 2
            while len(at) >= least:
                fresh, firsts, lasts = [], [], []
                for *_, first, last, low, high in sorted(self.candidates(name, own, at, reach)):
                    k = bisect_left(firsts, first)
                    if (k and lasts[k - 1] >= first) or (k < len(firsts) and firsts[k] <= last):
                        continue  # it overlaps a better one
                    firsts.insert(k, first)
                    lasts.insert(k, last)
                    fresh.append([(i + low, j) for i, j in align(own[low:high], t)])
                for got in fresh:
                    for i, _ in got:
                        own[i] = b""
                at = [i for i in at if own[i]]
                for got in fresh:
                    if len(got) < len(t):
                        for i, j in got:
                            own[i] = t[j]
                        got = self.widened(name, own, at, got)
                        for i, _ in got:
                            own[i] = b""
                    out.append((name, len(got) / len(t), len(got), len(t), got[0][0], got[-1][0]))
                at = [i for i in at if own[i]]
                if not fresh:
                    if reach >= len(words):
                        break
                    reach *= 2
        return sorted(out, key=lambda p: (-p[1], -p[3], p[0], p[4]))

    def scan(self, text: bytes) -> tuple | None:
        """(name, coverage, matched, words, first, last) of the best place in the text."""
        return next(iter(self.places(text)), None)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """A row a document: the best license found in it, if any covers min_coverage, with its place in words; and all places."""
    spark = docs.sparkSession
    small_batches(spark)
    scanner = Scanner(TEMPLATES if templates is None else templates, min_coverage)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in OUT.split(", ")]
        one = [pa.string(), pa.float64(), *[pa.int64()] * 4]
        place = pa.struct(list(zip(names[1:7], one, strict=True)))
        kinds = [pa.int64(), *one, pa.list_(place)]
        for b in batches:
            if b.num_rows:
                found = [scanner.places(x) for x in texts(b)]
                rows = [(*(p[0] if p else (None, 0.0, 0, None, None, None)), [dict(zip(names[1:7], q, strict=True)) for q in p]) for p in found]
                cols = [b.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True)]]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return columns(docs, "doc_id", "text").mapInArrow(run, OUT)


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumn("n_words", F.coalesce("n_words", F.lit(0)))
