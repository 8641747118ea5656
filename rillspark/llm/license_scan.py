"""License scans by patience alignment of texts with license templates.

Words that occur once in the text and once in the template are anchors; the longest run of anchors in the same order in both
(a longest increasing subsequence) is kept, and each gap between neighbours is aligned in the same way, with the words that
are unique there.  A template's coverage is the share of its words that are aligned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

#: The least coverage of a template that counts as found.
LEAST_COVERAGE = 0.8
#: Templates of fewer words may miss one word at most.
SHORT = 20

# Short notices, the opening grants of common licenses, and the whole texts of the short ones.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (header)": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "MIT": "Released under the MIT License.",
    "MIT (grant)": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions:""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 (notice)": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met:""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "MIT (text)": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause (text)": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
        THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause (text)": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
        THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC (text)": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
        ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS SOFTWARE.""",
}

#: What names the license: phrases of a template, and those of their words that have to be aligned.  A phrase takes no more
#: words of the text than of the template, so that nothing (Lesser, NonCommercial, another version) stands in between.
_APACHE = (("apache license version 2.0", "apache license 2.0"),)
_GPL = (("gnu general public license", "gnu general public license"), ("version 3", "version 3"))
NAMES = {
    "Apache-2.0": _APACHE,
    "Apache-2.0 (header)": _APACHE,
    "MIT": (("mit license", "mit license"),),
    "GPL-3.0": _GPL,
    "GPL-3.0 (notice)": (("gnu general public license", "gnu general public license"), ("either version 3", "version 3")),
    "MPL-2.0": (("mozilla public license v 2.0", "mozilla public license 2.0"),),
    "CC-BY-4.0": (("creative commons attribution 4.0", "creative commons attribution 4.0"),),
    "CC-BY-NC-4.0": (("cc by-nc 4.0", "cc by-nc 4.0"),),
    "CC-BY-SA-4.0": (("cc by-sa 4.0", "cc by-sa 4.0"),),
    "BSD-3-Clause (text)": (("endorse or promote products", "endorse promote products"),),
}


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence of distinct values, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    below = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[pile], piles[pile] = v, i
        below[i] = piles[pile - 1] if pile else -1
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def _single(words: list[str], low: int, high: int) -> dict[str, int]:
    count = Counter(words[low:high])
    return {w: i for i, w in enumerate(words[low:high], low) if count[w] == 1}


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions of equal words, increasing in both: patience alignment, with a stack in place of recursion."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        ours, theirs = _single(text, a, b), _single(template, c, d)
        shared = sorted((theirs[w], i) for w, i in ours.items() if w in theirs)
        kept = [shared[k] for k in longest_increasing([i for _, i in shared])]
        if not kept:  # no anchor: equal words at the ends still align
            while a < b and c < d and text[a] == template[c]:
                out.append((a, c))
                a, c = a + 1, c + 1
            while a < b and c < d and text[b - 1] == template[d - 1]:
                b, d = b - 1, d - 1
                out.append((b, d))
            continue
        for j, i in kept:
            out.append((i, j))
        edges = [(a - 1, c - 1), *((i, j) for j, i in kept), (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, words_of(text)
        self.count = Counter(self.words)
        self.distinct = set(self.words)
        self.names = []
        for phrase, needed in NAMES.get(name, ()) if TEMPLATES.get(name) == text else ():
            p = words_of(phrase)
            first = next(i for i in range(len(self.words)) if self.words[i : i + len(p)] == p)
            self.names.append([first + k for k, w in enumerate(p) if w in words_of(needed)])
        self.reach = 2 * len(self.words) + 8

    def seeds(self, where: dict[str, list[int]]) -> list[str]:
        """Of the template's words at most a fifth may be missing, so one of its rarest ones stands in any hit."""
        missing = len(self.words) - int(-(-LEAST_COVERAGE * len(self.words) // 1))
        out, covered = [], 0
        for w in sorted(self.distinct, key=lambda w: len(where.get(w, ()))):
            if w in where:
                out.append(w)
            covered += self.count[w]
            if covered > missing:
                break
        return out

    def places(self, text: list[str], where: dict[str, list[int]]) -> list[tuple[int, int]]:
        """Stretches of the text that hold enough of the template's words: nothing outside can reach the least coverage."""
        rare = min(self.distinct & where.keys(), key=lambda w: len(where[w]), default=None)
        if rare is None or sum(w in where for w in self.words) < LEAST_COVERAGE * len(self.words):
            return []
        seeds = [at for w in self.seeds(where) for at in where[w]]
        out: list[tuple[int, int]] = []
        for at in sorted(seeds):
            low, high = max(0, at - self.reach), min(len(text), at + self.reach)
            if out and low <= out[-1][1]:
                out[-1] = (out[-1][0], high)
            else:
                out.append((low, high))
        return out

    def find(self, text: list[str], where: dict[str, list[int]]) -> tuple[float, int, int] | None:
        """The best coverage with the first and last aligned word, if it is enough."""
        best = None
        for low, high in self.places(text, where):
            found = self.within(text, low, high)
            if found is None or found[0] < 1:  # a notice that stands twice has no word once: each one is looked at alone
                found = max([f for f in (found, *self.alone(text, where, low, high)) if f], key=lambda f: f[0], default=None)
            if found and (best is None or found[0] > best[0]):
                best = found
        return best

    def within(self, text: list[str], low: int, high: int) -> tuple[float, int, int] | None:
        pairs = align(text[low:high], self.words)
        if pairs and pairs[-1][0] - pairs[0][0] > self.reach:
            pairs = densest(pairs, self.reach)
        coverage = len(pairs) / len(self.words)
        enough = coverage >= LEAST_COVERAGE and (len(self.words) >= SHORT or len(pairs) >= len(self.words) - 1)
        return (coverage, low + pairs[0][0], low + pairs[-1][0]) if enough and self.named(pairs) else None

    def named(self, pairs: list[tuple[int, int]]) -> bool:
        at = {j: i for i, j in pairs}
        return all(all(j in at for j in needed) and at[needed[-1]] - at[needed[0]] <= needed[-1] - needed[0] for needed in self.names)

    def alone(self, text: list[str], where: dict[str, list[int]], low: int, high: int) -> Iterator[tuple[float, int, int] | None]:
        """Windows of about the template's length, where it has to begin for one of its rare words to be in place."""
        n, begins = len(self.words), set()
        for w in self.seeds(where):
            for at in where[w][bisect_left(where[w], low) : bisect_left(where[w], high)]:
                begins |= {at - i for i, own in enumerate(self.words) if own == w}
        for slack in (n // 4 + 2, n + 4):
            for at in sorted(begins):
                a, b = max(low, at - slack), min(high, at + n + slack)
                if (self.count & Counter(text[a:b])).total() >= LEAST_COVERAGE * n:
                    yield self.within(text, a, b)


def densest(pairs: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """The most pairs whose text positions lie within ``reach``."""
    best, low = (0, 0), 0
    for high in range(len(pairs)):
        while pairs[high][0] - pairs[low][0] > reach:
            low += 1
        best = max(best, (high - low + 1, -low))
    return pairs[-best[1] : -best[1] + best[0]]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, license, coverage, matches)``, a row for each row of ``docs``.

    ``matches`` are ``(license, coverage, first_word, last_word)`` for all templates found, in the templates' order; license is
    the one that covers most words, of equal ones the first.  Null, empty and unlicensed texts have a null license, coverage 0
    and no matches.  The whole text is read, however long.  Nothing is compared between rows: null ids and repeated rows get a row
    each, an empty table gives an empty one, and other columns are left out, so their names can't clash.
    """
    kind = "struct<license:string,coverage:double,matches:array<struct<license:string,coverage:double,first_word:int,last_word:int>>>"
    match = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32())])
    compiled = [Template(*t) for t in templates.items()]
    vocabulary = set().union(*(t.distinct for t in compiled)) if compiled else set()

    def scan_text(text: str | None) -> list[dict]:
        words = words_of(text or "")
        where: dict[str, list[int]] = {}
        if vocabulary.isdisjoint(words):
            return []
        for i, w in enumerate(words):
            if w in vocabulary:
                where.setdefault(w, []).append(i)
        found = [(t, t.find(words, where)) for t in compiled]
        return [{"license": t.name, "coverage": f[0], "first_word": f[1], "last_word": f[2], "size": len(t.words)} for t, f in found if f]

    @F.arrow_udf(kind)
    def of(texts: pa.Array) -> pa.Array:
        rows = [scan_text(t.as_py()) for t in texts]
        best = [max(r, key=lambda m: m["coverage"] * m["size"]) if r else None for r in rows]
        return pa.StructArray.from_arrays(
            [
                pa.array([b and b["license"] for b in best], pa.string()),
                pa.array([b["coverage"] if b else 0.0 for b in best], pa.float64()),
                pa.array([[{k: m[k] for k in ("license", "coverage", "first_word", "last_word")} for m in r] for r in rows], pa.list_(match)),
            ],
            ["license", "coverage", "matches"],
        )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), of(F.col(text_col).cast("string")).alias("m")).select("doc_id", "m.*")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "license", "coverage", F.size("matches").alias("n_matches"), F.col("license").isNotNull().alias("licensed")
    )
