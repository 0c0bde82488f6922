"""License scans: Dice coefficient over word bigrams between normalised text and licence templates.

A text is normalised to lower-case words of letters and digits; its word bigrams, as a multiset, are
compared with those of each template. Every window of a text is compared, of any length and over any
lines. Dice t between sizes a and b needs 2 min(a, b) >= t (a + b), which bounds the lengths; and a window
that begins or ends with a bigram of no use to the template is never better than the one without it, so
windows between bigrams of the template are all. A sliding window of the greatest length says how many
bigrams any window that begins at a place can have in common; places with too few for t, or for a better
match than the best so far, are passed over. Nothing is lost by that.

Each template has the best match in a text: the highest Dice coefficient of THRESHOLD or more, at the
first place. Defined cases: null and empty texts match nothing; ties go to the first place, then to the
template's order; repeated rows and null ids are rows of their own; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

THRESHOLD = 0.8

# Notices and licence texts.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        'documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" '
        "AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
        "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain '
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See '
        "the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, "
        "see https://www.gnu.org/licenses/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}

#: ASCII upper case to lower case, other ASCII but letters and digits to a space; bytes beyond ASCII stay.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 10 if c == 10 else 32 for c in range(256))


def normal_lines(text: str) -> list[list[bytes]]:
    return [line.split() for line in text.encode("utf-8", "surrogatepass").translate(_NORMAL).split(b"\n")]


def dice(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    total = sum(a.values()) + sum(b.values())
    return 2 * both / total if total else 0.0


def bigrams(words: list) -> Counter:
    return Counter(zip(words, words[1:]))


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold, self.names, self.grams, self.sizes = threshold, [], [], []
        self.words: dict[bytes, int] = {}
        for name, text in templates.items():
            words = [w for line in normal_lines(text) for w in line]
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words]
            self.names.append(name)
            self.grams.append(bigrams(ids))
            self.sizes.append(len(ids) - 1)
        self.holders: dict[tuple[int, int], list[int]] = {}
        for t, grams in enumerate(self.grams):
            for g in grams:
                self.holders.setdefault(g, []).append(t)

    def _bounded(self, a: int, b: int) -> bool:
        return 2 * min(a, b) >= self.threshold * (a + b)

    def scan(self, text: str | None) -> list[dict]:
        """Best match of each template with Dice of threshold or more: licence, dice, place (word number), length in words.

        Only of the whole text, lines and windows of a template's own length; the query runs search().
        """
        lines = normal_lines(text or "")
        get = self.words.get
        ids = [get(w, 0) for line in lines for w in line]  # 0: a word of no template
        places = [i for i, (a, b) in enumerate(zip(ids, ids[1:])) if a and b and (a, b) in self.holders]
        if not places:
            return []
        hits: dict[int, list[int]] = {}
        for i in places:
            for t in self.holders[ids[i], ids[i + 1]]:
                hits.setdefault(t, []).append(i)
        spans = {(0, len(ids))}
        at = 0
        for line in lines:
            spans.add((at, at + len(line)))
            at += len(line)
        out = []
        for t in sorted(hits):
            size, where = self.sizes[t], hits[t]
            # a unit of u bigrams must share threshold * (u + size) / 2 with the template, and u >= size * threshold / (2 - threshold)
            if len(where) < size * self.threshold / (2 - self.threshold):
                continue
            mark = [0] * len(ids)
            for i in where:
                mark[i] = 1
            upto = [0, *accumulate(mark)]
            windows = {(max(0, min(i, len(ids) - size - 1)), min(len(ids), max(0, min(i, len(ids) - size - 1)) + size + 1)) for i in where}
            best = None
            for a, b in sorted(spans | windows):
                u = b - a - 1
                if u < 1 or not self._bounded(u, size) or 2 * (upto[b - 1] - upto[a]) < self.threshold * (u + size):
                    continue
                d = dice(bigrams(ids[a:b]), self.grams[t])
                if d >= self.threshold and (best is None or d > best[0]):
                    best = (d, a, b - a)
            if best:
                out.append({"licence": self.names[t], "dice": best[0], "place": best[1], "length": best[2]})
        return out


    def search(self, text: str | None) -> list[dict]:
        """As scan(), over windows of every length."""
        ids = [self.words.get(w, 0) for line in normal_lines(text or "") for w in line]
        hits: dict[int, list[int]] = {}
        for i, (a, b) in enumerate(zip(ids, ids[1:])):
            if a and b:
                for t in self.holders.get((a, b), ()):
                    hits.setdefault(t, []).append(i)
        out = []
        for t in sorted(hits):
            if len(hits[t]) >= self.sizes[t] * self.threshold / (2 - self.threshold) - 1e-9:
                best = self._best_window([(ids[i], ids[i + 1]) for i in hits[t]], hits[t], t)
                if best:
                    out.append({"licence": self.names[t], "dice": best[0], "place": best[1], "length": best[2]})
        return out

    def _best_window(self, grams: list[tuple[int, int]], where: list[int], t: int) -> tuple | None:
        """(dice, place, length in words) of the best window; grams of the template at the places where, in order."""
        size, most = self.sizes[t], self.grams[t]
        longest = int(size * (2 - self.threshold) / self.threshold + 1e-9)
        inside: Counter = Counter()
        common, end, best = 0, 0, None
        for start, first in enumerate(where):
            while end < len(where) and where[end] - first < longest:
                g = grams[end]
                inside[g] += 1
                common += inside[g] <= most[g]
                end += 1
            # a window from here has at most `common` in common, and is as long at least
            bound = 2 * common / (common + size)
            if bound >= self.threshold and (best is None or bound > best[0]):
                seen: Counter = Counter()
                both = 0
                for g, at in zip(grams[start:end], where[start:end]):
                    seen[g] += 1
                    if seen[g] > most[g]:
                        continue  # no gain
                    both += 1
                    u = at - first + 1
                    d = 2 * both / (u + size)
                    if d >= self.threshold and (best is None or d > best[0]):
                        best = (d, first, u + 1)
            g = grams[start]
            common -= inside[g] <= most[g]
            inside[g] -= 1
        return best


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) to (doc_id, licence, dice, matches): the best match, null without any, and all of them."""

    def make(rows):
        scanner = Scanner(threshold=threshold)
        for r in rows:
            found = scanner.search(r["text"])
            best = max(found, key=lambda m: m["dice"], default={"licence": None, "dice": None})
            yield {"doc_id": r["doc_id"], "licence": best["licence"], "dice": best["dice"], "matches": found}

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, licence string, dice double, matches array<struct<licence:string,dice:double,place:int,length:int>>")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
