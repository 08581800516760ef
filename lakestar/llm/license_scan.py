"""License scan by patience alignment of texts with license templates.

Words unique to both text window and template are anchors; the longest increasing subsequence
of the anchors (by template place) fixes an alignment, and the gaps between anchors are
aligned the same way, down to gaps without unique common words, whose equal ends are matched.
Coverage is the share of template words aligned.  Windows of two template lengths slide over
the places where enough of the template's words stand together, so a license is found
anywhere in a text of any length, and as often as it occurs.  A window that starts at an
earlier common word may cut the license: of the windows that start inside a match, the one of
best coverage (then of shortest span) tells its place.

Defined cases: null and empty texts have no license (null, coverage 0); repeated rows are each
scanned; among templates of equal coverage the longer one wins, then the alphabetically first;
a null id is carried through; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lakestar.llm.common import batches, id_and_text, ship, word_hashes

#: Least share of a template's words that must be aligned.
COVERAGE = 0.8

# Public license texts and the notices by which texts refer to them.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in "
        "all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in "
        "all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN "
        "NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "Licensed under the MIT License."),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
        "License for the specific language governing permissions and limitations under the "
        "License.",
        "Licensed under the Apache License, Version 2.0."),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "This work is licensed under the GNU General Public License, version 3."),
    "CC-BY-NC-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
        "Licensed under CC BY-NC 4.0."),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. Neither the name of the copyright holder nor "
        "the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. Neither the name of the copyright holder nor "
        "the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
        "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT "
        "OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
        "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Licensed under the BSD 3-Clause License."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "LGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
        "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT "
        "OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
        "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If "
        "a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0",),
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License.",),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free "
        "to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event "
        "will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: The origin of this software must not be misrepresented; you "
        "must not claim that you wrote the original software. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. "
        "This notice may not be removed or altered from any source distribution.",),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a "
        "copy of the software and accompanying documentation covered by this license (the "
        "\"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
        "and to prepare derivative works of the Software, and to permit third-parties to whom "
        "the Software is furnished to do so, all subject to the following.",),
}

# For each template: words that its span must hold (one of those joined by |), and words of
# other licenses that it must not hold.  Headers that differ in a few words need them as well.
NAMING = {
    "MIT": (("", ""), ("", ""), ("mit", ""), ("mit", "")),
    "Apache-2.0": (("", ""), ("apache 2", "")),
    "GPL-3.0": (("general 3", "lesser affero library"), ("gnu|gpl 3", "lesser affero library")),
    "CC-BY-NC-4.0": (("noncommercial|commercial 4", "sharealike alike noderivatives derivatives"),
                     ("cc by nc 4", "sa nd")),
    "CC-BY-4.0": (("attribution 4",
                   "noncommercial commercial sharealike alike noderivatives derivatives"),
                  ("cc by 4", "nc sa nd")),
    "BSD-3-Clause": (("endorse|promote", ""), ("endorse|promote", ""), ("bsd 3 clause", "")),
    "GPL-2.0": (("general 2", "lesser affero library"),),
    "LGPL-2.1": (("lesser 2", ""),),
    "LGPL-3.0": (("lesser 3", ""),),
    "AGPL-3.0": (("affero 3", ""),),
    "BSD-2-Clause": (("", "endorse promote"),),
    "MPL-2.0": (("mozilla 2", ""),),
    "EPL-2.0": (("eclipse 2", ""),),
    "CC-BY-SA-4.0": (("sharealike|alike 4", "noncommercial commercial noderivatives derivatives"),),
}


def _rising(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence (patience piles with back links)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[pile], piles[pile] = v, i
        back.append(piles[pile - 1] if pile else -1)
    out = []
    at = piles[-1] if piles else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned (text place, template place) pairs, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {template[j]: j for j in range(c, d) if there[template[j]] == 1}
        anchors = [(i, place[text[i]]) for i in range(a, b)
                   if here[text[i]] == 1 and text[i] in place]
        anchors = [anchors[k] for k in _rising([j for _, j in anchors])]
        out += anchors
        if anchors:
            for (i, j), (x, y) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
                todo.append((i + 1, x, j + 1, y))
    return sorted(out)


class Template:
    """One template as word numbers of the scanner's vocabulary."""

    def __init__(self, name: str, words: list[int], vocabulary: int, naming: tuple[str, str]):
        self.name, self.words, self.size = name, words, len(words)
        self.named = [set(word_hashes(w.replace("|", " ")).tolist()) for w in naming[0].split()]
        self.barred = set(word_hashes(naming[1]).tolist())
        self.share = np.bincount(words, minlength=vocabulary)
        self.known = np.append(self.share > 0, False)

    def matches(self, numbers: np.ndarray, least: float) -> Iterator[list[int]]:
        """Places of the aligned words of each occurrence, left to right."""
        need = int(np.ceil(least * self.size - 1e-9))
        here = self.known[numbers]
        # Enough template words must stand within two template lengths.
        reach = 2 * self.size
        sums = np.concatenate([[0], np.cumsum(here)])
        starts = np.flatnonzero(here)
        starts = starts[sums[np.minimum(starts + reach, len(numbers))] - sums[starts] >= need]
        at = 0
        while at < len(starts):
            best = self._aligned(numbers, int(starts[at]))
            if len(best) < need:
                at += 1
                continue
            found = set(best)
            for s in starts[at + 1:int(np.searchsorted(starts, best[-1] + 1))].tolist():
                if best[-1] - best[0] + 1 == len(best) == self.size:
                    break  # verbatim
                other = self._aligned(numbers, s)
                # An occurrence that follows shares few words with this one.
                if ((len(other), best[-1] - best[0]) > (len(best), other[-1] - other[0] if other else 0)
                        and 2 * len(found.intersection(other)) >= len(found)):
                    best = other
            yield best
            at = max(at + 1, int(np.searchsorted(starts, best[-1] + 1)))

    def names(self, span: np.ndarray) -> bool:
        """Whether the words of a match name this license and no other."""
        held = set(span.tolist()) if self.named or self.barred else set()
        return all(held & one for one in self.named) and not held & self.barred

    def _aligned(self, numbers: np.ndarray, start: int) -> list[int]:
        window = numbers[start:start + 2 * self.size].tolist()
        return [start + i for i, _ in align(window, self.words)]


class Scanner:
    """All templates over one vocabulary of word hashes."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = COVERAGE,
                 naming: dict[str, tuple[tuple[str, str], ...]] = NAMING):
        hashed = [(name, word_hashes(t), how) for name, ts in templates.items()
                  for t, how in zip(ts, naming.get(name, (("", ""),) * len(ts)), strict=True)]
        self.vocabulary = np.unique(np.concatenate([h for _, h, _ in hashed]))
        size = len(self.vocabulary)
        self.least = least
        self.templates = [Template(n, np.searchsorted(self.vocabulary, h).tolist(), size, how)
                          for n, h, how in hashed]
        self.shares = np.array([t.share for t in self.templates])
        self.needs = np.array([least * t.size for t in self.templates]) - 1e-9

    def scan(self, text: str) -> list[tuple]:
        """(license, coverage, aligned words, first word, end word), best first."""
        hashes = word_hashes(text)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        numbers = np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary))
        present = np.bincount(numbers, minlength=len(self.vocabulary) + 1)[:-1]
        # No alignment can cover more words than text and template share.
        bound = np.minimum(self.shares, present).sum(axis=1)
        found = [(t, m) for t, b, need in
                 zip(self.templates, bound, self.needs, strict=True) if b >= need
                 for m in t.matches(numbers, self.least)]
        found = [m for m in found if m[0].names(hashes[m[1][0]:m[1][-1] + 1])]
        found.sort(key=lambda m: (-len(m[1]) / m[0].size, -m[0].size, m[0].name, m[1][0]))
        kept: list[tuple] = []
        spans: list[set[int]] = []
        for t, m in found:
            if any(2 * len(better.intersection(m)) >= len(m) and min(better) <= m[0]
                   and m[-1] <= max(better) for better in spans):
                continue
            kept.append((t.name, len(m) / t.size, len(m), m[0], m[-1] + 1))
            spans.append(set(m))
        return kept


def scan_licenses(docs: DataFrame, least: float = COVERAGE) -> DataFrame:
    """One row per document: its best license, coverage, place, and all licenses found.

    ``first_word`` and ``end_word`` count the text's words.  One narrow pass, no shuffle.
    """
    ship(docs.sparkSession)
    columns = ["doc_id", "license", "coverage", "aligned", "first_word", "end_word", "licenses"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(least=least)
        for part in batches(frames, 512):
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                found = scanner.scan(text)
                best = found[0] if found else (None, 0.0, 0, None, None)
                rows.append((doc_id, *best, ",".join(sorted({m[0] for m in found}))))
            frame = pd.DataFrame(rows, columns=columns)
            yield frame.astype({"first_word": "Int64", "end_word": "Int64"})

    ids = docs.schema["doc_id"].dataType.simpleString()
    return id_and_text(docs).mapInPandas(
        run, f"doc_id {ids}, license string, coverage double, aligned long, "
             "first_word long, end_word long, licenses string")
