"""License scan: Dice coefficient over word bigrams against templates, with size bounds pruning."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.llm.common import LOWER_ALNUM, table

#: Notices and texts as their licences publish them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY "
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
        "the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
        "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
        "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF "
        "SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
        "the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone "
        "to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment "
        "in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
        "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or "
        "in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS "
        "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT "
        "SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
)
#: Least Dice coefficient of a match.
THRESHOLD = 0.8
_BLOCK_END = re.compile(r"\n[ \t\r]*\n")
#: The words of LOWER_ALNUM.
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def bigrams(text: str) -> set[tuple[bytes, bytes]]:
    """Distinct pairs of neighbouring words of the normalised text (letters and digits, A-Z lower-cased)."""
    w = text.encode().translate(LOWER_ALNUM).split()
    return set(zip(w, w[1:], strict=False))


def units(text: str, matcher: Matcher | None = None) -> Iterator[tuple[int, int]]:
    """Spans in code points of what is compared: every line, every block between empty lines that has several lines, the whole text, and the matcher's passages."""
    spans = {}
    at = 0
    for line in text.split("\n"):
        spans[at, at + len(line)] = None
        at += len(line) + 1
    at = 0
    for m in _BLOCK_END.finditer(text):
        spans[at, m.start()] = None
        at = m.end()
    if at:
        spans[at, len(text)] = None
    spans[0, len(text)] = None
    matcher = matcher or _published()
    if found := matcher.passages(text):
        known = [(*span, hit[1]) for span in spans if (hit := matcher.best(bigrams(text[slice(*span)])))]
        for start, end in found:
            name = matcher.best(bigrams(text[start:end]))[1]
            if not any(a <= start and end <= b and name == n for a, b, n in known):
                spans[start, end] = None
    yield from spans


class Matcher:
    """Templates by the bigrams they hold. A template can only reach the threshold with units of sizes within t / (2 - t) of its own, either way."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        self.names, sets = [n for n, _ in templates], [bigrams(t) for _, t in templates]
        self.sizes, self.threshold = [len(s) for s in sets], threshold
        self.holders: dict[tuple[bytes, bytes], list[int]] = {}
        for i, s in enumerate(sets):
            for b in s:
                self.holders.setdefault(b, []).append(i)
        self.most = max((n * (2 - threshold) / threshold for n in self.sizes), default=0)

    def best(self, unit: set) -> tuple[float, str, int] | None:
        if not unit or len(unit) > self.most:
            return None
        shared = Counter(i for b in unit & self.holders.keys() for i in self.holders[b])
        found = None
        for i, n in shared.items():
            if 2 * min(len(unit), self.sizes[i]) < self.threshold * (len(unit) + self.sizes[i]):
                continue
            dice = 2 * n / (len(unit) + self.sizes[i])
            if dice >= self.threshold and (found is None or (-dice, self.names[i], i) < (-found[0], found[1], found[2])):
                found = (dice, self.names[i], i)
        return found

    def passages(self, text: str) -> list[tuple[int, int]]:
        """Spans of runs of words, wherever lines and blocks end, that reach the threshold: from and to a bigram of the template, the best of those that overlap.

        Runs of other templates of one licence may overlap; of two licences the better stays.
        """
        shared = Counter(i for b in bigrams(text) & self.holders.keys() for i in self.holders[b])
        near = [i for i, n in shared.items() if 2 * n / (n + self.sizes[i]) >= self.threshold]
        if not near:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b].encode().translate(LOWER_ALNUM) for a, b in spans]
        pairs = list(zip(words, words[1:], strict=False))
        found = [(-dice, -n, at, end, self.names[i], i) for i in near for dice, n, at, end in self._runs(pairs, i)]
        kept: list[tuple] = []
        # what stands is looked up by word, so that many runs cost no more than their lengths
        over: dict[int, list[tuple]] = {}
        for run in sorted(found):
            _, _, at, end, name, i = run
            if not any(o[4] != name or o[5] == i for k in range(at, end + 2) for o in over.get(k, ())):
                kept.append(run)
                for k in range(at, end + 2):
                    over.setdefault(k, []).append(run)
        return sorted({(spans[at][0], spans[end + 1][1]) for _, _, at, end, *_ in kept})

    def _runs(self, pairs: list[tuple[bytes, bytes]], i: int) -> Iterator[tuple[float, int, int, int]]:
        """(dice, shared, first pair, last pair) of the best run from each pair of template i that reaches the threshold.

        A run goes no further than to its first pair's next occurrence, as the run without the first is no worse from there on.
        """
        size, t = self.sizes[i], self.threshold
        hit = [i in self.holders.get(p, ()) for p in pairs]
        for at in (k for k, h in enumerate(hit) if h):
            seen, n, best = {pairs[at]}, 1, (2 / (1 + size), 1, at)
            for end in range(at + 1, len(pairs)):
                p = pairs[end]
                if p == pairs[at] or 2 * size / (len(seen) + size) < t:
                    break
                if p in seen:
                    continue
                seen.add(p)
                n += hit[end]
                if hit[end] and 2 * n / (len(seen) + size) > best[0]:
                    best = (2 * n / (len(seen) + size), n, end)
            if best[0] >= t:
                yield best[0], best[1], at, best[2]


@cache
def _published() -> Matcher:
    return Matcher(TEMPLATES, THRESHOLD)


_SCHEMA = "doc_id bigint, matches array<struct<start:bigint,end:bigint,license:string,template:int,dice:double>>"
_MATCH = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("template", pa.int32()), ("dice", pa.float64())])


def _scan(templates: tuple[tuple[str, str], ...], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for batch in batches:
            out = []
            for text in batch.column(1):
                text, found = text.as_py() or "", []
                for start, end in units(text, matcher):
                    if hit := matcher.best(bigrams(text[start:end])):
                        found.append({"start": start, "end": end, "license": hit[1], "template": hit[2], "dice": hit[0]})
                out.append(sorted(found, key=lambda m: (m["start"], m["end"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(_MATCH))], names=["doc_id", "matches"])

    return run


def license_matches(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) -> doc_id and ``matches``: start, end (code points), license, template number, dice; by start, then end.

    Every line, block, whole text and passage (a run of words anywhere, across lines and blocks or inside a line) is compared with every template whose size and bigrams allow the threshold, and
    matches its best one (ties: by name, then number). Null and empty texts, and units of fewer than two words, match nothing. Rows that
    repeat a doc_id are scanned each; other columns are ignored. Row by row: no shuffle. The templates are code, so small.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan(tuple(templates), threshold), _SCHEMA)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_matches(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"), F.get("matches", F.lit(0)).isNotNull().alias("licensed"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"), F.array_max("matches.dice").alias("best_dice"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))), ",").alias("spans"),
    )
