"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Templates and texts are sequences of words (letters and digits, A-Z as a-z; punctuation and
comment marks do not count) and sets of five-word shingles. A template of t shingles is
sought in windows of 2L shingles at strides of L, where L is the least power of four not
below t and 8: wherever a copy of it stands, one window holds all of it. A window that
contains at least 0.8 of the shingles has Jaccard similarity J >= 0.8 t / (2L + 0.2 t), and
the number of bands of its length class is chosen so that it meets its template in a band
with probability `sure`: 1 - (1 - J) ** bands. What meets is verified exactly.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytehash import U, Hasher, mixed
from ._common import table, text_steps, tidy

SHINGLE, LEAST, SURE = 5, 0.8, 0.9999
STEP = 1 << 19
#: More bands than this are not used; a class of templates that would need them is split
#: by its shortest template.
MOST_BANDS = 512

#: How documents name a license, and the names that make a notice with each of these.
PHRASES = ("Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.")
NAMES = {
    "MIT": "MIT License", "ISC": "ISC License", "Apache-2.0": "Apache License, Version 2.0", "BSD": "BSD License", "BSD-3-Clause": "BSD 3-Clause License",
    "MPL-2.0": "Mozilla Public License, version 2.0", "GPL-3.0": "GNU General Public License, version 3", "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "AGPL-3.0": "GNU Affero General Public License, version 3", "CC-BY-4.0": "Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International License",
}
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
    "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version 3 of the License, "
    "or (at your option) any later version."
)
#: The texts that are sought, by license; a part of a license has its name behind a colon. A parameter of the scan.
TEMPLATES = {
    **{f"{k}:notice{i}": phrase.format(name) for k, name in NAMES.items() for i, phrase in enumerate(PHRASES)},
    "CC-BY-NC-4.0:notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0:short": "Licensed under CC BY 4.0.",
    "MIT:grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software."
    ),
    "MIT:disclaimer": _AS_IS,
    "BSD-2-Clause:terms": _BSD_TERMS,
    "BSD-3-Clause:terms": _BSD_TERMS + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD:disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC:grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ),
    "Zlib:terms": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented "
        "as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense:grant": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "BSL-1.0:grant": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "
        "\"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so"
    ),
    "Apache-2.0:header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0:header": _GNU_NOTICE.format("General Public License"),
    "LGPL-3.0:header": _GNU_NOTICE.format("Lesser General Public License"),
    "AGPL-3.0:header": _GNU_NOTICE.format("Affero General Public License"),
    "MPL-2.0:header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ),
}

LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _words(hasher: Hasher, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a buffer. Long buffers are hashed by steps
    that end between words."""
    gap = np.concatenate(([False], LETTER[data], [False]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + STEP, "right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        out.append(hasher.of(hasher.prefix(data[lo:hi]), starts[at:to] - lo, ends[at:to] - lo))
        at = to
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), starts, ends


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    if len(words) < k:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = h * U(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i]
    return mixed(h)


def _bands(n: int) -> list[np.uint64]:
    return [mixed(np.array([i + 1], np.uint64))[0] | U(1) for i in range(n)]


class Templates:
    """Templates by length class, with the tables of their bands."""

    def __init__(self, texts: dict[str, str], shingle: int = SHINGLE, least: float = LEAST, sure: float = SURE):
        hasher = Hasher(STEP + 1, 41, fold=True)
        self.shingle, self.least, self.names = shingle, least, list(texts)
        self.sets = [np.unique(_shingles(_words(hasher, np.frombuffer(t.encode(), np.uint8))[0], shingle)) for t in texts.values()]
        if any(not len(s) for s in self.sets):
            raise ValueError(f"a template needs {shingle} words at least")
        classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            width = 8
            while width < len(s):
                width *= 4
            classes.setdefault(width, []).append(i)
        self.classes = []
        for width, own in sorted(classes.items()):
            t = min(len(self.sets[i]) for i in own)
            hits = math.ceil(least * t - 1e-9)
            j = hits / (2 * width + t - hits)
            n = math.ceil(math.log(1 - sure) / math.log(1 - j))
            if n > MOST_BANDS:
                raise ValueError("the band setting does not reach the probability")
            tables = []
            for a in _bands(n):
                least_of = np.array([(self.sets[i] * a).min() for i in own], np.uint64)
                order = np.argsort(least_of, kind="stable")
                tables.append((a, least_of[order], np.array(own)[order]))
            self.classes.append((width, tables))

    def scan(self, shingles: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first and last shingle of the match, containment) of a text's verified matches."""
        out = []
        n = len(shingles)
        for width, tables in self.classes if n else ():
            blocks = np.arange(0, n, width)
            met: dict[int, set[int]] = {}
            for a, values, own in tables:
                low = np.minimum.reduceat(shingles * a, blocks)
                if len(low) > 1:
                    low = np.minimum(low[:-1], low[1:])
                for v, i in zip(values, own, strict=True):
                    for w in np.flatnonzero(low == v).tolist():
                        met.setdefault(int(i), set()).add(w)
            for i, windows in sorted(met.items()):
                sure = []  # positions of the template's shingles in verified windows
                for w in sorted(windows):
                    lo = w * width
                    hit = lo + np.flatnonzero(np.isin(shingles[lo : lo + 2 * width], self.sets[i]))
                    if len(np.unique(shingles[hit])) / len(self.sets[i]) >= self.least - 1e-12:
                        sure.append(hit)
                if sure:
                    out += [(i, *m) for m in self._copies(shingles, np.unique(np.concatenate(sure)), len(self.sets[i]), 2 * width)]
        return out

    def best(self, found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """Of matches of one license (the name before the colon) that overlap, the one of greatest containment, then the shorter,
        then that of the first template. Matches of different licenses stand side by side."""
        out: dict[str, list[tuple[int, int, int, float]]] = {}
        for m in sorted(found, key=lambda m: (-m[3], m[2] - m[1], m[0], m[1])):
            own = out.setdefault(self.names[m[0]].split(":")[0], [])
            k = bisect_left(own, m[1], key=lambda o: o[1])  # those kept lie apart, in order of place
            if not (k < len(own) and own[k][1] <= m[2]) and not (k and own[k - 1][2] >= m[1]):
                own.insert(k, m)
        return sorted(m for own in out.values() for m in own)

    def _copies(self, shingles: np.ndarray, at: np.ndarray, size: int, reach: int) -> list[tuple[int, int, float]]:
        """(first, last, containment) of a template's copies among its shingles' positions: a copy
        ends where a gap is longer than a window, or where a shingle returns that it has, once it has enough."""
        out, seen, first, last = [], set(), 0, 0

        def close():
            if len(seen) / size >= self.least - 1e-12:
                out.append((first, last, len(seen) / size))

        for p, h in zip(at.tolist(), shingles[at].tolist(), strict=True):
            if seen and (p - last > reach or (h in seen and len(seen) / size >= self.least - 1e-12)):
                close()
                seen = set()
            if not seen:
                first = p
            seen.add(h)
            last = p
        close()
        return out


def scan(df: DataFrame, templates: dict[str, str] | None = None, shingle: int = SHINGLE, least: float = LEAST, sure: float = SURE, doc_id: str = "doc_id", text: str = "text", every: bool = False) -> DataFrame:
    """doc_id, license, containment, start, end: a row for each place of an input row's text that
    holds at least `least` of a template's shingles; start and end are the byte range from the
    first to the last of them there. Where several templates of one license meet in a place, the best
    one is told; every: all of them.

    Null and empty texts, and those of fewer words than a shingle, match nothing. Whole texts
    are scanned. Repeated rows are scanned each for itself. Other columns are ignored. The templates are a
    parameter and go with the function to the workers.
    """
    known = Templates(templates or TEMPLATES, shingle, least, sure)
    src = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(STEP + 1, 41, fold=True)
        # a text without any shingle of a template matches none
        inside = np.unique(np.concatenate(known.sets))
        for batch in text_steps(batches):
            rows, cols = [], [[], [], [], []]
            for no, t in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words, starts, ends = _words(hasher, np.frombuffer(t or b"", np.uint8))
                grams = _shingles(words, known.shingle)
                at = np.minimum(np.searchsorted(inside, grams), len(inside) - 1)
                if not (inside[at] == grams).any():
                    continue
                found = known.scan(grams)
                for i, first, last, share in found if every else known.best(found):
                    rows.append(no)
                    for c, v in zip(cols, (known.names[i], share, int(starts[first]), int(ends[last + known.shingle - 1])), strict=True):
                        c.append(v)
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["doc_id", "license", "containment", "start", "end"])

    return src.mapInArrow(tidy(run), f"doc_id {kind}, license string, containment double, start long, end long")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in `documents`: doc_id, license, containment, start, end."""
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))
