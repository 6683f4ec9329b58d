"""License scans (operator 9): passages compared with licence templates by the Dice coefficient of word bigrams.

Text and templates are normalised to lower-case words of letters and digits.  Every bigram of a text that
belongs to a template proposes where that template would begin; proposals close together form a candidate
passage, from its first to its last such bigram.  If Dice reaches ``least``, the sizes of both bigram sets differ
by at most the factor (2 - least) / least: templates that passage size or the number of proposals rule out
are pruned, and only the rest are compared.  Proposals are grouped by small and by large shifts, and of a group also
its densest part is a candidate, as common bigrams around a licence join its group.  So a licence is found as a
whole file, a header, a line, or within a line of other text.

A passage that names versions must name one of its template's, and one that names a variant of a licence far more
often than the template (the AGPL's full text, say, which is not held) does not match.  Of templates that match one passage (each span
holding more than half of the other) the best is returned, so a version or variant does not pass for another.

Nulls count as empty texts; rows are independent, so repeated rows give repeated results and an empty table
gives an empty one.  Of equal matches all are returned, of overlapping ones with one template the best, the first of ties."""

from __future__ import annotations

import pkgutil
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.llm.common import byte_texts, code_point_offsets, map_arrow

LEAST = 0.8

# Public licence texts and notices.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software. """ + _AS_IS,
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{_BSD_CONDITIONS} {_BSD_THIRD} {_BSD_DISCLAIMER}",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a
copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any
source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
    "notice-MIT": "Released under the MIT License.",
    "notice-Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice-GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice-BSD": "Licensed under the BSD License.",
    "notice-CC-BY-4.0": "Licensed under CC BY 4.0.",
    "notice-CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "notice-CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice-rights-reserved": "All rights reserved.",
}

_GNU_END = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."""
_GNU_WEB = "You should have received a copy of the GNU {0}General Public License along with this program. If not, see http://www.gnu.org/licenses/."
_GNU_POST = """You should have received a copy of the GNU {0}General Public License along with this program; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""


def _gnu(kind: str, version: str, later: bool, end: str) -> str:
    terms = f"either version {version} of the License, or (at your option) any later version." if later else f"version {version} of the License."
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License
as published by the Free Software Foundation, {terms} {_GNU_END.format(kind)} {end.format(kind)}"""


MORE_TEMPLATES = {
    "GPL-2.0-or-later": _gnu("", "2", True, _GNU_POST), "GPL-2.0-only": _gnu("", "2", False, _GNU_POST), "GPL-3.0-only": _gnu("", "3", False, _GNU_WEB),
    "LGPL-2.1-or-later": _gnu("Lesser ", "2.1", True, _GNU_POST), "LGPL-2.1-only": _gnu("Lesser ", "2.1", False, _GNU_POST),
    "LGPL-3.0-or-later": _gnu("Lesser ", "3", True, _GNU_WEB), "LGPL-3.0-only": _gnu("Lesser ", "3", False, _GNU_WEB),
    "AGPL-3.0-or-later": _gnu("Affero ", "3", True, _GNU_WEB), "AGPL-3.0-only": _gnu("Affero ", "3", False, _GNU_WEB),
    "EPL-1.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which
accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
available at https://www.eclipse.org/legal/epl-2.0/""",
    "BSD-4-Clause": _BSD_CONDITIONS + """ 3. All advertising materials mentioning features or use of this software must display the following
acknowledgement: This product includes software developed by the organization. 4. Neither the name of the copyright holder nor the names of
its contributors may be used to endorse or promote products derived from this software without specific prior written permission. """ + _BSD_DISCLAIMER,
    "notice-GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "notice-LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "notice-LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "notice-AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
}
FULL_TEXTS = ("Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0")
VARIANTS = (b"affero", b"lesser")


def all_templates() -> dict[str, str]:
    """Headers, notices and the full texts, which are files of this package."""
    texts = {f"text-{name}": pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode() for name in FULL_TEXTS}
    return TEMPLATES | MORE_TEMPLATES | texts


# A-Z become a-z, other ASCII characters than letters and digits a space; bytes of other characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def dice(one: set, two: set) -> float:
    return 2 * len(one & two) / (len(one) + len(two)) if one or two else 0.0


def versions(pairs) -> set[bytes]:
    """Numbers that follow the word version."""
    return {two for one, two in pairs if one == b"version" and two[:1].isdigit()}


class Matcher:
    def __init__(self, templates: dict[str, str], least: float = LEAST):
        self.least = least
        self.names = list(templates)
        words = [normal_words(t.encode()) for t in templates.values()]
        self.sets = [set(zip(w, w[1:])) for w in words]
        self.versions = [versions(own) for own in self.sets]
        self.variants = [[w.count(v) for v in VARIANTS] for w in words]
        self.lengths = [len(w) for w in words]
        self.places: dict[tuple[bytes, bytes], dict[int, list[int]]] = defaultdict(dict)
        for k, w in enumerate(words):
            for j, pair in enumerate(zip(w, w[1:])):
                self.places[pair].setdefault(k, []).append(j)

    def densest(self, at: list[int]) -> tuple[int, int]:
        """First and last of the ascending places whose passage has the largest 2 * proposals - least * size."""
        best, total, begin, out = 0.0, 0.0, 0, (at[0], at[0])
        for n, i in enumerate(at):
            total -= self.least * (i - at[n - 1] - 1) if n else 0.0
            if total <= 0:
                total, begin = 0.0, i
            total += 2 - self.least
            if total > best:
                best, out = total, (begin, i)
        return out

    def candidates(self, pairs: list[tuple[bytes, bytes]]):
        """(template, first word, last word) of passages that the bounds do not rule out."""
        shared = Counter(k for pair in set(pairs) if pair in self.places for k in self.places[pair])
        lows = {k: len(self.sets[k]) * self.least / (2 - self.least) for k in shared}
        alive = {k for k, n in shared.items() if n >= lows[k]}  # fewer bigrams in common rule the template out
        if not alive:
            return
        proposals = defaultdict(list)
        for i, pair in enumerate(pairs):
            if pair in self.places:
                for k, own in self.places[pair].items():
                    if k in alive:
                        proposals[k].extend((i - j, i) for j in own)
        for k, own in proposals.items():
            own.sort()
            n, low = len(self.sets[k]), lows[k]
            high = n * (2 - self.least) / self.least
            shifts = (1 - self.least, (2 - 2 * self.least) / self.least)  # edits of some words, and as many added as Dice allows
            # bigrams that the template holds once place a copy; all others of the range then complete it, so copies stay apart
            # however often the template repeats itself
            once = [(shift, i) for shift, i in own if len(self.places[pairs[i]][k]) == 1]
            seen = set()
            for reach in (max(1, round(self.lengths[k] * x)) for x in shifts):
                for placed in (own, once):
                    for group in self.chains(placed, reach):
                        if placed is once:
                            low_shift, high_shift = group[0][0], group[-1][0]
                            group = own[bisect_left(own, (low_shift, -1)) : bisect_left(own, (high_shift + 1, -1))]
                        if len(group) < low:
                            continue
                        at = sorted({i for _, i in group})
                        for first, last in ((at[0], at[-1]), self.densest(at)):
                            if low <= last + 1 - first <= high + reach and (first, last) not in seen:
                                seen.add((first, last))
                                yield k, first, last + 1

    @staticmethod
    def chains(placed: list[tuple[int, int]], reach: int):
        """Runs of proposals whose shifts follow each other within ``reach``."""
        begin = 0
        for end in range(1, len(placed) + 1):
            if end == len(placed) or placed[end][0] - placed[end - 1][0] > reach:
                yield placed[begin:end]
                begin = end

    def matches(self, words: list[bytes]) -> list[tuple[int, int, str, float]]:
        """(first word, last word, name, Dice) by first word; of overlapping ones with one template, and of templates
        of one passage, the best."""
        pairs = list(zip(words, words[1:]))
        if self.places.keys().isdisjoint(pairs):
            return []
        found = []
        for k, first, last in self.candidates(pairs):
            passage = set(pairs[first:last])
            score = dice(passage, self.sets[k])
            named = versions(passage)
            if score < self.least or named and self.versions[k] and named.isdisjoint(self.versions[k]):
                continue
            if all(words[first : last + 1].count(v) <= 2 * n + 1 for v, n in zip(VARIANTS, self.variants[k])):
                found.append((first, last, self.names[k], score))
        out: list[tuple[int, int, str, float]] = []
        for match in sorted(found, key=lambda m: (-m[3], m[0], m[2])):
            if not any(self._rivals(match, m) for m in out) and not self._bridges(match, out):
                out.append(match)
        return sorted(out)

    @staticmethod
    def _bridges(match, better) -> bool:
        """Whether more than half of a match lies in better ones, and in none of them whole: the end of one and the
        beginning of the next."""
        first, last = match[:2]
        if any(m[0] <= first and last <= m[1] for m in better):
            return False
        covered = {i for m in better for i in range(max(first, m[0]), min(last, m[1]) + 1)}
        return 2 * len(covered) > last + 1 - first

    @staticmethod
    def _rivals(one, two) -> bool:
        common = min(one[1], two[1]) - max(one[0], two[0])
        if one[2] == two[2]:
            return common >= 0
        return 2 * common > max(one[1] - one[0], two[1] - two[0])


def licences(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """Per row: doc_id and matches, an array of (license, start, end, dice) in code points of the text."""
    templates = templates or all_templates()
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("dice", pa.float64())]))

    def start():
        matcher = Matcher(templates, least)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text in byte_texts(batch.column("text")):
                found = matcher.matches(normal_words(text))
                if found:
                    places = [m.span() for m in _WORD.finditer(text)]
                    ends = sorted({x for first, last, _, _ in found for x in (places[first][0], places[last][1])})
                    at = dict(zip(ends, code_point_offsets(text, ends)))
                    out.append([{"license": name, "start": at[places[a][0]], "end": at[places[b][1]], "dice": score} for a, b, name, score in found])
                else:
                    out.append([])
            return pa.record_batch([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "matches"])

        return step

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_arrow(rows, start, "doc_id bigint, matches array<struct<license:string,start:bigint,end:bigint,dice:double>>")


def summary(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_matches, licenses (distinct names, sorted), best_dice (6 decimals, 0 without a match), spans."""
    listed = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"]))
    return licences(docs).select(
        "doc_id", F.size("matches").cast("bigint").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.coalesce(F.round(F.array_max(F.transform("matches", lambda m: m["dice"])), 6), F.lit(0.0)).alias("best_dice"),
        F.array_join(listed, ",").alias("spans"))
