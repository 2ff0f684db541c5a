"""Licence scan by conditional compression.

Blocks of a text that mention licensing are compressed alone and with each licence template as a raw zstandard dictionary; the
templates are short notices and whole ones. Every template is compressed against every block; those that save a fair part of
what they save of themselves are ranked by the bytes they save, and confirmed in that order by aligning words: a template wins
if few words differ and none of them names a licence, or a version, or tells the template from a neighbour. The differences are
reported; of templates that save alike the one that agrees best wins, then the earlier one. What is left before and behind a
winner is read again, so a block may hold several. Where a line alone says nothing, runs of lines (or sentences of long lines)
around it, over blank lines and behind comment marks, are blocks, as notices are wrapped.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Notices by SPDX id; <...> stands for any words.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without permission."),
)

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_GNU = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. "
    "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."
)
#: Whole notices by SPDX id, with the words that a text must have to be one; others may differ.
NOTICES: tuple[tuple[str, str, str], ...] = (
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "granted charge sublicense merge",
    ),
    ("BSD-2-Clause", _BSD + _BSD_END, "redistributions binary forms disclaimer"),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END, "redistributions binary forms disclaimer neither endorse"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "permission fee granted disclaims",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
        "apache 2.0 compliance governing",
    ),
    ("GPL-2.0-or-later", _GNU.format("program", "", "2"), "gnu general either 2 later"),
    ("GPL-3.0-or-later", _GNU.format("program", "", "3"), "gnu general either 3 later"),
    ("AGPL-3.0-or-later", _GNU.format("program", "Affero ", "3"), "gnu affero general either 3 later"),
    ("LGPL-2.1-or-later", _GNU.format("library", "Lesser ", "2.1"), "gnu lesser general either 2.1 later"),
    ("LGPL-3.0-or-later", _GNU.format("library", "Lesser ", "3"), "gnu lesser general either 3 later"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla 2.0 form mpl"),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
        "misrepresented altered plainly origin",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unencumbered public domain compile",
    ),
)
LEAST_SAVING = 0.2
LEAST_AGREEMENT = 0.8
#: Part of what a template saves of itself that it has to save of a block to be confirmed.
LEAST_SHARE = 0.3
#: Agreement of two licences' templates from which the words that differ are decisive.
NEIGHBOURS = 0.7
#: Words that name a licence.
NAMED = frozenset("affero apache bsd cc cc0 commons creative gnu isc lesser mit mozilla mpl unencumbered".split())
#: Longest line whose licences are kept for when it comes again.
LINE = 400

_HINT = re.compile(r"licen[sc]|spdx|copyright|all rights reserved|hereby granted|permission is granted|redistribution and use|public domain|\bcc[ -](?:by|0)|\bcc0\b", re.IGNORECASE)
_HINT_WORDS = ("licen", "spdx", "copyright", "rights reserved", "hereby granted", "permission is granted", "redistribution and use", "public domain", "cc by", "cc-by", "cc0", "cc 0")
_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
_NAME = r"[A-Za-z0-9+\-]+(?:\.[A-Za-z0-9+\-]+)*"
_ID = rf"\(*[ \t]*{_NAME}(?:[ \t]*\))*"
_SPDX = re.compile(rf"SPDX-License-Identifier:\s*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)")
_SPDX_PART = re.compile(rf"(WITH[ \t]+)?({_NAME})")
_CLOSING = re.compile(r"[.,;:!?)\"']*")
_LOWER = {c: c + 32 for c in range(65, 91)}
_COMMON = frozenset("a all and any are be by except for form free in is it license licensed no not of or part released software source subject terms that the this to under use version with work you".split())


class Found(NamedTuple):
    license: str
    start: int
    end: int
    saving: float
    agreement: float
    missing: str
    added: str


_INITIALS = re.compile(r"[a-z](?:\.[a-z])+")


def _same(word: str) -> str:
    """The word as it is compared: initials without stops."""
    return word.replace(".", "") if _INITIALS.fullmatch(word) else word


def words(text: str) -> list[str]:
    return [_same(w) for w in _WORD.findall(text.lower())]


class _Template:
    def __init__(self, name: str, text: str, telling: str | None = None):
        self.name, self.words = name, words(text)
        self.telling = {w for w in self.words if w not in _COMMON} if telling is None else set(telling.split())
        content = text.lower().encode()
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=3)
        self.coder = zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.saves = len(_PLAIN.compress(content)) - len(self.coder.compress(content))
        #: words that may not be missing: of its telling ones names and versions, later those that a neighbour lacks
        self.decisive = {w for w in self.telling if w in NAMED or any(c.isdigit() for c in w)}


_PLAIN = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)


class Scanner:
    def __init__(self, templates: tuple[tuple[str, ...], ...] = TEMPLATES + NOTICES):
        self.templates = [_Template(*t) for t in templates]
        self.most = max((len(t.words) for t in self.templates), default=0)
        #: words that may not be added: names, and what a neighbour of another licence has more
        self.foreign: dict[int, set[str]] = {}
        for i, t in enumerate(self.templates):
            own = set(t.words)
            self.foreign[i] = set(NAMED - own)
            for u in self.templates:
                if u.name != t.name and 2 * len(own & set(u.words)) >= NEIGHBOURS * (len(own) + len(set(u.words))) and difflib.SequenceMatcher(None, t.words, u.words, autojunk=False).ratio() >= NEIGHBOURS:
                    t.decisive |= own - set(u.words)
                    self.foreign[i] |= set(u.words) - own
        self.known: dict[str, list[Found]] = {}

    def _ranked(self, text: str) -> list[tuple[int, int]]:
        """(bytes saved, template) of the templates that save a fair part, the most first."""
        raw = text.lower().encode("utf-8", "surrogatepass")
        alone = len(_PLAIN.compress(raw))
        saved = [(alone - len(t.coder.compress(raw)), k) for k, t in enumerate(self.templates)]
        return sorted((x for x in saved if x[0] >= LEAST_SHARE * self.templates[x[1]].saves), key=lambda x: (-x[0], x[1]))

    def block(self, text: str) -> list[Found]:
        """The licences of a block by place, with the offsets of their words; a single one beside which there is no word has 0 and
        the block's length."""
        if len(text) > LINE:
            return self._block(text)
        if text not in self.known:
            if len(self.known) >= 10_000:
                self.known.clear()
            self.known[text] = self._block(text)
        return self.known[text]

    def _block(self, text: str) -> list[Found]:
        marks = list(_SPDX.finditer(text))
        if marks:
            # notices may stand before, between and behind tags
            found, gone = [f for m in marks for f in self._tag(m)], 0
            for begin, end in [*(m.span() for m in marks), (len(text), len(text))]:
                found += [f._replace(start=f.start + gone, end=f.end + gone) for f in self._notices(text[gone:begin])] if _HINT.search(text, gone, begin) else []
                gone = end
            return sorted(found, key=lambda f: f.start)
        found = self._notices(text)
        alone = len(found) == 1 and not _WORD.search(self._low(text[: found[0].start] + " " + text[found[0].end :]))
        return [found[0]._replace(start=0, end=len(text))] if alone else found

    def _tag(self, tag: re.Match[str]) -> list[Found]:
        """A licence for each identifier of the tag's expression; the first one's span begins with the tag."""
        ids = [m for m in _SPDX_PART.finditer(tag[1]) if not m[1] and m[2] not in ("AND", "OR", "WITH")]
        at = tag.start(1)
        return [Found(m[2], at + m.start(2) if k else tag.start(), at + m.end(2), 1.0, 1.0, "", "") for k, m in enumerate(ids)]

    def _notices(self, text: str) -> list[Found]:
        """Confirmed templates in a text by place; offsets are those of the words.

        A text of many words is read by windows that hold three of the longest template that may be in them, so time grows with
        its length; what a window finds counts up to where a template may reach beyond it.
        """
        at = [m.span() for m in _WORD.finditer(self._low(text))]
        out: list[Found] = []
        first = seen = most = 0
        while first < len(at):
            last = min(len(at), first + 3 * self.most)
            if last < len(at):  # of a long text the templates that save something here tell how far to look
                if not most or first + max(3 * most, 30) > seen:
                    most, seen = max([len(self.templates[k].words) for _, k in self._ranked(text[at[first][0] : at[last - 1][1]])], default=0), last
                if not most:
                    first = max(first + 1, last - self.most * 3 // 2)
                    continue
                last = min(len(at), first + max(3 * most, 30))
            begin, end = at[first][0], at[last - 1][1] if last < len(at) else len(text)
            sure = len(at) if last == len(at) else last - max(most * 3 // 2, 1)
            found = sorted((f._replace(start=f.start + begin, end=f.end + begin) for f in self._few(text[begin:end])), key=lambda f: f.start)
            kept = [f for f in found if sure == len(at) or f.end <= at[sure][0] or f is found[0]]
            out += kept
            behind = bisect_left(at, (kept[-1].end,)) if kept else first
            first = len(at) if last == len(at) else max(behind, sure, first + 1) if len(kept) == len(found) else max(behind, first + 1)
        return out

    def _few(self, text: str) -> list[Found]:
        """Templates in a text of a window's length, and in what is before and behind each."""
        out, left = [], [(0, len(text))]
        while left:
            begin, end = left.pop()
            if best := self._best(text[begin:end]):
                best = best._replace(start=best.start + begin, end=best.end + begin)
                out.append(best)
                left += [(a, b) for a, b in ((begin, best.start), (best.end, end)) if _HINT.search(text, a, b)]
        return out

    @staticmethod
    def _low(text: str) -> str:
        low = text.lower()
        return low if len(low) == len(text) else text.translate(_LOWER)

    def _best(self, text: str) -> Found | None:
        low = self._low(text)
        at = [m.span() for m in _WORD.finditer(low)]
        own, best, least = [_same(low[a:b]) for a, b in at], None, 0
        for saved, k in self._ranked(text):
            # those that save as much as the first confirmed one may agree better
            if best and saved < least:
                break
            t = self.templates[k]
            # the words around the longest agreement, so that stray words of other text do not count as part of the notice
            core = difflib.SequenceMatcher(None, t.words, own, autojunk=False).find_longest_match()
            low_end, high_end = core.b - core.a * 5 // 4 - 2, core.b + core.size + (len(t.words) - core.a - core.size) * 5 // 4 + 2
            shift = max(0, low_end)
            near = own[shift:high_end]
            match = difflib.SequenceMatcher(None, t.words, near, autojunk=False)
            blocks = [b for b in match.get_matching_blocks() if b.size]
            if not blocks:
                continue
            same = sum(b.size for b in blocks)
            first, last = blocks[0].b, blocks[-1].b + blocks[-1].size
            agreement = 2 * same / (len(t.words) + last - first)
            missing = [w for op, a, b, _, _ in match.get_opcodes() if op in ("delete", "replace") for w in t.words[a:b]]
            added = [w for op, _, _, a, b in match.get_opcodes() if op in ("insert", "replace") for w in near[max(a, first) : min(b, last)]]
            first, last = first + shift, last + shift
            # a wording that only this licence's neighbour has, such as another version, is no confirmation
            if agreement < LEAST_AGREEMENT or t.decisive & set(missing) or self.foreign[k] & set(added) or any(w[0].isdigit() for w in added):
                continue
            part = text[at[first][0] : at[last - 1][1]].lower().encode("utf-8", "surrogatepass")
            size = len(_PLAIN.compress(part))
            saving = (size - len(t.coder.compress(part))) / size
            if saving >= LEAST_SAVING and (best is None or (agreement, saving) > (best.agreement, best.saving)):
                best, least = Found(t.name, at[first][0], at[last - 1][1], saving, agreement, " ".join(missing), " ".join(added)), saved
        return best and best._replace(end=best.end + len(_CLOSING.match(text, best.end)[0]))

    def _wrapped(self, text: str, run: list[tuple[int, int]]) -> list[Found]:
        """Licences that only several adjacent pieces give together, as (start, end) of the text."""
        out: list[Found] = []
        counts = [len(words(text[a:b])) for a, b in run]
        done = 0
        for i, (a, b) in enumerate(run):
            if a < done or not _HINT.search(text, a, b):
                continue
            # enough pieces on both sides for the longest template, with words that differ
            first, last, more = i, i, int(self.most * 1.5)
            while first and run[first - 1][0] >= done and sum(counts[first:i]) < more:
                first -= 1
            while last + 1 < len(run) and sum(counts[i + 1 : last + 1]) < more:
                last += 1
            if last > first:
                begin, end = run[first][0], run[last][1]
                for f in self._notices(text[begin:end]):
                    out.append(f._replace(start=f.start + begin, end=f.end + begin))
                    done = max(done, f.end + begin)
        return out

    def scan(self, text: str) -> list[Found]:
        """Licences by place; start and end are code points of the block, of the words, or of the SPDX tag."""
        low = text.lower()
        if not any(h in low for h in _HINT_WORDS):
            return []
        out, at = [], 0
        run: list[tuple[int, int]] = []

        def close() -> None:
            if len(run) > 1:
                out.extend(self._wrapped(text, run))
            run.clear()

        for line in text.split("\n"):
            found = self.block(line) if _HINT.search(line) else []
            out += [f._replace(start=at + f.start, end=at + f.end) for f in found]
            # a notice reaches over blank lines, but not over a line that has one by itself
            if found:
                close()
            elif _WORD.search(line.lower()):
                run.append((at, at + len(line)))
            at += len(line) + 1
        close()
        return sorted(out, key=lambda f: f.start)


_FOUND = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saving", pa.float64()), ("agreement", pa.float64()), ("missing", pa.string()), ("added", pa.string())])


def scan(docs: DataFrame, templates: tuple[tuple[str, ...], ...] = TEMPLATES + NOTICES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, found) of every row: structs of license, start, end, saving, agreement, missing and added words.

    The whole text is read, by lines and by runs of adjacent lines. A null or empty text, and one without a licence, has an empty list. Each row is
    handled for itself. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            found = [[x._asdict() for x in scanner.scan(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_FOUND))], names=["doc_id", "found"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(
        run, "doc_id long, found array<struct<license:string,start:long,end:long,saving:double,agreement:double,missing:string,added:string>>"
    )


def names(found: Column) -> Column:
    """The different licences found, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["license"]))), ",")
