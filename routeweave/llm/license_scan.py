"""Operator 8: license scans by conditional compression.

Cue words are derived from the templates (``cues_of``), so that no wording that can be confirmed is without one. Texts with a cue word are cut into blocks: sentences that hold a cue, and around each cue the words that a template of
each size class (``REACHES``) could take, over line ends, sentences, comment marks and blank lines, wherever in a
paragraph of any length they stand. A block is compressed with zstandard alone and with each template as
raw-content dictionary; templates are ranked by how much they shrink it. The first in rank that fits is confirmed by
exact wording: the words of block and template are aligned, and what the template misses, and what is added between its
first and last aligned word, must be few words. What is left beside a finding is searched again. Texts without a cue
never reach Python, and nothing is shuffled.

Defined cases: a null or empty text has no block; a very long text is scanned whole, as its blocks are bounded by the
longest template; a template of so few characters that it shrinks no block is not found; of overlapping confirmed blocks the longer one is returned; ties in
rank go to the template named first; repeated rows, and rows that repeat a doc_id, are scanned each; a null doc_id is
returned as null; an empty table yields no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common license notices, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without permission."),
    ("Proprietary", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: Words on each side of a cue that a block has, by size class: a template of at most so many words, additions included, lies inside.
REACHES = (12, 24, 48, 96, 192, 384)
#: A wording is confirmed with at most this share of the template's words missing, and added.
MISSING, ADDED = 0.1, 0.2

#: Letters of words that are preferred as cues.
CUE_CHARS = 6
_SENTENCE = re.compile(r"\S(?:[^\n]*?(?:[.:;!?](?=\s)|$))", re.MULTILINE)
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def cues_of(templates: Sequence[tuple[str, str]]) -> tuple[str, ...]:
    """Words, in lower case, of which every wording that can be confirmed holds one.

    At most the share ``MISSING`` of a template's words may be missing, so one word more than that is enough. Long words that many templates have are taken first,
    which keeps the list short and ordinary texts free of cues.
    """
    words = [_WORD.findall(text.lower()) for _, text in templates]
    spread, cues = Counter(w for own in words for w in set(own)), []
    for own in sorted(words, key=len):
        have = sum(any(c in w for c in cues) for w in own)
        for word in sorted(set(own), key=lambda w: (len(w) < CUE_CHARS, -spread[w], -len(w), w)):
            if have > MISSING * len(own):
                break
            if not any(c in word for c in cues):
                have += sum(word in w and not any(c in w for c in cues) for w in own)
                cues.append(word)
    return tuple(cues)


@dataclass(frozen=True)
class Finding:
    start: int
    length: int
    license: str
    template: int
    reduction: float
    missing: int
    added: int


class Scanner:
    """Compressors of every template, made once in a task."""

    def __init__(self, templates: Sequence[tuple[str, str]], level: int = 3):
        import zstandard

        self.templates, self._alone = templates, zstandard.ZstdCompressor(level=level, write_content_size=False)
        raw = [zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, text in templates]
        self._given = [zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False) for d in raw]
        self._words = [_WORD.findall(text.lower()) for _, text in templates]
        self._cue = re.compile("|".join(map(re.escape, cues_of(templates))), re.IGNORECASE)
        longest = max(len(w) + int(ADDED * len(w)) for w in self._words)
        self._reaches = [n for k, n in enumerate(REACHES) if not k or REACHES[k - 1] < longest]
        if longest > REACHES[-1]:
            self._reaches.append(longest)

    def blocks(self, text: str) -> list[tuple[int, int]]:
        words, found = [m.span() for m in _WORD.finditer(text)], set()
        starts = [a for a, _ in words]
        for cue in self._cue.finditer(text) if words else ():
            at = max(0, bisect_right(starts, cue.start()) - 1)
            for n in self._reaches:
                found.add((words[max(0, at - n)][0], words[min(len(words) - 1, at + n)][1]))
        for s in _SENTENCE.finditer(text):
            if self._cue.search(text, s.start(), s.end()):
                found.add(s.span())
        return sorted(found, key=lambda x: (x[0] - x[1], x[0]))  # longest first

    def rank(self, block: bytes) -> list[tuple[float, int]]:
        """(reduction, template), best first."""
        alone = len(self._alone.compress(block))
        return sorted(((1 - len(c.compress(block)) / alone, k) for k, c in enumerate(self._given)), key=lambda x: (-x[0], x[1]))

    def fit(self, words: list[str], template: int) -> tuple[int, int, int, int] | None:
        """(first word, end, words missing, words added) of the template's place among ``words``, if it has one."""
        wanted = self._words[template]
        n, present = len(wanted), set(words)
        if n - sum(w in present for w in wanted) > MISSING * n:
            return None
        same = [m for m in SequenceMatcher(None, wanted, words, autojunk=False).get_matching_blocks() if m.size]
        best = None
        for i, first in enumerate(same):
            size = 0
            for last in same[i:]:
                size += last.size
                end = last.b + last.size
                missing, added = n - size, end - first.b - size
                if missing <= MISSING * n and added <= ADDED * n and (best is None or missing + added < best[2] + best[3]):
                    best = first.b, end, missing, added
        return best

    def confirm(self, text: str, start: int, end: int) -> Finding | None:
        """The first template in rank order that fits a block, where it fits."""
        places = [m.span() for m in _WORD.finditer(text, start, end)]
        words = [text[a:b].lower() for a, b in places]
        for reduction, template in self.rank(text[start:end].rstrip().encode("utf-8", "surrogatepass")):
            if reduction <= 0:
                return None
            if at := self.fit(words, template):
                first, stop = places[at[0]][0], places[at[1] - 1][1]
                while stop < len(text) and text[stop] in ".:;!?)\"":
                    stop += 1
                return Finding(first, stop - first, self.templates[template][0], template, reduction, at[2], at[3])
        return None

    def scan(self, text: str) -> list[Finding]:
        found, pieces = [], [(0, len(text))]
        while pieces:
            start, end = pieces.pop()
            piece = text[start:end]
            if not self._cue.search(piece):
                continue
            fits = {f for block in self.blocks(piece) if (f := self.confirm(piece, *block))}
            taken: list[Finding] = []
            for f in sorted(fits, key=lambda f: (-f.length, -f.reduction, f.template, f.start)):
                if not any(g.start < f.start + f.length and f.start < g.start + g.length for g in taken):
                    taken.append(f)
            at = 0
            for f in sorted(taken, key=lambda f: f.start):
                found.append(replace(f, start=start + f.start))
                pieces.append((start + at, start + f.start))
                at = f.start + f.length
            if taken:
                pieces.append((start + at, end))
        return sorted(found, key=lambda f: f.start)


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, start, length, block, license, template, reduction, words_missing, words_added) of each confirmed block; start and length in code points."""
    lower = F.lower("text")
    cue = F.lit(False)
    for c in cues_of(templates):
        cue |= F.contains(lower, F.lit(c))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = [
                (i, f.start, f.length, text[f.start : f.start + f.length], f.license, f.template, f.reduction, f.missing, f.added)
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for f in scanner.scan(text)
            ]
            if rows:
                types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int32(), pa.float64(), pa.int32(), pa.int32()]
                names = ["doc_id", "start", "length", "block", "license", "template", "reduction", "words_missing", "words_added"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = "doc_id bigint, start bigint, length bigint, block string, license string, template int, reduction double, words_missing int, words_added int"
    return docs.filter(cue).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scan, schema)
