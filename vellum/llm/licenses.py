"""License scans by conditional compression.

Blocks (lines up to an empty one) that hold a cue word are candidates. A notice can stand anywhere
in a block, over several lines, and beside others, so a block is read in windows: around every
place of a template's rarest telling word (names and versions), as wide as the template with the
differences it may have. A window's words are compressed by zstandard on their own and with the
template's as raw dictionary; the bytes saved, by the template's own compressed size, don't depend
on what else the block holds. Where they reach `LEAST_SAVED`, window and template are compared
word by word: the alignment's missing, added and replaced words are the exact differences. A
template is confirmed where they are few and none touches its telling words, so that a close
relative with other terms doesn't pass. All confirmed templates of a block are returned; of those
that claim the same words, the one that agrees in most words, less those that differ.

Defined cases: null and empty texts have no block; repeated notices of a text count each time;
every row keeps its own result, however many repeat; other columns are ignored; a tie between
templates goes to the first by name.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum import runtime
from vellum.llm.common import columns, in_pieces, utf8

#: The wording of common notices, and the words in them that tell them apart.
TEMPLATES: dict[str, tuple[str, str]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "apache 2.0",
    ),
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache 2.0 governing limitations",
    ),
    "MIT": ("Released under the MIT License.", "mit"),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "permission granted sublicense substantial noninfringement",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "permission fee disclaims tortious",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
        "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
        "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "redistribution redistributions disclaimer disclaimed exemplary",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
        "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
        "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "redistribution redistributions neither endorse promote disclaimed exemplary",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, "
        "an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
        "misrepresented altered plainly acknowledgment",
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "gnu general 3 foundation hope",
    ),
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "gnu general 2 foundation hope",
    ),
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction",
        "permission granted free charge without restriction",
    ),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "gnu general 3"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "gnu general 2"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero 3"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
        "mozilla 2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "redistribution source binary permitted",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "cc by 4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "cc by-sa 4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "cc by-nc 4.0"),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "cc by-nd 4.0"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal", "cc0 waived"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
        "unencumbered public domain heirs relinquishment",
    ),
    "reserved": ("All rights reserved.", "all rights reserved"),
    "confidential": ("Confidential. Do not distribute.", "confidential"),
}
CUES = re.compile(rb"licen[sc]e|copyright|permission|as.is|\(c\)|rights reserved|redistribut|hereby granted|public domain|creative commons|waived|confidential", re.IGNORECASE)
_WORD = re.compile(r"[\w.+-]*\w")
#: Of a template's compressed size, this share at least must be saved.
LEAST_SAVED = 0.25
#: Of a template's words, this share may be missing or replaced, and as many added within it.
DIFFERENT = 0.2
LEVEL = 9
TEXT_BYTES = 4 << 20
REMEMBERED, REMEMBERED_BYTES = 50_000, 1000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, str]] = TEMPLATES):
        self.names = sorted(templates)
        self.words = {n: words_of(templates[n][0]) for n in self.names}
        self.telling = {n: set(templates[n][1].split()) for n in self.names}
        options = {"level": LEVEL, "write_content_size": False}
        self.alone = zstandard.ZstdCompressor(**options).compress
        raw = zstandard.DICT_TYPE_RAWCONTENT
        plain = {n: " ".join(self.words[n]).encode() for n in self.names}
        self.given = {n: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(plain[n], dict_type=raw), **options).compress for n in self.names}
        self.size = {n: len(self.alone(plain[n])) for n in self.names}
        self.known: dict[bytes, list] = {}

    def saved(self, name: str, window: list[str]) -> float:
        """Bytes the template saves of the window, by its own compressed size."""
        data = " ".join(window).encode()
        return (len(self.alone(data)) - len(self.given[name](data))) / self.size[name]

    def steps(self, name: str, block: list[str]) -> list[tuple[str, int, int, int, int]]:
        """The alignment's steps inside the template's extent in the block."""
        steps = SequenceMatcher(None, self.words[name], block, autojunk=False).get_opcodes()
        return [s for i, s in enumerate(steps) if not (s[0] == "insert" and i in (0, len(steps) - 1))]

    def differences(self, name: str, block: list[str]) -> list[tuple[str, list[str], list[str]]]:
        """(kind, template words, block words) inside the template's extent in the block."""
        return [(kind, self.words[name][a:b], block[c:d]) for kind, a, b, c, d in self.steps(name, block) if kind != "equal"]

    def windows(self, name: str, places: dict[str, list[int]], n: int) -> list[tuple[int, int]]:
        """Word ranges that hold every place where the template can be confirmed in a block of n words."""
        if not all(w in places for w in self.telling[name]):
            return []
        words = self.words[name]
        rare = min(sorted(self.telling[name]), key=lambda w: len(places[w]))
        at = [i for i, w in enumerate(words) if w == rare]
        more = int(DIFFERENT * len(words)) + 1
        return [(max(0, k - at[-1] - more), min(n, k + len(words) - at[0] + more)) for k in places[rare]]

    def fit(self, name: str, window: list[str]) -> tuple[int, int, float, int, int] | None:
        """(first word, end, share saved, words that differ, words that agree) where it is confirmed."""
        if (saved := self.saved(name, window)) < LEAST_SAVED:
            return None
        words, steps = self.words[name], self.steps(name, window)
        lost = sum(b - a for kind, a, b, _, _ in steps if kind != "equal")
        if lost > DIFFERENT * len(words) or any(self.telling[name] & set(words[a:b]) for kind, a, b, _, _ in steps if kind != "equal"):
            return None
        # an end that is replaced stands at the block's edge of the notice: other text follows there
        extra = sum(d - c for kind, _, _, c, d in steps if kind == "insert")
        if extra > DIFFERENT * len(words):
            return None
        same = [x for x in steps if x[0] == "equal"]
        return same[0][3], same[-1][4], saved, lost + extra, len(words) - lost

    def notices(self, block: list[str]) -> list[tuple[int, int, str, float, int]]:
        """(first word, end, template, share saved, words that differ) of a block's notices in order."""
        places: dict[str, list[int]] = {}
        for i, w in enumerate(block):
            places.setdefault(w, []).append(i)
        hits = set()
        for name in self.names:
            for low, high in self.windows(name, places, len(block)):
                if hit := self.fit(name, block[low:high]):
                    first, end, saved, different, agree = hit
                    hits.add((different - agree, name, low + first, low + end, different, saved))
        found: list[tuple[int, int, str, float, int]] = []
        taken = bytearray(len(block))
        for _, name, first, end, different, saved in sorted(hits):
            if not any(taken[first:end]):
                taken[first:end] = b"\1" * (end - first)
                found.append((first, end, name, saved, different))
        return sorted(found)

    def confirm(self, block: bytes) -> tuple[str, float, int] | None:
        """(template, share saved, words that differ) of the block's first notice."""
        found = self.notices(words_of(block.decode(errors="replace")))
        return found[0][2:] if found else None

    def block(self, lines: list[bytes]) -> list[tuple[str, int, int, float, int]]:
        key = b"\n".join(lines)
        if not CUES.search(key):
            return []
        if key in self.known:
            return self.known[key]
        words, line_of = [], []
        for i, line in enumerate(lines):
            found = words_of(line.decode(errors="replace"))
            words += found
            line_of += [i] * len(found)
        hits = [(name, line_of[first], line_of[end - 1], saved, different) for first, end, name, saved, different in self.notices(words)]
        if len(key) <= REMEMBERED_BYTES:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = hits
        return hits

    def scan(self, text: bytes | None) -> list[tuple[str, int, int, float, int]]:
        """(template, first line, last line, share saved, words that differ) in order of lines."""
        if not text or not CUES.search(text):
            return []
        lines = text.split(b"\n")
        found, start = [], 0
        for i in range(len(lines) + 1):
            if i == len(lines) or not lines[i].strip():
                if i > start:
                    found += [(name, start + low, start + high, saved, n) for name, low, high, saved, n in self.block(lines[start:i])]
                start = i + 1
        return found


_HITS = pa.list_(pa.struct([("license", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("saved", pa.float64()), ("n_different", pa.int32())]))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict = TEMPLATES) -> DataFrame:
    """(doc_id, notices) for every row of docs: its confirmed notices in order of lines."""
    runtime.ship(docs.sparkSession)
    arrow = pa.schema([("doc_id", pa.int64()), ("notices", _HITS)])

    def run(batches):
        scanner = Scanner(templates)
        for batch in in_pieces(batches, 1, TEXT_BYTES):
            rows = [[dict(zip(("license", "first_line", "last_line", "saved", "n_different"), x)) for x in scanner.scan(t)] for t in utf8(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(rows, _HITS)], schema=arrow)

    return columns(docs, doc_id=docs[id_col].cast("bigint"), text=text_col).mapInArrow(
        run, "doc_id bigint, notices array<struct<license:string,first_line:int,last_line:int,saved:double,n_different:int>>"
    )


def op10(docs: DataFrame) -> DataFrame:
    names = F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["license"])))
    return license_scan(docs).select(
        "doc_id", F.size("notices").cast("bigint").alias("n_notices"), F.array_join(names, ",").alias("licenses"),
        F.aggregate("notices", F.lit(0).cast("bigint"), lambda n, x: n + x["n_different"]).alias("n_different"),
    )
