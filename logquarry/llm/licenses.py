"""License notices in texts by conditional compression.

A candidate block is compressed alone and once with each template as a raw zstandard
dictionary. The template that shortens the block most says most about it. In this order
all templates that the block has words enough for are confirmed by the exact differences in
wording; the words that tell one license from another must be the same.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from difflib import SequenceMatcher
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FOLDER = Path(__file__).parent / "license_texts"
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_ADS = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_NOTICE = "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{end} either version {version} of the License, or (at your option) any later version."
# License texts and short notices in their usual wording.
TEMPLATES = (
    *((path.stem, path.read_text().strip()) for path in sorted(_FOLDER.glob("*.txt"))),
    ("MIT", f"{_MIT} {_MIT_REST}"),
    ("ISC", _ISC),
    ("BSD-2-Clause", f"{_BSD} {_BSD_TWO} {_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_TWO} 3. {_BSD_NAMES} {_AS_IS}"),
    ("BSD-4-Clause", f"{_BSD} {_BSD_TWO} {_BSD_ADS} 4. {_BSD_NAMES} {_AS_IS}"),
    ("BSD", _BSD),  # the opening that all of them share
    ("LGPL-2.1", _NOTICE.format(what="library", mark=";", kind="Lesser ", end=";", version="2.1")),
    ("LGPL-2.0", _NOTICE.format(what="library", mark=";", kind="Library ", end=";", version="2")),
    ("LGPL-3.0", _NOTICE.format(what="program", mark=":", kind="Lesser ", end=",", version="3")),
    ("AGPL-3.0", _NOTICE.format(what="program", mark=":", kind="Affero ", end=",", version="3")),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Licensed under the ISC license."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", _MIT),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: A block must hold a word that starts one of these; each template does.
_ANCHOR = r"(?i)\b(?:licen[sc]|permission|redistribut|free software|public domain|creative commons)"
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([(]?[A-Za-z0-9][A-Za-z0-9.+-]*(?:[ \t]+(?:OR|AND|WITH)[ \t]+[(]?[A-Za-z0-9][A-Za-z0-9.+-]*[)]?)*)")
#: Words that tell licenses apart: of a short notice also the numbers; of a text of ``_LONG`` words only those that no other license's text mentions.
_NAMES = frozenset("apache mit isc bsd gnu general lesser library affero mozilla mpl cc cc0 nc sa nd attribution sharealike noncommercial noderivatives".split())
_NAMES_LONG = frozenset("lesser affero advertising endorse sharealike noncommercial noderivatives".split())
_LONG = 100
_WORD = re.compile(r"[^\W_]+(?:[.][0-9]+)*")


@dataclass(frozen=True)
class Settings:
    """A match may miss or change at most ``differing`` of a template's words, one of five words in any case."""

    templates: tuple[tuple[str, str], ...] = TEMPLATES
    least_reduction: float = 0.2
    differing: float = 0.15
    level: int = 9


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


class Scanner:
    """Compressors and words of all templates."""

    def __init__(self, s: Settings):
        self.s = s
        self.anchor = re.compile(_ANCHOR)
        self.words = [[w for w, _, _ in _words(t)] for _, t in s.templates]
        self.bags = [Counter(w) for w in self.words]
        self.allowed = [max(s.differing * len(w), len(w) >= 5) for w in self.words]
        self.telling = [self._telling(w, k) for k, w in enumerate(self.words)]
        plain = {"level": s.level, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.alone = zstandard.ZstdCompressor(**plain)
        self.given = [
            zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(" ".join(t).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **plain)
            for t in self.words
        ]

    def _telling(self, words: list[str], k: int) -> set[str]:
        """The words among ``words`` that must be those of template ``k``."""
        if len(self.words[k]) >= _LONG:
            return _NAMES_LONG.intersection(words)
        # a library may be under any license; the name is "Library General"
        pairs = zip(words, [*words[1:], ""], strict=True)
        return {w for w, after in pairs if (w in _NAMES and (w != "library" or after == "general")) or any(c.isdigit() for c in w)}

    def _enough(self, k: int, bag: Counter) -> bool:
        """Whether ``bag`` has the words for a match of template ``k``, in whatever order."""
        short = self.allowed[k]
        for w, n in self.bags[k].items():
            short -= max(0, n - bag[w])
            if short < 0:
                return False
        return True

    def ranking(self, words: list[str], among: list[int] | None = None) -> list[tuple[float, int]]:
        """Templates by the share of a block's compressed size that they save, best first."""
        raw = " ".join(words).encode()
        size = len(self.alone.compress(raw))
        among = range(len(self.given)) if among is None else among
        saved = [((size - len(self.given[k].compress(raw))) / size, -k) for k in among]
        return [(share, -k) for share, k in sorted(saved, reverse=True)]

    def differences(self, words: list[str], k: int) -> tuple[int, int, int, int]:
        """Template words missing or changed, foreign words within the match, and where in ``words`` the match lies."""
        # in a text of thousands of words, frequent ones only count beside others that match
        matcher = SequenceMatcher(None, self.words[k], words, autojunk=len(self.words[k]) >= 10 * _LONG)
        same = [b for b in matcher.get_matching_blocks() if b.size]
        kept = sum(b.size for b in same)
        if not kept:
            return len(self.words[k]), 0, 0, 0
        first, last = same[0].b, same[-1].b + same[-1].size
        return len(self.words[k]) - kept, last - first - kept, first, last

    def scan(self, text: str) -> list[dict]:
        """All notices of a text, without overlap, in order."""
        found: list[dict] = []
        done = 0
        words = None
        tags = {m.start() + len("SPDX-"): m for m in _SPDX.finditer(text)} if "SPDX-" in text else {}
        for m in self.anchor.finditer(text):
            if m.start() < done:
                continue
            if m.start() in tags:
                tag = tags[m.start()]
                name = tag[1].rstrip(".").strip("()")
                found.append({"start": tag.start(), "end": tag.start(1) + len(tag[1].rstrip(".")), "license": name, "template": None, "reduction": None, "missing": 0, "added": 0})
                done = found[-1]["end"]
                continue
            if words is None:
                words = _words(text)
                bag = Counter(w for w, _, _ in words)
                lengths: dict[int, list[int]] = {}
                for k, own in enumerate(self.words):
                    if self._enough(k, bag):
                        lengths.setdefault(len(own), []).append(k)
            hit = self._at(text, words, m.start(), lengths) if lengths else None
            if hit and hit["start"] >= done:
                found.append(hit)
                done = hit["end"]
        return found

    def _at(self, text: str, words: list[tuple[str, int, int]], anchor: int, lengths: dict[int, list[int]]) -> dict | None:
        lo, hi = 0, len(words)
        while lo < hi:  # the first word that ends behind the anchor
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if words[mid][2] <= anchor else (lo, mid)
        best = None
        for n, ks in sorted(lengths.items()):
            # the anchor may be anywhere in a notice of n words
            a, b = max(0, lo - n), min(len(words), lo + n + 1)
            block = [w for w, _, _ in words[a:b]]
            bag = Counter(block)
            ks = [k for k in ks if self._enough(k, bag)]
            for _, k in self.ranking(block, ks) if ks else ():
                missing, added, first, last = self.differences(block, k)
                if not first <= lo - a < last or max(missing, added) > self.allowed[k]:
                    continue
                if self._telling(block[first:last], k) != self.telling[k]:
                    continue
                start, end = words[a + first][1], words[a + last - 1][2]
                reduction = self.ranking(block[first:last], [k])[0][0]
                if reduction < self.s.least_reduction:
                    continue
                rank = (n - 2 * missing - added, reduction)
                if best is None or rank > best[0]:
                    best = (rank, {"start": start, "end": end, "license": self.s.templates[k][0], "template": k, "reduction": reduction, "missing": missing, "added": added})
        return best and best[1]


def find_licenses(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """License notices in ``docs`` (doc_id, text), one row each.

    Returns doc_id, start, end (code points, end exclusive), license, template (its number),
    reduction (share of the compressed size saved), missing and added (words that differ).
    An SPDX tag gives its own expression as license, without template and reduction.
    Texts are cut at the words around each anchor word, wherever it stands. Null and empty
    texts and texts without an anchor give no row; repeated rows give theirs each.
    """
    s = settings or Settings()
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("template", pa.int32()), ("reduction", pa.float64()), ("missing", pa.int64()), ("added", pa.int64())]
    schema = pa.schema(kinds)

    def scan(batches):
        scanner = Scanner(s)
        for batch in batches:
            rows = [{"doc_id": i} | hit for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for hit in scanner.scan(t)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select("doc_id", "text").where(F.col("text").rlike(_ANCHOR)).mapInArrow(
        scan, "doc_id long, start long, end long, license string, template int, reduction double, missing long, added long"
    )
