"""License scan by conditional compression.

Around lines with hints, every stretch that holds the wording of a template, but for a few words, is
compressed alone and with the template as a raw zstandard dictionary. Stretches are ranked by the bytes
that the template saves; in this order they are confirmed by their exact differences in wording, and
one that overlaps a confirmed one is left out. No word that tells licenses apart (a name, a version, a
negation) may be missing or added.
Lines with hints but no such stretch are reported with the template that saves most.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notices and texts by which licenses are declared, as their publishers word them.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_END = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_1 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version."
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-text": _MIT,
    "MIT-full": f"{_MIT} {_MIT_END}",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-full-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD": _BSD_1,
    "BSD-2-Clause": f"{_BSD_1} {_BSD_2}",
    "BSD-3-Clause": f"{_BSD_1} {_BSD_2} {_BSD_3}",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "reserved": "All rights reserved.",
}
for _version in ("2", "3"):
    TEMPLATES[f"GPL-{_version}.0"] = f"This work is licensed under the GNU General Public License, version {_version}."
    TEMPLATES[f"GPL-{_version}.0-header"] = _GNU.format(what="program", colon=":" if _version == "3" else ";", kind="", comma="," if _version == "3" else ";", version=_version)
for _version in ("2.1", "3"):
    TEMPLATES[f"LGPL-{_version if '.' in _version else _version + '.0'}"] = f"This library is licensed under the GNU Lesser General Public License, version {_version}."
    TEMPLATES[f"LGPL-{_version if '.' in _version else _version + '.0'}-header"] = _GNU.format(what="library", colon=";", kind="Lesser ", comma=";", version=_version)
TEMPLATES["AGPL-3.0"] = "This work is licensed under the GNU Affero General Public License, version 3."
TEMPLATES["AGPL-3.0-header"] = _GNU.format(what="program", colon=":", kind="Affero ", comma=",", version="3")
for _short, _long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _version, _where in (("3.0", "Unported"), ("4.0", "International")):
        TEMPLATES[f"CC-{_short}-{_version}"] = f"This work is licensed under a Creative Commons {_long} {_version} {_where} License."
        TEMPLATES[f"CC-{_short}-{_version}-short"] = f"Licensed under CC {_short} {_version}."
for _id in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "Unlicense", "Zlib", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", *(f"{g}-{o}" for g in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for o in ("only", "or-later"))):
    TEMPLATES[f"{_id}-spdx"] = f"SPDX-License-Identifier: {_id}"

# Words that tell licenses apart, beside all words with digits; parts of a word between hyphens count alike.
TELLING = frozenset("mit isc bsd apache mozilla eclipse gnu gpl lgpl agpl lesser affero attribution nc nd sa sharealike noncommercial noderivatives cc0 unlicense zlib mpl epl dual proprietary".split())
# Words that turn a notice into its contrary.
NEGATIONS = frozenset("not never cannot isn aren wasn no longer neither nor".split())
#: Words before a stretch among which a negation counts.
BEFORE = 3
#: Share of a template's words that may be missing from a stretch; share of the stretch's compressed size that the template must save.
MOST_MISSING, LEAST_SAVED = 0.1, 0.1
#: Lines between two candidate lines that still belong to their block.
GAP = 1

#: Words by which a line becomes a candidate, also where a line break parts them; the same pattern is used before and in the scan.
HINT = r"(?i)licen[cs]|copyright|rights reserved|creative commons|\bcc[ -]by\b|\bcc0\b|public domain|permission is hereby|redistribution and use|permission to use|redistribute it|free software|provided that the|sublicense|unencumbered|be held liable|made available under|spdx".replace("[ -]", "[\\s-]").replace(" ", r"[\s#*/;]+")
_HINT = re.compile(HINT)
_WORD = re.compile(r"[a-z0-9]+(?:(?:\.|-(?:[ \t\r]*\n[\s#*/;]*)?)[a-z0-9]+)*")  # a hyphen may end a line
_SPLIT = re.compile(r"[-.]")
_SENTENCE_END = re.compile(r"[.!?;]\s")
_BREAK = re.compile(r"(?<=-)[^a-z0-9]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _telling(word: str) -> list[str]:
    """What a word tells licenses apart by."""
    return [p for p in _SPLIT.split(word) if p in TELLING] + ([word] if any(c.isdigit() for c in word) else [])


def candidate_blocks(text: str | None) -> list[tuple[int, str]]:
    """(number of the first line, text) of each run of lines with hints; up to ``GAP`` other lines in between belong to it."""
    lines = (text or "").split("\n")
    return [(a, "\n".join(lines[a : b + 1])) for a, b in _hint_runs(text, lines)]


def _hint_runs(text: str | None, lines: list[str]) -> list[tuple[int, int]]:
    """(first, last line) of each run."""
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    out: list[tuple[int, int]] = []
    for m in _HINT.finditer(text or ""):
        a, b = bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1) - 1
        if out and a - out[-1][1] <= GAP + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _regions(runs: list[tuple[int, int]], lines: list[str], words: int) -> list[tuple[int, int]]:
    """The runs with lines of at least ``words`` words around them on either side; what touches is one region."""
    out: list[tuple[int, int]] = []
    for a, b in runs:
        n = 0
        while a > 0 and n < words:
            a -= 1
            n += len(lines[a].split())
        n = 0
        while b < len(lines) - 1 and n < words:
            b += 1
            n += len(lines[b].split())
        if out and a <= out[-1][1]:
            out[-1] = (min(a, out[-1][0]), max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _most_inserted(n: int) -> float:
    """Words that a stretch of a template of ``n`` words may have in between."""
    return max(2, 0.5 * n)


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, level: int = 19):
        self.templates, self.level = templates, level

    def _make(self):
        import zstandard as z

        params = {"level": self.level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = z.ZstdCompressor(**params)
        self.given = {k: z.ZstdCompressor(dict_data=z.ZstdCompressionDict(t.encode(), dict_type=z.DICT_TYPE_RAWCONTENT), **params) for k, t in self.templates.items()}
        self.words = {k: _WORD.findall(t.lower()) for k, t in self.templates.items()}
        self.counts = {k: Counter(w) for k, w in self.words.items()}

    def __getstate__(self):
        return {"templates": self.templates, "level": self.level}

    def saved(self, block: str) -> list[tuple[float, str]]:
        """(share of the block's compressed size that the template saves, template), the most first."""
        if not hasattr(self, "alone"):
            self._make()
        raw = block.encode("utf-8", "surrogatepass")
        size = len(self.alone.compress(raw))
        return sorted(((round(1 - len(c.compress(raw)) / size, 6), k) for k, c in self.given.items()), key=lambda x: (-x[0], x[1]))

    def holds(self, name: str, counts: Counter) -> bool:
        """Whether counted words are enough of the template's, in any order."""
        n = len(self.words[name])
        return sum(min(k, counts[w]) for w, k in self.counts[name].items()) >= n - MOST_MISSING * n

    def wording(self, block: str, template: str) -> tuple[int, int, int]:
        """(words of the template, of which missing from the block, words of the block in between), by the longest alignment."""
        words, own = self.words[template], _WORD.findall(block.lower())
        parts = [m for m in SequenceMatcher(None, words, own, autojunk=False).get_matching_blocks() if m.size]
        found = sum(m.size for m in parts)
        inside = parts[-1].b + parts[-1].size - parts[0].b - found if parts else 0
        return len(words), len(words) - found, inside

    def differences(self, name: str, own: list[str]) -> tuple[list[str], list[str]]:
        """(words of the template that are missing, words that are added) by the longest alignment."""
        words, missing, added = self.words[name], [], []
        for what, a, b, c, d in SequenceMatcher(None, words, own, autojunk=False).get_opcodes():
            if what != "equal":
                missing += words[a:b]
                added += own[c:d]
        return missing, added

    def agrees(self, name: str, own: list[str], before: str) -> bool:
        """Whether a stretch says the same in every telling word, and nothing in it or ``before`` it in its sentence turns it into its contrary.

        Added numbers don't count: texts may number their clauses.
        """
        missing, added = self.differences(name, own)
        if any(_telling(w) for w in missing) or any(p in TELLING for w in added for p in _SPLIT.split(w)):
            return False
        return not NEGATIONS.intersection(added) and not NEGATIONS.intersection(_WORD.findall(_SENTENCE_END.split(before)[-1]))

    def stretches(self, name: str, own: list[str], counts: Counter) -> Iterator[tuple[int, int, int, int]]:
        """(first word, end, missing, inserted) of each stretch of the words ``own`` that has the template's wording."""
        words = self.words[name]
        n, most = len(words), _most_inserted(len(words))
        if not self.holds(name, counts):
            return
        open_ = [(0, len(own))]
        whole = SequenceMatcher(None, words, own, autojunk=False)
        while open_:
            low, high = open_.pop()
            m = whole.find_longest_match(0, n, low, high)
            if m.size < max(1, n // 8):
                continue
            start, stop = max(low, int(m.b - m.a - most)), min(high, int(m.b - m.a + n + most))
            parts = [p for p in SequenceMatcher(None, words, own[start:stop], autojunk=False).get_matching_blocks() if p.size]
            best = None
            for i in range(len(parts)):  # ends that match only by chance, far away, are left out
                for j in range(len(parts) - 1, i - 1, -1):
                    found, span = sum(p.size for p in parts[i : j + 1]), parts[j].b + parts[j].size - parts[i].b
                    if n - found <= MOST_MISSING * n and span - found <= most:
                        best = max(best or (-1e9,), (2 * found - span, start + parts[i].b, start + parts[i].b + span, n - found, span - found))
            if best:
                yield best[1:]
                open_ += [(low, best[1]), (best[2], high)]
            else:
                open_ += [(low, m.b), (m.b + m.size, high)]

    def scan(self, text: str | None) -> list[tuple]:
        """(first line, block, license, saved, words, missing, inserted, confirmed) of what is found.

        Every stretch around the lines with hints that holds a template's wording gives a row, with the lines it lies on and the share of its own compressed size that the template saves.
        Of stretches that overlap the one whose template saves the most bytes stays. Where a template
        is missing a telling word, or a negation stands in the stretch or up to ``BEFORE`` words before
        it, it isn't confirmed, however much it saves. A run of lines with hints without any such stretch gives one unconfirmed row, with the template that saves
        most of the run.
        """
        if not text or not _HINT.search(text):
            return []
        if not hasattr(self, "alone"):
            self._make()
        lines = text.split("\n")
        runs = _hint_runs(text, lines)
        longest = max(len(w) for w in self.words.values())
        out, taken = [], []
        for a, b in _regions(runs, lines, 2 * longest):
            region = "\n".join(lines[a : b + 1])
            spots = [(m.start(), m.end()) for m in _WORD.finditer(ascii_lower(region))]
            own = [_BREAK.sub("", ascii_lower(region[x:y])) for x, y in spots]
            found, counts = [], Counter(own)
            for name in self.templates:
                for first, end, missing, inserted in self.stretches(name, own, counts):
                    raw = region[spots[first][0] : spots[end - 1][1]].encode("utf-8", "surrogatepass")
                    size = len(self.alone.compress(raw))
                    gain = size - len(self.given[name].compress(raw))
                    if gain >= LEAST_SAVED * size:
                        found.append((gain, round(gain / size, 6), name, first, end, missing, inserted))
            kept = []
            for f in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
                _, _, name, first, end = f[:5]
                free = all(end <= k[3] or first >= k[4] for k in kept)
                if free and self.agrees(name, own[first:end], ascii_lower(region[spots[max(0, first - BEFORE)][0] : spots[first][0]])):
                    kept.append(f)
            for _, saved, name, first, end, missing, inserted in kept:
                x, y = (a + region.count("\n", 0, at) for at in (spots[first][0], spots[end - 1][1]))
                taken.append((x, y))
                out.append((x, "\n".join(lines[x : y + 1]), name, saved, len(self.words[name]), missing, inserted, True))
        for a, b in runs:
            if all(y < a or x > b for x, y in taken):
                block = "\n".join(lines[a : b + 1])
                saved, name = self.saved(block)[0]
                out.append((a, block, name, saved, *self.wording(block, name), False))
        return sorted(out, key=lambda r: (r[0], r[2]))


def ascii_lower(text: str) -> str:
    """A-Z in lower case; the length stays, so positions do."""
    return text.translate(_LOWER)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """(id, line, block, license, saved, n_words, n_missing, n_inserted, confirmed): a row for each confirmed stretch, and for each run of lines with hints that has none.

    Texts that are null, empty or without hints give no rows; whole texts are searched. Repeated
    rows are scanned each. Documents without hints are left out before the scan; nothing is shuffled.
    """
    scanner = scanner or Scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in scanner.scan(t)]
            cols = list(zip(*rows)) if rows else [[]] * 9
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "line", "block", "license", "saved", "n_words", "n_missing", "n_inserted", "confirmed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.where(F.col(text_col).rlike(HINT)).select(id_col, text_col).mapInArrow(run, f"id {kind}, line long, block string, license string, saved double, n_words long, n_missing long, n_inserted long, confirmed boolean")
