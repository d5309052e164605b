"""License scans by patience alignment of texts with license templates.

Words that occur once in both sides are anchors; the longest run of anchors in the same order is kept, and
the gaps between them are aligned in the same way. Coverage is the share of the template's words that are
aligned. Words in braces tell templates apart (a name, a version): they must stand in the text as they are, side by
side, and a template that has such words is aligned outwards from each place where the first of them stand. The other
templates, whole license texts, are aligned where enough of their words stand in a window of their length. Where a
repeated notice leaves no word unique, a narrower window is aligned as well. Tags with SPDX identifiers are read as
they are.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

COVERAGE = 0.8
# Words around a notice that are looked at besides the template's length, and in the narrow window.
SLACK_SHARE, NARROW = 4, 2

# fixed values: license identifiers, their names in notices, the words that lead to a name, notices and texts
NAMES = {
    "MIT": ["MIT License", "MIT Licence", "MIT/X11 License", "Expat License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL version 2",
                "GNU GPL v2", "GPL version 2", "GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL version 3",
                "GNU GPL v3", "GPL version 3", "GPL v3", "GPLv3", "GPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1",
                 "LGPL version 2.1", "LGPL v2.1", "LGPLv2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3",
                 "LGPL version 3", "LGPL v3", "LGPLv3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3",
                 "AGPL version 3", "AGPL v3", "AGPLv3", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License, v. 2.0", "Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0", "Creative Commons CC0 1.0 Universal"],
}
# the parts of Creative Commons names: letters and words
CC_TERMS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
CC_KINDS = ["BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"]
CC_VERSIONS = ["2.0", "2.5", "3.0", "4.0"]
LEADS = ["licensed under", "licensed under the", "released under the", "distributed under the", "available under the",
         "provided under the", "published under the", "covered by the", "under the terms of the",
         "subject to the terms of the"]
NOTICES = [
    ("Apache-2.0", "Licensed under the {Apache License, Version 2.0} (the License); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the {GNU "
                "General Public License} as published by the Free Software Foundation; either {version 2} of the License, or "
                "(at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU "
                "General Public License} as published by the Free Software Foundation, either {version 3} of the License, or "
                "(at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the {GNU "
                 "Lesser General Public License} as published by the Free Software Foundation; either {version 2.1} of the "
                 "License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU "
                 "Lesser General Public License} as published by the Free Software Foundation, either {version 3} of the "
                 "License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU "
                 "Affero General Public License} as published by the Free Software Foundation, either {version 3} of the "
                 "License, or (at your option) any later version."),
    ("GPL-2.0", "{GNU General Public License Version 2}, June 1991"),
    ("GPL-3.0", "{GNU General Public License Version 3}, 29 June 2007"),
    ("LGPL-2.1", "{GNU Lesser General Public License Version 2.1}, February 1999"),
    ("LGPL-3.0", "{GNU Lesser General Public License Version 3}, 29 June 2007"),
    ("AGPL-3.0", "{GNU Affero General Public License Version 3}, 19 November 2007"),
    ("Apache-2.0", "{Apache License Version 2.0}, January 2004"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the {Eclipse Public "
                "License 2.0} which is available at"),
    ("BSL-1.0", "Distributed under the {Boost Software License, Version 1.0}. See accompanying file or copy at"),
]
TEXTS = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
        DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction"""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright
        holder nor the names of its contributors may be used to {endorse or promote products} derived from this
        software without specific prior written permission."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this {permission notice appear in all copies}."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without {fee is
        hereby granted. THE SOFTWARE IS PROVIDED} "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
        be held liable for any damages arising from the use of this software. Permission is granted to anyone to use
        this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
        subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not
        claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
        product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
        marked as such, and must not be misrepresented as being the original software. 3. This notice may not be
        removed or altered from any source distribution."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
        software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
        distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
        third-parties to whom the Software is furnished to do so, all subject to the following"""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", """To the extent possible under law, the author has waived all copyright and related or neighboring rights
        to this work. This work is published under {CC0 1.0}"""),
]

_WORD = re.compile(r"[a-z0-9]+")
_TAG = re.compile(r"spdx-license-identifier:[ \t]*([a-z0-9.+()\- \t]+)", re.I | re.A)
_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str) -> list[tuple[str, int, int]]:
    """Runs of ASCII letters and digits in lower case, with their places as code points."""
    return [(m[0], *m.span()) for m in _WORD.finditer(text.translate(_LOWER))]


def standard_templates() -> list[tuple[str, str]]:
    """(license, template): every name behind every lead, the notices and the texts."""
    names = {license: list(found) for license, found in NAMES.items()}
    for kind in CC_KINDS:
        spelt = "-".join(CC_TERMS[part] for part in kind.split("-"))
        for version in CC_VERSIONS:
            names[f"CC-{kind}-{version}"] = [
                f"CC {kind} {version}", f"Creative Commons {kind} {version}",
                f"Creative Commons {spelt} {version}", f"Creative Commons {spelt} License {version}"]
    led = [(license, f"{lead} {{{name}}}") for license, found in names.items() for name in found for lead in LEADS]
    return led + NOTICES + TEXTS


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, int], ...]  # word numbers, end exclusive

    @staticmethod
    def parse(name: str, text: str) -> Template:
        found, phrases = [], []
        for n, part in enumerate(re.split(r"[{}]", text)):
            more = [w for w, _, _ in words(part)]
            if n % 2 and more:
                phrases.append((len(found), len(found) + len(more)))
            found += more
        return Template(name, tuple(found), tuple(phrases))


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal words of `a` and `b`, in order on both sides."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        here, there = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if there[w] == 1}
        pairs = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if here[w] == 1 and w in place]
        tails, last, back = [], [], {}
        for n, (_, j) in enumerate(pairs):  # longest increasing subsequence, by piles
            pile = bisect_left(tails, j)
            back[n] = last[pile - 1] if pile else None
            if pile == len(tails):
                tails.append(j)
                last.append(n)
            else:
                tails[pile], last[pile] = j, n
        anchors, n = [], last[-1] if last else None
        while n is not None:
            anchors.append(pairs[n])
            n = back[n]
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors[::-1], (a1, b1)]
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


class Scanner:
    """Templates, ready for texts."""

    def __init__(self, templates: list[tuple[str, str]], coverage: float):
        parsed = {Template.parse(name, text) for name, text in templates}
        self.templates = sorted((t for t in parsed if t.words), key=lambda t: (t.name, t.words, t.phrases))
        self.coverage = coverage
        common = Counter(w for t in self.templates for w in set(t.words))
        # templates by their first phrase, and phrases by their rarest word
        self.led: dict[tuple[str, ...], list[Template]] = {}
        for t in self.templates:
            if t.phrases:
                self.led.setdefault(t.words[slice(*t.phrases[0])], []).append(t)
        self.by_word: dict[str, list[tuple[str, ...]]] = {}
        for phrase in sorted(self.led):
            self.by_word.setdefault(min(phrase, key=lambda w: (len(w) < 3, common[w], w)), []).append(phrase)
        # a few words of which every phrase has one
        self.signs, left = [], list(self.led)
        while left:
            count = Counter(w for phrase in left for w in set(phrase))
            best = min(count, key=lambda w: (-count[w] * min(len(w), 6), w))
            self.signs.append(best.encode())
            left = [phrase for phrase in left if best not in phrase]
        self.whole = [(t, [(w.encode(), n) for w, n in sorted(Counter(t.words).items(), key=lambda x: (common[x[0]], -len(x[0]), x[0]))])
                      for t in self.templates if not t.phrases]

    def possible(self, low: bytes, template: Template, ranked: list[tuple[bytes, int]]) -> bool:
        """False if the template's words that the text lacks weigh too much for the wanted coverage."""
        missing = (1 - self.coverage + 1e-9) * len(template.words)
        for word, weight in ranked:
            if word not in low:
                missing -= weight
                if missing < 0:
                    return False
        return True

    def find(self, text: str) -> list[tuple[str, int, int, float]]:
        """(license, start, end, coverage) for each place; of places that overlap the one with most words aligned."""
        low = text.encode("utf-8", "replace").lower()  # on bytes: A-Z only
        led = any(sign in low for sign in self.signs)
        whole = [t for t, ranked in self.whole if self.possible(low, t, ranked)]
        hits = []
        if b"spdx-license-identifier" in low:
            for m in _TAG.finditer(text):
                for part in re.finditer(r"[A-Za-z0-9][A-Za-z0-9.+-]*", m[1]):
                    if part[0].upper() not in ("OR", "AND", "WITH"):
                        hits.append((1 << 20, part[0].rstrip(".-"), m.start(1) + part.start(), m.start(1) + part.end(), 1.0))
        if led or whole:
            found = words(text)
            plain = [w for w, _, _ in found]
            for template, pairs in [*(self._named(plain) if led else ()), *(x for t in whole for x in self._texts(plain, t))]:
                first, last = pairs[0][0], pairs[-1][0]
                hits.append((len(pairs), template.name, found[first][1], found[last][2], round(len(pairs) / len(template.words), 4)))
        best = []
        for hit in sorted(set(hits), key=lambda h: (-h[0], -h[4], h[2] - h[3], h[2], h[1])):
            if all(hit[3] <= other[2] or other[3] <= hit[2] for other in best):
                best.append(hit)
        return [hit[1:] for hit in sorted(best, key=lambda h: (h[2], h[3]))]

    def _named(self, plain: list[str]):
        """(template, aligned pairs) around each place of a first phrase."""
        for p, word in enumerate(plain):
            for phrase in self.by_word.get(word, ()):
                at = p - phrase.index(word)
                if at >= 0 and tuple(plain[at:at + len(phrase)]) == phrase:
                    for template in self.led[phrase]:
                        pairs = self._around(plain, at, template)
                        if pairs:
                            yield template, pairs

    def _around(self, plain: list[str], at: int, template: Template) -> list[tuple[int, int]] | None:
        """The best alignment with the first phrase of the template at word `at`, if it covers enough."""
        a, b = template.phrases[0]
        m, need = len(template.words), self.coverage * len(template.words) - 1e-9
        end, best = at + b - a, None
        for slack in {max(NARROW, m // SLACK_SHARE), NARROW, 0}:
            left = max(0, at - a - slack) if a else at
            before = align(plain[left:at], list(template.words[:a]))
            behind = align(plain[end:end + m - b + slack], list(template.words[b:])) if b < m else []
            pairs = [(i + left, j) for i, j in before] + [(at + n, a + n) for n in range(b - a)] + [
                (i + end, j + b) for i, j in behind]
            place = {j: i for i, j in pairs}
            whole = all(place.get(j) == place.get(x, -m) + j - x for x, y in template.phrases for j in range(x, y))
            if whole and len(pairs) >= need and (best is None or len(pairs) > len(best)):
                best = pairs
        return best

    def _texts(self, plain: list[str], template: Template):
        """(template, aligned pairs) of each place of a whole text, from left to right."""
        m, need, slack = len(template.words), self.coverage * len(template.words) - 1e-9, max(NARROW, len(template.words) // SLACK_SHARE)
        known = set(template.words)
        seen = np.concatenate([[0], np.cumsum([w in known for w in plain])])
        # windows that hold enough words of the template
        starts = np.arange(len(plain))
        full = seen[np.minimum(starts + m + slack, len(plain))] - seen[starts] >= need
        # words that a text with the wanted coverage cannot lack all
        weight, rare, total = Counter(template.words), {}, 0
        for word in sorted(weight, key=lambda w: (weight[w], -len(w), w)):
            if total > m - need:
                break
            rare[word] = [i for i, w in enumerate(template.words) if w == word]
            total += weight[word]
        likely = sorted({max(0, p - q) for p, w in enumerate(plain) for q in rare.get(w, ())})
        done = -1
        for start in likely:
            low = max(start - slack, done + 1, 0)
            if start + slack < done or not full[low:start + 1].any():
                continue
            best = None
            for a, b in ((low, start + m + slack), (max(start, done + 1), start + m + NARROW)):
                pairs = align(plain[a:b], list(template.words))
                if len(pairs) >= need and (best is None or len(pairs) > len(best)):
                    best = [(i + a, j) for i, j in pairs]
            if best:
                done = best[-1][0]
                yield template, best


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None,
         coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_licenses, licenses (names, sorted, each once), spans (name:start:end:coverage by start), per row.

    `templates` are (license, text), words in braces must stand in the text as they are. Places are code points, end
    exclusive. Where aligned places overlap, the one with more words aligned counts, then with more coverage, then
    the longer, then the earlier. Null and empty texts have no license. Repeated rows and rows without id are
    answered each for itself. Extra columns are ignored; an empty table gives an empty result.
    """
    given = standard_templates() if templates is None else templates

    def run(batches):
        scanner = Scanner(given, coverage)
        for batch in batches:
            hits = [scanner.find(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(h) for h in hits], pa.int64()),
                 pa.array([",".join(sorted({x[0] for x in h})) for h in hits], pa.string()),
                 pa.array([",".join(f"{n}:{a}:{b}:{c}" for n, a, b, c in h) for h in hits], pa.string())],
                names=["doc_id", "n_licenses", "licenses", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_licenses long, licenses string, spans string")
