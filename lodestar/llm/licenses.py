"""License scans by patience alignment.

A text is searched near the places where short word runs of a template occur. There the words that occur once in both are
anchors; the longest increasing run of their places aligns; what lies between neighbouring anchors is aligned in the same
way, and equal words at a gap's ends are taken as they are. Coverage is the aligned share of the template's words.

Words in braces decide: a notice is the template's only if all of them align, whatever the coverage, and if no other
version or variant stands between or right before them. So "the BSD License" is no MIT notice, and "GNU Lesser General
Public License" none of the GPL.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, tidy

WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
MARKED = re.compile(r"\{([^{}]*)\}|([^{}]+)")
VERSION = re.compile(r"v?([0-9]+(?:\.[0-9]+)*)")

# Licenses by their names, as they stand before or around the word License; braces mark what decides.
NAMES = {
    "MIT": ["{MIT} License", "{MIT/X11} License", "{Expat} License"],
    "ISC": ["{ISC} License"],
    "Zlib": ["{zlib} License", "{zlib/libpng} License"],
    "0BSD": ["{BSD} {Zero} Clause License", "{Zero-Clause} {BSD} License", "{0-clause} {BSD} License"],
    "BSD-2-Clause": ["{BSD} {2-Clause} License", "{2-Clause} {BSD} License", "{Simplified} {BSD} License", "{BSD-2-Clause} License"],
    "BSD-3-Clause": ["{BSD} {3-Clause} License", "{3-Clause} {BSD} License", "{New} {BSD} License", "{Modified} {BSD} License", "{BSD-3-Clause} License"],
    "BSD-4-Clause": ["{BSD} {4-Clause} License", "{4-Clause} {BSD} License", "{Original} {BSD} License"],
    "Apache-1.1": ["{Apache} {Software} License, Version {1.1}", "{Apache} License, Version {1.1}"],
    "Apache-2.0": ["{Apache} License, Version {2.0}", "{Apache} License {2.0}", "{Apache} {2.0} License", "{Apache-2.0} License"],
    "GPL-1.0": ["GNU {General} {Public} License, version {1}", "GNU {GPL} version {1}"],
    "GPL-2.0": ["GNU {General} {Public} License, version {2}", "GNU {GPL} version {2}"],
    "GPL-3.0": ["GNU {General} {Public} License, version {3}", "GNU {GPL} version {3}"],
    "LGPL-2.0": ["GNU {Library} {General} {Public} License, version {2}", "GNU {Lesser} {General} {Public} License, version {2}", "GNU {LGPL} version {2}"],
    "LGPL-2.1": ["GNU {Lesser} {General} {Public} License, version {2.1}", "GNU {LGPL} version {2.1}"],
    "LGPL-3.0": ["GNU {Lesser} {General} {Public} License, version {3}", "GNU {LGPL} version {3}"],
    "AGPL-3.0": ["GNU {Affero} {General} {Public} License, version {3}", "GNU {AGPL} version {3}"],
    "MPL-1.1": ["{Mozilla} {Public} License, version {1.1}", "{MPL} {1.1} License"],
    "MPL-2.0": ["{Mozilla} {Public} License, version {2.0}", "{MPL} {2.0} License"],
    "EPL-1.0": ["{Eclipse} {Public} License, version {1.0}", "{Eclipse} {Public} License v {1.0}"],
    "EPL-2.0": ["{Eclipse} {Public} License, version {2.0}", "{Eclipse} {Public} License v {2.0}"],
    "EUPL-1.2": ["{European} {Union} {Public} License, version {1.2}"],
    "CDDL-1.0": ["{Common} {Development} and {Distribution} License, version {1.0}"],
    "BSL-1.0": ["{Boost} {Software} License, Version {1.0}"],
    "Artistic-2.0": ["{Artistic} License {2.0}", "{Artistic} License, version {2.0}"],
    "Unlicense": ["{Unlicense}"],
    "WTFPL": ["{WTFPL} License"],
}
FORMS = ["Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "This software is distributed under the terms of the {}."]
CREATIVE = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CREATIVE_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
#: Words that tell another license where they stand between or right before deciding words, and belong to none of them.
VARIANTS = frozenset("lesser library affero simplified modified new original academic artistic zero mozilla eclipse apache boost lgpl agpl gpl mpl by-nc by-sa by-nd by-nc-sa by-nc-nd 0-clause 2-clause 3-clause 4-clause".split())

# Whole texts of short licenses, and the opening words or file notices of long ones.
BODIES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, {provided} that the above copyright notice and this permission notice appear in all copies."],
    "Zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to {endorse} or {promote} products derived from this software without specific prior written permission."],
    "Apache-2.0": [
        "Licensed under the {Apache} License, Version {2.0} (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Apache License Version {2.0}, January {2004} TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {General} {Public} License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version.",
        "GNU {GENERAL} {PUBLIC} LICENSE Version {2}, June {1991}",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {General} {Public} License as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version.",
        "GNU {GENERAL} {PUBLIC} LICENSE Version {3}, 29 June {2007}",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU {Lesser} {General} {Public} License as published by the Free Software Foundation; either version {2.1} of the License, or (at your option) any later version.",
        "GNU {LESSER} {GENERAL} {PUBLIC} LICENSE Version {2.1}, February {1999}",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU {Lesser} {General} {Public} License as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version.",
        "GNU {LESSER} {GENERAL} {PUBLIC} LICENSE Version {3}, 29 June {2007}",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {Affero} {General} {Public} License as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version.",
        "GNU {AFFERO} {GENERAL} {PUBLIC} LICENSE Version {3}, 19 November {2007}",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the {Mozilla} {Public} License, v. {2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at", "This Source Code Form is subject to the terms of the {Mozilla} {Public} License, v. {2.0}."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the {Eclipse} {Public} License {2.0} which is available at"],
    "EPL-1.0": ["All rights reserved. This program and the accompanying materials are made available under the terms of the {Eclipse} {Public} License v {1.0} which accompanies this distribution"],
    "BSL-1.0": ["Distributed under the {Boost} {Software} License, Version {1.0}. See accompanying file or copy at", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"],
    "Unlicense": ["This is free and {unencumbered} software released into the {public} {domain}.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC0-1.0": ["Released under {CC0} {1.0}.", "To the extent possible under law, the author has {waived} all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under {CC0} {1.0} Universal"],
}


def templates() -> dict[str, list[str]]:
    """Notices of all licenses by name: bodies, each name in each form, and identifier lines."""
    out = {name: list(texts) for name, texts in BODIES.items()}
    for name, called in NAMES.items():
        out.setdefault(name, []).extend(form.format(c) for form in FORMS for c in called)
    for code, words in CREATIVE.items():
        for version, kind in CREATIVE_VERSIONS.items():
            called = [f"Licensed under {{CC}} {{{code}}} {{{version}}}.", f"This work is licensed under a {{Creative}} {{Commons}} {{{words}}} {{{version}}} {kind} License."]
            out.setdefault(f"CC-{code}-{version}", []).extend(called)
    for name in out:
        ids = [name, f"{name}-only", f"{name}-or-later"] if "GPL" in name else [name]
        out[name] += [f"{{SPDX-License-Identifier}}: {{{i}}}" for i in ids] + [f"Licensed under {{{name}}}."]
    return out


TEMPLATES = templates()
SEED = 3  # words in a row that a template without deciding words is searched by; two for others, one of them deciding
SCHEMA = "doc_id long, license string, coverage double, start long, end long"


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words in lower case, versions without a v and closing zeros, and their places."""
    words, spans = [], []
    for m in WORD.finditer(text):
        w = m[0].lower()
        v = VERSION.fullmatch(w) if w[0] in "v0123456789" else None
        if v:
            w = v[1]
            while w.endswith(".0"):
                w = w[:-2]
        words.append(w)
        spans.append(m.span())
    return words, spans


def marked(template: str) -> tuple[list[str], frozenset]:
    """A template's words, and the places of those that decide."""
    words, deciding = [], set()
    for m in MARKED.finditer(template):
        some = words_of(m[1] if m[1] is not None else m[2])[0]
        if m[1] is not None:
            deciding.update(range(len(words), len(words) + len(some)))
        words += some
    return words, frozenset(deciding)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (a, b), a in order, in which b increases: patience piles with links to the pile before."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        p = bisect_left(tops, b)
        back[k] = piles[p - 1] if p else -1
        if p == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[p], piles[p] = b, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of a and b."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        at: dict[str, list] = {}
        for side, (xs, x0, x1) in enumerate(((a, a0, a1), (b, b0, b1))):
            for k in range(x0, x1):
                at.setdefault(xs[k], [[], []])[side].append(k)
        anchors = increasing(sorted((x[0], y[0]) for x, y in at.values() if len(x) == len(y) == 1))
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return sorted(out)


class Templates:
    def __init__(self, templates: dict[str, list[str]]):
        made = [(name, *marked(t)) for name, ts in templates.items() for t in ts]
        self.all = [x for x in made if x[1]]
        self.seeds: dict[tuple, list[tuple[int, int]]] = {}
        for k, (_, w, deciding) in enumerate(self.all):
            size = min(len(w), 2 if deciding else SEED)
            for p in range(len(w) - size + 1):
                if not deciding or not deciding.isdisjoint(range(p, p + size)):
                    self.seeds.setdefault(tuple(w[p : p + size]), []).append((k, p))
        self.sizes = sorted({len(x) for x in self.seeds})
        self.first = frozenset(x[0] for x in self.seeds)

    def _decided(self, template: list[str], deciding: frozenset, pairs: list, words: list[str], low: int) -> bool:
        """Whether all deciding words align, and nothing that tells another license stands among them."""
        if not deciding:
            return True
        to = dict(pairs)
        if not deciding <= to.keys():
            return False
        at = sorted(low + to[x] for x in deciding)
        aligned = {low + y for y in to.values()}
        own = {template[x] for x in deciding}
        for k in range(max(0, at[0] - 1), at[-1] + 1):
            if k not in aligned and words[k] not in own and (words[k] in VARIANTS or (k >= at[0] and VERSION.fullmatch(words[k]))):
                return False
        return True

    def matches(self, text: str, least: float) -> list[tuple[str, float, int, int]]:
        """(license, coverage, start, end) of the best template at each place; code points, the end exclusive."""
        words, spans = words_of(text)
        places: dict[int, list[int]] = {}
        first, seeds = self.first, self.seeds
        for k, w in enumerate(words):
            if w in first:
                for size in self.sizes:
                    for t, p in seeds.get(tuple(words[k : k + size]), ()):
                        places.setdefault(t, []).append(k - p)
        found = []
        for t, starts in places.items():
            name, template, deciding = self.all[t]
            n, done = len(template), -len(template)  # a notice may lack its first words
            starts.sort()
            few = max(1, n // 8) if not deciding else 1
            for start in sorted(set(starts)):
                if start <= done or bisect_right(starts, start + n // 2) - bisect_left(starts, start - n // 2) < few:
                    continue
                low, high = max(0, start - n // 2), min(len(words), start + n + n // 2)
                pairs = align(template, words[low:high])
                # what lies far from the seed's own alignment isn't this notice
                pairs = [(x, y) for x, y in pairs if abs((y + low - start) - x) <= max(3, n // 3)]
                coverage = len(pairs) / n
                if coverage >= least and self._decided(template, deciding, pairs, words, low):
                    found.append((coverage, n, name, low + pairs[0][1], low + pairs[-1][1]))
                    done = start + n // 2
        # the better-covered and longer template first; others on the same words go
        starts_, ends_, kept = [], [], []
        for c, n, name, first_, last in sorted(found, key=lambda f: (-f[0], -f[1], f[3], f[2])):
            k = bisect_left(starts_, first_)
            if (k == len(starts_) or starts_[k] > last) and (k == 0 or ends_[k - 1] < first_):
                starts_.insert(k, first_)
                ends_.insert(k, last)
                kept.append((name, c, first_, last))
        return [(name, c, spans[f][0], spans[z][1]) for name, c, f, z in sorted(kept, key=lambda k: k[2])]


def from_table(table: DataFrame, most_bytes: int = 32 << 20) -> dict[str, list[str]]:
    """Templates of a table (license, text), for scan(); braces mark deciding words. Null or empty rows are left out.

    The templates go to every task, so a table of over `most_bytes` characters is refused.
    """
    rows = only(table, "license", "text").where("license is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"templates of {size} bytes are more than {most_bytes}")
    out: dict[str, list[str]] = {}
    for r in sorted(rows.collect()):
        out.setdefault(r["license"], []).append(r["text"])
    return out


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, license, coverage, start and end of every notice in every whole text of (doc_id, text).

    templates: texts by license (see from_table), TEMPLATES without. least: the share of a template's words that must
    align; a template without deciding words must also share an eighth as many of its word runs as it has words. Of
    templates on the same words the better covered stays, then the longer, then the earlier, then the name first in order.
    Null and empty texts hold none; texts may be of any length; repeated rows give repeated rows; null doc_ids are kept;
    other columns are ignored; an empty table gives no rows.
    """
    known = TEMPLATES if templates is None else templates

    def run(batches):
        ready = Templates(known)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                rows = [(d, *m) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if t for m in ready.matches(t, least)]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "license", "coverage", "start", "end"])

    return only(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidy(run), SCHEMA)
