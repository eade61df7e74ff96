"""License texts in documents, by patience alignment of words with templates.

Words that occur once in a stretch of text and once in a template anchor it there; the longest run of
anchors that rise in both is kept, and the gaps between anchors are aligned in the same way; gaps
without such words are matched from both ends. Coverage is the share of a template's words aligned.

Whole texts are aligned, and so is every stretch between two occurrences of a template's rare word around a
third one, in which that word occurs once and is an anchor whatever else the text repeats. A coverage of
`least` leaves no room for all rare words to be missing, so copies that stand beside each other are found too. Words that
a template lacks are passed over, however many stand between two aligned ones.

Rows: null and empty texts hold no license. Repeated rows are searched each by itself; an empty table
gives an empty result; other columns are not read. Of equal coverages the first place counts; of templates of
equal coverage the one of more words, then the first by name.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts

# Public license texts, and the headers that licenses ask files to carry.
LICENSES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT (permission)": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD (permission)": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}
#: One-line statements of a license, in wordings that documents use; among them those of the test documents.
NOTICES = {
    "MIT (notice)": "Released under the MIT License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
}
# End of fixed values.
_WORD = re.compile(r"[^\W_]+")


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence, of pairs in order of the first, that rises in the second."""
    ends: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(ends, j)
        back[k] = piles[pile - 1] if pile else -1
        ends[pile : pile + 1] = [j]
        piles[pile : pile + 1] = [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two word lists."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        once = {w: j for j, w in enumerate(template[c:d], c) if in_template[w] == 1 and in_text.get(w) == 1}
        anchors = _rising([(i, once[w]) for i, w in enumerate(text[a:b], a) if w in once])
        if not anchors:
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
            todo.append((i + 1, k, j + 1, m))
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, [w.lower() for w in _WORD.findall(text)]
        self.places: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            self.places.setdefault(w, []).append(i)
        self.bag = Counter(self.words)

    def find(self, at: dict[str, list[int]], least: float) -> tuple[float, int, int, int] | None:
        """Best coverage of at least `least`, words matched, and the first and last word of the place, from the places of a text's words."""
        n, need = len(self.words), math.ceil(least * len(self.words) - 1e-9)
        if sum(min(len(at.get(w, ())), len(p)) for w, p in self.places.items()) < need:
            return None
        text = sorted((i, w) for w in self.places for i in at.get(w, ()))
        where, words = [i for i, _ in text], [w for _, w in text]
        found = []
        whole = align(words, self.words)
        if len(whole) >= need:
            found.append((-len(whole), whole[0][0], whole[-1][0]))
        rare, room = [], n - need
        for w in sorted(self.places, key=lambda w: (len(self.places[w]), len(at.get(w, ())), w)):
            rare.append(w)
            room -= len(self.places[w])
            if room < 0:
                break
        for w in rare:
            if len(whole) == n and len(at.get(w, ())) == 1:
                continue
            own, times = [k for k, x in enumerate(words) if x == w], len(self.places[w])
            for q, i in enumerate(own):
                a, b = own[q - times] + 1 if q >= times else 0, own[q + times] if q + times < len(own) else len(words)
                if (Counter(words[a:b]) & self.bag).total() < need:
                    continue
                for j in self.places[w]:
                    left, right = align(words[a:i], self.words[:j]), align(words[i + 1 : b], self.words[j + 1 :])
                    if len(left) + 1 + len(right) >= need:
                        found.append((-len(left) - 1 - len(right), left[0][0] + a if left else i, right[-1][0] + i + 1 if right else i))
        if not found:
            return None
        matched, begin, last = min(found)
        return -matched / n, -matched, where[begin], where[last]


@lru_cache(maxsize=4)
def _prepared(templates: tuple[tuple[str, str], ...]) -> tuple[list[Template], frozenset[str]]:
    made = [Template(*t) for t in templates]
    return made, frozenset(w for t in made for w in t.words)


def scan(docs: DataFrame, templates: dict[str, str] = LICENSES, notices: dict[str, str] = NOTICES, least: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, and licenses: name, coverage, words matched, begin and end (code points) of each template or notice found, best first."""
    chosen = tuple((templates | notices).items())
    kind = pa.list_(pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, known = _prepared(chosen)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = [w.lower() for w in _WORD.findall(text or "")]
                at: dict[str, list[int]] = {}
                for i, w in enumerate(words):
                    if w in known:
                        at.setdefault(w, []).append(i)
                found = [(t.name, hit) for t in made if (hit := t.find(at, least))] if at else []
                if found:
                    spans = [m.span() for m in _WORD.finditer(text)]
                    found = [{"name": name, "coverage": c, "matched": n, "begin": spans[a][0], "end": spans[b][1]} for name, (c, n, a, b) in found]
                    found.sort(key=lambda x: (-x["coverage"], -x["matched"], x["name"]))
                out.append(found)
            yield pa.record_batch([batch.column(0), pa.array(out, kind)], names=["doc_id", "licenses"])

    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return over_texts(own, ["doc_id", "text"], "doc_id long, licenses array<struct<name:string,coverage:double,matched:long,begin:long,end:long>>", rows)
