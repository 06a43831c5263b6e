"""License scans: normalised text compared to licence templates by the Dice coefficient over word bigrams.

A text is normalised to words of letters and digits in lower case, each with its place in the text. The best windows begin and end at a bigram
of the template, as any other bigram at an edge only lowers the coefficient. A window of n bigrams that shares s with a template of m has a
coefficient of 2 * s / (n + m), and s is n at most; so for the threshold t, s is t / (2 - t) * m at least (and n with it), and n is (2 - t) / t * m at
most. Only templates are compared that have so many bigrams within such a stretch of the text; windows grow bigram by bigram there,
and all that reach the threshold are found. Every text is scanned.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

THRESHOLD = 0.8
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_GNU = (
    "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; "
    "either version {version} of the License, or (at your option) any later version."
)
_GNU_ONLY = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name}, version {version}, as published by the Free Software Foundation."


def _gnu(name: str, version: str, what: str = "program", mark: str = ":") -> tuple[str, str]:
    """The standard notices, 'or any later version' and without it."""
    return tuple(x.format(name=name, version=version, what=what, mark=mark) for x in (_GNU, _GNU_ONLY))


_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
    "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS {or_holders}BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the "
    "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE '
    "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
    "compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
#: Notices and openings of public licences, and the whole texts of the short ones, fixed values.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        _GRANT + _AS_IS.format(or_holders="OR COPYRIGHT HOLDERS "),
    ),
    "ISC": (_ISC,),
    "Unlicense": (_UNLICENSE, _UNLICENSE + " " + _AS_IS.format(or_holders="")),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        _gnu("General Public License", "3")[1],
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", *_gnu("General Public License", "2", mark=";")),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", *_gnu("Lesser General Public License", "3", "library")),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "library", ";"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", *_gnu("Affero General Public License", "3")),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        _BSD + _BSD_THIRD + _BSD_END,
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", _BSD + _BSD_END),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.",),
    "proprietary": ("All rights reserved.",),
}
FOUND = "doc_id {id}, license string, score double, start int, stop int"


def normalised(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words in lower case, and their places in the text."""
    words = [(m.group().lower(), m.span()) for m in WORD.finditer(text)]
    return [w for w, _ in words], [s for _, s in words]


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


class Templates:
    """Templates as bigram counts, and the templates that hold a bigram."""

    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float) -> None:
        self.threshold = threshold
        self.all = [(name, bigrams(words)) for name, texts in sorted(templates.items()) for t in texts if len(words := normalised(t)[0]) > 1]
        self.where: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, (_, own) in enumerate(self.all):
            for pair in own:
                self.where[pair].append(i)
        sizes = [sum(own.values()) for _, own in self.all]
        #: of each template: its bigrams, the least number that a window shares with it, and a window's greatest length
        self.bounds = [(m, math.ceil(threshold / (2 - threshold) * m - 1e-9), math.floor((2 - threshold) / threshold * m + 1e-9)) for m in sizes]

    def windows(self, words: list[str], i: int, at: list[int]) -> Iterator[tuple[float, int, int]]:
        """(score, first word, end) of all windows that begin and end at the places ``at`` of a template's bigrams and reach the threshold."""
        own = self.all[i][1]
        m, least, longest = self.bounds[i]
        for u in range(len(at) - least + 1):
            begin = at[u]
            if at[u + least - 1] - begin >= longest:
                continue
            left, shared = dict(own), 0
            for place in at[u:]:
                n = place - begin + 1
                if n > longest:
                    break
                pair = (words[place], words[place + 1])
                if left[pair]:
                    left[pair] -= 1
                    shared += 1
                    if 2 * shared >= self.threshold * (n + m) - 1e-9:
                        yield 2 * shared / (n + m), begin, place + 2

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, score, start, stop) of the best windows that don't overlap, in order."""
        words = [w.lower() for w in WORD.findall(text)]
        places: dict[int, list[int]] = defaultdict(list)
        for at, pair in enumerate(zip(words, words[1:], strict=False)):
            for i in self.where.get(pair, ()):
                places[i].append(at)
        hits = {(-score, a - b, a, self.all[i][0]) for i, at in places.items() if len(at) >= self.bounds[i][1] for score, a, b in self.windows(words, i, at)}
        if not hits:
            return []
        taken: list[tuple[int, int, float, str]] = []
        for score, size, a, name in sorted(hits):
            if all(a - size <= x or y <= a for x, y, *_ in taken):
                taken.append((a, a - size, -score, name))
        spans = normalised(text)[1]
        return [(name, score, spans[a][0], spans[b - 1][1]) for a, b, score, name in sorted(taken)]


def _scan(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, templates: dict[str, tuple[str, ...]], threshold: float) -> Iterator[pa.RecordBatch]:
    known = Templates(templates, threshold)
    for batch in batches:
        out = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in known.scan(t)]
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (id_type, pa.string(), pa.float64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "license", "score", "start", "stop"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per licence text found: doc_id, license, score, and its span in code points, the end exclusive.

    Null, empty and licence-free texts give no row, an empty table neither; texts of any length are read whole. Ids stay as they are. Of windows that overlap the best stays: by score, then length, then
    place, then name. Repeated rows give repeated answers; other columns are ignored.
    """
    common.python_ready(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where(F.col("text").isNotNull())
    templates = templates or TEMPLATES
    id_type = rows.schema["doc_id"].dataType
    arrow_type = to_arrow_type(id_type)
    return rows.mapInArrow(common.in_arrow(lambda b: _scan(b, arrow_type, templates, threshold)), FOUND.format(id=id_type.simpleString()))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
