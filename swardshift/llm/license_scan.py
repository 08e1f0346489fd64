"""License scans by alignment and conditional compression.

Around every licensing word each template is aligned to its best stretch of
words, wherever lines break. The stretch is compressed alone and with the
template as a zstandard raw dictionary; of the stretches whose wording differs
little enough, the one whose template saves most bytes is the finding.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Wordings of public licences and of their usual notices; {} stands for a year, a holder or other words of the user.
TEMPLATES: dict[str, tuple[str, str]] = {
    "mit-notice": ("MIT", "Released under the MIT License."),
    "mit-notice-2": ("MIT", "Licensed under the MIT License."),
    "mit-text": ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "apache-2.0-notice": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "apache-2.0-header": ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "gpl-3.0-notice": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "gpl-3.0-header": ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "gpl-2.0-notice": ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    "cc-by-nc-4.0-notice": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "cc-by-4.0-notice": ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    "cc-by-sa-4.0-notice": ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    "cc-by-4.0-sentence": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "bsd-2-text": ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "bsd-3-text": ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "bsd-4-text": ("BSD-4-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by {}. 4. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "isc-text": ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "all-rights": ("Proprietary", "Copyright {}. All rights reserved."),
}

#: Words where a template is looked for, as one pattern that Java and Python read alike; lines may break between them.
CUE = r"(?i)licen[cs]e|copyright|all[^0-9A-Za-z]+rights[^0-9A-Za-z]+reserved|hereby[^0-9A-Za-z]+granted|without[^0-9A-Za-z]+warrant|redistribution"
#: So many words may differ in any template, however short: one changed word.
LEAST_CHANGED = 2
#: Words that a {} may stand for.
SLOT_WORDS = 16
#: Words that tell one licence from another: none of them may be missing from a stretch or stand in it besides the template's.
NAMES = frozenset(
    "mit apache gnu gpl lgpl agpl general public lesser library affero cc by by-nc by-sa by-nd by-nc-sa by-nc-nd nc sa nd creative commons "
    "attribution noncommercial sharealike noderivatives noderivs attribution-noncommercial attribution-sharealike attribution-noderivatives".split()
)
#: Words that may not be missing from a template besides.
MUST = {"all-rights": frozenset(["all", "rights", "reserved"])}
#: In templates under so many words, this word may not be missing either: "under the MIT License" grants, "the MIT License" may be any mention.
SHORT_WORDS, GRANT = 20, "under"
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_NEVER = 1 << 20


def telling(words: list[str]) -> np.ndarray:
    """Which words name a licence or its version: names, numbers with a point and numbers after 'version'."""
    return np.array(
        [w in NAMES or (w[0].isdigit() and ("." in w or (k > 0 and words[k - 1] == "version"))) for k, w in enumerate(words)], dtype=bool
    )


class Template(NamedTuple):
    words: list[str]
    #: Numbers of the words before which a {} stands.
    slots: frozenset[int]
    #: What it costs to miss a word.
    missing: np.ndarray


def parse_template(name: str, text: str) -> Template:
    words, slots = [], set()
    for part in text.split("{}"):
        slots.add(len(words))
        words += [w.lower() for w in _WORD.findall(part)]
    must = MUST.get(name, frozenset()) | ({GRANT} if len(words) < SHORT_WORDS else set())
    fixed = telling(words) | np.array([w in must for w in words], dtype=bool)
    return Template(words, frozenset(slots) - {0, len(words)}, np.where(fixed, _NEVER, 1))


def align(template: Template, have: list[str], adding: np.ndarray, most: int, cover: int) -> tuple[int, int, int, int] | None:
    """(begin, end, missing, added) of the stretch around word ``cover`` that differs least from the template; none if over ``most`` words differ.

    Words before and after the stretch cost nothing, a missing or added word
    one or, if it tells the licence, too much; words in a slot nothing.
    """
    want, n = template.words, len(have)
    place: dict[str, list[int]] = {}
    for k, w in enumerate(have):
        place.setdefault(w, []).append(k)
    before = np.concatenate([[0], np.cumsum(adding)])
    rows = [np.zeros(n + 1, dtype=np.int64)]
    through: dict[int, np.ndarray] = {}
    for i, w in enumerate(want):
        last = rows[-1]
        if i in template.slots:
            free = last.copy()
            for step in range(1, SLOT_WORDS + 1):
                np.minimum(free[step:], last[:-step], out=free[step:])
            through[i] = last = free
        row = last + template.missing[i]
        if w in place:
            at = np.array(place[w]) + 1
            row[at] = np.minimum(row[at], last[at - 1])
        if i + 1 < len(want):  # words added behind the last belong to what follows
            row = np.minimum.accumulate(row - before) + before
        rows.append(row)
    costs = rows[-1]
    for end in sorted((j for j in np.flatnonzero(costs <= most).tolist() if j > cover), key=lambda j: (costs[j], j)):
        i, j, missing, added = len(want), end, 0, 0
        while i > 0:
            last = through.get(i - 1, rows[i - 1])
            now = rows[i][j]
            if j and have[j - 1] == want[i - 1] and now == last[j - 1]:
                i, j = i - 1, j - 1
            elif now == last[j] + template.missing[i - 1]:
                i, missing = i - 1, missing + 1
            else:
                j, added = j - 1, added + 1
                continue
            if i in through:
                j -= next(step for step in range(SLOT_WORDS + 1) if j >= step and rows[i][j - step] == through[i][j])
        if j <= cover:
            return j, end, missing, added
    return None


class Scanner:
    """The templates as raw dictionaries."""

    def __init__(self, templates: Mapping[str, tuple[str, str]], least_saving: float, most_changed: float) -> None:
        self.templates, self.least_saving = templates, least_saving
        self.plain = self._compressor(None)
        self.primed = {k: self._primed(text) for k, (_, text) in templates.items()}
        self.parsed = {k: parse_template(k, text) for k, (_, text) in templates.items()}
        self.folded = {k: self._primed(" ".join(t.words)) for k, t in self.parsed.items()}
        self.most = {k: max(LEAST_CHANGED, int(most_changed * len(t.words))) for k, t in self.parsed.items()}
        self.bags = {k: Counter(t.words) for k, t in self.parsed.items()}

    @staticmethod
    def _compressor(own) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=6, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)

    @classmethod
    def _primed(cls, text: str) -> zstandard.ZstdCompressor:
        return cls._compressor(zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def best(self, words: list[str], adding: np.ndarray, least: int, cover: int) -> tuple[str, int, int, int, int] | None:
        """(template, begin, end, missing, added) of the best confirmed stretch from word ``least`` on that holds the word ``cover``."""
        found = []
        for name, template in self.parsed.items():
            most = self.most[name]
            reach = len(template.words) + most + SLOT_WORDS * len(template.slots)
            a, b = max(least, cover - reach), min(len(words), cover + reach + 1)
            if sum((self.bags[name] & Counter(words[a:b])).values()) < len(template.words) - most:
                continue
            if (stretch := align(template, words[a:b], adding[a:b], most, cover - a)) is None:
                continue
            data = " ".join(words[a + stretch[0] : a + stretch[1]]).encode()
            alone, primed = len(self.plain.compress(data)), len(self.folded[name].compress(data))
            if alone - primed >= self.least_saving * alone:
                found.append((primed - alone, stretch[2] + stretch[3], name, a + stretch[0], a + stretch[1], *stretch[2:]))
        return min(found)[2:] if found else None

    def scan(self, text: str) -> Iterator[dict]:
        """The stretches of a text in order; no two share a word."""
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        adding = np.where(telling(words), _NEVER, 1)
        begins, breaks = [a for a, _ in spans], [m.start() for m in re.finditer("\n", text)]
        lines, done = text.split("\n"), 0
        for cue in re.finditer(CUE, text):
            cover = bisect.bisect_right(begins, cue.start()) - 1
            if cover < done or (found := self.best(words, adding, done, cover)) is None:
                continue
            name, begin, done, missing, added = found
            first, last = bisect.bisect_left(breaks, spans[begin][0]), bisect.bisect_left(breaks, spans[done - 1][0])
            block = "\n".join(lines[first : last + 1]).encode()
            yield {
                "first_line": first, "last_line": last, "template": name, "license": self.templates[name][0],
                "bytes_alone": len(self.plain.compress(block)), "bytes_primed": len(self.primed[name].compress(block)),
                "n_missing": missing, "n_added": added,
            }


def scan_licenses(
    docs: DataFrame, id: str = "doc_id", text: str = "text", templates: Mapping[str, tuple[str, str]] | None = None,
    least_saving: float = 0.2, most_changed: float = 0.1,
) -> DataFrame:
    """A row for every confirmed stretch: id, lines, licence, sizes of these lines and wording differences.

    A stretch is confirmed when the template saves at least ``least_saving`` of
    the compressed size of its words and the words missing from and added to
    the template are at most ``most_changed`` of the template's words (two in
    any case); words that name a licence or its version must agree. Words are
    compared in lower case; line breaks, comment signs and the text around a
    stretch count nothing. Each licensing word is in one stretch at most, that
    of the template that saves most bytes. Null and empty texts have none;
    repeated rows repeat theirs; a null id stays null; extra columns are
    ignored. Texts are judged in their scan tasks, without a shuffle.
    """
    given = dict(templates or TEMPLATES)
    schema = T.StructType([
        docs.schema[id], T.StructField("first_line", T.LongType()), T.StructField("last_line", T.LongType()),
        T.StructField("template", T.StringType()), T.StructField("license", T.StringType()),
        T.StructField("bytes_alone", T.LongType()), T.StructField("bytes_primed", T.LongType()),
        T.StructField("n_missing", T.LongType()), T.StructField("n_added", T.LongType()),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given, least_saving, most_changed)
        for batch in batches:
            rows = []
            for row, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [{id: row, **found} for found in scanner.scan(body.as_py())]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = T_arrow(schema)
    own = docs.select(F.col(id), F.col(text).cast("string").alias("__text")).where(F.col("__text").rlike(CUE))
    return own.mapInArrow(scan, schema)


def T_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
