"""Licence scan: Dice coefficient over word bigrams between parts of a text and licence templates.

Method. Text is normalised to words (letters A-Z lower-cased; runs of letters, digits and non-ASCII
characters). What is compared with a template of ``k`` bigrams is every line, every paragraph (lines
between blank lines), the whole text, and every window of ``k`` bigrams, wherever it begins or ends. A
unit of ``n`` bigrams can reach a Dice of ``t`` only if ``t/(2-t) <= n/k <= (2-t)/t``; units of other sizes
are pruned for that template, and so are units and windows in which too few bigrams occur in the template at
all. What is left is compared exactly, as multisets; windows slide from one bigram of the template to the next, so a
text takes time linear in its length.

Everything runs in one pass over the texts without a shuffle.

Defined results. Null or empty text, or no match: no row. Parts of fewer than two words match nothing.
``n_units`` counts the lines, paragraphs and whole texts that match (0 where windows alone do); the reported span is the first
of the best, of equal Dice that of most bigrams. A template equal
to another by its words is reported under both names. Repeated rows give repeated results, null ids are scanned. Extra
columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dhwani.llm.common import bound_batches, text_chunks
from dhwani.llm.wordhash import U, byte_hashes, mix

# Notices and short licences by name.
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_TERMS = (
    "it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) "
    "any later version."
)
_GNU_WARRANTY = (
    "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
    "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
)
TEMPLATES = {
    "agpl-3.0-notice": f"This program is free software: you can redistribute it and/or modify {_GNU_TERMS.format('Affero General Public License', '3')} "
    f"This program {_GNU_WARRANTY.format('Affero General Public License')}",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "bsd-2-clause": f"{_BSD} {_BSD_WARRANTY}",
    "bsd-3-clause": f"{_BSD} {_BSD_3} {_BSD_WARRANTY}",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software "
        "to the public domain worldwide. This software is distributed without any warranty."
    ),
    "gpl-2.0-notice": f"This program is free software; you can redistribute it and/or modify {_GNU_TERMS.format('General Public License', '2')} "
    f"This program {_GNU_WARRANTY.format('General Public License')}",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": f"This program is free software: you can redistribute it and/or modify {_GNU_TERMS.format('General Public License', '3')} "
    f"This program {_GNU_WARRANTY.format('General Public License')}",
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "lgpl-2.1-notice": f"This library is free software; you can redistribute it and/or modify {_GNU_TERMS.format('Lesser General Public License', '2.1')} "
    f"This library {_GNU_WARRANTY.format('Lesser General Public License')}",
    "mit": "Released under the MIT License.",
    "mit-full": (
        f"{_GRANT} "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mit-grant": _GRANT,
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ),
}
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PAIR = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))


def _bigrams(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * _PAIR[0] + h[1:] * _PAIR[1])


def template_bigrams(text: str) -> Counter:
    data = np.frombuffer(text.encode() + b"\n", np.uint8)
    h, _, _ = byte_hashes(data, _WORD)
    return Counter(_bigrams(h).tolist()) if len(h) > 1 else Counter()


def _units(data: np.ndarray, start: np.ndarray, text_stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, text) of every line, paragraph and text; texts end with a newline."""
    breaks = np.flatnonzero(data == 10) + 1
    lines = np.searchsorted(start, breaks)
    a = np.append(0, lines[:-1])
    of = np.searchsorted(text_stop, breaks)
    # paragraphs: runs of lines with words; a line without words or a new text ends one
    blank = lines == a
    fresh = np.ones(len(a), bool)
    fresh[1:] = blank[1:] | blank[:-1] | (of[1:] != of[:-1])
    p0 = np.flatnonzero(fresh)
    p_end = lines[np.append(p0[1:], len(a)) - 1] if len(a) else lines
    whole = np.searchsorted(start, text_stop)
    units = np.concatenate((
        np.stack((a, lines, of)), np.stack((a[p0], p_end, of[p0])), np.stack((np.append(0, whole[:-1]), whole, np.arange(len(whole))))), 1)
    units = units[:, units[1] - units[0] > 1]
    units = np.unique(units, axis=1) if units.size else units
    return units[0], units[1], units[2]


def _windows(at: np.ndarray, grams: np.ndarray, template: Counter, size: int, threshold: float, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """(bigrams matched, first bigram) of windows of ``size`` bigrams in ``begin..end`` that reach the threshold.

    ``at`` are the places of the template's bigrams there. Of windows that hold the same of them the last
    is looked at, and the one that ends with the text.
    """
    least = int(np.ceil(threshold * size - 1e-9))
    if len(at) < least or end - begin < size:
        return
    starts = np.append(at[at < end - size], end - size)
    starts = starts[np.searchsorted(at, starts + size) - np.searchsorted(at, starts) >= least]
    held: Counter = Counter()
    lo = hi = matched = 0
    places, codes = at.tolist(), grams[at].tolist()
    for s in starts.tolist():
        while hi < len(places) and places[hi] < s + size:
            held[codes[hi]] += 1
            matched += held[codes[hi]] <= template[codes[hi]]
            hi += 1
        while lo < hi and places[lo] < s:
            matched -= held[codes[lo]] <= template[codes[lo]]
            held[codes[lo]] -= 1
            lo += 1
        if matched >= least:
            yield matched, s


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, matched, total, n_units, first_word, n_words) of every text and template that meet.

    Dice is ``2 * matched / total``; the span is the first part of the best Dice, in words.
    """
    known = [(name, template_bigrams(text)) for name, text in sorted(templates.items())]
    known = [(name, grams, sum(grams.values())) for name, grams in known if grams]
    every = np.unique(np.concatenate([np.fromiter(g, np.uint64, len(g)) for _, g, _ in known])) if known else np.empty(0, np.uint64)
    table = np.zeros(1 << 16, bool)
    table[(every & U(0xFFFF)).astype(np.int64)] = True
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches, "doc_id", "text"):
            data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
            h, start, _ = byte_hashes(data, _WORD)
            if len(h) < 2:
                continue
            grams = _bigrams(h)
            hit = table[(grams & U(0xFFFF)).astype(np.int64)]
            at = np.flatnonzero(hit)
            hit[at] = np.isin(grams[at], every)
            total = np.append(0, np.cumsum(hit))
            a, b, of = _units(data, start, np.cumsum([len(t) + 1 for t in texts]))
            n = b - a - 1
            hits = total[b - 1] - total[a]
            best: dict[tuple[int, int], list] = {}

            def better(d: int, k: int, matched: int, both: int, first: int, words: int, unit: int) -> None:
                old = best.setdefault((d, k), [0, 1, 0, 0, 0])  # noqa: B023
                old[2] += unit
                if (matched * old[1], matched, -first) > (old[0] * both, old[0], -old[3]):
                    old[0], old[1], old[3], old[4] = matched, both, first, words

            at = np.flatnonzero(hit)
            base = np.searchsorted(start, np.append(0, np.cumsum([len(t) + 1 for t in texts])))
            for k, (_, template, size) in enumerate(known):
                mine = at[np.isin(grams[at], np.fromiter(template, np.uint64, len(template)))]
                mine = mine[np.searchsorted(base, mine, "right") == np.searchsorted(base, mine + 1, "right")]  # not from one text to the next
                owner = np.searchsorted(base, mine, "right") - 1
                for d in np.flatnonzero(np.bincount(owner, minlength=len(ids)) >= threshold * size - 1e-9).tolist():
                    for matched, s in _windows(mine[owner == d], grams, template, size, threshold, int(base[d]), int(base[d + 1]) - 1):
                        better(d, k, matched, 2 * size, s, size + 1, 0)
            for k, (_, template, size) in enumerate(known):
                can = np.flatnonzero((n >= low * size - 1e-9) & (n <= high * size + 1e-9) & (2 * np.minimum(hits, size) >= threshold * (n + size) - 1e-9))
                for u in can.tolist():
                    mine = Counter(grams[a[u] : b[u] - 1].tolist())
                    matched = sum((mine & template).values())
                    both = int(n[u]) + size
                    if 2 * matched < threshold * both - 1e-9:
                        continue
                    better(int(of[u]), k, matched, both, int(a[u]), int(n[u]) + 1, 1)
            if best:
                rows = [(ids[d], known[k][0], m, t, c, f - int(base[d]), w) for (d, k), (m, t, c, f, w) in sorted(best.items())]
                names = ("doc_id", "license", "matched", "total", "n_units", "first_word", "n_words")
                cols = dict(zip(names, zip(*rows, strict=True), strict=True))
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.string() if c == "license" else pa.int64()) for c, v in cols.items()})

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, matched long, total long, n_units long, first_word long, n_words long")


def oracle_sql(templates: Mapping[str, str] = TEMPLATES, threshold: str = "0.9") -> str:
    """The scan's rows (doc_id, license, matched, total, n_units) as DuckDB SQL."""
    values = ", ".join("('{}', '{}')".format(k, re.sub("'", "''", v)) for k, v in sorted(templates.items()))
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = "regexp_extract_all({}, '[^\\x00-/:-@\\[-`{{-\\x7f]+')"
    return f"""
WITH t(license, text) AS (VALUES {values}),
tw AS (SELECT license, {words.format(low.format("text"))} AS w FROM t),
tb AS (SELECT license, w[i] || ' ' || w[i + 1] AS g, count(*) AS c FROM tw, unnest(range(1, len(w))) AS r(i) GROUP BY ALL),
ts AS (SELECT license, sum(c) AS k FROM tb GROUP BY license),
l AS (SELECT doc_id, i, {words.format(low.format("string_split(text, chr(10))[i]"))} AS w
      FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i)),
p AS (SELECT *, sum(CASE WHEN len(w) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS para,
      sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS stop FROM l),
spans AS (SELECT doc_id, stop - len(w) AS a, stop AS b FROM p
  UNION SELECT doc_id, min(stop - len(w)), max(stop) FROM p WHERE len(w) > 0 GROUP BY doc_id, para
  UNION SELECT doc_id, 0, max(stop) FROM p GROUP BY doc_id),
dw AS (SELECT doc_id, flatten(list(w ORDER BY i)) AS w FROM l GROUP BY doc_id),
u AS (SELECT doc_id, a, b, b - a - 1 AS n FROM spans WHERE b - a > 1),
c AS (SELECT doc_id, a, n, license, k, w[a + 1 : a + n + 1] AS w FROM u JOIN ts ON n >= {threshold} / (2 - {threshold}) * k AND n <= (2 - {threshold}) / {threshold} * k JOIN dw USING (doc_id)),
g AS (SELECT doc_id, a, n, license, k, w[i] || ' ' || w[i + 1] AS g, count(*) AS x FROM c, unnest(range(1, (n + 1)::BIGINT)) AS r(i) GROUP BY ALL),
m AS (SELECT doc_id, license, k + n AS total, sum(least(x, tb.c)) AS matched, 1 AS unit FROM g JOIN tb USING (license, g) GROUP BY doc_id, a, n, license, k),
every AS (SELECT DISTINCT g FROM tb),
bi AS (SELECT doc_id, len(w) - 1 AS size, unnest(list_transform(range(1, len(w)), lambda i: {{'pos': i - 1, 'g': w[i] || ' ' || w[i + 1]}}), recursive := true) FROM dw WHERE len(w) > 1),
hits AS (SELECT doc_id, size, pos, license, k, g FROM bi JOIN every USING (g) JOIN tb USING (g) JOIN ts USING (license)
  WHERE size >= k QUALIFY count(*) OVER (PARTITION BY doc_id, license) >= {threshold} * k),
starts AS (SELECT DISTINCT doc_id, license, k, least(pos, size - k) AS s FROM hits UNION SELECT DISTINCT doc_id, license, k, size - k FROM hits),
win AS (SELECT doc_id, license, k, s, g, count(*) AS x FROM starts JOIN hits USING (doc_id, license, k) WHERE pos >= s AND pos < s + k GROUP BY ALL),
wm AS (SELECT doc_id, license, 2 * k AS total, sum(least(x, tb.c)) AS matched, 0 AS unit FROM win JOIN tb USING (license, g) GROUP BY doc_id, license, k, s),
z AS (SELECT doc_id, license, max({{'r': matched / total, 'm': matched::BIGINT, 't': total::BIGINT}}) AS b, sum(unit)::BIGINT AS n_units
  FROM (FROM m UNION ALL FROM wm) WHERE 2 * matched >= {threshold} * total GROUP BY doc_id, license)
SELECT doc_id, license, b.m AS matched, b.t AS total, n_units FROM z
"""
