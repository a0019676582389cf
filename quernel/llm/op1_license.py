"""License scans, with DataFrame expressions only.

A template is cut into segments of ``SEGMENT`` five-word shingles (shorter
templates are one segment).  The text is covered by overlapping windows of as
many shingles, one beginning at every word, and each window has a minimum for
each hash function.  A band is one minimum; a window and a segment that share a
band make their template a candidate there, and the share of the template's
shingles in the text around it is then counted exactly.

With similarity s of window and segment and b bands, a candidate is found with
chance 1 - (1 - s)**b.  A segment that is whole in the text has a window with
s = 1, so it is found for certain; segments cover a template, so one that is
long enough to lose a fifth of its shingles nearly always keeps a whole one, and
a window that lost one shingle of a segment's end (s = 3/5) has chance 0.84 more.

Templates are data: their bands are one table of buckets, in which a window looks
its minimum up, and their shingles another, so the expression is the same however
many and long they are, and only candidates are compared.  Rows stay where they
are: there is no join, shuffle or Python on the way.
"""

from __future__ import annotations

import json
import re

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHINGLE, CONTAINMENT = 5, 0.8
SEGMENT, BANDS = 4, 2
#: Words around a candidate that are searched on either side, and as a share of the template's.
SLACK, LOOSE = 6, 8
#: Buckets of a band table for each of its keys, at least.
SPARE = 16
#: Characters of templates in all, at most; more raise an error.
CHARS = 8_000_000
#: Names and texts of licenses, or of their notices.
BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        + BSD_END,
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        + BSD_END,
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}
#: Constants that permute 64-bit hashes by exclusive or; the first leaves them.
SEEDS = [0, *(int.from_bytes(xxhash.xxh64_digest(bytes([i]), 1), "big", signed=True) for i in range(1, BANDS))]


def words(text: str) -> list[str]:
    """As the expression below cuts a text into words."""
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def shingles(ws: list[str]) -> list[int]:
    """Spark's xxhash64 of each five words."""
    out = []
    for i in range(len(ws) - SHINGLE + 1):
        h = 42
        for w in ws[i : i + SHINGLE]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


def segments(found: list[int]) -> list[tuple[int, list[int]]]:
    """Offset and shingles of the segments of a template."""
    n = len(found)
    size = min(n, SEGMENT)
    starts = sorted({*range(0, n - size + 1, size), n - size})
    return [(a, found[a : a + size]) for a in starts]


def literal(value, kind: str) -> str:
    """A SQL value that Spark reads once, as it plans, from one text."""
    text = json.dumps(value, separators=(",", ":")).replace("\\", "\\\\").replace("'", "\\'")
    return f"from_json('{text}', '{kind}')"


def matches(templates: dict[str, list[str]], text: str) -> str:
    """The SQL expression of a text's matches: array of (license, start, end, containment)."""
    if sum(len(t) for texts in templates.values() for t in texts) > CHARS:
        raise ValueError(f"templates of more than {CHARS} characters")
    made = [(name, shingles(words(t))) for name, texts in templates.items() for t in texts]
    made = [(name, s) for name, s in made if s]
    none = "cast(array() as array<struct<license: string, start: bigint, end: bigint, containment: double>>)"
    if not made:
        return none
    slack = [max(SLACK, len(s) // LOOSE) for _, s in made]
    # by size of window and band: the minima of segments, with template and place
    keys: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
    for t, (_, found) in enumerate(made):
        for at, s in segments(found):
            for b in range(BANDS if len(s) == SEGMENT else 1):
                keys.setdefault((len(s), b), set()).add((min(x ^ SEEDS[b] for x in s), t, at + slack[t]))
    fields, places = [], []
    for n, ((k, b), found) in enumerate(sorted(keys.items())):
        x = [f"(get(h, i + {j}) ^ {SEEDS[b]}L)" if b else f"get(h, i + {j})" for j in range(1, k)]
        first = f"x ^ {SEEDS[b]}L" if b else "x"
        size = 1 << (SPARE * len(found) - 1).bit_length()
        table_: list[list] = [[] for _ in range(size)]
        for key, t, at in sorted(found):
            table_[key & (size - 1)].append({"k": key, "t": t, "a": at})
        fields += [f"'w{n}', {f'transform(h, (x, i) -> least({chr(44).join([first, *x])}))' if k > 1 else 'h'}", f"'b{n}', {literal(table_, 'array<array<struct<k: bigint, t: int, a: int>>>')}"]
        bucket = f"m.b{n}[cast(m.w{n}[i] & {size - 1} as int)]"
        places.append(f"flatten(transform(filter(sequence(0, size(m.h) - 1), i -> size({bucket}) > 0), i -> transform(filter({bucket}, e -> e.k = m.w{n}[i]), e -> named_struct('t', e.t, 's', greatest(0, i - e.a) div m.t[e.t].slack * m.t[e.t].slack))))")
    rows = [{"license": name, "s": sorted(set(s)), "n": len(s) + 3 * k, "slack": k} for (name, s), k in zip(made, slack, strict=True)]
    fields.append(f"'t', {literal(rows, 'array<struct<license: string, s: array<bigint>, n: int, slack: int>>')}")
    # a candidate's region, and what it shares with the template, in its order and from its end
    region = "transform(c, c -> named_struct('c', c, 'r', slice(m.h, cast(c.s + 1 as int), m.t[c.t].n)))"
    both = f"transform({region}, x -> named_struct('s', x.c.s, 'r', x.r, 't', x.c.t, 'both', array_intersect(x.r, m.t[x.c.t].s)))"
    good = f"filter({both}, x -> size(x.both) >= {CONTAINMENT} * size(m.t[x.t].s))"
    span = f"transform({good}, x -> named_struct('license', m.t[x.t].license, 'start', x.s + array_position(x.r, x.both[0]) - 1, 'end', x.s + size(x.r) - array_position(reverse(x.r), array_intersect(reverse(x.r), m.t[x.t].s)[0]) + {SHINGLE}, 'containment', size(x.both) / size(m.t[x.t].s)))"
    rank = "named_struct('a', {0}.containment, 'b', {0}.end - {0}.start, 'c', -{0}.start, 'd', {0}.license)".format
    best = f"transform(array(array_sort(array_distinct({span}))), f -> filter(f, x -> not exists(f, y -> y.start < x.end and x.start < y.end and {rank('y')} > {rank('x')})))[0]"
    ws = f"array_remove(split(lower(coalesce(`{text}`, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), '')"
    h = f"transform(array({ws}), w -> transform(slice(w, 1, greatest(size(w) - {SHINGLE - 1}, 0)), (x, i) -> xxhash64(x, {', '.join(f'w[i + {j}]' for j in range(1, SHINGLE))})))[0]"
    m = f"transform(array({h}), h -> if(size(h) = 0, null, named_struct('h', h, {', '.join(fields)})))[0]"
    found = f"transform(array(array_distinct(concat({', '.join(places)}))), c -> if(size(c) = 0, {none}, {best}))[0]"
    return f"transform(array({m}), m -> if(m is null, {none}, {found}))[0]"


def read_templates(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Templates from a folder: a text file's name, without .txt or .md, is the license's.  ``CHARS`` bounds them all."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.txt|\.md)?$", 1).alias("name"), "value")
    if (files.agg(F.coalesce(F.sum(F.length("value")), F.lit(0))).first()[0]) > CHARS:
        raise ValueError(f"templates of more than {CHARS} characters")
    out: dict[str, list[str]] = {}
    for r in sorted(files.collect()):
        out.setdefault(r.name, []).append(r.value)
    return out


def scan(documents: DataFrame, templates: dict[str, list[str]] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key and ``matches`` of each row: license, first and end word, containment.

    Of matches that overlap, that of the largest containment stays, then the
    longest, then the first in the text, then the last by name.
    Words are runs of letters and digits, in lower case.  Null texts and texts of
    fewer than five words match nothing; equal rows match equally; a template of
    fewer than five words is not looked for; whole texts are read, however long;
    other columns are not.
    """
    found = matches(TEMPLATES if templates is None else templates, text)
    return documents.select(F.col(key), F.expr(found).alias("matches"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.expr("array_join(array_sort(array_distinct(matches.license)), ',')").alias("licenses"), F.expr("cast(size(matches) as long)").alias("n_matches"), F.expr("array_join(transform(matches, x -> concat(x.license, ':', x.start, ':', x.end)), ',')").alias("spans"))
