"""License scans: normalised text against license templates by Dice's coefficient.

Texts and templates are normalised alike (A-Z to lower case, every run of other
characters than a-z and 0-9 to one space) and turned into their sets of word
bigrams. The segments of a document are its lines, its paragraphs of several
lines, with several paragraphs the whole text, and windows of words, whatever
line they stand in. A segment matches a template if 2 |A and B| / (|A| + |B|)
reaches the threshold.

Windows find licenses inside longer lines, over several lines, or with text right
before and after. A template has two anchors, the three words at its start and
three at its middle. Where one stands in the text, a window as long as the template
is laid such that the anchor is at its place, and compared with that template. A copy in which both anchors are
changed has no window (its line, paragraph or text may still match).

Pruning, all of it exact: Dice's coefficient can't reach t unless
|B| t / (2 - t) <= |A| <= |B| (2 - t) / t, so segments outside the bounds of all
templates go before they are compared, as do those of whose bigrams less than
t / (2 - t) occur in any template, and a segment is compared with those templates
alone whose bounds hold its size. Texts without any anchor aren't split for
windows. The templates are a parameter of fixed size and go into the plan as a
literal; nothing else is broadcast, and there is no shuffle.

Defined results: null and empty texts have no segments; segments of fewer than
two words have no bigrams and match nothing; a line that matches several
templates gives a row for each (ties included), and a license may be found as a
line and as a window; repeated rows give repeated results; a very long text is one
array of words in its task, and windows take work in proportion to it. Only the id
and the text are looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices and short license texts.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-licensed": "This project is licensed under the terms of the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
    ),
    "LGPL-3.0-notice": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. "
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. "
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software "
        "Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest "
        "in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs "
        "and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
        'software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org"
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and '
        "to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
        "following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the "
        "following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language "
        'processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR "
        "ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}
THRESHOLD = 0.8


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def bigrams(text: str) -> list[str]:
    w = words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def bounds(size: int, threshold: float) -> tuple[float, float]:
    return size * threshold / (2 - threshold), size * (2 - threshold) / threshold


def anchors(text: str) -> list[tuple[list[str], int]]:
    """(words, words before them in the template): three words from its start and three from its middle."""
    w = words(text)
    return [(w[at : at + 3], at) for at in sorted({0, max(0, min(len(w) // 2, len(w) - 3))})]


def _normal(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.trim(F.regexp_replace(F.translate(text, upper, upper.lower()), "[^a-z0-9]+", " "))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, segment (line, paragraph, text or window), number (from 0 within its
    kind; a window's is its first word's), license, shared, n_segment, n_template, dice of every match."""
    templates = templates or TEMPLATES
    sets = {name: grams for name, text in templates.items() if (grams := bigrams(text))}
    lowest = min(bounds(len(g), threshold)[0] for g in sets.values())
    highest = max(bounds(len(g), threshold)[1] for g in sets.values())
    known = F.array(*[
        F.struct(F.lit(name).alias("license"), F.lit(len(g)).alias("n"), F.lit(bounds(len(g), threshold)[0]).alias("low"), F.lit(bounds(len(g), threshold)[1]).alias("high"), F.array(*map(F.lit, g)).alias("grams"))
        for name, g in sets.items()
    ])

    def pieces(kind: str, texts: Column) -> Column:
        return F.transform(texts, lambda t, i: F.struct(F.lit(kind).alias("segment"), i.cast("int").alias("number"), t.alias("part")))

    lines = F.split("text", "\n")
    paragraphs = F.filter(pieces("paragraph", F.split("text", "\n[ \t\r]*\n")), lambda p: F.contains(p["part"], F.lit("\n")))
    whole = F.when(F.regexp_like("text", F.lit("\n[ \t\r]*\n")), pieces("text", F.array("text"))).otherwise(F.array().cast("array<struct<segment:string,number:int,part:string>>"))
    parts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.explode(F.concat(pieces("line", lines), paragraphs, whole)).alias("s"))
    # a segment of n bigrams has more than 2 n characters: an exact bound before any splitting.
    # explode(array(x)) computes x once: a projection would be merged into its uses.
    parts = parts.where(F.char_length("s.part") > 2 * lowest)
    tokens = parts.select("doc_id", "s.segment", "s.number", F.explode(F.array(F.split(_normal(F.col("s.part")), " "))).alias("w")).where(F.size("w") > lowest)
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    tokens = tokens.withColumn("laid", F.lit(None).cast("string")).union(_windows(docs, {name: templates[name] for name in sets}))
    sets_of = tokens.where(F.size("w") > 1).select("doc_id", "segment", "number", "laid", F.explode(F.array(F.array_distinct(pairs))).alias("grams"))
    sets_of = sets_of.where(F.size("grams").between(lowest, highest))
    # what a match shares is at least t / (2 - t) of its segment, and is among the bigrams of some template
    share = round(1000 * threshold)
    listed = sorted({g for grams in sets.values() for g in grams})
    sets_of = sets_of.where(F.size(F.filter("grams", lambda g: g.isin(listed))) * (2000 - share) >= share * F.size("grams"))
    fitting = F.filter(known, lambda t: (F.size("grams") >= t["low"]) & (F.size("grams") <= t["high"]) & (F.col("laid").isNull() | (F.col("laid") == t["license"])))
    shared = F.transform(fitting, lambda t: F.struct(t["license"].alias("license"), t["n"].alias("n"), F.size(F.array_intersect(F.col("grams"), t["grams"])).alias("shared")))
    hits = F.filter(shared, lambda t: 2000 * t["shared"] >= share * (t["n"] + F.size("grams")))
    found = sets_of.select("doc_id", "segment", "number", F.size("grams").alias("n"), F.explode(hits).alias("t"))
    return found.select(
        "doc_id", "segment", "number", F.col("t.license").alias("license"),
        F.col("t.shared").cast("long").alias("shared"), F.col("n").cast("long").alias("n_segment"), F.col("t.n").cast("long").alias("n_template"),
        F.round(2 * F.col("t.shared") / (F.col("t.n") + F.col("n")), 6).alias("dice"),
    )


def _windows(docs: DataFrame, templates: dict[str, str]) -> DataFrame:
    """doc_id, segment, number, w, laid of the windows that the anchors of a template (laid) lay."""
    known = F.array(*[
        F.struct(F.lit(name).alias("laid"), F.lit(len(words(text))).alias("size"), F.array(*[F.struct(F.lit(" ".join(a)).alias("text"), F.array(*map(F.lit, a)).alias("words"), F.lit(before).alias("before")) for a, before in anchors(text)]).alias("anchors"))
        for name, text in templates.items()
    ])
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.explode(F.array(_normal(F.col("text")))).alias("t"))
    fitting = F.filter(known, lambda k: F.exists(k["anchors"], lambda a: F.contains(F.col("t"), a["text"])))
    held = texts.select("doc_id", "t", F.explode(F.array(fitting)).alias("known")).where(F.size("known") > 0)
    held = held.select("doc_id", F.explode(F.array(F.split("t", " "))).alias("w"), "known")

    def starts(k):
        found = lambda a: F.filter(F.sequence(F.lit(1), F.size("w")), lambda j: F.slice("w", j, F.size(a["words"])) == a["words"])
        moved = F.transform(k["anchors"], lambda a: F.transform(F.filter(found(a), lambda j: j > a["before"]), lambda j: j - a["before"]))
        return F.transform(F.array_distinct(F.flatten(moved)), lambda j: F.struct(j.alias("start"), k["size"].alias("size"), k["laid"].alias("laid")))

    laid = held.select("doc_id", "w", F.explode(F.flatten(F.transform("known", starts))).alias("at"))
    return laid.select("doc_id", F.lit("window").alias("segment"), (F.col("at.start") - 1).alias("number"), F.slice("w", F.col("at.start"), F.col("at.size")).alias("w"), "at.laid")


def sql(threshold: float = THRESHOLD) -> str:
    """The same rows by a plain join on bigrams, for DuckDB."""
    laid = ", ".join(f"('{' '.join(a)}', {before}, {len(words(text))}, '{name}')" for name, text in TEMPLATES.items() for a, before in anchors(text))
    rows = ", ".join(f"('{name}', '{g}', {len(grams)})" for name, text in TEMPLATES.items() for grams in [bigrams(text)] for g in grams)
    return rf"""
    WITH t(license, g, n) AS (VALUES {rows}),
    l AS (SELECT doc_id, 'line' AS segment, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS number FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, 'paragraph' AS segment, unnest(x) AS part, generate_subscripts(x, 1) - 1 AS number FROM (SELECT doc_id, regexp_split_to_array(text, '\n[ \t\r]*\n') AS x FROM documents WHERE text IS NOT NULL)),
    a AS (SELECT * FROM l UNION ALL SELECT * FROM p WHERE contains(part, chr(10))
          UNION ALL SELECT doc_id, 'text', text, 0 FROM documents WHERE regexp_matches(text, '\n[ \t\r]*\n')),
    w AS (SELECT doc_id, segment, number, string_split(trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM a),
    k(g, before, size, laid) AS (VALUES {laid}),
    d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, string_split(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
    j AS (SELECT id, unnest(range(1, len(w) - 1)) AS j, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d),
    y AS (SELECT DISTINCT id, j - before AS start, size, laid FROM j JOIN k USING (g) WHERE j > before),
    v AS (SELECT *, NULL AS laid FROM w UNION ALL SELECT doc_id, 'window', start - 1, list_slice(w, start, start + size - 1), laid FROM y JOIN d USING (id)),
    b AS (SELECT doc_id, segment, number, laid, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM v WHERE len(w) > 1),
    u AS (SELECT row_number() OVER () AS id, doc_id, segment, number, laid, len(grams) AS n, grams FROM b),
    x AS (SELECT id, doc_id, segment, number, laid, n, unnest(grams) AS g FROM u),
    m AS (SELECT x.id, x.doc_id, x.segment, x.number, t.license, count(*) AS shared, x.n AS n_segment, t.n AS n_template
          FROM x JOIN t USING (g) WHERE laid IS NULL OR laid = license GROUP BY ALL)
    SELECT doc_id, segment, CAST(number AS INT) AS number, license, CAST(shared AS BIGINT) AS shared, CAST(n_segment AS BIGINT) AS n_segment,
           CAST(n_template AS BIGINT) AS n_template, round(2 * shared / (n_template + n_segment), 6) AS dice
    FROM m WHERE 2000 * shared >= {round(1000 * threshold)} * (n_template + n_segment)"""
