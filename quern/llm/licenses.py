"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams. DataFrame only.

Units of a document are its lines, its sentences, its paragraphs (parted by blank lines) and the whole text. Words are runs of a-z and
0-9 after lower-casing; a unit's bigrams are distinct. A template is a candidate only if the unit's number of bigrams
lies in the bounds within which the coefficient can reach the threshold at all: t/(2-t) to (2-t)/t times its own.
Texts without any of the anchor words, one of which every match must have, are left out first by one pattern. Bigrams are looked up in a broadcast table of the templates' bigrams, a constant of this module; only hits are grouped.

Templates are short wordings, made by rule of lead phrases and licence names, and notices and whole texts of licences;
``templates_from`` takes further whole texts from a folder. A unit speaks for the licence with its best coefficient.

Nulls: a null text has no units; a null doc_id is a group of its own. Repeated rows give one finding. Ties between
licences stay: each that shares a unit's best coefficient is returned. Documents without a finding have no row; an empty table
gives an empty result. Further columns are ignored. Texts are scanned whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

THRESHOLD = 0.8

# How notices name public licences, by SPDX identifier, and the phrases that lead to or follow a name.
NAMES: dict[str, str] = {
    "MIT": "the MIT License",
    "Apache-2.0": "the Apache License, Version 2.0",
    "BSD-2-Clause": "the BSD 2-Clause License",
    "BSD-3-Clause": "the BSD 3-Clause License",
    "ISC": "the ISC License",
    "GPL-2.0": "the GNU General Public License, version 2",
    "GPL-3.0": "the GNU General Public License, version 3",
    "LGPL-2.1": "the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "the GNU Affero General Public License, version 3",
    "MPL-2.0": "the Mozilla Public License, version 2.0",
    "EPL-2.0": "the Eclipse Public License, version 2.0",
    "CC0-1.0": "CC0 1.0",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "CC-BY-ND-4.0": "CC BY-ND 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-NC-SA-4.0": "CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0": "CC BY-NC-ND 4.0",
}
PHRASES = (
    "Licensed under {}.",
    "Released under {}.",
    "Distributed under {}.",
    "This work is licensed under {}.",
    "This project is licensed under {}.",
    "This software is licensed under {}.",
    "This project is licensed under {} - see the LICENSE file for details.",
)

# Public licence notices and texts, by SPDX identifier where there is one.
TEXTS: dict[str, str] = {
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-2.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "LGPL-2.1": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see https://www.gnu.org/licenses/.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

#: Each template's text by its name: the licence, and after a slash which of its wordings it is.
TEMPLATES: dict[str, str] = {f"{k}/text": v for k, v in TEXTS.items()} | {f"{k}/{i}": p.format(v) for k, v in NAMES.items() for i, p in enumerate(PHRASES)}


def templates_from(spark: SparkSession, path: str, most_bytes: int = 1 << 17) -> dict[str, str]:
    """Whole licence texts as templates: the files of a folder, by their names. A file over ``most_bytes`` is an error."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.decode(F.substring("content", 1, most_bytes), "UTF-8").alias("body"))
    rows = files.collect()
    if any(r["length"] > most_bytes for r in rows):
        raise ValueError(f"a licence text is larger than {most_bytes} bytes")
    return {f"{r['name'].removesuffix('.txt')}/text": r["body"] for r in rows}


def word_list(text: Column) -> Column:
    """The words of a text; the cheap pass over long texts is one regular expression."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def bigrams(words: Column) -> Column:
    """Distinct neighbouring pairs; fewer than two words have none."""
    after = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(words, 1, F.size(after)), after, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def template_bigrams(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """bigram, template, t_size: some thousand rows, as many as the given templates have pairs of words."""
    rows = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(v).alias("notice")) for k, v in templates.items()])
    table = spark.range(1, numPartitions=1).select(F.inline(rows)).withColumn("b", bigrams(word_list(F.col("notice"))))
    return table.select(F.explode("b").alias("bigram"), "template", F.size("b").alias("t_size"))


#: Words too common to anchor a search.
COMMON = frozenset("a all an and any are as at be by can do for from has have if in is it may more not of on one only or other such than that the these this to under use was with without you your must see free code copy along shall nd sa nc".split())


def anchors(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every unit that can reach the threshold has at least one.

    Such a unit shares at least t/(2-t) of a template's bigrams; words are chosen, the most covering first, until the
    bigrams without any of them are fewer than that. Long words are taken first, as fewer texts have them.
    """
    out: set[str] = set()
    for notice in templates.values():
        words = re.sub("[^a-z0-9]+", " ", notice.lower()).split()
        left = set(zip(words, words[1:], strict=False))
        need = math.ceil(threshold / (2 - threshold) * len(left) - 1e-9)
        while len(left) >= max(need, 1):
            count = Counter(w for pair in left for w in set(pair))
            best = min(count, key=lambda w: (2 if w in COMMON or len(w) < 2 else int(len(w) < 5), w not in out, -count[w], w))
            out.add(best)
            left = {pair for pair in left if best not in pair}
    return sorted(out)


def word_pattern(words: list[str]) -> str:
    """A pattern of any of the words, as a tree of their letters: a text's word leaves it at its first other letter."""

    def tree(rest: list[str]) -> str:
        by: dict[str, list[str]] = {}
        for w in rest:
            by.setdefault(w[:1], []).append(w[1:])
        ends = "" in by
        parts = [c + tree(more) for c, more in sorted(by.items()) if c]
        body = parts[0] if len(parts) == 1 and not ends else f"(?:{'|'.join(parts)}){'?' if ends else ''}" if parts else ""
        return body

    first = "".join(sorted({w[0] for w in words}))
    return f"(?<![a-z0-9])(?=[{first}]){tree(sorted(words))}(?![a-z0-9])" if words else "(?!)"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    """Per document and template over the threshold: doc_id, license, dice (the best unit's), n_units (units over it)."""
    spark = docs.sparkSession
    found = template_bigrams(spark, TEMPLATES if templates is None else templates)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = found.agg(F.min("t_size"), F.max("t_size")).head()
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = anchors(TEMPLATES if templates is None else templates, threshold)
    docs = docs.where(F.lower(text).rlike(word_pattern(known)))
    sentences = F.split(F.regexp_replace(text, r"([.!?])[ \t\r\n]+", "$1\x1e"), "\x1e")
    units = F.array_distinct(F.concat(F.split(text, r"\r?\n"), sentences, F.split(text, r"\n[ \t\r]*\n"), F.array(text)))
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.posexplode(units).alias("unit", "line"))
    words = lines.select("doc_id", "row", "unit", word_list(F.col("line")).alias("w"))
    # repeated pairs make fewer bigrams than words: the upper bound holds for distinct bigrams only, after this one
    words = words.where(F.size("w") - 1 >= F.lit(low * (sizes[0] or 0)))
    sized = words.select("doc_id", "row", "unit", bigrams(F.col("w")).alias("b")).withColumn("u_size", F.size("b"))
    sized = sized.where(F.col("u_size").between(low * (sizes[0] or 0), high * (sizes[1] or 0)))
    pairs = sized.select("doc_id", "row", "unit", "u_size", F.explode("b").alias("bigram"))
    hits = pairs.join(F.broadcast(found), "bigram").where(F.col("u_size").between(low * F.col("t_size"), high * F.col("t_size")))
    shared = hits.groupBy("doc_id", "row", "unit", "u_size", "template", "t_size").agg(F.count("*").alias("shared"))
    scored = shared.withColumn("dice", 2.0 * F.col("shared") / (F.col("u_size") + F.col("t_size"))).where(F.col("dice") >= threshold)
    scored = scored.withColumn("license", F.substring_index("template", "/", 1)).withColumn("best", F.max("dice").over(Window.partitionBy("doc_id", "row", "unit")))
    return scored.where("dice = best").groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.count_distinct("unit").alias("n_units"))


def oracle(threshold: float = THRESHOLD) -> str:
    """The same in DuckDB SQL over the view documents."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    words = "string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    grams = "list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
WITH t AS (SELECT template, {grams} AS b FROM (SELECT template, {words.format("notice")} AS w FROM (VALUES {values}) AS v(template, notice))
), tb AS (SELECT template, len(b) AS t_size, unnest(b) AS g FROM t
), d AS (
  SELECT doc_id, row_number() OVER () AS r, list_concat(list_concat(regexp_split_to_array(coalesce(text, ''), '\r?\n'), regexp_split_to_array(coalesce(text, ''), '\n[ \t\r]*\n')), list_concat(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\r\n]+', '\1' || chr(30), 'g'), chr(30)), [coalesce(text, '')])) AS units FROM documents
), u AS (SELECT doc_id, r, unnest(list_distinct(units)) AS line FROM d
), s AS (SELECT doc_id, r, line, {grams} AS b FROM (SELECT doc_id, r, line, {words.format("line")} AS w FROM u)
), x AS (SELECT doc_id, r, line, len(b) AS u_size, unnest(b) AS g FROM s
), h AS (
  SELECT doc_id, r, line, string_split(template, '/')[1] AS license, 2.0::DOUBLE * count(*) / (u_size + t_size) AS dice FROM x JOIN tb USING (g)
  WHERE u_size BETWEEN {low!r} * t_size AND {high!r} * t_size GROUP BY doc_id, r, line, template, u_size, t_size
), best AS (SELECT * FROM h WHERE dice >= {threshold} QUALIFY dice = max(dice) OVER (PARTITION BY doc_id, r, line))
SELECT doc_id, license, max(dice) AS dice, count(DISTINCT line) AS n_units FROM best GROUP BY doc_id, license
"""
