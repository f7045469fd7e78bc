"""Licence scans by the Dice coefficient over word bigrams, in built-in functions only.

A text is brought to lower-case words; its bigrams, repeats counted, are compared with those of
each template. A coefficient above THRESHOLD needs sizes within a ratio, so parts of other sizes
are not compared, and it needs so many of a template's bigrams that any larger rest of them is
touched: so each template has a few pairs of words, its rarest (taken as the longest), of which
one must stand in the part. A pattern of these pairs' longer words passes over the texts first,
then one of the pairs themselves; texts that hold none have no notice.

Where such a pair stands in a text it says where the template would start. From each such start,
whatever the lines, three windows of words are compared: one of the template's size, one of the
largest size that the coefficient allows, and one of that size that starts earlier by as much as
it is larger. Each is cut to its best end, and then to the best start before it. Of windows that
overlap the best one is a notice, taken from the left.

Defined results: null and empty texts have no licences; very long texts are compared around such
pairs only; ties go to the longer window, then the smaller licence name; rows repeat as given; an
empty table gives no rows; only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: What a notice's coefficient has to be above.
THRESHOLD = 0.8

# Fixed value: the end of the BSD licences.
_BSD_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
    " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

# Notices by which texts name their licence, the licences' own words, and tags.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution." + _BSD_DISCLAIMER),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." + _BSD_DISCLAIMER),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("0BSD", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib")),
)


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def bigrams_of(words: list[str]) -> list[str]:
    """Pairs of neighbouring words, numbered where they repeat."""
    seen: dict[str, int] = {}
    out = []
    for a, b in zip(words, words[1:]):
        seen[f"{a} {b}"] = seen.get(f"{a} {b}", 0) + 1
        out.append(f"{a} {b} {seen[f'{a} {b}']}")
    return out


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes that can reach the threshold with size."""
    ratio = threshold / (2 - threshold)
    return math.ceil(size * ratio - 1e-9), math.floor(size / ratio + 1e-9)


def needed(size: int, threshold: float) -> int:
    """How many of a template's size bigrams any part of a text shares that reaches the threshold."""
    return math.ceil(threshold / 2 * (size + bounds(size, threshold)[0]) - 1e-9)


def pair_anchors(text: str, threshold: float) -> list[tuple[str, int]]:
    """(pair, place) of a template's rarest pairs of words, as the longest: so many that a part without any is below the threshold."""
    words = words_of(text)
    pairs = list(zip(words, words[1:]))
    most = len(pairs) - needed(len(pairs), threshold) + 1
    chosen = sorted(range(len(pairs)), key=lambda i: (-len(pairs[i][0]) - len(pairs[i][1]), pairs[i], i))[:most]
    return [(" ".join(pairs[i]), i) for i in sorted(chosen)]


def word_anchors(pairs: list[str]) -> list[str]:
    """The longer words of some pairs."""
    return sorted({max(p.split(" "), key=lambda w: (len(w), w)) for p in pairs})


def any_of(words: list[str]) -> str:
    """A pattern of whole words, by their first letters."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return "(?i)(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")(?![a-z0-9])"


FOUND = "array<struct<dice:double,licence:string,first:int,last:int>>"


def licences(text: Column, threshold: float = THRESHOLD, templates=TEMPLATES) -> Column:
    """array of (dice, licence, first, last) of a text's notices, by place: first and last are the numbers of their words."""
    table, anchors = [], []
    for number, (name, notice) in enumerate(templates):
        words = words_of(notice)
        pairs = Counter(" ".join(p) for p in zip(words, words[1:]))
        n = pairs.total()
        more = [(p, c) for p, c in pairs.items() if c > 1]
        table.append(
            F.struct(
                F.lit(name).alias("licence"), F.lit(n).alias("n"), F.lit(bounds(n, threshold)[1]).alias("most"), F.lit(needed(n, threshold)).alias("need"), F.array(*map(F.lit, pairs)).alias("pairs"),
                F.array(*(F.struct(F.lit(p).alias("pair"), F.lit(c).alias("n")) for p, c in more)).cast("array<struct<pair:string,n:int>>").alias("more"),
            )
        )
        anchors += [(pair, number, place) for pair, place in pair_anchors(notice, threshold)]
    known = F.array(*table)
    close = sorted({a[0] for a in anchors})
    starts_of = F.array(*(F.struct(F.lit(p).alias("pair"), F.lit(t).alias("t"), F.lit(i).alias("place")) for p, t, i in anchors))
    rare = any_of(word_anchors(close))
    paired = any_of([p.replace(" ", "[^a-z0-9]+") for p in close])

    def window(ws: Column, t: Column, start: Column, size: Column) -> Column:
        """What is found in a window of size bigrams from a start on, which may lie before the text."""
        first = F.greatest(start, F.lit(0))

        def best_end(pairs: Column) -> Column:
            """(minus, end): of the parts from the first pair on, the best one's negative coefficient and how many pairs it has."""
            allowed = lambda p: F.aggregate(t["more"], F.lit(1), lambda s, m: s + F.when(m["pair"] == p, m["n"] - 1).otherwise(0))
            shared = F.transform(
                pairs, lambda p, i: F.array_contains(t["pairs"], p) & (F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda q: q == p)) < allowed(p))
            )

            def step(s: Column, counts: Column) -> Column:
                n = s["shared"] + F.when(counts, 1).otherwise(0)
                minus = -2.0 * n / (s["i"] + 1 + t["n"])
                better = counts & (minus <= s["minus"])
                return F.struct(
                    (s["i"] + 1).alias("i"), n.alias("shared"), F.when(better, minus).otherwise(s["minus"]).alias("minus"), F.when(better, s["i"] + 1).otherwise(s["end"]).alias("end")
                )

            return F.aggregate(shared, F.struct(F.lit(0).alias("i"), F.lit(0).alias("shared"), F.lit(0.0).alias("minus"), F.lit(0).alias("end")), step)

        def cut(pairs: Column) -> Column:
            hits = F.transform(pairs, lambda p: F.array_contains(t["pairs"], p))

            def scored(before: Column) -> Column:
                """The best end from the first hit on, then the best start before that end."""

                def ended(e: Column) -> Column:
                    own = F.slice(pairs, before, F.greatest(e["end"], F.lit(0)))
                    return let(
                        best_end(F.reverse(own)),
                        lambda x: F.struct(
                            (first + before - 1 + e["end"] - x["end"]).alias("first"), x["minus"].alias("minus"), (-x["end"]).alias("minus_size"),
                            t["licence"].alias("licence"), (first + before - 1 + e["end"]).alias("last"),
                        ),
                    )

                return let(best_end(F.slice(pairs, before, F.size(pairs))), ended)

            enough = F.size(F.filter(hits, lambda h: h)) >= t["need"]
            return F.when(enough, let(F.array_position(hits, True).cast("int"), scored))

        part = F.slice(ws, first + 1, size + 1 - (first - start))
        return let(part, lambda w: let(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)), cut))

    def notices(ws: Column) -> Column:
        marks = F.filter(F.transform(ws, lambda w, i: F.struct(i.alias("i"), F.concat_ws(" ", w, F.get(ws, i + 1)).alias("pair"))), lambda m: m["pair"].isin(close))
        starts = F.array_distinct(F.flatten(F.transform(marks, lambda m: F.transform(F.filter(starts_of, lambda a: a["pair"] == m["pair"]), lambda a: F.struct(a["t"].alias("t"), (m["i"] - a["place"]).alias("s"))))))

        def windows(x: Column) -> Column:
            return let(
                F.element_at(known, x["t"] + 1),
                lambda t: F.array(window(ws, t, x["s"], t["n"]), window(ws, t, x["s"], t["most"]), window(ws, t, x["s"] - (t["most"] - t["n"]), t["most"])),
            )

        found = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(starts, windows)), lambda w: w["minus"] < -threshold)))
        none = F.lit(None).cast("struct<first:int,minus:double,minus_size:int,licence:string,last:int>")
        empty = F.array().cast("array<struct<first:int,minus:double,minus_size:int,licence:string,last:int>>")
        chosen = F.aggregate(
            found,
            F.struct(empty.alias("done"), none.alias("now")),
            lambda s, w: F.when(s["now"].isNull(), F.struct(s["done"].alias("done"), w.alias("now")))
            .when(w["first"] > s["now"]["last"], F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), w.alias("now")))
            .when(F.struct(w["minus"], w["minus_size"]) < F.struct(s["now"]["minus"], s["now"]["minus_size"]), F.struct(s["done"].alias("done"), w.alias("now")))
            .otherwise(s),
            lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))),
        )
        return F.transform(chosen, lambda w: F.struct((-w["minus"]).alias("dice"), w["licence"].alias("licence"), w["first"].alias("first"), w["last"].alias("last")))

    found = let(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""), notices)
    return F.when(text.rlike(rare) & text.rlike(paired), found).otherwise(F.array().cast(FOUND))


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_notices, licence, dice, found) of every row of docs: how many notices, the best one's licence and coefficient, and all licences, sorted."""
    found = docs.select("doc_id", licences(F.coalesce(F.col("text").cast("string"), F.lit("")), threshold, templates).alias("l"))
    best = let(F.array_min(F.transform("l", lambda f: F.struct((-f["dice"]).alias("minus"), f["licence"].alias("licence")))), lambda b: b)
    return found.select(
        "doc_id", F.size("l").cast("long").alias("n_notices"), best["licence"].alias("licence"), F.round(-best["minus"], 6).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("l", lambda f: f["licence"]))), ",").alias("found"),
    )
