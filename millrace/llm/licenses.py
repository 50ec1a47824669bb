"""License scan by Dice coefficient over word bigrams.

Lines, their sentences and paragraphs of a text are normalised (lower case, runs
of letters and digits, so that comment marks are nothing) and compared to licence templates by the Dice coefficient of their sets
of word bigrams. Size bounds prune templates first: a Dice of t needs the sizes
a and b to satisfy a t / (2 - t) <= b <= a (2 - t) / t. Before that, a unit must
hold one of the anchor words, which are chosen so that no unit without them can
reach the threshold. Column expressions only, within each row.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices and grants of common licences.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "LGPL-3.0": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "Proprietary": ("All rights reserved.",),
}

#: Short references.
SHORT = {"MIT": ("Licensed under the MIT License.",)}

#: Identifiers that a tag names a licence by, and the licence.
TAGS = {
    "MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0", "BSD-3-Clause": "BSD-3-Clause", "CC-BY-NC-4.0": "CC-BY-NC-4.0", "CC-BY-4.0": "CC-BY-4.0",
    "CC0-1.0": "CC0-1.0", "MPL-2.0": "MPL-2.0", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0", "ISC": "ISC", "Unlicense": "Unlicense", "BSL-1.0": "BSL-1.0", "EPL-2.0": "EPL-2.0",
}


def normalise(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def bigrams(words: list[str]) -> list[str]:
    """Distinct bigrams in order; a single word is its own."""
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])] or words
    return list(dict.fromkeys(pairs))


def dice(a: str, b: str) -> float:
    x, y = set(bigrams(normalise(a))), set(bigrams(normalise(b)))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def templates(threshold: float) -> list[dict]:
    out = []
    tags = {tag: (f"SPDX-License-Identifier: {tag}",) for tag in TAGS}
    for name, texts in [*TEMPLATES.items(), *SHORT.items(), *((TAGS[t], x) for t, x in tags.items())]:
        for text in texts:
            words = normalise(text)
            grams = bigrams(words)
            n = len(grams)
            low, high = math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)
            anchors: list[str] = []
            for w in sorted(set(words), key=lambda w: (-len(w), w)):
                # the fewest bigrams that a match shares is ``low``
                if sum(not set(g.split()) & set(anchors) for g in grams) < low:
                    break
                anchors.append(w)
            out.append({"name": name, "grams": grams, "low": low, "high": high, "anchors": anchors})
    return out


def anchor_pattern(words: set[str]) -> str:
    """Finds any of the words as a word of a lower-cased text, by first letters."""
    first = {w[0]: sorted(x[1:] for x in words if x[0] == w[0]) for w in words}
    return "(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(first.items())) + ")(?![a-z0-9])"


SENTENCE = r"[.!?;][\x20\x09-\x0D]+"
#: A line without a word, so that one of comment marks alone ends a paragraph too.
PARAGRAPH = r"\n[^A-Za-z0-9\n]*\n"


def matches_column(text: Column, threshold: float) -> Column:
    """Array of structs (neg, license, unit) for units that match; neg is minus
    the Dice and unit the normalised text, units that are equal in it being one."""
    own = templates(threshold)
    anchor = anchor_pattern({a for t in own for a in t["anchors"]})
    low, high = min(t["low"] for t in own), max(t["high"] for t in own)
    t = F.lower(F.coalesce(text, F.lit("")))
    named = lambda a: F.filter(a, lambda u: u.rlike(anchor))
    lines = named(F.split(t, "\n", -1))
    sentences = named(F.flatten(F.transform(lines, lambda u: F.split(u, SENTENCE, -1))))
    units = F.concat(lines, sentences, named(F.split(t, PARAGRAPH, -1)))
    units = F.array_distinct(F.transform(units, lambda u: F.array_join(F.regexp_extract_all(u, F.lit("[a-z0-9]+"), F.lit(0)), " ")))
    words = F.transform(units, lambda u: F.struct(u.alias("u"), F.split(u, " ").alias("w")))
    grams = F.transform(words, lambda x: F.struct(x["u"].alias("u"), F.array_distinct(F.when(F.size(x["w"]) > 1, F.zip_with(F.slice(x["w"], 1, F.size(x["w"]) - 1), F.slice(x["w"], 2, F.size(x["w"]) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(x["w"])).alias("g")))
    grams = F.filter(grams, lambda x: F.size(x["g"]).between(low, high))

    def of_unit(x: Column) -> Column:
        hits = []
        for t in own:
            lit = F.array(*(F.lit(g) for g in t["grams"]))
            score = 2 * F.size(F.array_intersect(x["g"], lit)) / (F.size(x["g"]) + len(t["grams"]))
            fits = F.size(x["g"]).between(t["low"], t["high"])
            hits.append(F.when(fits & (score >= threshold), F.struct((-score).alias("neg"), F.lit(t["name"]).alias("license"), x["u"].alias("unit"))))
        return F.array_min(F.array(*hits))  # the best template; ties by name

    # a text without any anchor word is settled by one search
    none = F.array().cast("array<struct<neg:double,license:string,unit:string>>")
    return F.when(t.rlike(anchor), F.array_compact(F.transform(grams, of_unit))).otherwise(none)


def scan(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, license (best match; ties by name; null if
    none), dice, n_license_units (matching lines, sentences and paragraphs,
    those of the same words once) and licenses (sorted distinct names, comma-joined).

    Null, empty and wordless texts match nothing; texts and lines of any length
    are read whole; repeated rows each give a row; a null doc_id is kept; other
    columns are not looked at; an empty table gives no rows.
    """
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"))
    own = own.withColumn("m", matches_column(F.col("t"), threshold)).withColumn("best", F.array_min("m"))
    names = F.array_sort(F.array_distinct(F.transform("m", lambda x: x["license"])))
    return own.select("doc_id", F.col("best.license").alias("license"), F.coalesce(-F.col("best.neg"), F.lit(0.0)).alias("dice"), F.size("m").cast("long").alias("n_license_units"), F.array_join(names, ",").alias("licenses"))
