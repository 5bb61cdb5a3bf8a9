"""Licence scan: Dice coefficient of word bigrams against licence templates.

Templates are short notices, and of whole licences the longer sentences, every
paragraph and all of it. Units are a text's lines and their sentences, its paragraphs (between blank
lines) and their sentences, which cross line ends, and the whole text; so a
licence wrapped over lines, in a comment or on one line gives the same units as
its template. A unit's words are lower-cased runs of letters, digits and inner
dots. For sets A (unit) and B (template) of bigrams the coefficient is
2|A n B| / (|A| + |B|). It can reach t only if |B| t / (2 - t) <= |A| <= |B|
(2 - t) / t, so a template is compared only with units within these bounds. A
unit that reaches t also shares more than |B| t / (2 - t) bigrams of B; hence
it holds one of a few words of each template that its other bigrams cannot make
up for, and units without any of these words are left out before bigrams are
made. Both prunings are lossless.

Everything is built-in expressions. Defined cases: null and empty texts have no
licence; of equal scores the licence first by name wins; rows with null or
repeated ids give one row each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The usual short notices of common licences.
NOTICES = {
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-3-Clause": ["Released under the BSD License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3"],
    "MIT": ["Released under the MIT License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
# Paragraphs of whole licences.
FULL = {
    "BSD-2-Clause": [_BSD_GRANT, _BSD_SOURCE, _BSD_BINARY, _BSD_WARRANTY],
    "BSD-3-Clause": [_BSD_GRANT, _BSD_SOURCE, _BSD_BINARY, _BSD_NAME, _BSD_WARRANTY],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    ],
}


def templates_of(notices: dict[str, list[str]], full: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(licence, text) of all notices and, of whole licences, of their sentences of eight words or more, paragraphs and all, by licence."""
    out = {(n, t) for n, ts in notices.items() for t in ts}
    for n, ts in full.items():
        sentences = [s for t in ts for s in re.split(r"(?<=[.!?:;]) ", t) if len(s.split()) >= 8]
        out |= {(n, t) for t in [*sentences, *ts, " ".join(ts)]}
    return sorted(out)


TEMPLATES = templates_of(NOTICES, FULL)
#: A word: letters or digits, with single dots inside.
WORD = r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*"


def template_bigrams(text: str) -> list[str]:
    """Distinct bigrams of a template, by the rule that units follow."""
    words = re.findall(r"[^\W_]+(?:\.[^\W_]+)*", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def telling_words(grams: list[str], threshold: float) -> set[str]:
    """Words so chosen that fewer than the needed share of bigrams has none of them."""
    chosen: set[str] = set()
    left = set(grams)
    while len(left) >= len(grams) * threshold / (2 - threshold):
        counts: dict[str, int] = {}
        for g in left:
            for w in set(g.split(" ")):
                counts[w] = counts.get(w, 0) + 1
        best = max(counts, key=lambda w: (len(w) > 4, len(w) * counts[w], w))
        chosen.add(best)
        left = {g for g in left if best not in g.split(" ")}
    return chosen


def best_template(unit: Column, templates: list[tuple[str, str]], threshold: float) -> Column:
    """struct(score, licence) of the best template of a unit at the threshold, or null."""
    words = F.regexp_extract_all(F.lower(unit), F.lit(WORD), F.lit(0))
    grams = F.array_distinct(F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))

    def score(g: Column, name: str, own: list[str]) -> Column:
        low, high = len(own) * threshold / (2 - threshold), len(own) * (2 - threshold) / threshold
        dice = 2.0 * F.size(F.array_intersect(g, F.array(*map(F.lit, own)))) / (F.size(g) + len(own))
        return F.when(F.size(g).between(low, high), F.struct(dice.alias("score"), F.lit(name).alias("licence")))

    scored = F.transform(F.array(grams), lambda g: F.array_compact(F.array(*[score(g, n, template_bigrams(t)) for n, t in templates])))
    best = lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a)
    start = F.struct(F.lit(0.0).alias("score"), F.lit("").alias("licence"))
    return F.transform(scored, lambda s: F.aggregate(s, start, best))[0]


def units_of(text: Column) -> Column:
    """Distinct units of a text, as one array."""
    lines = F.split(text, "\n", -1)
    ends = F.split(F.regexp_replace(text, r"([.!?:;])[\x20\t]", "$1\n"), "\n", -1)
    # What is left of line ends in a paragraph becomes a space.
    paragraphs = F.transform(F.split(text, r"\n[\x20\t\r]*\n", -1), lambda p: F.replace(p, F.lit("\n"), F.lit(" ")))
    flowing = F.flatten(F.transform(paragraphs, lambda p: F.split(F.regexp_replace(p, r"([.!?:;])[\x20\t]", "$1\n"), "\n", -1)))
    return F.array_distinct(F.concat(lines, ends, paragraphs, flowing, F.array(text)))


def scan(docs: DataFrame, threshold: float = 0.8, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_units, licence, score, licences) for every row: units with a licence, the best one, and all found."""
    templates = sorted(templates or TEMPLATES)
    telling = sorted(set().union(*(telling_words(template_bigrams(t), threshold) for _, t in templates)))
    # Plain substring searches, of the text for all such words and of its units for those that it has; a word inside another only goes on to the exact test.
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = lambda t: F.filter(F.array(*map(F.lit, telling)), lambda w: F.contains(t, w))
    has = lambda u, words: F.exists(words, lambda w: F.contains(u, w))
    let = lambda value, body: F.transform(F.array(value), body)[0]
    units = let(let(F.lower(text), held), lambda words: F.when(F.size(words) > 0, F.filter(units_of(text), lambda u: let(F.lower(u), lambda low: has(low, words)))))
    found = F.filter(F.transform(units, lambda u: best_template(u, templates, threshold)), lambda s: s["score"] >= threshold)
    top = lambda f: F.array_sort(f, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["licence"] < b["licence"], -1).when(a["licence"] > b["licence"], 1).otherwise(0))
    pick = F.transform(F.array(found), lambda f: F.struct(f.alias("f"), F.get(top(f), F.lit(0)).alias("t")))[0]
    out = docs.select(F.col(id_col).alias("doc_id"), pick.alias("x")).select("doc_id", "x.f", "x.t")
    return out.select("doc_id", F.coalesce(F.size("f"), F.lit(0)).cast("long").alias("n_units"), F.col("t.licence").alias("licence"), F.round("t.score", 6).alias("score"), F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.col("f.licence"))), ","), F.lit("")).alias("licences"))
