"""Licence notices: lines, whole texts and runs of words against templates, by Dice over word bigrams.

Dice of two bigram sets A and B is 2|A & B| / (|A| + |B|).  From a threshold t follow size bounds,
t/(2-t) |B| <= |A| <= (2-t)/t |B|, and that at least t/(2-t) of a template's bigrams must occur; so
one of any that leave fewer must occur, which one regular expression tests before anything is split.  The best run of words begins and ends with a bigram of the template, so
only runs between two such places are looked at.  Spark expressions only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0-terms": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC0-1.0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = f"{TEMPLATES['BSD-conditions']} 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
#: Whole licences.
TEMPLATES |= {
    "MIT-text": f"{TEMPLATES['MIT-grant']} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC-text": f"{TEMPLATES['ISC-grant']} "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause-text": f"{_BSD} {_AS_IS}",
    "BSD-3-Clause-text": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS}",
}


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def least(n: int, dice: float) -> int:
    """The fewest of a template's ``n`` bigrams that a match holds; its own size is no less."""
    return max(1, math.ceil(n * dice / (2 - dice) - 1e-9))


def most(n: int, dice: float) -> int:
    return math.floor(n * (2 - dice) / dice + 1e-9)


def needed(n: int, dice: float) -> int:
    """The fewest of a template's ``n`` bigrams that a matching run of words holds."""
    return max(1, math.ceil(n * dice - 1e-9))


def anchor_pattern(texts: list[str], dice: float, fewest=needed) -> str:
    """A regular expression found in every match that holds ``fewest`` of a template's bigrams: so many bigrams that too few are left without them."""
    by: dict[str, dict[str, list[str]]] = {}
    for grams in map(bigrams_of, texts):
        for gram in sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - fewest(len(grams), dice) + 1]:
            one, two = gram.split()
            by.setdefault(one[0], {}).setdefault(one[1:], []).append(two)
    rest = lambda x: "|".join(f"{k}[^a-z0-9]+(?:{'|'.join(sorted(set(v)))})" for k, v in sorted(x.items()))
    return f"(?<![a-z0-9])(?:{'|'.join(f'{k}(?:{rest(v)})' for k, v in sorted(by.items()))})(?![a-z0-9])"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[^a-z0-9]+"), lambda w: w != "")


def _dice(grams: Column, other: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(grams, other)) / (F.size(grams) + F.size(other))


def _windows(docs: DataFrame, templates: dict[str, str], dice: float, id_col: str, text_col: str) -> DataFrame:
    """(id_col, license, line, dice) of runs of words that match where no line or whole text says so."""

    def may(name: str, text: str) -> Column:
        n = len(bigrams_of(text))
        it = F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, bigrams_of(text))).alias("grams"), F.lit(needed(n, dice)).alias("least"), F.lit(most(n, dice)).alias("most"))
        return F.when(F.col("t").rlike(anchor_pattern([text], dice)), it)

    every = F.array(*(F.array(*map(F.lit, bigrams_of(v))) for v in templates.values()))
    rows = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("t")).where(F.col("t").rlike(anchor_pattern(list(templates.values()), dice)))
    rows = rows.select("id", "t", F.explode_outer(F.filter(F.array(*(may(*x) for x in sorted(templates.items()))), lambda x: x.isNotNull())).alias("m")).where("m IS NOT NULL")
    rows = rows.select("id", "m", F.split("t", "\n", -1).alias("lines"))
    rows = rows.withColumn("w", F.flatten(F.transform("lines", lambda x, i: F.transform(_words(x), lambda w: F.struct(w.alias("w"), i.alias("line"))))))
    follow = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat_ws(" ", a.w, b.w))
    rows = rows.withColumn("g", F.slice(follow, 1, F.greatest(F.size("w") - 1, F.lit(0))))
    rows = rows.withColumn("at", F.filter(F.transform("g", lambda g, i: F.when(F.array_contains("m.grams", g), i)), lambda i: i.isNotNull()))
    ends = lambda a, i: F.filter(F.slice("at", i + F.col("m.least"), F.col("m.most") - F.col("m.least") + 1), lambda b: b - a < F.col("m.most"))
    run = lambda a, b: F.struct((-near(F.array_distinct(F.slice("g", a + 1, b - a + 1)))).alias("d"), a.alias("a"), b.alias("b"))
    near = lambda x: 2.0 * F.size(F.array_intersect(x, F.col("m.grams"))) / (F.greatest(F.size(x), F.size("m.grams")) + F.size("m.grams"))
    rows = rows.withColumn("runs", F.array_sort(F.filter(F.flatten(F.transform("at", lambda a, i: F.transform(ends(a, i), lambda b: run(a, b)))), lambda r: r.d <= -dice)))
    apart = lambda got, r: ~F.exists(got, lambda s: (s.a <= r.b + 1) & (r.a <= s.b + 1))
    best = F.aggregate("runs", F.expr("CAST(array() AS array<struct<d:double,a:int,b:int>>)"), lambda got, r: F.when(apart(got, r), F.concat(got, F.array(r))).otherwise(got))
    rows = rows.select("id", "m", "lines", "w", F.array_distinct("g").alias("all"), F.explode_outer(best).alias("r")).where("r IS NOT NULL")
    rows = rows.select("id", "m", "lines", "all", "r.d", F.element_at("w", F.col("r.a") + 1).line.alias("line"), F.element_at("w", F.col("r.b") + 2).line.alias("last"))
    # A condition on the text alone would be moved down to the scan: it asks for the run.
    whole = F.when(F.col("d") <= 0, (F.size("lines") > 1) & F.exists(every, lambda t: _dice(F.col("all"), t) >= dice))
    inside = (F.col("line") == F.col("last")) & F.exists(every, lambda t: _dice(_bigrams(_words(F.element_at("lines", F.col("line") + 1))), t) >= dice)
    told = F.exists(F.slice("lines", F.col("line") + 1, F.col("last") - F.col("line") + 1), lambda x: _dice(_bigrams(_words(x)), F.col("m.grams")) >= dice)
    return rows.where(~(whole | inside | told)).select(F.col("id").alias(id_col), "m.license", "line", (-F.col("d")).alias("dice"))


def _bigrams(words: Column) -> Column:
    follow = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.slice(follow, 1, F.greatest(F.size(words) - 1, F.lit(0))))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, dice: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, license, line, dice): every line (0, 1, ...) or whole text (-1) that matches a template.

    Besides these, runs of words over several lines or inside one, with the line they begin on: of
    overlapping runs that match a template the one with the best Dice (then the first, the shorter),
    unless it lies in a whole text or a line that matches some template, or touches a line that
    matches the same.  A run begins and ends with a bigram of the template,
    has at most (2-t)/t times the template's bigrams, and one with fewer
    than the template counts as having as many: what it lacks is not made good by leaving off the
    words around.

    Texts are normalised to their lower-case runs of a-z and 0-9.  The whole text is compared only
    if it has more than one line.  ``templates`` is a dictionary in the plan, so it is small.

    Null or empty texts and texts of one word match nothing.  Repeated rows give repeated results;
    ties between templates are all returned; other columns are ignored; null ids are kept.
    """
    templates = {k: v for k, v in (templates or TEMPLATES).items() if bigrams_of(v)}
    some = anchor_pattern(list(templates.values()), dice, least)
    fewest = min(least(len(bigrams_of(v)), dice) for v in templates.values())
    text = F.col(text_col)
    lines = F.split(text, "\n", -1)
    units = F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.lower(x).alias("t")))
    units = F.when(F.size(lines) > 1, F.concat(F.array(F.struct(F.lit(-1).alias("line"), F.lower(text).alias("t"))), units)).otherwise(units)
    rows = docs.select(F.col(id_col), text_col).where(F.lower(text).rlike(some)).select(id_col, F.explode(F.filter(units, lambda u: u.t.rlike(some))).alias("u"))
    rows = rows.select(id_col, "u.line", F.filter(F.split("u.t", "[^a-z0-9]+"), lambda w: w != "").alias("w")).where(F.size("w") > fewest)
    rows = rows.select(id_col, "line", _bigrams(F.col("w")).alias("b")).withColumn("n", F.size("b"))

    def score(name: str, text: str) -> Column:
        grams = bigrams_of(text)
        n = len(grams)
        near = 2.0 * F.size(F.array_intersect("b", F.array(*map(F.lit, grams)))) / (F.col("n") + n)
        fits = F.col("n").between(least(n, dice), most(n, dice))
        return F.struct(F.lit(name).alias("license"), F.when(fits, near).alias("dice"))

    scores = F.filter(F.array(*(score(*x) for x in sorted(templates.items()))), lambda s: s.dice >= dice)
    found = rows.select(id_col, "line", F.explode(scores).alias("s")).select(id_col, "s.license", "line", "s.dice")
    return found.unionAll(_windows(docs, templates, dice, id_col, text_col))
