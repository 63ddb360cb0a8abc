"""Licence scans: passages compared with licence templates by the Dice coefficient over word bigrams, natively.

Passages are a text's lines, the whole text, and for each template the windows of as many words as it has, over the whole
text with its lines joined, begun at each fourth of their size and at the end: so a notice within a longer line, and a licence wrapped over
lines in a longer text, are found. A passage is lower-cased, everything but letters a to z
and digits becomes a blank, and its distinct word bigrams are taken. Dice is twice the common bigrams
over the sum of both counts; for it to reach the threshold t, a passage's count must lie between
t / (2 - t) and (2 - t) / t of the template's, so a template outside is never compared. It must also hold
t / (2 - t) of the template's bigrams, so one of any set of all but fewer (`anchors`): windows are only looked at in texts with such a bigram.

Templates are a short fixed list held in the expression itself, and a document's passages stay in its row: no
join and no shuffle.

Nulls: a null text has no passages; null ids stay. Empty texts and texts without a licence get no licence
(null), an empty list of licences and the score 0. Ties between templates go to the first in the list. Repeated rows are reported each
for itself. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Short notices and whole texts of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "MIT": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "GPL-3.0 notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
}


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def anchors(text: str, threshold: float) -> list[str]:
    """Bigrams of a template of which a passage that reaches the threshold has one at least: the longest ones."""
    own = bigrams_of(text)
    least = math.ceil(len(own) * threshold / (2 - threshold) - 1e-9)
    return sorted(own, key=lambda x: (-len(x), x))[: len(own) - least + 1]


def stride(words: int) -> int:
    """How far apart windows of so many words begin."""
    return max(1, words // 4)


def bounds(n: int, threshold: float) -> tuple[float, float]:
    """How many bigrams a passage may have to reach the threshold with a template of n."""
    return n * threshold / (2 - threshold), n * (2 - threshold) / threshold


def best(bigrams: Column, templates: dict[str, str], threshold: float) -> Column:
    """struct(score, rank, licence) of the best template, score 0 where none is within bounds."""
    found = []
    for rank, (name, text) in enumerate(templates.items()):
        own = bigrams_of(text)
        low, high = bounds(len(own), threshold)
        dice = 2.0 * F.size(F.array_intersect(bigrams, F.lit(own))) / (F.size(bigrams) + len(own))
        score = F.when((F.size(bigrams) >= low) & (F.size(bigrams) <= high), dice).otherwise(0.0)
        found.append(F.struct(score.alias("score"), F.lit(-rank).alias("rank"), F.lit(name).alias("licence")))
    return F.greatest(*found)


def best_window(grams: Column, name: str, text: str, rank: int, threshold: float) -> Column:
    """struct(score, rank, licence) of a text's best window of the template's size, null where none is within bounds."""
    own, size = bigrams_of(text), len(words_of(text)) - 1
    low, high = bounds(len(own), threshold)
    last = F.size(grams) - size + 1

    def score(at: Column) -> Column:
        def dice(b: Column) -> Column:
            return F.when((F.size(b) >= low) & (F.size(b) <= high), 2.0 * F.size(F.array_intersect(b, F.lit(own))) / (F.size(b) + len(own)))

        return F.get(F.transform(F.array(F.array_distinct(F.slice(grams, at, size))), dice), F.lit(0))

    starts = F.when(last < 1, F.array().cast("array<int>")).otherwise(F.array_append(F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(stride(size + 1))), last))
    return F.struct(F.array_max(F.transform(starts, score)).alias("score"), F.lit(-rank).alias("rank"), F.lit(name).alias("licence"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licence, licences, score, passages): the best licence of every row, all that it has (joined, in the order of the templates), and how many
    lines, or the whole text, match any."""
    templates = templates or TEMPLATES
    sizes = [len(bigrams_of(t)) for t in templates.values()]
    least, most = bounds(min(sizes), threshold)[0], bounds(max(sizes), threshold)[1]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    plain = lambda t: F.btrim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))

    def fits(t: Column) -> Column:
        # a passage of too few characters or words can't have the bigrams; repeats only lessen them
        return F.size(F.split(t, " ")) - 1 >= least

    def grams(t: Column) -> Column:
        words = F.split(t, " ")
        return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))

    lines = F.split(text, "\n")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.filter(F.transform(F.when(F.size(lines) > 1, lines).otherwise(F.array().cast("array<string>")), plain), fits).alias("lines"), plain(text).alias("whole"))
    rows = rows.select("doc_id", "lines", F.when(fits(F.col("whole")), grams(F.col("whole"))).otherwise(F.array().cast("array<string>")).alias("all"))
    # the most words that a passage within bounds may have is not known (bigrams may repeat), so all are counted
    passages = F.concat(F.transform("lines", lambda t: F.array_distinct(grams(t))), F.array(F.array_distinct("all")))
    rows = rows.select("doc_id", "all", F.filter(passages, lambda b: (F.size(b) >= least) & (F.size(b) <= most)).alias("grams"))
    of_passage = F.filter(F.transform("grams", lambda b: best(b, templates, threshold)), lambda s: s["score"] >= threshold)
    signs = sorted({x for t in templates.values() for x in anchors(t, threshold)})
    windows = F.array(*[best_window(F.col("all"), name, t, rank, threshold) for rank, (name, t) in enumerate(templates.items())])
    of_window = F.when(F.arrays_overlap("all", F.lit(signs)), F.filter(windows, lambda s: s["score"] >= threshold)).otherwise(F.filter(of_passage, lambda s: F.lit(False)))
    scored = rows.select("doc_id", of_passage.alias("of_passage"), of_window.alias("of_window"))
    scored = scored.select("doc_id", F.concat("of_passage", "of_window").alias("found"), F.size("of_passage").cast("long").alias("passages"))
    top = F.array_max("found")
    names = F.filter(F.lit(list(templates)), lambda n: F.exists("found", lambda s: s["licence"] == n))
    return scored.select("doc_id", top["licence"].alias("licence"), F.array_join(names, ", ").alias("licences"), F.coalesce(top["score"], F.lit(0.0)).alias("score"), "passages")


def oracle_sql(threshold: float = THRESHOLD) -> str:
    rows = ", ".join(f"({rank}, '{name}', {[*bigrams_of(text)]!r}, {len(words_of(text)) - 1}, {stride(len(words_of(text)))})" for rank, (name, text) in enumerate(TEMPLATES.items()))
    signs = sorted({x for t in TEMPLATES.values() for x in anchors(t, threshold)})
    dice = "2.0::DOUBLE * len(list_intersect(b, own)) / (len(b) + len(own))"
    within = f"len(b) BETWEEN len(own) * {threshold} / (2 - {threshold}) AND len(own) * (2 - {threshold}) / {threshold}"
    return f"""
    WITH templates(rank, licence, own, size, step) AS (VALUES {rows}),
    numbered AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    parts AS (SELECT r, text, string_split(text, chr(10)) AS lines FROM numbered
    ), passages AS (
      SELECT r, p, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS t FROM (
        SELECT r, unnest(CASE WHEN len(lines) > 1 THEN list_append(lines, text) ELSE lines END) AS x, generate_subscripts(CASE WHEN len(lines) > 1 THEN list_append(lines, text) ELSE lines END, 1) AS p FROM parts)
    ), words AS (SELECT r, p, string_split(t, ' ') AS w FROM passages
    ), grams AS (
      SELECT r, p, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words WHERE len(w) >= 2
    ), scored AS (
      SELECT r, p, max({dice}) AS score, arg_max(licence, ({dice}, -rank)) AS licence, arg_max(rank, ({dice}, -rank)) AS rank
      FROM grams, templates WHERE {within} GROUP BY r, p
    ), whole AS (
      SELECT r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g
      FROM (SELECT r, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM numbered) WHERE len(w) >= 2
    ), starts AS (
      SELECT r, g, rank, licence, own, size, unnest(list_append(range(1, len(g) - size + 2, step), len(g) - size + 1)) AS first
      FROM whole, templates WHERE list_has_any(g, {signs!r}) AND len(g) >= size
    ), windows AS (SELECT r, rank, licence, own, list_distinct(g[first : first + size - 1]) AS b FROM starts
    ), found AS (
      SELECT r, rank, licence, score, 1 AS passage FROM scored WHERE score >= {threshold}
      UNION ALL SELECT r, rank, licence, max({dice}), 0 FROM windows WHERE {within} GROUP BY r, rank, licence HAVING max({dice}) >= {threshold}
    ), kinds AS (SELECT r, string_agg(licence, ', ' ORDER BY rank) AS licences FROM (SELECT DISTINCT r, rank, licence FROM found) GROUP BY r
    ), tops AS (SELECT r, arg_max(licence, (score, -rank)) AS licence, max(score) AS score, sum(passage) AS n FROM found GROUP BY r)
    SELECT d.doc_id, f.licence, coalesce(k.licences, '') AS licences, coalesce(f.score, 0.0)::DOUBLE AS score, coalesce(f.n, 0)::BIGINT AS passages
    FROM numbered d LEFT JOIN tops f USING (r) LEFT JOIN kinds k USING (r)
    """
