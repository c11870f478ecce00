"""Licence scan by Dice coefficient over word bigrams, in DataFrame functions only.

Texts and templates are brought to one form (A-Z and digits in lower case, one
blank between words). A text is looked at as a whole, by paragraphs and by lines.
A template is compared only with units whose number of bigrams lies within the
bounds that the threshold sets, and only units that hold one of its telling words
are looked at at all; both bounds are exact.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# The licences' own notices and the usual one-line statements.
TEMPLATES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this "
        "program. If not, see https://www.gnu.org/licenses/.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
}


# Words of everyday prose, taken as telling words last.
COMMON = {"a", "an", "and", "any", "as", "at", "be", "by", "for", "if", "in", "is", "it", "no", "not", "of", "on", "or", "that", "the", "this", "to", "with", "you"}


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def telling_words(bigrams: list[str], threshold: float) -> list[str]:
    """Words of which any unit at the threshold holds one.

    Dice at ``t`` over a unit at the lower size bound shares at least t / (2 - t) of
    the template's bigrams. Words are taken, longest first and everyday ones last, until the bigrams without
    any of them are fewer than that.
    """
    needed = threshold / (2 - threshold) * len(bigrams)
    left = set(bigrams)
    use = Counter(w for b in bigrams for w in set(b.split()))
    chosen: list[str] = []
    for word in sorted(use, key=lambda w: (w in COMMON, -len(w), w)):
        if len(left) < needed:
            break
        hit = {b for b in left if word in b.split()}
        if hit:
            left -= hit
            chosen.append(word)
    return chosen


def size_bounds(n: int, threshold: float) -> tuple[float, float]:
    """Numbers of bigrams that a unit may have to reach the threshold with ``n``."""
    return threshold / (2 - threshold) * n, (2 - threshold) / threshold * n


def _forms(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    return [(name, bigrams_of(text)) for name, texts in templates.items() for text in texts]


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """(key, license, dice, n_units) of every row of ``docs``.

    ``license`` and ``dice`` are those of the best unit and template, ties to the
    name first in order, null where none reaches the threshold; ``n_units`` counts
    the units that reach it. Null and empty texts have none. Rows repeat as given,
    null keys included; no other column is read, and nothing is shuffled.
    """
    forms = _forms(templates or TEMPLATES)
    telling = sorted({w for _, b in forms for w in telling_words(b, threshold)})
    low = min(size_bounds(len(b), threshold)[0] for _, b in forms)
    high = max(size_bounds(len(b), threshold)[1] for _, b in forms)
    has_word = "(?i)(?<![A-Za-z0-9])(?:" + "|".join(telling) + ")(?![A-Za-z0-9])"
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    maybe = F.col("_text").rlike(has_word)
    units = F.array_distinct(
        F.concat(F.array("_text"), F.split("_text", "\\n[ \\t\\r]*\\n"), F.split("_text", "\\n"))
    )
    rows = rows.withColumn("_units", F.when(maybe, F.filter(units, lambda u: u.rlike(has_word))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_grams", F.transform("_units", _bigrams))
    rows = rows.withColumn("_grams", F.filter("_grams", lambda g: (F.size(g) >= F.lit(low)) & (F.size(g) <= F.lit(high))))
    rows = rows.withColumn("_best", F.filter(F.transform("_grams", lambda g: _best(g, forms, threshold)), lambda b: b["dice"] >= threshold))
    best = F.get(F.array_sort("_best", lambda a, b: _order(a, b)), F.lit(0))
    return rows.withColumn("_top", best).select(
        F.col("_key").alias(key), F.col("_top")["license"].alias("license"), F.col("_top")["dice"].alias("dice"), F.size("_best").cast("long").alias("n_units")
    )


def _order(a: Column, b: Column) -> Column:
    return F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).when(a["license"] < b["license"], -1).when(a["license"] > b["license"], 1).otherwise(0)


def _bigrams(unit: Column) -> Column:
    plain = F.regexp_replace(F.translate(unit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " ")
    words = F.array_remove(F.split(plain, " "), "")
    # the words are bound once, as the only element of an array
    pairs = F.transform(
        F.array(words),
        lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat_ws(" ", a, b)),
    )
    return F.when(F.size(words) > 1, F.array_distinct(F.get(pairs, F.lit(0)))).otherwise(F.array().cast("array<string>"))


def _best(grams: Column, forms: list[tuple[str, list[str]]], threshold: float) -> Column:
    scored = []
    for name, bigrams in forms:
        low, high = size_bounds(len(bigrams), threshold)
        listed = F.array(*[F.lit(b) for b in bigrams])
        dice = 2.0 * F.size(F.array_intersect(grams, listed)) / (F.size(grams) + len(bigrams))
        inside = (F.size(grams) >= low) & (F.size(grams) <= high)
        scored.append(F.struct(F.when(inside, dice).otherwise(0.0).alias("dice"), F.lit(name).alias("license")))
    return F.get(F.array_sort(F.array(*scored), lambda a, b: _order(a, b)), F.lit(0))


def oracle(table: str = "documents", threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB's SQL, without the pruning."""
    values = ",\n".join(
        f"('{name}', [" + ", ".join(f"'{b}'" for b in bigrams) + "])" for name, bigrams in _forms(TEMPLATES)
    )
    return f"""
WITH t(license, g) AS (VALUES {values}),
u AS (SELECT doc_id, unnest(list_distinct(list_concat([t], regexp_split_to_array(t, '\\n[ \\t\\r]*\\n'), string_split(t, chr(10))))) AS unit
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
w AS (SELECT doc_id, unit, list_filter(string_split(regexp_replace(
        translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws
        FROM u),
b AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS bg FROM w WHERE len(ws) > 1),
s AS (SELECT doc_id, unit, license, 2.0::DOUBLE * len(list_intersect(bg, g)) / (len(bg) + len(g)) AS dice FROM b, t),
r AS (SELECT doc_id, unit, max(dice) AS dice, arg_min(license, (-dice, license)) AS license FROM s GROUP BY 1, 2),
k AS (SELECT doc_id, arg_min(license, (-dice, license)) AS license, max(dice) AS dice, count(*) AS n_units
        FROM r WHERE dice >= {threshold} GROUP BY 1)
SELECT doc_id, license, dice, coalesce(n_units, 0) AS n_units FROM documents LEFT JOIN k USING (doc_id)"""
