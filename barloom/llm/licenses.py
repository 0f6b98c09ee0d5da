"""License scan: normalised lines and blocks against licence templates by the Dice coefficient over word bigrams.

Words are the runs of letters and digits of the lower-cased text. Every line, and every block of several lines between lines
without words, is compared as the bag of its word bigrams. Two bags of sizes a and b have a Dice coefficient of
2 min(a, b) / (a + b) at most, so only templates whose size can reach the threshold are compared. All of
it is column expressions over one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import read_table

LEAST_DICE = 0.8

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
    " files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy,"
    " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
    " Software is furnished to do so, subject to the following conditions:"
)
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
    " Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO"
    " THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR"
    " COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,"
    " ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)

# Licence names and the public wording that announces them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", f"{_MIT_GRANT} {_MIT_REST}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the"
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable"
        " law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT"
        " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing"
        " permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
        " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
        " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
        " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met:",
    ),
    ("proprietary", "All rights reserved."),
)


NO_WORD = "[^\\\\p{L}\\\\p{N}]+"


def _words(text: str) -> str:
    """SQL of the words of a text: runs of letters and digits of its lower-case form."""
    return f"filter(split(lower({text}), '{NO_WORD}'), w -> w <> '')"


def _bigrams(words: str) -> str:
    """SQL of the hashed word bigrams, in order, repeats included."""
    return f"transform(slice({words}, 2, greatest(size({words}) - 1, 0)), (w, i) -> xxhash64({words}[i], w))"


def template_sets(spark: SparkSession, templates=TEMPLATES) -> list[tuple[str, list[int]]]:
    """Licence name and hashed bigrams of every template, through the same expressions as the texts."""
    frame = spark.createDataFrame(list(templates), "name string, body string").select("name", F.expr(_words("body")).alias("words"))
    return [(r["name"], r["grams"]) for r in frame.select("name", F.expr(_bigrams("words")).alias("grams")).collect() if r["grams"]]


def scan(docs: DataFrame, templates=TEMPLATES, least: float = LEAST_DICE) -> DataFrame:
    """``doc_id, licenses, n_matches, license, dice, unit, unit_no``, one row per row.

    ``n_matches`` counts the units (lines and blocks) that reach ``least`` with some template, ``licenses`` lists the licences
    found in order of name, and the rest describes the best match: the highest Dice coefficient, then the first licence
    name, then lines before blocks, then the first unit. A unit of fewer than two words has no bigrams and matches
    nothing. Null and empty texts have no match (an empty list, 0, nulls). Other columns are not read.
    """
    sets = template_sets(docs.sparkSession, templates)
    known = [
        F.struct(F.lit(n).alias("name"), F.lit(len(g)).alias("n"), F.lit(len(g) - len(set(g))).alias("again"), F.array(*map(F.lit, g)).alias("grams"))
        for n, g in sets
    ]
    low, high = least / (2 - least), (2 - least) / least
    fewest, most = min(len(g) for _, g in sets) * low, max(len(g) for _, g in sets) * high
    fits = f"size(words) - 1 >= {fewest} and size(words) - 1 <= {most}"
    lines = docs.select("doc_id", F.expr(f"transform(split(coalesce(text, ''), '\n'), l -> {_words('l')})").alias("lines"))
    joined = "array_join(transform(lines, l -> if(size(l) = 0, '\n', concat('\t ', array_join(l, ' '), ' '))), '')"
    blocks = f"filter(split({joined}, '\n'), b -> b <> '')"
    units = lines.select(
        "doc_id",
        F.expr("transform(lines, (l, i) -> struct(false as is_block, cast(i + 1 as int) as unit_no, l as words))").alias("lines"),
        F.expr(f"transform({blocks}, (b, i) -> struct(true as is_block, cast(i + 1 as int) as unit_no, b as body))").alias("blocks"),
    )
    several = "filter(blocks, u -> instr(substring(u.body, 2), '\t') > 0)"
    split = f"transform({several}, u -> struct(u.is_block, u.unit_no, filter(split(translate(u.body, '\t', ' '), ' '), w -> w <> '') as words))"
    units = units.select("doc_id", F.expr(f"filter(concat(lines, {split}), u -> {fits.replace('words', 'u.words')})").alias("parts"))
    grams = f"transform(parts, u -> struct(u.is_block, u.unit_no, {_bigrams('u.words')} as grams))"
    units = units.select("doc_id", F.expr(grams).alias("parts"))

    def shared(a: Column, b: Column) -> Column:
        """Common bigrams, each as often as both have it."""
        times = lambda grams, g: F.size(F.filter(grams, lambda x: x == g))
        return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, g: n + F.least(times(a, g), times(b, g)))

    def matches(u: Column) -> Column:
        n, grams = F.size(u["grams"]), u["grams"]

        def may_reach(t: Column) -> Column:  # by size, then by the bigrams in common at most
            sized = (n >= F.lit(low) * t["n"] - 1e-9) & (n <= F.lit(high) * t["n"] + 1e-9)
            return sized & (2.0 * (F.size(F.array_intersect(grams, t["grams"])) + t["again"]) >= least * (n + t["n"]) - 1e-9)

        scored = F.transform(F.filter(F.array(*known), may_reach), lambda t: F.struct((2.0 * shared(grams, t["grams"]) / (n + t["n"])).alias("dice"), t["name"].alias("name")))
        return F.transform(
            F.filter(scored, lambda s: s["dice"] >= least - 1e-9),
            lambda s: F.struct((-s["dice"]).alias("order"), s["name"].alias("name"), u["is_block"].alias("is_block"), u["unit_no"].alias("unit_no")),
        )

    found = units.select("doc_id", F.filter(F.transform("parts", matches), lambda m: F.size(m) > 0).alias("found"))
    found = found.select("doc_id", "found", F.array_min(F.flatten("found")).alias("best"))
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.flatten("found"), lambda m: m["name"]))), ",").alias("licenses"),
        F.size("found").alias("n_matches"),
        F.col("best.name").alias("license"),
        F.round(-F.col("best.order"), 6).alias("dice"),
        F.when(F.col("best").isNotNull(), F.when(F.col("best.is_block"), "block").otherwise("line")).alias("unit"),
        F.col("best.unit_no").alias("unit_no"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES)
    words = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    grams = "list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])"
    low, high = LEAST_DICE / (2 - LEAST_DICE), (2 - LEAST_DICE) / LEAST_DICE
    times = "len(list_filter({}, lambda y: y = x))"
    return f"""
        WITH t AS (SELECT name, {words.format('body')} AS words FROM (VALUES {rows}) v(name, body)),
        ts AS (SELECT name, {grams} AS g FROM t),
        l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS u, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS unit_no FROM documents),
        lw AS (SELECT doc_id, unit_no, {words.format('u')} AS words FROM l),
        e AS (SELECT *, len(words) = 0 AS empty, lag(len(words), 1, 0) OVER (PARTITION BY doc_id ORDER BY unit_no) = 0 AND len(words) > 0 AS opens FROM lw),
        n AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY unit_no) AS block FROM e),
        b AS (SELECT doc_id, block AS unit_no, flatten(list(words ORDER BY unit_no)) AS words FROM n WHERE NOT empty GROUP BY doc_id, block HAVING count(*) > 1),
        us AS (SELECT doc_id, 'line' AS unit, unit_no, words FROM lw UNION ALL SELECT doc_id, 'block', unit_no, words FROM b),
        ug AS (SELECT doc_id, unit, unit_no, {grams} AS g FROM us WHERE len(words) > 1),
        c AS (SELECT doc_id, unit, unit_no, name, ug.g AS a, ts.g AS b FROM ug JOIN ts
              ON len(ug.g) BETWEEN {low} * len(ts.g) - 1e-9 AND {high} * len(ts.g) + 1e-9 WHERE list_has_any(ug.g, ts.g)),
        m AS (SELECT doc_id, unit, unit_no, name, 2.0 / (len(a) + len(b)) * list_sum(list_transform(list_intersect(a, b),
              lambda x: least({times.format('a')}, {times.format('b')}))) AS dice FROM c),
        h AS (SELECT * FROM m WHERE dice >= {LEAST_DICE} - 1e-9),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name, unit = 'block', unit_no) AS k FROM h),
        s AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(DISTINCT unit || unit_no) AS n FROM h GROUP BY doc_id)
        SELECT d.doc_id, coalesce(s.licenses, '') AS licenses, CAST(coalesce(s.n, 0) AS INTEGER) AS n_matches, r.name AS license, round(r.dice, 6) AS dice,
               r.unit, CAST(r.unit_no AS INTEGER) AS unit_no
        FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN r ON r.doc_id = d.doc_id AND r.k = 1"""


QUERIES = {"op3_licenses": op3_licenses}
ORACLES = {"op3_licenses": _sql()}
