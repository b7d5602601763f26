"""Licence scan: Dice coefficient over word bigrams against templates, in DataFrame functions only.

Units are the lines of a text, the whole text, and runs of words anywhere in it, over line ends too: a
notice that is wrapped, or shares its line with other words. A unit is normalised to lower-case words of
letters and digits. Its Dice coefficient with a template can reach the threshold only if their
numbers of bigrams are close (size bounds), and only if it holds enough of the template's bigrams:
so many that it must hold a word of a small set chosen per template. Units without such a word are
pruned by substring tests before anything is split; the bounds prune templates after that.

A run starts and ends with bigrams of the template that have none before and after them: other ends
lower the coefficient. It is as long as the size bounds allow at most. Runs are taken from the
highest coefficient down, none overlapping one taken; a run inside a line or text that is a unit of
its own adds nothing to it and does not count.

Defined cases: a null or empty text has no licence; a unit under two words has no bigrams and none
either; of equal coefficients the template last in alphabetical order is given; rows that share a
doc_id are one document.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and wordings of licence notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "mit": "Released under the MIT License.",
    "mit-header": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Dice coefficient, in percent, from which a unit counts as a template.
PERCENT = 75

_NOT_WORD = "[^\\p{L}\\p{N}]+"


def words_of(text: str) -> list[str]:
    return [x for x in re.split(r"[\W_]+", text.lower()) if x]


def bigrams_of(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(n: int, percent: int) -> tuple[int, int]:
    """The sizes a set of bigrams may have for the coefficient with n bigrams to reach percent."""
    return -(-n * percent // (200 - percent)), n * (200 - percent) // percent


def needles(words: list[str], percent: int) -> set[str]:
    """Words of which any unit that is similar enough holds one: they cover more bigrams than it may lack."""
    grams = bigrams_of(words)
    low, _ = bounds(len(grams), percent)
    lacking = len(grams) - -(-percent * (low + len(grams)) // 200)
    chosen: set[str] = set()
    # Words that say licence first, then long ones: rare in prose, so few units stay.
    for word in sorted(set(words), key=lambda x: (not x.startswith(("licens", "sublicens")), -len(x), x)):
        if sum(any(x in chosen for x in g.split()) for g in grams) > lacking:
            break
        chosen.add(word)
    return chosen


def _dice(grams: Column, template: list[str], percent: int) -> Column:
    low, high = bounds(len(template), percent)
    value = 2 * F.size(F.array_intersect(grams, F.array(*map(F.lit, template)))) / (F.size(grams) + len(template))
    return F.when(F.size(grams).between(low, high), value)


def _pairs(word: Column) -> Column:
    most = F.greatest(F.size(word) - 1, F.lit(0))
    return F.slice(F.zip_with(word, F.slice(word, 2, most), lambda a, b: F.concat_ws(" ", a, b)), 1, most)


def _best(grams: Column, split: dict[str, list[str]], percent: int) -> Column:
    """(dice, license) of the best template that reaches percent, or null."""
    scored = [F.struct(_dice(grams, bigrams_of(x), percent).alias("dice"), F.lit(name).alias("license")) for name, x in sorted(split.items())]
    return F.array_max(F.filter(F.array(*scored), lambda s: s["dice"] * 100 >= percent))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _candidates(spots: Column, pairs: Column, name: str, words: list[str], percent: int) -> Column:
    """(dice, license, -length, -start) of the runs that reach percent; spots: (g, i) of template bigrams."""
    grams = bigrams_of(words)
    low, high = bounds(len(grams), percent)
    most = high + len(words) - 1 - len(grams)

    def run(own: Column, s: Column, e: Column) -> Column:
        shared = F.size(F.array_distinct(F.transform(F.slice(own, s["j"] + 1, e["j"] - s["j"] + 1), lambda x: x["g"])))
        size = F.size(F.array_distinct(F.slice(pairs, s["i"] + 1, e["i"] - s["i"] + 1)))
        return F.struct((2 * shared / (size + len(grams))).alias("dice"), F.lit(name).alias("license"), (s["i"] - e["i"]).alias("length"), (-s["i"]).alias("start"))

    def of(own: Column) -> Column:
        def tag(s: Column, j: Column) -> Column:
            begins = F.coalesce(F.get(own, j - 1)["i"] < s["i"] - 1, F.lit(True))
            ends = F.coalesce(F.get(own, j + 1)["i"] > s["i"] + 1, F.lit(True))
            return F.struct(s["g"].alias("g"), s["i"].alias("i"), j.alias("j"), begins.alias("begins"), ends.alias("ends"))

        def starting(own: Column, s: Column) -> Column:
            here = F.filter(F.slice(own, s["j"] + low, most), lambda e: (e["i"] - s["i"] < most) & (e["ends"] | (e["i"] - s["i"] == most - 1)))
            return F.transform(here, lambda e: run(own, s, e))

        return _let(F.transform(own, tag), lambda own: F.flatten(F.transform(F.filter(own, lambda s: s["begins"]), lambda s: starting(own, s))))

    def enough(own: Column) -> Column:
        return F.when(F.size(F.array_distinct(F.transform(own, lambda s: s["g"]))) >= low, F.filter(of(own), lambda r: r["dice"] * 100 >= percent))

    return _let(F.filter(spots, lambda s: s["g"].isin(grams)), enough)


def _runs(pairs: Column, text: Column, split: dict[str, list[str]], percent: int) -> Column:
    """(dice, license, -length, -start) of the runs taken in a lower-case text that is no unit of its own."""
    every = sorted(set().union(*map(bigrams_of, split.values())))
    spots = F.filter(F.transform(pairs, lambda g, i: F.struct(g.alias("g"), i.alias("i"))), lambda s: s["g"].isin(every))
    each = _let(spots, lambda spots: F.array(*(_candidates(spots, pairs, name, x, percent) for name, x in sorted(split.items()))))
    ordered = F.sort_array(F.flatten(F.array_compact(each)), False)

    def apart(a: Column, b: Column) -> Column:
        # A run of n bigrams is n + 1 words; length is 1 - n.
        return (-a["start"] - a["length"] + 1 < -b["start"]) | (-b["start"] - b["length"] + 1 < -a["start"])

    def greedy(ordered: Column) -> Column:
        none = F.slice(ordered, 1, 0)
        return F.aggregate(ordered, none, lambda taken, r: F.when(F.forall(taken, lambda t: apart(t, r)), F.concat(taken, F.array(r))).otherwise(taken))

    def outside(taken: Column) -> Column:
        words = F.transform(F.split(text, "\n"), lambda x: F.array_remove(F.split(x, _NOT_WORD), ""))
        line = F.flatten(F.transform(words, lambda x, k: F.array_repeat(k, F.size(x))))
        found = F.transform(F.transform(words, lambda x: F.array_distinct(_pairs(x))), lambda g: _best(g, split, percent).isNotNull())

        def beyond(r: Column, line: Column, found: Column) -> Column:
            first, last = F.get(line, -r["start"]), F.get(line, -r["start"] - r["length"] + 1)
            return (first != last) | ~F.get(found, first)

        return _let(line, lambda line: _let(found, lambda found: F.filter(taken, lambda r: beyond(r, line, found))))

    return _let(_let(ordered, greedy), lambda taken: F.when(F.size(taken) > 0, outside(taken)))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT) -> DataFrame:
    """(doc_id, license, dice, n_units): the best template of each document that has one, and its matching units."""
    templates = templates or TEMPLATES
    split = {name: words_of(body) for name, body in templates.items()}
    words = sorted(set().union(*(needles(x, percent) for x in split.values())))
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    low = F.lower("text")
    rows = rows.filter(reduce(Column.__or__, [low.contains(x) for x in words]))
    lines = F.split("text", "\n")
    units = rows.select("doc_id", F.size(lines).alias("n"), F.posexplode(F.when(F.size(lines) > 1, F.concat(lines, F.array("text"))).otherwise(lines)).alias("at", "unit"))
    units = units.select("doc_id", F.lower("unit").alias("unit"), ((F.col("n") == 1) | (F.col("at") == F.col("n"))).alias("whole"))
    units = units.filter(reduce(Column.__or__, [F.col("unit").contains(x) for x in words]))
    units = units.withColumn("word", F.array_remove(F.split("unit", _NOT_WORD), ""))
    pairs = _pairs(F.col("word"))
    # Generators compute bigrams and coefficients once a unit; a projection would be merged into each use.
    units = units.select("doc_id", "unit", "whole", F.explode(F.array(pairs)).alias("pairs"))
    units = units.select("doc_id", "unit", "whole", "pairs", F.explode(F.array(F.array_distinct("pairs"))).alias("grams"))
    units = units.select("doc_id", "unit", "whole", "pairs", "grams", F.explode(F.array(_best(F.col("grams"), split, percent))).alias("best"))
    every = sorted(set().union(*map(bigrams_of, split.values())))
    least = min(bounds(len(bigrams_of(x)), percent)[0] for x in split.values())
    some = F.col("whole") & (F.size(F.array_intersect("grams", F.array(*map(F.lit, every)))) >= least)
    runs = F.transform(_runs(F.col("pairs"), F.col("unit"), split, percent), lambda r: F.struct(r["dice"].alias("dice"), r["license"].alias("license")))
    units = units.select("doc_id", F.explode(F.when(F.col("best").isNotNull(), F.array("best")).when(some, runs)).alias("best"))
    found = units.groupBy("doc_id").agg(F.max("best").alias("best"), F.count("*").alias("n_units"))
    return found.select("doc_id", F.col("best.license").alias("license"), F.round("best.dice", 6).alias("dice"), "n_units")


def oracle(templates: dict[str, str] | None = None, percent: int = PERCENT) -> str:
    """DuckDB SQL for scan_licenses over `documents`: every line and text against every template; it has no runs."""
    rows = ", ".join("('{}', '{}')".format(n, b.replace("'", "''")) for n, b in sorted((templates or TEMPLATES).items()))
    return f"""
WITH template(license, body) AS (VALUES {rows}),
unit AS (
  SELECT doc_id, unnest(CASE WHEN contains(text, chr(10)) THEN list_concat(string_split(text, chr(10)), [text]) ELSE [text] END) AS unit
  FROM documents WHERE text IS NOT NULL
),
word AS (
  SELECT doc_id, row_number() OVER () AS nr, list_filter(regexp_split_to_array(lower(unit), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM unit
),
gram AS (
  SELECT doc_id, nr, list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM word WHERE len(w) > 1
),
template_word AS (
  SELECT license, list_filter(regexp_split_to_array(lower(body), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM template
),
template_gram AS (
  SELECT license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM template_word
),
scored AS (
  SELECT doc_id, nr, license, 2.0 * len(list_intersect(g, t)) / (len(g) + len(t)) AS dice FROM gram, template_gram
),
best AS (
  SELECT doc_id, nr, license, dice, row_number() OVER (PARTITION BY nr ORDER BY dice DESC, license DESC) AS r FROM scored WHERE dice * 100 >= {percent}
)
SELECT doc_id, arg_max(license, (dice, license)) AS license, round(max(dice), 6) AS dice, count(*) AS n_units
FROM best WHERE r = 1 GROUP BY doc_id"""
