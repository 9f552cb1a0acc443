"""Licence scans: Dice coefficient over word bigrams against licence templates; DataFrame expressions only.

The units of a text are its lines, its blocks between blank lines and the
whole, each compared as a set of word bigrams of its normalised text.  Two
sets of sizes a and b have a Dice coefficient of at most 2 min(a, b) / (a + b),
so a template of b bigrams can only reach ``least`` if a is from
b * least / (2 - least) to b * (2 - least) / least.  Templates outside those
bounds are pruned before any bigram is compared.

A licence that no unit of a text reports can still stand in it: behind other
words of a line, over several blocks, or with code right after it.  So every
run of words, wherever it begins and ends, is compared too.  A run that
reaches ``least`` holds b * least / (2 - least) of a template's bigrams or
more; texts that hold fewer are left out, and the rest are few.  The best run
begins with a bigram of the template that it has once: others only lower it,
and one that comes again can be left out.  It ends before it has more bigrams
than a match can have.  So a text of any length, and one that repeats a
licence many times, costs work in proportion to its words.

Before any of that a text is left out that holds none of some words: those are
chosen until fewer of a template's bigrams have none of them than a match needs.

The templates are a literal of the plan, in parts of ``TEMPLATE_BYTES`` of text;
more than one part costs a pass over the texts each, and a unit's best template
is the best of all parts.  The exchanges are of the texts that hold a licence's
bigrams, by text, and of what is found, by id and licence.

Defined results: null and empty texts, and units of fewer than two words, match
nothing; a unit's best template is reported, the first by name on a tie; a
text's blocks are those of more than one line, if there are several, and the
whole counts if it has a newline, so that one licence can be told by several
units.  A text's best
run for a licence is reported once, the shortest and then the first on a tie, with the number of its
first word as ``at``, if no unit of that id reports the licence.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: Text of the templates that one pass compares.
TEMPLATE_BYTES = 4 << 20
#: Words of a run that are read first, and a place that no text has.
STRETCH, NEVER = 64, 2**31 - 1

#: Notices and short licences, by name.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "all-rights-reserved": "All rights reserved.",
}


def template_bigrams(text: str) -> list[str]:
    """The distinct bigrams of a template, in order."""
    words = re.sub(r"[^\w]+|_+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def bounds(size: int, least: float) -> tuple[float, float]:
    """The sizes that a set can have whose Dice coefficient with one of ``size`` is at least ``least``."""
    return size * least / (2 - least), size * (2 - least) / least


def words(text: Column) -> Column:
    """The words of a text: lower-cased, with all but letters and digits as blanks."""
    return F.split(F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def bigrams(word: Column) -> Column:
    """The distinct bigrams of an array of words."""
    pairs = F.zip_with(word, F.slice(word, F.lit(2), F.size(word)), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def units(text: Column) -> Column:
    """(kind, at, text) of each line, of each block if there are more than one, and of the whole if it has more than one line."""
    named = lambda parts, kind: F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x.alias("text")))
    newline = F.contains(text, F.lit("\n"))
    blocks = F.filter(named(F.split(text, r"\n\s*\n"), "block"), lambda u: F.contains(u["text"], F.lit("\n")))
    none = F.expr("cast(array() as array<struct<kind:string,at:int,text:string>>)")
    return F.concat(named(F.split(text, "\n"), "line"), F.when(text.rlike(r"\n\s*\n"), blocks).otherwise(none), F.when(newline, named(F.array(text), "text")).otherwise(none))


def runs(docs: DataFrame, known: list[Column], least: float) -> DataFrame:
    """``row, id, kind, at, license, dice`` of the best run of words for each template that a run of ``docs(row, id, text)`` reaches ``least`` with."""
    templates = F.array(*known)
    every = F.array_distinct(F.flatten(F.transform(templates, lambda t: t["pairs"])))
    # exploding an array of one keeps the planner from copying its expression to each use
    each = docs.select("row", "id", F.explode(F.array(words(F.col("text")))).alias("word"))
    pairs = F.zip_with("word", F.slice("word", F.lit(2), F.size("word")), lambda x, y: F.concat(x, F.lit(" "), y))
    each = each.select("row", "id", F.explode(F.array(F.filter(pairs, lambda p: p.isNotNull()))).alias("pairs"))
    each = each.select("row", "id", "pairs", F.explode(F.array(F.array_intersect("pairs", every))).alias("shared"))
    hits = F.filter(templates, lambda t: F.size(F.array_intersect(t["pairs"], F.col("shared"))) >= t["low"])
    names = F.when(F.size("shared") > 0, F.transform(hits, lambda t: t["name"]))
    held = each.select("row", "id", "pairs", F.explode(F.array(names)).alias("names")).filter(F.size("names") > 0)
    # each bigram with the places of the ones before and after it that are equal
    placed = held.select("row", "id", "names", F.posexplode("pairs").alias("pos", "pair"))
    equal = Window.partitionBy("row", "pair").orderBy("pos")
    placed = placed.withColumn("before", F.coalesce(F.lag("pos").over(equal), F.lit(-1))).withColumn("after", F.coalesce(F.lead("pos").over(equal), F.lit(NEVER)))
    whole = placed.groupBy("row").agg(F.first("id").alias("id"), F.first("names").alias("names"), F.array_sort(F.collect_list(F.struct("pos", "before", "after", "pair"))).alias("seq"))
    one = whole.select("row", "id", "seq", F.explode(F.filter(templates, lambda t: F.array_contains(F.col("names"), t["name"]))).alias("t"))
    marked = F.transform("seq", lambda x: F.struct(x["pos"].alias("pos"), x["before"].alias("before"), x["after"].alias("after"), F.array_contains(F.col("t.pairs"), x["pair"]).cast("int").alias("hit")))
    one = one.select("row", "id", F.col("t.name").alias("license"), F.size("t.pairs").alias("b"), F.col("t.high").alias("high"), F.explode(F.array(marked)).alias("seq"))
    # a run is read stretch by stretch, each twice as long as the one before
    stretches = F.array(*(F.struct(F.lit(STRETCH * (2**k - 1)).alias("skip"), F.lit(STRETCH * 2**k).alias("most")) for k in range(24)))

    def best_from(start: Column) -> Column:
        """The best run that begins here: up to where its first bigram comes again, or where it has more bigrams than a match can have.

        A run whose first bigram comes again is no better than without it, so
        at each word no more than ``high`` runs are still open, and the work
        grows in proportion to the text.
        """
        zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("both"), F.lit(0.0).alias("dice"))

        def step(acc: Column, x: Column) -> Column:
            new = (x["before"] < start["pos"]).cast("int")
            size, both = acc["size"] + new, acc["both"] + new * x["hit"]
            dice = F.lit(2.0) * both / (size + F.col("b"))
            return F.struct(size.alias("size"), both.alias("both"), F.greatest(acc["dice"], dice).alias("dice"))

        def stretch(acc: Column, part: Column) -> Column:
            first = start["pos"] + part["skip"]
            length = F.least(part["most"], start["after"] - first)
            return F.when((acc["size"] > F.col("high")) | (length <= 0) | (first >= F.size("seq")), acc).otherwise(F.aggregate(F.slice("seq", first + 1, length), acc, step))

        return F.struct((-F.aggregate(stretches, zero, stretch, lambda acc: acc["dice"])).alias("minus"), start["pos"].alias("at"))

    best = F.array_min(F.transform(F.filter("seq", lambda x: x["hit"] > 0), best_from))
    return one.select("row", "id", "license", F.explode(F.array(best)).alias("best")).filter(F.col("best.minus") <= -least).select("row", "id", F.lit("run").alias("kind"), F.col("best.at").alias("at"), "license", F.round(-F.col("best.minus"), 6).alias("dice"))


def needed_words(pairs: list[str], low: float, known: set[str] = frozenset(), rare: int = 6) -> set[str]:
    """Words, besides the known ones, of which a text holds one at least if it holds ``low`` of the bigrams.

    Of words of ``rare`` letters or more, which few texts hold, those of the most
    bigrams; then the longest of the rest.
    """
    left, chosen = [set(p.split(" ")) for p in pairs], set()
    left = [p for p in left if not p & known]
    while len(left) >= low:
        words = sorted(set().union(*left))
        word = max(words, key=lambda w: (len(w) >= rare, sum(w in p for p in left) if len(w) >= rare else 0, len(w)))
        chosen.add(word)
        left = [p for p in left if word not in p]
    return chosen


def template_parts(templates: dict[str, str], part_bytes: int) -> list[dict[str, str]]:
    """The templates by name, in parts of at most ``part_bytes`` of text or one template."""
    parts, size = [{}], 0
    for name in sorted(templates):
        more = len(templates[name].encode())
        if parts[-1] and size + more > part_bytes:
            parts.append({})
            size = 0
        parts[-1][name] = templates[name]
        size += more
    return parts


def scan_part(docs: DataFrame, templates: dict[str, str], least: float, scratch: Scratch) -> DataFrame:
    """``row, id, kind, at, license, dice`` of ``docs(row, id, text)``: each unit's best template, and each template's best run."""
    known, some = [], set()
    for name, text in templates.items():
        pairs = template_bigrams(text)
        if pairs:
            low, high = bounds(len(pairs), least)
            some |= needed_words(pairs, low, some)
            known.append(F.struct(F.lit(name).alias("name"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.array(*map(F.lit, pairs)).alias("pairs")))
    # a text without any of the words reaches no template, as a whole or in part
    docs = docs.select("*", F.explode(F.array(F.lower("text"))).alias("lower"))
    docs = docs.filter(reduce(Column.__or__, (F.contains("lower", F.lit(w)) for w in sorted(some)), F.lit(False))).drop("lower")
    docs = scratch.save(docs)  # few, and read for units and for runs
    if not known:
        known.append(F.struct(F.lit("").alias("name"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.array(F.lit("")).alias("pairs")))
    each = docs.select("row", "id", F.explode(units(F.col("text"))).alias("u"))
    # exploding an array of one keeps the planner from copying its expression to each use
    each = each.select("row", "id", "u.kind", "u.at", F.explode(F.array(words(F.col("u.text")))).alias("word"))
    each = each.select("row", "id", "kind", "at", F.explode(F.array(bigrams(F.col("word")))).alias("pairs"))
    n = F.size("pairs")
    fitting = F.filter(F.array(*known), lambda t: (t["low"] <= n) & (n <= t["high"]))
    dice = lambda t: F.lit(2.0) * F.size(F.array_intersect(t["pairs"], F.col("pairs"))) / (n + F.size(t["pairs"]))
    judged = F.filter(F.transform(fitting, lambda t: F.struct((-dice(t)).alias("minus"), t["name"].alias("name"))), lambda m: m["minus"] <= -least)
    best = F.array_min(judged)
    by_unit = each.filter(n > 0).select("row", "id", "kind", "at", F.explode(F.array(best)).alias("best")).filter("best is not null").select("row", "id", "kind", "at", F.col("best.name").alias("license"), F.round(-F.col("best.minus"), 6).alias("dice"))
    return by_unit.unionByName(runs(docs, known, least))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = 0.8, part_bytes: int = TEMPLATE_BYTES) -> DataFrame:
    """``id_col, kind, at, license, dice`` for each unit whose best template has a Dice coefficient of at least ``least``, and for the best run of each other licence."""
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scratch = Scratch(df.sparkSession, "licenses")
    parts = template_parts(TEMPLATES if templates is None else templates, part_bytes)
    if len(parts) == 1:
        found = scan_part(docs, parts[0], least, scratch)
    else:
        docs = scratch.save(docs)  # so that each part numbers the rows alike
        every = reduce(DataFrame.unionByName, [scratch.save(scan_part(docs, p, least, scratch)) for p in parts])
        unit = ["row", "id", "kind", "at"]
        best = every.filter("kind != 'run'").groupBy(*unit).agg(F.min(F.struct((-F.col("dice")).alias("minus"), "license")).alias("b"))
        found = best.select(*unit, "b.license", (-F.col("b.minus")).alias("dice")).unionByName(every.filter("kind = 'run'"))
    told = F.max(F.col("kind") != "run").over(Window.partitionBy("id", "license"))
    return found.withColumn("told", told).filter((F.col("kind") != "run") | ~F.col("told")).select(F.col("id").alias(id_col), "kind", "at", "license", "dice")
