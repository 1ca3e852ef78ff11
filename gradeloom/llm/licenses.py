"""Licence scan: Dice coefficient over word bigrams against licence templates.

A text and each of its parts (paragraphs between blank lines, and lines) are
normalised to lower-case words and compared to the templates by the Dice
coefficient of their sets of word bigrams, 2 |A & B| / (|A| + |B|). A coefficient
of at least t is only possible for sizes |B| t / (2 - t) <= |A| <= |B| (2 - t) / t.
Each template is listed under all sizes it admits, and a part meets only the
templates listed under its own size. Only texts are looked at that hold one of the templates' cue words, without
which no part of a text can match.

Runs of consecutive lines, so of paragraphs too, are compared as well: a run that
matches shares at least |B| t / (2 - t) bigrams with the template, so only texts that
share as many are looked at, and there each run of an admitted size is. A run that
overlaps a run closer to another licence is left out (ties: the first by name stays).

Everything is DataFrame code. The list of templates is a parameter; it is sent to
all tasks, so it is refused when it is longer than ``MOST_TEMPLATES``. A part
takes the template with the largest coefficient (ties: the first by name). Only
matches are shuffled, combined first, so a notice that a third of all documents
carry is a few rows per task.

Bigrams are compared by 64-bit hashes of their words.

Defined cases: null and empty texts, and parts of fewer than two words, match
nothing; rows with the same identifier are one document; documents without a match
have no row; an empty table or an empty list gives an empty result. The result
has its own columns, so input columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.functions.lets import int_range, let
from gradeloom.llm.common import require, text_or_empty

MOST_TEMPLATES = 1000
LEAST = 0.8

# Public licence texts and the usual one-line notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)


def normalised(text: Column) -> Column:
    """Lower-case words between blanks; line ends stay."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def bigrams(part: Column) -> Column:
    """Distinct word bigrams of a normalised part, as hashes; none for fewer than two words."""
    words = F.filter(F.split(part, "[ \n]+"), lambda w: w != "")
    pairs = lambda w: F.transform(int_range(1, F.size(w) - 1), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i)))
    return let(words, lambda w: F.array_distinct(pairs(w)))


def admitted(size: Column, least: float) -> tuple[Column, Column]:
    """Smallest and largest size of a set that can match a template of ``size`` bigrams."""
    low, high = F.ceil(size * least / (2 - least) - 1e-9), F.floor(size * (2 - least) / least + 1e-9)
    return low, high


def cue_words(templates: list[list[str]], least: float) -> list[str]:
    """Words of which every match of a template holds at least one.

    A match shares |B| t / (2 - t) bigrams with the template, so it can't miss all
    bigrams of a choice of more than the rest; the longest words are chosen, as they are rare.
    """
    out: set[str] = set()
    for words in templates:
        own = set(zip(words, words[1:]))
        missed = len(own) - math.ceil(len(own) * least / (2 - least) - 1e-9)
        touched: set[tuple[str, str]] = set()
        for word in sorted(set(words), key=lambda w: (-len(w), w)):
            if len(touched) > missed:
                break
            touched |= {b for b in own if word in b}
            out.add(word)
    return sorted(out)


def runs_in_rows(rows: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """``id, row, license_id, dice`` of the runs of lines that match; ``rows``: ``id, row, text``, normalised."""
    words = lambda t: F.filter(F.split(t, "[ \n]+"), lambda w: w != "")
    every = let(words(F.col("text")), lambda w: F.transform(int_range(1, F.size(w) - 1), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i))))
    union = known.agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("union"))
    low, high = admitted(F.size("own"), least)
    hits = rows.withColumn("every", every).crossJoin(F.broadcast(union)).withColumn("hits", F.array_intersect("every", "union")).filter(F.size("hits") > 0).drop("union")
    near = hits.crossJoin(F.broadcast(known)).filter(F.size(F.array_intersect("hits", "own")) >= low)

    # Words before each line, and the last bigram of each line; of each bigram its place, the last place before with the same one, and whether the template has it.
    counts = F.transform(F.split("text", "\n"), lambda line: F.size(words(line)))
    sums = F.aggregate(counts, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    by_gram = F.array_sort(F.transform("every", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    before = lambda b: F.transform(b, lambda x, k: F.struct(
        x["i"].alias("i"), F.coalesce(F.when((k > 0) & (F.get(b, F.greatest(k - 1, F.lit(0)))["g"] == x["g"]), F.get(b, F.greatest(k - 1, F.lit(0)))["i"]), F.lit(-1)).alias("prev"), F.array_contains("own", x["g"]).alias("hit"),
    ))
    placed = near.select("id", "row", "license_id", "own", F.array_distinct(sums).alias("edges"), F.array_sort(let(by_gram, before)).alias("places"))
    # A run without hits in its first line, or behind its last hit, has no larger coefficient than without that line.
    hit_at = F.transform(F.filter("places", lambda x: x["hit"]), lambda x: x["i"])
    starts = F.filter("edges", lambda e, k: F.exists("hit_at", lambda h: (h >= e) & (h < F.coalesce(F.get("edges", k + 1), F.lit(1 << 30)))) & (F.size(F.filter("hit_at", lambda h: h >= e)) >= low))
    begun = placed.withColumn("hit_at", hit_at).select("*", F.explode_outer(starts).alias("start")).filter("start IS NOT NULL")
    zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("c"), F.lit(0.0).alias("dice"), F.lit(-1).alias("stop"))

    def step(acc, x):
        new = x["prev"] < F.col("start")
        a, c = acc["a"] + F.when(new, 1).otherwise(0), acc["c"] + F.when(new & x["hit"], 1).otherwise(0)
        dice = 2 * c / (a + F.size("own"))
        better = (a >= low) & (a <= high) & (dice > acc["dice"]) & F.array_contains("edges", x["i"] + 2)
        return F.struct(a.alias("a"), c.alias("c"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"), F.when(better, x["i"]).otherwise(acc["stop"]).alias("stop"))

    best = begun.withColumn("best", F.aggregate(F.slice("places", F.col("start") + 1, F.greatest(F.array_max("hit_at") - F.col("start") + 1, F.lit(1))), zero, step))
    found = best.filter(F.col("best.dice") >= least - 1e-12).select("id", "row", F.struct("license_id", "start", "best.stop", "best.dice").alias("run"))
    runs = found.groupBy("id", "row").agg(F.collect_list("run").alias("runs"))
    closer = lambda x, y: (y["license_id"] != x["license_id"]) & (y["start"] <= x["stop"]) & (x["start"] <= y["stop"]) & ((y["dice"] > x["dice"]) | ((y["dice"] == x["dice"]) & (y["license_id"] < x["license_id"])))
    stay = let(F.col("runs"), lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda y: closer(x, y))))
    return runs.select("id", "row", F.inline(stay)).select("id", "row", "license_id", "dice")


def scan(docs: DataFrame, templates=TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, license_id, dice`` (the largest), ``n_parts``: one row per document and licence that a part of it matches.

    ``n_parts`` counts texts, paragraphs and lines; it is 1 where only a run of several lines matches.
    """
    require(docs, id_col, text_col)
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; at most {MOST_TEMPLATES}")
    spark = docs.sparkSession
    known = spark.createDataFrame(list(templates), "license_id string, text string").select("license_id", bigrams(normalised(F.col("text"))).alias("own"))
    known = known.filter(F.size("own") > 0)
    by_size = F.broadcast(known.withColumn("size", F.explode(F.sequence(*admitted(F.size("own"), least)))).withColumn("size", F.col("size").cast("int")))

    text = normalised(text_or_empty(text_col))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    listed = spark.createDataFrame([(t,) for _, t in templates], "text string").select(F.split(normalised(F.col("text")), "[ \n]+").alias("w")).collect()  # one row per template
    cues = cue_words([[w for w in r["w"] if w] for r in listed], least)
    rows = rows.filter(F.arrays_overlap(F.split("text", "[ \n]+"), F.array(*[F.lit(w) for w in cues]).cast("array<string>")))
    lines, paragraphs = F.split("text", "\n"), F.split("text", "\n( ?\n)+")
    several = lambda parts: F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.array("text"), several(paragraphs), several(lines))
    parted = rows.select("id", "row", F.posexplode(parts).alias("part", "words")).select("id", "row", "part", bigrams(F.col("words")).alias("grams"))
    sized = parted.withColumn("size", F.coalesce(F.size("grams"), F.lit(0)))
    dice = 2 * F.size(F.array_intersect("grams", "own")) / (F.col("size") + F.size("own"))
    matches = sized.join(by_size, "size").select("id", "row", "part", "license_id", dice.alias("dice")).filter(F.col("dice") >= least - 1e-12)
    # max_by on (coefficient, then the first name) for each part.
    best = matches.groupBy("id", "row", "part").agg(F.max("dice").alias("top"), F.collect_set(F.struct("dice", "license_id")).alias("all"))
    name = F.array_min(F.transform(F.filter("all", lambda m: m["dice"] == F.col("top")), lambda m: m["license_id"]))
    best = best.select("id", name.alias("license_id"), "top")
    runs = runs_in_rows(rows, known, least)
    both = best.select("id", "license_id", "top", F.lit(1).alias("n")).unionByName(runs.select("id", "license_id", F.col("dice").alias("top"), F.lit(0).alias("n")))
    return both.groupBy("id", "license_id").agg(F.max("top").alias("dice"), F.greatest(F.sum("n"), F.lit(1)).cast("bigint").alias("n_parts"))
