"""License scans: sparse TF-IDF cosine of lines, blocks and files to templates, then inheritance from the nearest ancestor directory; DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import Workspace, materialize

THRESHOLD = 0.6
BROADCAST_ROWS = 200_000  # licensed directories (some 60 bytes each) up to which they are broadcast
COMMON_SHARE = 1000  # words in more than one of so many rows are broadcast: at most so many times a row's mean number of words
SPLIT = r"[^\p{L}\p{N}]+"

# The notices by which files and headers name these licenses, and the whole texts of the short ones.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of "
        "the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "MIT",
        "MIT License Copyright (c) <year> <copyright holders> Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or '
        "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        'notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-3-Clause",
        "Copyright (c) <year> <owner>. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce "
        "the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of "
        "the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE "
        'IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "ISC License Copyright (c) <year> <owner> Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING "
        "FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), "")


def template_terms(templates: list[tuple[str, str]]) -> list[dict[str, int]]:
    """Term counts of each template, words cut as in documents."""
    out = []
    for _, text in templates:
        counts: dict[str, int] = {}
        for word in re.findall(r"[^\W_]+", text.lower()):
            counts[word] = counts.get(word, 0) + 1
        out.append(counts)
    return out


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``term``, ``df``: in how many rows each word occurs; all words, whole texts, all rows."""
    found = docs.select(F.explode(F.array_distinct(_words(F.col(text_col)))).alias("term"))
    return found.groupBy("term").agg(F.count("*").alias("df"))


def _units(text: Column) -> Column:
    """A text's lines, its blocks (runs of lines between lines without a word) and the text itself."""
    blocks = F.split(text, r"\n(?:[^\p{L}\p{N}\n]*\n)+")
    return F.array_distinct(F.concat(F.split(text, "\n"), blocks, F.array(text)))


def line_scores(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``license``, ``score``: of each document with a line, block or whole text at cosine ``threshold`` or more, the best (ties: first name).

    Terms are lower-cased runs of letters and digits; weights are counts times ln((1 + rows) / (1 + df)) + 1
    with df over all rows, of every word. Only units with an anchor term are scored: without one of a
    template's anchors, no cosine reaches the threshold, whatever else the unit holds. A template's commonest
    terms are left out of its anchors as long as that holds, so the words of all prose ("the", "of") anchor no unit.
    Frequencies of common words are broadcast, those of the others meet the units' words in an equi-join, so
    no key of that join holds more than a small share of the rows. Null texts have no unit; null ids take part
    as one document.
    """
    spark, bags = docs.sparkSession, template_terms(templates)
    terms = sorted({t for bag in bags for t in bag})
    rows, every = docs.count(), materialize(document_frequencies(docs, text_col), "license-df")
    df = {r["term"]: r["df"] for r in every.where(F.col("term").isin(terms)).collect()}
    idf = {t: math.log((1 + rows) / (1 + df.get(t, 0))) + 1 for t in terms}
    weights, anchors = [], set()
    for number, bag in enumerate(bags):
        vector = {t: n * idf[t] for t, n in bag.items()}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        rest = norm * norm
        for t in sorted(vector, key=lambda t: (df.get(t, 0), -vector[t], t)):
            if math.sqrt(max(rest, 0.0)) < 0.999 * threshold * norm:
                break
            anchors.add(t)
            rest -= vector[t] ** 2
        weights += [(number, templates[number][0], t, vector[t] / norm) for t in vector]
    # Bounded by the templates' words.
    table = F.broadcast(spark.createDataFrame(weights, "template int, license string, term string, weight double"))

    marks = F.array(*map(F.lit, sorted(anchors)))
    hit = docs.where(F.arrays_overlap(_words(F.col(text_col)), marks)).select(F.col(id_col).cast("long").alias("doc_id"), F.explode(_units(F.col(text_col))).alias("unit"))
    units = hit.select("doc_id", F.array_sort(_words(F.col("unit"))).alias("words")).where(F.arrays_overlap("words", marks))
    units = units.select("doc_id", F.xxhash64("words").alias("unit"), "words").dropDuplicates(["doc_id", "unit"])
    units = materialize(units, "license-units")
    counts = units.select("doc_id", "unit", F.explode("words").alias("term")).groupBy("doc_id", "unit", "term").agg(F.count("*").alias("n"))
    counts = materialize(counts, "license-counts")
    often = F.col("df") * COMMON_SHARE > rows
    common = F.broadcast(every.where(often))
    known = counts.join(common, "term").unionByName(counts.join(common, "term", "left_anti").join(every.where(~often), "term"))
    heavy = known.select("doc_id", "unit", "term", (F.col("n") * (F.log(F.lit(1 + rows) / (1 + F.col("df"))) + 1)).alias("x"))
    heavy = materialize(heavy, "license-terms")
    norms = heavy.groupBy("doc_id", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = heavy.join(table, "term").groupBy("doc_id", "unit", "template", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    same = (dots["unit"] == norms["unit"]) & dots["doc_id"].eqNullSafe(norms["doc_id"])
    scored = dots.join(norms, same).select(dots["doc_id"], "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    best = scored.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("x"))
    return best.select("doc_id", "x.license", (-F.col("x.minus")).alias("score"))


def inherit(files: DataFrame) -> DataFrame:
    """``files`` (``path``, ``license``, ``score``) plus ``basis`` and ``inherited_from``; ``license`` and ``score`` filled where inherited.

    A directory's license is that of its file named LICENSE or COPYING (any extension; of several the best
    score, then the first path). A file without a license of its own takes that of the nearest directory
    above it, its own first. ``basis`` is header, inherited or none. Every open file meets each of its
    ancestor directories once, so a directory with a third of all files makes as many rows, not pairs; the
    licensed directories are broadcast while there are at most ``BROADCAST_ROWS``. Null paths inherit nothing.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    named = F.regexp_extract("path", "([^/]*)$", 1).rlike(r"^(LICENSE|COPYING)(\..*)?$")
    of = files.where(F.col("license").isNotNull() & named).groupBy(folder.alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("minus"), "path", "license")).alias("x"))
    of = materialize(of.select("dir", F.col("x.license").alias("dir_license"), (-F.col("x.minus")).alias("dir_score")), "license-dirs")
    few = of.count() <= BROADCAST_ROWS
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir")))
    open_ = files.where(F.col("license").isNull() & F.col("path").isNotNull()).select("path", F.explode(above).alias("a")).select("path", "a.*").distinct()
    near = open_.join(F.broadcast(of) if few else of, "dir").groupBy("path").agg(F.max(F.struct("depth", "dir", "dir_license", "dir_score")).alias("n"))
    out = files.join(near, "path", "left")
    return out.select(
        *[c for c in files.columns if c not in ("license", "score")],
        F.coalesce("license", "n.dir_license").alias("license"),
        F.coalesce("score", "n.dir_score").alias("score"),
        F.when(F.col("license").isNotNull(), "header").when(F.col("n").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.when(F.col("license").isNull(), F.col("n.dir")).alias("inherited_from"),
    )


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """``doc_id``, ``path``, ``license``, ``score``, ``basis``, ``inherited_from`` per row of ``files``.

    Repeated rows stay rows; an empty table gives an empty table; other columns are not read.
    """
    with Workspace(files.sparkSession) as work:
        found = line_scores(files, templates, threshold, id_col, text_col).withColumnRenamed("doc_id", "of")
        slim = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"))
        own = work.give(slim.join(found, slim["doc_id"].eqNullSafe(found["of"]), "left").drop("of"), "license-own")
    return inherit(own).select("doc_id", "path", "license", "score", "basis", "inherited_from")


def repository_path(doc_id: Column, source: Column) -> Column:
    """A place for each document in a tree per source: twenty files a directory, twenty directories a block, every twentieth file a LICENSE."""
    k = F.coalesce(doc_id, F.lit(0)).cast("long")
    row = F.floor(k / 20)
    folder = F.concat_ws("/", F.coalesce(source, F.lit("unknown")), F.floor(row / 400).cast("string"), (F.floor(row / 20) % 20).cast("string"))
    block = F.concat_ws("/", F.coalesce(source, F.lit("unknown")), F.floor(row / 400).cast("string"))
    return F.when(row % 400 == 0, F.concat(block, F.lit("/LICENSE"))).when(row % 20 == 0, F.concat(folder, F.lit("/LICENSE"))).otherwise(F.concat(folder, F.lit("/"), k.cast("string"), F.lit(".txt")))


def scan_sql(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, documents: str = "documents") -> str:
    """``scan`` of ``repository_path`` in DuckDB SQL, every line scored and no anchor used."""
    rows = ", ".join(f"({k}, '{templates[k][0]}', '{t}', {n})" for k, bag in enumerate(template_terms(templates)) for t, n in bag.items())
    words = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    folder = "coalesce(source, 'unknown') || '/' || (doc_id // 20 // 400) || '/' || (doc_id // 20 // 20 % 20)"
    block = "coalesce(source, 'unknown') || '/' || (doc_id // 20 // 400)"
    return f"""
        with t(template, license, term, n) as (values {rows}),
        d as (select doc_id, text, case when doc_id // 20 % 400 = 0 then {block} || '/LICENSE' when doc_id // 20 % 20 = 0 then {folder} || '/LICENSE'
                                        else {folder} || '/' || doc_id || '.txt' end as path from {documents}),
        total as (select count(*) as n from d),
        df as (select term, count(*) as df from (select unnest(list_distinct({words.format("text")})) as term from d) where term in (select term from t) group by term),
        k as (select distinct term, ln((1 + total.n) / (1 + coalesce(df, 0))) + 1 as idf from t left join df using (term), total),
        tw as (select template, license, term, t.n * idf as x from t join k using (term)),
        tn as (select template, sqrt(sum(x * x)) as norm from tw group by template),
        l as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
        ld as (select doc_id, row_number() over () as id, line from l),
        c as (select doc_id, id, term, count(*) as n from (select doc_id, id, unnest({words.format("line")}) as term from ld) group by all),
        w as (select doc_id, id, term, c.n * coalesce(idf, ln(1 + total.n) + 1) as x from c left join k using (term), total),
        ln as (select id, sqrt(sum(x * x)) as norm from w group by id),
        s as (select doc_id, license, round(sum(w.x * tw.x / tn.norm) / any_value(ln.norm), 6) as score
              from w join tw using (term) join tn using (template) join ln using (id) group by doc_id, id, template, license),
        b as (select doc_id, license, score from s where score >= {threshold} qualify row_number() over (partition by doc_id order by score desc, license) = 1),
        o as (select d.doc_id, path, license, score, regexp_replace(path, '/?[^/]*$', '') as dir from d left join b using (doc_id)),
        dirs as (select dir, license, score from o where license is not null and regexp_matches(path, '(^|/)(LICENSE|COPYING)([.][^/]*)?$')
                 qualify row_number() over (partition by dir order by score desc, path) = 1),
        near as (select o.doc_id, path, max_by(struct_pack(dir := dirs.dir, license := dirs.license, score := dirs.score), length(dirs.dir)) as x
                 from o join dirs on o.dir = dirs.dir or starts_with(o.dir, dirs.dir || '/') where o.license is null group by all)
        select o.doc_id, o.path, coalesce(o.license, x.license) as license, coalesce(o.score, x.score) as score,
               case when o.license is not null then 'header' when x is not null then 'inherited' else 'none' end as basis, x.dir as inherited_from
        from o left join near using (doc_id, path)"""
