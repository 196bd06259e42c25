"""License scan: TF-IDF cosine to templates, then inheritance along directories.

Sentences of single lines, and (``units``) sentences over wrapped lines, paragraphs,
leading comments and whole files, become sparse term vectors; document frequencies count
all sentences of lines that hold a cue word, over all files. A part that is near enough to a
template names its license. A file whose first or last part does is a licence file of its
directory; files that name no license themselves take that of the nearest ancestor
directory with a licence file.

Parts without a cue word name no license: weights come from sentences that have one, and
by those a bare "By." would be near "Licensed under CC BY 4.0.". Of the others, bounds keep
most out of the comparison, and lose none. A text whose terms hold too little of every
template is not cut into parts (``may_hold``). Of a part, the weights of its template terms are known in
the scan, and its other terms weigh no less than the commonest of them (``can_reach``).
What is left, short texts like the templates, is shuffled and compared exactly.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.llm.tables import Workspace

MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
GNU_GRANT = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."

# License ids, and sentences that grant each.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
    # Standard notices and texts.
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", MIT_GRANT),
    ("MIT", "MIT License Copyright (c) " + MIT_GRANT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", GNU_GRANT.format("program", "General", "3")),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", GNU_GRANT.format("program", "General", "2")),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", GNU_GRANT.format("library", "Lesser General", "3")),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", GNU_GRANT.format("program", "Affero General", "3")),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *(
        (name, f"SPDX-License-Identifier: {name}{end}")
        for name in ("Apache-2.0", "MIT", "BSD-3-Clause", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0")
        + ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0")
        for end in (("", "-only", "-or-later") if "GPL" in name else ("",))
    ),
)

# Parts are compared, and sentences counted, if they hold one of these words (fixed values).
CUES = (
    "license",
    "licensed",
    "licence",
    "licenced",
    "copyright",
    "rights",
    "permission",
    "redistribution",
    "spdx",
)
LEAST_COSINE = 0.8
SENTENCE_END = r"\n|(?<=[.!?])\s+"
# Marks that a line of a comment begins with.
MARK = r"(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--+)"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
CUE = rf"(?i)(?<![a-z0-9])({'|'.join(CUES)})(?![a-z0-9])"
# What rounding may add to a bound.
SLACK = 1e-6
# A term of every sentence, which counts them.
ANY = ""


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1)


def sentences(files: DataFrame) -> DataFrame:
    """``path, place, edge, sentence`` of all sentences of single lines; place from 0.

    ``edge`` says whether it is the first or the last sentence.
    """
    return (
        files.select("path", F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), SENTENCE_END).alias("all"))
        .select("path", F.size("all").alias("n"), F.posexplode("all").alias("place", "sentence"))
        .withColumn("edge", (F.col("place") == 0) | (F.col("place") == F.col("n") - 1))
        .select("path", "place", "edge", "sentence")
    )


def cued(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).rlike(CUE))


def frequencies(files: DataFrame) -> DataFrame:
    """``term, held``: sentences with a cue word that hold the term; ANY counts them all."""
    held = F.array_append(F.array_distinct(terms(F.col("sentence"))), ANY)
    said = cued(sentences(files), "sentence")
    return said.select(F.explode(held).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("held"))


def units(files: DataFrame) -> DataFrame:
    """``path, place, edge, sentence`` of the parts of a text over several lines.

    Lines lose their comment marks and are joined: to paragraphs, which blank lines end,
    to the sentences of these, to the leading comment, and to the whole text.
    ``edge`` says whether a part begins or ends the text; ``place`` comes after those of
    ``sentences``.
    """

    def joined(text: Column) -> Column:
        return F.trim(F.regexp_replace(text, r"\s+", " "))

    def plain(text: Column) -> Column:
        return F.regexp_replace(text, rf"(?m)^[ \t]*{MARK}|[ \t]*(?:\*+/|--+>)[ \t\r]*$", "")

    def parts(texts: Column, first: int) -> Column:
        return F.transform(
            texts,
            lambda t, k: F.struct(
                (k + F.lit(first)).alias("place"),
                ((k == 0) | (k == F.size(texts) - 1)).alias("edge"),
                t.alias("sentence"),
            ),
        )

    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    lines = F.split("whole", "\n")
    code = F.array_position(F.transform(lines, lambda line: line.rlike(rf"^\s*(?:{MARK}|$)")), False)
    comment = F.when(F.col("whole").startswith("/*"), F.substring_index("whole", "*/", 1)).when(
        code > 1, F.array_join(F.slice(lines, F.lit(1), F.greatest(code - 1, F.lit(1)).cast("int")), "\n")
    )
    after = F.length("whole")
    return (
        files.select("path", text.alias("whole"))
        .withColumn(
            "blocks",
            F.transform(F.split(F.trim(plain(F.col("whole"))), r"\n[ \t\r]*\n\s*"), joined),
        )
        .withColumn(
            "said", F.flatten(F.transform("blocks", lambda b: F.split(b, r"(?<=[.!?])\s+")))
        )
        .withColumn(
            "ends", F.array_compact(F.array(joined(plain(comment)), joined(plain(F.col("whole")))))
        )
        .withColumn("shift", after)
        .select(
            "path",
            "shift",
            F.explode(
                F.concat(parts(F.col("said"), 1), parts(F.col("blocks"), 1), parts(F.col("ends"), 1))
            ).alias("u"),
        )
        .select("path", (F.col("shift") + F.col("u.place")).cast("int").alias("place"), "u.edge", "u.sentence")
    )


def template_table(spark: SparkSession) -> DataFrame:
    rows = [(k, license, text) for k, (license, text) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template int, license string, sentence string")


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    """Each row's terms with their counts."""
    return (
        rows.select(*keys, F.explode(terms(F.col("sentence"))).alias("term"))
        .groupBy(*keys, "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@dataclass(frozen=True)
class Bounds:
    """Weights of the templates' terms, each template's share of them, and of others the least."""

    weights: dict[str, float]
    templates: list[dict[str, float]]
    others: float
    least: float

    def may_hold(self, text: str) -> bool:
        """Whether a part of a text may be near some template, by the terms that it has at all.

        A cosine is no more than the root of what the part's terms hold of the
        template's squares, and the text's terms hold no less.
        """
        held = self.weights.keys() & re.findall(TERM, text.lower())
        enough = (self.least - SLACK) ** 2
        return any(
            sum(shares[term] ** 2 for term in held if term in shares) >= enough for shares in self.templates
        )

    def can_reach(self, text: str) -> bool:
        """Whether some template may be near enough; its cosine counts other terms too light."""
        held = Counter(re.findall(TERM, text.lower()))
        own = {term: n * self.weights[term] for term, n in held.items() if term in self.weights}
        square = sum(w * w for w in own.values())
        square += sum((n * self.others) ** 2 for term, n in held.items() if term not in self.weights)
        reach = (self.least - SLACK) * math.sqrt(square)
        return bool(own) and any(
            sum(w * shares[term] for term, w in own.items() if term in shares) >= reach
            for shares in self.templates
        )


def bounds(seen: DataFrame, total: int, least: float) -> Bounds:
    """From the frequencies of the templates' terms, a few hundred rows, and one more."""
    counts = [Counter(re.findall(TERM, text.lower())) for _, text in TEMPLATES]
    known = sorted(set().union(*counts))
    held = {r["term"]: r["held"] for r in seen.filter(F.col("term").isin(known)).collect()}
    most = seen.filter(~F.col("term").isin([*known, ANY])).agg(F.max("held")).first()[0] or 0

    def weight(n: int) -> float:
        return math.log((total + 1) / (n + 1)) + 1

    weights = {term: weight(held.get(term, 0)) for term in known}
    templates = []
    for count in counts:
        length = math.sqrt(sum((n * weights[term]) ** 2 for term, n in count.items()))
        templates.append({term: n * weights[term] / length for term, n in count.items()})
    return Bounds(weights, templates, weight(most), least)


def filtered(rows: DataFrame, column: str, keep) -> DataFrame:
    """Rows whose text, a null one as an empty one, is kept."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([keep(t or "") for t in batch.column(column).to_pylist()], pa.bool_()))

    return rows.mapInArrow(chosen, rows.schema)


def parts_in_reach(files: DataFrame, limit: Bounds) -> DataFrame:
    """``path, place, edge, sentence`` of the parts that may be near a template."""
    texts = filtered(files, "text", limit.may_hold)
    return filtered(cued(sentences(texts).unionByName(units(texts)), "sentence"), "sentence", limit.can_reach)


def matches(files: DataFrame, workspace: Workspace, least: float = LEAST_COSINE) -> DataFrame:
    """``path, place, edge, license, cosine``: the best template of each part near one.

    Distinct parts are compared once, however often they occur. Ties go to the
    first template.
    """
    spark = files.sparkSession
    # Most texts have no cue at all.
    texts = workspace.save(cued(files.select("path", "text"), "text"), "texts")
    seen = workspace.save(frequencies(texts), "seen")
    total = seen.filter(F.col("term") == ANY).agg(F.sum("held")).first()[0] or 0
    parts = parts_in_reach(texts, bounds(seen, total, least))
    found = workspace.save(parts.withColumn("key", F.sha2("sentence", 256)), "sentences")
    kinds = workspace.save(found.groupBy("key").agg(F.first("sentence").alias("sentence")), "kinds")
    of_kind = workspace.save(counted(kinds, "key"), "terms")
    # Smoothed; a term in no sentence weighs the most.
    weight = F.log((F.lit(total) + 1) / (F.coalesce("held", F.lit(0)) + 1)) + 1
    template_terms = counted(template_table(spark), "template", "license")
    weighed = template_terms.join(seen, "term", "left").withColumn("w", F.col("n") * weight)
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    # The templates and their terms are a fixed few rows.
    templates = F.broadcast(
        weighed.join(norms, "template").select("template", "license", "term", (F.col("w") / F.col("length")).alias("t"))
    )
    vectors = of_kind.join(seen, "term", "left").withColumn("w", F.col("n") * weight)
    lengths = vectors.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    best = (
        vectors.join(templates, "term")
        .groupBy("key", "template", "license")
        .agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
        .join(lengths, "key")
        .withColumn("cosine", F.round(F.col("dot") / F.col("length"), 9))
        .filter(F.col("cosine") >= least)
        .groupBy("key")
        .agg(F.max(F.struct("cosine", -F.col("template"), "license")).alias("best"))
        .select("key", "best.license", "best.cosine")
    )
    return found.join(best, "key").select("path", "place", "edge", "license", "cosine")


def parent(path: Column) -> Column:
    """The directory of a path; the root is the empty path, which has none."""
    up = F.regexp_replace(path, r"/?[^/]*$", "")
    return F.when(path != "", up)


def scanned(files: DataFrame, workspace: Workspace, least: float = LEAST_COSINE) -> DataFrame:
    """``path, own_license, cosine, license, inherited_from`` for every file.

    ``own_license`` is that of the file's best part (then the earliest), null without
    one; reserved rights count only in a file that grants none. ``license`` falls back to the nearest ancestor directory with
    a licence file (of several files in one directory, the nearest to its template,
    then the least path), whose path is ``inherited_from``. A null or empty text
    names no license. Paths are relative with ``/`` between names; rows that repeat a
    path are one file each with the same result per path; a null path has no directory.
    """
    near = workspace.save(matches(files, workspace, least), "matches")
    # Reserved rights stand in front of many grants.
    granting = F.col("license") != "Proprietary"
    own = near.groupBy("path").agg(
        F.max(F.struct(granting, "cosine", -F.col("place"), "license")).alias("own")
    )
    own = own.select("path", F.col("own.license").alias("own_license"), F.col("own.cosine").alias("cosine"))
    granted = (
        near.filter("edge")
        .groupBy(parent(F.col("path")).alias("folder"))
        .agg(F.min(F.struct(~granting, -F.col("cosine"), "path", "license")).alias("grant"))
        .select("folder", F.col("grant.license").alias("folder_license"))
    )
    # Directories, far fewer than files, look their ancestors up; files then look up
    # only their own directory.
    folders = files.select(parent(F.col("path")).alias("home")).distinct().filter("home is not null")
    names = F.split("home", "/")
    depth = F.when(F.col("home") == "", F.lit(0)).otherwise(F.size(names))
    ancestors = folders.select(
        "home",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), depth),
                lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(names, 1, k), "/").alias("folder")),
            )
        ).alias("up"),
    ).select("home", "up.*")
    nearest = (
        ancestors.join(granted, "folder")
        .groupBy("home")
        .agg(F.max(F.struct("depth", "folder", "folder_license")).alias("near"))
        .select("home", "near.folder", "near.folder_license")
    )
    return (
        files.select("path")
        .join(own, "path", "left")
        .withColumn("home", parent(F.col("path")))
        .join(nearest, "home", "left")
        .select(
            "path",
            "own_license",
            "cosine",
            F.coalesce("own_license", "folder_license").alias("license"),
            F.when(F.col("own_license").isNull(), F.col("folder")).alias("inherited_from"),
        )
    )


def document_files(documents: DataFrame) -> DataFrame:
    """Documents as files below ``source/language``, by the hundreds and tens of their ids.

    Ids that end in 00 stand in the language's directory, others that end in 0 in that of
    their hundred, the rest in that of their ten. A null part of a path is the name ``none``.
    """
    part = lambda column: F.coalesce(column.cast("string"), F.lit("none"))
    doc = F.col("doc_id")
    return documents.select(
        "doc_id",
        F.concat_ws(
            "/",
            part(F.col("source")),
            part(F.col("lang")),
            F.when((doc % 100 != 0) | doc.isNull(), part(F.floor(doc / 100))),
            F.when((doc % 10 != 0) | doc.isNull(), part(F.floor(doc / 10))),
            part(doc),
        ).alias("path"),
        "text",
    )
