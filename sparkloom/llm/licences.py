"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance along paths; native (operator 1).

Lines and whole texts become sparse TF-IDF vectors (terms joined with their inverse document frequencies over all documents,
terms outside the templates weighing most), and their cosine to each template is a join on terms and a sum. Only lines and
texts that hold none of the terms without which no cosine can reach its threshold (see `telling`) are left out of the join;
no term is left out for being frequent. A document's own licence is its best header; a document that as a whole is close to
a template is a licence file of its directory.
Documents without a licence of their own inherit from the nearest ancestor directory that has a licence file, by a join
of each path's ancestors with the table of licensed directories.

Defined cases: null or empty text has no own licence but inherits; null path parts count as empty; documents that share
a path share the best licence found there; ties go to the better cosine, then to the licence's name, then to the smaller path;
an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, whole_text

#: (licence, statement) as documents and licence files word it.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright, CC0 1.0 public domain dedication"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
            "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, "
            "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
            "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
            "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
            "and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions "
                     "of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the "
                     "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither "
                     "the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
                     "written permission."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the "
                   "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
                "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
                "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
                  "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
SPLIT = "[^a-z0-9]+"
#: Sub-groups over which the documents of one directory are dealt.
SALTS = 64


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda t: t != "")


def template_terms(templates) -> list[dict[str, int]]:
    import re

    out = []
    for _, statement in templates:
        counts: dict[str, int] = {}
        for t in re.split(SPLIT, statement.lower()):
            if t:
                counts[t] = counts.get(t, 0) + 1
        out.append(counts)
    return out


def literal_rows(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A small table of constants."""
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
    return spark.range(1).select(F.explode(each).alias("r")).select("r.*")


def squares(terms: Column) -> Column:
    """The sum of the squared counts of an array's distinct terms."""
    none = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum"))

    def add(a: Column, term: Column) -> Column:
        run = F.when(a["last"] == term, a["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(term.alias("last"), run.alias("run"), (a["sum"] + 2 * run - 1).alias("sum"))

    return F.aggregate(F.sort_array(terms), none, add, lambda a: a["sum"])


def scores(spark: SparkSession, texts: DataFrame, templates, idf: dict[str, float], unknown: float) -> DataFrame:
    """The best (licence, score) by cosine for each row of texts(row, inside, outside).

    inside: the text's template terms, each as often as it occurs; outside: the sum of the squared counts of its other terms.
    """
    vectors = []
    for k, ((name, _), counts) in enumerate(zip(templates, template_terms(templates))):
        length = math.sqrt(sum((n * idf[t]) ** 2 for t, n in counts.items())) or 1.0
        vectors += [(k, name, t, n * idf[t] / length) for t, n in counts.items()]
    # As many rows as the templates have terms.
    table = F.broadcast(literal_rows(spark, vectors, ("template", "licence", "term", "weight")))
    known = F.broadcast(literal_rows(spark, list(idf.items()), ("term", "idf")))
    found = texts.select("row", "outside", F.explode("inside").alias("term")).groupBy("row", "outside", "term").agg(F.count(F.lit(1)).alias("n"))
    found = found.join(known, "term").withColumn("tfidf", F.col("n") * F.col("idf"))
    norms = found.groupBy("row", "outside").agg(F.sum(F.col("tfidf") * F.col("tfidf")).alias("s")).select(
        "row", F.sqrt(F.col("s") + unknown * unknown * F.col("outside")).alias("norm"))
    dots = found.join(table, "term").groupBy("row", "template", "licence").agg(F.sum(F.col("tfidf") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "row").withColumn("score", F.round(F.col("dot") / F.col("norm"), 9))
    # Among equal scores the greatest struct would take the last name; the negated template order takes the first.
    best = F.max_by(F.struct("licence", "score"), F.struct("score", (-F.col("template")).alias("o"))).alias("b")
    return scored.groupBy("row").agg(best).select("row", "b.licence", "b.score")


def telling(templates, idf: dict[str, float], limit: float) -> list[str]:
    """Terms of which a text must hold one to reach a cosine of `limit` with any template.

    The shared terms' part of a template's unit vector bounds the cosine (Cauchy and Schwarz), so terms are taken from each template,
    the rarest in the corpus first, until those left cannot reach the limit by themselves.
    """
    found: set[str] = set()
    for counts in template_terms(templates):
        left = sum((n * idf[t]) ** 2 for t, n in counts.items()) or 1.0
        least = limit * limit * left
        for t in sorted(counts, key=lambda t: (-idf[t], t)):
            if left < least:
                break
            found.add(t)
            left -= (counts[t] * idf[t]) ** 2
    return sorted(found)


def scan(docs: DataFrame, path: Column, text: str = "text", doc_id: str = "doc_id", templates=TEMPLATES,
         header_score: float = 0.6, file_score: float = 0.3) -> DataFrame:
    """doc_id, path, licence, basis (header, inherited or none), score, licence_file, inherited_from for every row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), path.alias("path"), whole_text(docs, text).alias("body"))
    vocabulary = sorted({t for counts in template_terms(templates) for t in counts})
    held = F.array_intersect(terms_of(F.col("body")), F.array(*[F.lit(t) for t in vocabulary]))
    # One row for each template term.
    seen = {r["term"]: r["n"] for r in docs.select(F.explode(held).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = docs.agg(F.count(F.lit(1))).first()[0]
    idf = {t: math.log((1 + rows) / (1 + seen.get(t, 0))) + 1 for t in vocabulary}
    unknown = math.log(1 + rows) + 1
    near = lambda limit: limit - 1e-6  # noqa: E731  scores are rounded
    tells = [F.array(*[F.lit(t) for t in telling(templates, idf, near(limit))]) for limit in (file_score, header_score)]
    # A line's terms are among its text's, and a lower limit takes more terms to tell.
    lines = F.transform(F.split("body", "\n"), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("body")))
    hits = docs.filter(F.arrays_overlap(terms_of(F.col("body")), tells[0 if file_score <= header_score else 1])).select(
        "path", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), "body")), lines)).alias("x")).select("path", "x.*")
    hits = hits.filter(F.arrays_overlap(terms_of(F.col("body")), F.when(F.col("whole"), tells[0]).otherwise(tells[1])))
    hits = hits.select("path", "whole", terms_of(F.col("body")).alias("terms")).select(
        "path", "whole", F.filter("terms", lambda t: t.isin(*vocabulary)).alias("inside"), squares(F.filter("terms", lambda t: ~t.isin(*vocabulary))).alias("outside"))
    hits = materialize(hits.withColumn("row", F.monotonically_increasing_id()), "licence-candidates")
    found = scores(spark, hits, templates, idf, unknown).join(hits.select("row", "path", "whole"), "row")
    best = F.max_by(F.struct("licence", "score"), F.struct("score", F.hex("licence")))
    own = found.filter(~F.col("whole") & (F.col("score") >= header_score)).groupBy("path").agg(best.alias("own"))
    files = found.filter(F.col("whole") & (F.col("score") >= file_score)).groupBy("path").agg(best.alias("file"))
    own, files = materialize(own, "licence-headers"), materialize(files, "licence-files")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    folders = files.select(folder.alias("folder"), "path", "file").groupBy("folder").agg(
        F.min(F.struct((-F.col("file.score")).alias("s"), F.col("file.licence").alias("licence"), F.col("path").alias("from"))).alias("given"))
    slim = docs.select("doc_id", "path")
    # Every distinct directory with its ancestors, nearest first and the empty root last; depth is that of the path.
    parts = F.split("folder", "/")
    depth = F.explode(F.sequence(F.lit(0), F.size(parts)))
    above = slim.select(folder.alias("folder")).distinct().select("folder", depth.alias("up")).withColumn(
        "ancestor", F.concat_ws("/", F.slice(parts, F.lit(1), F.size(parts) - F.col("up"))))
    given = above.join(folders.withColumnRenamed("folder", "ancestor"), "ancestor").groupBy("folder").agg(F.min_by("given", "up").alias("given"))
    # A directory may hold a third of all documents: its row is repeated for as many sub-groups as its documents are dealt over.
    salt = F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt")
    given = given.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = slim.select("doc_id", "path", folder.alias("folder"), salt).join(own, "path", "left").join(files.select("path", F.lit(True).alias("licence_file")), "path", "left").join(
        given, ["folder", "salt"], "left")
    return out.select(
        "doc_id", "path", F.coalesce("own.licence", "given.licence").alias("licence"),
        F.when(F.col("own").isNotNull(), "header").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.coalesce(F.col("own.score"), -F.col("given.s")).alias("score"), F.coalesce("licence_file", F.lit(False)).alias("licence_file"),
        F.when(F.col("own").isNull(), F.col("given.from")).alias("inherited_from"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = F.lit("")
    path = F.concat_ws("/", F.coalesce("source", none), F.coalesce("lang", none), F.coalesce(F.col("doc_id").cast("string"), none))
    return scan(docs, path)
