"""License scans with DataFrame functions only.

Words are the runs of a-z and 0-9 of the lower-cased text; shingles are five
words in a row, hashed.  Templates of like length share a *class*: windows of
a quarter more words than its longest template, each a quarter of that length
after the one before, so every span of a template's length lies whole inside
some window.  A window with a match at the threshold then has a Jaccard
similarity of at least J = threshold * shortest / (shortest + window) shingles
or more with the template, and signatures of ``bands`` MinHash values, one to a
band, share one with probability 1 - (1 - J)^bands; bands are chosen for each
class so that this is at least ``PROBABILITY``.

A MinHash value shared with a template is the hash of a shared shingle, so
windows without any template shingle are never built: that loses nothing and
leaves the signatures to a small part of the text.  Retrieved templates are
verified by exact containment: the share of the template's distinct shingles
that the window holds.

Results for odd input: null, empty and short texts have no shingles and no
matches; rows with equal doc_id are scanned each and reported once, by their
best window; a null doc_id is a document of its own; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
THRESHOLD = 0.8
PROBABILITY = 0.9999

# Public licence notices, as their publishers word them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


@dataclass(frozen=True)
class SizeClass:
    """Windows of `width` shingles, each `step` after the one before; a signature has `bands` values."""

    number: int
    shortest: int
    longest: int
    width: int
    step: int
    bands: int
    shingles: tuple[int, ...]


def size_class(number: int, sizes: list[int], shingles: tuple[int, ...], threshold: float = THRESHOLD) -> SizeClass:
    longest = max(sizes)
    step = max(1, -(-longest // 4))
    width = longest + step
    shortest = min(sizes)
    held = threshold * shortest
    jaccard = held / (shortest + width - held)
    return SizeClass(number, shortest, longest, width, step, math.ceil(math.log(1 - PROBABILITY) / math.log(1 - jaccard)), shingles)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def shingles_of(found: Column) -> Column:
    """Hashes of five words in a row, in order; `found` must be a plain column."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(found) - SHINGLE), lambda i: F.xxhash64(*[F.get(found, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(found) >= SHINGLE, hashed).otherwise(F.array().cast("array<bigint>"))


def _with_shingles(df: DataFrame, keep: str) -> DataFrame:
    # explode(array(x)) computes x once: the optimizer doesn't copy it into what follows.
    split = df.select(keep, F.explode(F.array(words(F.col("text")))).alias("words"))
    return split.select(keep, F.explode(F.array(shingles_of(F.col("words")))).alias("shingles"))


def signature(shingles: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda seed: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, seed))))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in sorted(templates.items())])
    table = _with_shingles(spark.range(1).select(F.inline(rows)), "license")
    return table.withColumn("shingles", F.array_distinct("shingles"))


def classes_of(templates: DataFrame, threshold: float = THRESHOLD) -> tuple[list[SizeClass], dict[str, int]]:
    """Size classes of templates within a factor of 1.25, and the class of each template."""
    rows = sorted((len(r["shingles"]), r["license"], r["shingles"]) for r in templates.collect() if r["shingles"])  # a row for each template
    groups: list[list[tuple]] = []
    for row in rows:
        if groups and row[0] <= 1.25 * groups[-1][0][0]:
            groups[-1].append(row)
        else:
            groups.append([row])
    found = [size_class(k, [r[0] for r in g], tuple(sorted({h for r in g for h in r[2]})), threshold) for k, g in enumerate(groups)]
    return found, {r[1]: k for k, g in enumerate(groups) for r in g}


def _windows_of_class(c: SizeClass) -> Column:
    """(class, window) of every window that holds a shingle of the class's templates."""
    hits = F.array_compact(F.transform("shingles", lambda h, i: F.when(h.isin(*c.shingles), i)))
    near = F.transform(hits, lambda i: F.sequence(F.greatest(F.lit(0), F.ceil((i - c.width + 1) / c.step).cast("int")), F.floor(i / c.step).cast("int")))
    return F.transform(F.array_distinct(F.flatten(near)), lambda k: F.struct(F.lit(c.number).alias("class"), k.alias("window")))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, containment (best window), first_word (of the first window at that containment), n_windows (that match)."""
    spark = docs.sparkSession
    table = template_table(spark, templates)
    classes, class_of = classes_of(table, threshold)
    number = F.create_map(*[F.lit(x) for pair in class_of.items() for x in pair])
    by_class = lambda pick: F.element_at(F.array(*[F.lit(pick(c)) for c in classes]), F.col("class") + 1)
    known = table.withColumn("class", number[F.col("license")]).filter("class is not null")
    known = known.select("license", "class", F.col("shingles").alias("of_template"), F.posexplode(signature(F.col("shingles"), by_class(lambda c: c.bands))).alias("band", "least"))

    every = sorted({h for c in classes for h in c.shingles})
    hit = _with_shingles(docs.select("doc_id", "text"), "doc_id").filter(F.exists("shingles", lambda h: h.isin(*every)))
    windows = hit.select("doc_id", "shingles", F.inline(F.flatten(F.array(*[_windows_of_class(c) for c in classes]))))
    width, step = by_class(lambda c: c.width), by_class(lambda c: c.step)
    start = F.col("window") * step
    held = windows.select("doc_id", "class", start.alias("first_word"), F.explode(F.array(F.slice("shingles", start + 1, width))).alias("held"))
    signed = held.select("doc_id", "class", "first_word", "held", F.posexplode(signature(F.col("held"), by_class(lambda c: c.bands))).alias("band", "least"))
    # Templates are a fixed table of a few rows a band.
    met = signed.join(F.broadcast(known), ["class", "band", "least"])
    share = F.size(F.array_intersect("held", "of_template")) / F.size("of_template")
    checked = met.select("doc_id", "license", "first_word", share.alias("containment")).filter(F.col("containment") >= threshold)
    best = F.struct(F.col("containment"), (-F.col("first_word")).alias("before"))
    out = checked.groupBy("doc_id", "license").agg(F.max(best).alias("best"), F.count_distinct("first_word").alias("n_windows"))
    return out.select("doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.before")).cast("long").alias("first_word"), "n_windows")


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for scan() on documents, by shingle text and without signatures."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted(templates.items()))
    cut = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
    shingles = f"unnest(list_transform(range(len(w) - {SHINGLE - 1}), lambda i: list_aggregate(w[i + 1 : i + {SHINGLE}], 'string_agg', ' '))) AS s, unnest(range(len(w) - {SHINGLE - 1})) AS i"
    return f"""
WITH RECURSIVE t AS (SELECT license, text FROM (VALUES {values}) v(license, text)),
ts AS (SELECT DISTINCT license, s FROM (SELECT license, {shingles} FROM (SELECT license, {cut} AS w FROM t) WHERE len(w) >= {SHINGLE})),
tn AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
o AS (SELECT license, n, row_number() OVER (ORDER BY n, license) AS k FROM tn),
g AS (SELECT license, n, k, n AS least FROM o WHERE k = 1
      UNION ALL SELECT o.license, o.n, o.k, CASE WHEN o.n <= 1.25 * g.least THEN g.least ELSE o.n END FROM g JOIN o ON o.k = g.k + 1),
c AS (SELECT license, n, greatest(1, CAST(ceil(max(n) OVER (PARTITION BY least) / 4.0) AS BIGINT)) AS step,
             max(n) OVER (PARTITION BY least) + greatest(1, CAST(ceil(max(n) OVER (PARTITION BY least) / 4.0) AS BIGINT)) AS width FROM g),
ds AS (SELECT doc_id, {shingles} FROM (SELECT doc_id, {cut} AS w FROM documents) WHERE len(w) >= {SHINGLE}),
h AS (SELECT doc_id, license, s, i FROM ds JOIN ts USING (s)),
m AS (SELECT doc_id, h.license, n, step, s, unnest(range(greatest(0, CAST(ceil((i - width + 1) / step) AS BIGINT)), i // step + 1)) AS k FROM h JOIN c USING (license)),
x AS (SELECT doc_id, license, k * step AS first_word, count(DISTINCT s) / n AS containment FROM m GROUP BY doc_id, license, k, step, n HAVING count(DISTINCT s) / n >= {threshold})
SELECT doc_id, license, max(containment) AS containment, arg_max(first_word, (containment, -first_word)) AS first_word, count(*) AS n_windows
FROM x GROUP BY doc_id, license"""
