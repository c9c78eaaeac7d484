"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Words are runs of a-z and 0-9 in the lower-cased text, shingles are five words in a row. A
window is four shingles (eight words); a document's windows begin at every second shingle, so
they overlap by half, a template's at every shingle. Each of 16 bands is one MinHash of a
window; a template is retrieved by a document that shares a band's value with it.

Collision probability: a window that lies within an unchanged stretch of a template equals
one of the template's windows and collides for certain. That needs nine words in a row, so a
template of 12 or more words with containment 0.8 or more nearly always has one. A template
of few words lies in a larger window of the document: each of its shingles is among the four
of two windows, one of which selects it in a band with probability of at least 1/4, and all
16 bands of a template of one shingle miss it with at most 0.75^16 = 1 %, of two with 0.01 %.

A retrieved template is a match if the document holds at least 0.8 of its distinct shingles.
Everything is an expression over one row: no Python, no join, no shuffle. The templates are
literals of the plan; their number is the caller's, never the corpus's.

Defined cases: null and empty texts and texts of fewer than five words match nothing; long
texts take time and memory in proportion; templates that match equally are all reported, by
name; repeated rows give repeated rows; an empty table gives an empty one; only the named
columns are read.
"""

from __future__ import annotations

import json
import re
import struct
from functools import cache

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import read

WORDS, WINDOW, STEP, BANDS, CONTAINMENT = 5, 4, 2, 16, 0.8

# Wording of public licenses and of the usual statements that name them.
TEMPLATES = {
    "agpl-3.0": "GNU Affero General Public License, version 3",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd-2-clause": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "gpl-2.0": "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-notice": "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "mit": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def xxhash64(*values: int | str) -> int:
    """Spark's function of that name for longs and strings."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return signed(seed)


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def shingles_of(text: str) -> list[int]:
    hashes = [xxhash64(w) for w in words_of(text)]
    return [xxhash64(*hashes[i : i + WORDS]) for i in range(len(hashes) - WORDS + 1)]


def bands_of(shingles: list[int]) -> set[int]:
    """Every band's values in all windows of a template."""
    windows = [shingles[i : i + WINDOW] for i in range(max(1, len(shingles) - WINDOW + 1))]
    return {min(xxhash64(b, s) for s in window) for window in windows if window for b in range(BANDS)}


@cache
def compiled(templates: tuple[tuple[str, str], ...]) -> tuple[str, tuple[int, ...]]:
    """The templates' names, shingles and band values as JSON, and all their shingles."""
    found = []
    for name, text in sorted(templates):
        shingles = shingles_of(text)
        if not shingles:
            raise ValueError(f"template {name} has fewer than {WORDS} words")
        found.append({"name": name, "shingles": sorted(set(shingles)), "bands": sorted(bands_of(shingles))})
    return json.dumps(found), tuple(sorted({x for t in found for x in t["shingles"]}))


def band(runs: str, i: Column, b: int) -> Column:
    """Band ``b`` of the window that begins at shingle ``i``; positions behind the last shingle are null and left out."""
    return F.least(*[F.when(F.get(runs, i + j).isNotNull(), F.xxhash64(F.lit(b).cast("long"), F.get(runs, i + j))) for j in range(WINDOW)])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = CONTAINMENT) -> DataFrame:
    """doc_id and ``matches``, array<struct<name, containment, first_word>> by name, of every row."""
    document, shingles = compiled(tuple((templates or TEMPLATES).items()))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)).alias("words"))
    rows = rows.select("doc_id", F.transform("words", lambda x: F.xxhash64(x)).alias("words"))
    n = F.size("words")
    runs = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(WORDS)]))
    rows = rows.select("doc_id", F.when(n >= WORDS, runs).otherwise(F.array().cast("array<bigint>")).alias("runs"))
    # a band's value is the hash of a shingle, so only windows with a template's shingle can share one
    at = F.when(F.size("runs") > 0, F.sequence(F.lit(0), F.size("runs") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.select("doc_id", "runs", F.filter(at, lambda i: F.get("runs", i).isin(*shingles)).alias("known"))
    first = lambda i: i - i % STEP
    windows = F.flatten(F.transform("known", lambda i: F.array(*[F.greatest(first(i) - k, F.lit(0)) for k in range(0, WINDOW, STEP)])))
    rows = rows.select("doc_id", "runs", F.array_distinct(windows).alias("windows"))
    rows = rows.select("doc_id", "runs", F.flatten(F.transform("windows", lambda i: F.array(*[band("runs", i, b) for b in range(BANDS)]))).alias("bands"))
    kind = "array<struct<name: string, shingles: array<bigint>, bands: array<bigint>>>"
    retrieved = F.filter(F.from_json(F.lit(document), kind), lambda t: F.arrays_overlap(t["bands"], F.col("bands")))
    rows = rows.select("doc_id", "runs", F.when(F.size("bands") > 0, retrieved).otherwise(F.array().cast(kind)).alias("retrieved"))
    judged = F.transform("retrieved", lambda t: F.struct(
        t["name"].alias("name"),
        (F.size(F.array_intersect(t["shingles"], F.col("runs"))) / F.size(t["shingles"])).alias("containment"),
        (F.array_position(F.transform("runs", lambda x: F.array_contains(t["shingles"], x)), True) - 1).alias("first_word"),
    ))
    return rows.select("doc_id", F.filter(judged, lambda m: m["containment"] >= threshold).alias("matches"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("matches").cast("long").alias("n_licenses"),
        F.array_join("matches.name", ",").alias("licenses"),
        F.coalesce(F.array_max("matches.containment"), F.lit(0.0)).alias("containment"),
    )


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op6_sql() -> str:
    """Exact containment of every template in every document."""
    rows = ", ".join(f"({quoted(name)}, {quoted(' '.join(words_of(text)[i : i + WORDS]))})" for name, text in sorted(TEMPLATES.items()) for i in range(len(words_of(text)) - WORDS + 1))
    return rf"""
WITH templates AS (SELECT DISTINCT name, shingle FROM (VALUES {rows}) AS t(name, shingle)),
sizes AS (SELECT name, count(*) AS n FROM templates GROUP BY name),
words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+{WORDS - 1}], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WORDS - 2})) AS i FROM words)
), matches AS (
  SELECT doc_id, name, count(*) / any_value(n) AS containment
  FROM shingles JOIN templates USING (shingle) JOIN sizes USING (name)
  GROUP BY doc_id, name HAVING count(*) / any_value(n) >= {CONTAINMENT}
)
SELECT doc_id, count(name) AS n_licenses, coalesce(string_agg(name, ',' ORDER BY name), '') AS licenses,
       coalesce(max(containment), 0) AS containment
FROM documents LEFT JOIN matches USING (doc_id) GROUP BY doc_id
"""
