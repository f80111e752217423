"""Licence scan by canonical digests.

A text is brought to a canonical form: A-Z lower-cased, copyright lines
dropped, everything but a-z and 0-9 turned into single blanks, equivalent
spellings replaced.  Its sha256 is hash-joined to the digests of known licence
texts.  Entire texts are compared: the whole document, and every line of it on
its own (a one-line notice inside prose is a text of its own).  Known are the full
texts in ``license_texts`` and below, and the one-line notices that ``WORDINGS``
makes of ``NAMES``.

The known table is a parameter of at most ``BROADCAST_TEXTS`` rows for the
broadcast join; a larger one is joined by shuffling digests.

Edge cases: a NULL or empty text, or one with nothing left after
normalisation, matches nothing (license_id NULL, notices empty); rows are told
apart by a key of their own, so those that share a doc_id, or have none, keep
their own notices; a very long text is read whole like any other; several known
texts with one canonical form count as the first licence id in order; columns other
than doc_id and text are not read; an empty table gives an empty table.
"""
from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qpanel.llm.common import LOWER, UPPER, documents, whole_text, written

BROADCAST_TEXTS = 100_000

# Known licence texts and notices (public licence wording).
KNOWN = [
    ("MIT", """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]

# How notices name a licence (public usage), after its id.
NAMES = {
    "MIT": ["the MIT License", "MIT License", "MIT"],
    "ISC": ["the ISC License", "ISC License", "ISC"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache License 2.0", "Apache 2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License", "BSD 2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "BSD 3-Clause"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL v2", "the GPL v2", "GPLv2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "the GPL v3", "GPLv3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1", "LGPL 2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0", "LGPLv3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0", "AGPLv3"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-2.0": ["the Eclipse Public License, version 2.0", "the Eclipse Public License 2.0", "EPL 2.0"],
    "Unlicense": ["the Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License",
                     "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License",
                     "the Creative Commons Attribution-NonCommercial 4.0 International License"],
}
WORDINGS = ["Licensed under {}", "Licensed under the terms of {}", "Released under {}", "Distributed under {}", "Available under {}",
            "This work is licensed under {}", "This project is licensed under {}", "This software is licensed under {}",
            "This file is licensed under {}", "This code is licensed under {}", "License: {}"]

# First lines of the licences' own standard notices.
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# Equivalent spellings, each to its canonical form; words before phrases.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("licencing", "licensing"), ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("organisation", "organization"),
    ("honour", "honor"), ("favour", "favor"), ("whilst", "while"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
]

COPYRIGHT_LINE = r"^[^a-z0-9]*(copyright ([0-9(c]|by )|\(c\)|©|all rights reserved)"


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text) of all known texts and notices."""
    full = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    notices = [(i, w.format(n)) for i, names in NAMES.items() for n in names for w in WORDINGS]
    return KNOWN + full + HEADERS + notices + [(i, f"SPDX-License-Identifier: {i}") for i in NAMES]


def _apart(text: str) -> str:
    """Words with a blank of their own on each side."""
    return f" {text.replace(' ', '  ')} "


def spelled(form: Column) -> Column:
    """Blank-separated words with equivalent spellings replaced; neighbours do
    not share a blank, so each of a row of equal words is replaced."""
    t = F.concat(F.lit(" "), F.replace(form, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(_apart(a)), F.lit(_apart(b)))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def plain_lines(text: Column) -> Column:
    """The lines in lower case, as words with single blanks; no copyright lines."""
    lines = F.filter(F.split(F.translate(text, UPPER, LOWER), "\n"), lambda x: ~x.rlike(COPYRIGHT_LINE))
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9]+", " ")))


def whole_form(lines: Column) -> Column:
    return spelled(F.array_join(F.filter(lines, lambda x: x != ""), " "))


def sha(form: Column) -> Column:
    return F.when(F.length(form) > 0, F.sha2(form.cast("binary"), 256))


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license, size): of ``known`` (license_id, text), one row a digest."""
    known = spark.createDataFrame(known_texts(), "license_id string, text string") if known is None else known
    form = known.select("license_id", whole_form(plain_lines(F.col("text"))).alias("form")).filter("form <> ''")
    return form.groupBy(sha(F.col("form")).alias("digest")).agg(
        F.min("license_id").alias("license"), F.max(F.length("form")).alias("size"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_digest, license_id (of the
    whole text or NULL), notices (ids of licence lines, sorted, joined by ',').
    A line's digest is taken only if some known text has its length."""
    table = written(known_digests(docs.sparkSession, known), "licenses")
    few = table.count() <= BROADCAST_TEXTS
    lines = docs.select("doc_id", plain_lines(whole_text()).alias("lines"))
    forms = F.transform("lines", spelled)
    if few:
        sizes = F.array(*[F.lit(r["size"]) for r in table.select("size").distinct().collect()]).cast("array<int>")
        forms = F.filter(forms, lambda x: F.array_contains(sizes, F.length(x)))
        table = F.broadcast(table)
    rows = written(lines.select(F.monotonically_increasing_id().alias("row"), "doc_id", sha(whole_form(F.col("lines"))).alias("digest"),
                                F.array_distinct(F.transform(forms, sha)).alias("found")), "license-digests")
    found = (rows.select("row", F.explode("found").alias("digest")).join(table, "digest").groupBy("row")
             .agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices")))
    whole = rows.select("row", "doc_id", "digest").join(table, "digest", "left")
    return whole.join(found, "row", "left").select(
        "doc_id", F.col("digest").alias("text_digest"), F.col("license").alias("license_id"),
        F.coalesce("notices", F.lit("")).alias("notices"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's canonical digest, licence and licence notices."""
    return scan_licenses(documents(spark, sf_dir))


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def canonical_sql(col: str) -> str:
    line = COPYRIGHT_LINE.replace("^[^a-z0-9]*", r"(^|\n)[^a-z0-9\n]*") + r"[^\n]*"
    t = f"regexp_replace(translate({col}, '{UPPER}', '{LOWER}'), {_quote(line)}, chr(10), 'g')"
    t = f"(' ' || replace(trim(regexp_replace({t}, '[^a-z0-9]+', ' ', 'g')), ' ', '  ') || ' ')"
    for a, b in SPELLINGS:
        t = f"replace({t}, '{_apart(a)}', '{_apart(b)}')"
    return f"trim(replace({t}, '  ', ' '))"


ORACLE = f"""
WITH known(license_id, text) AS (VALUES {', '.join(f'({_quote(a)}, {_quote(b)})' for a, b in known_texts())}),
digests AS (SELECT sha256({canonical_sql('text')}) AS digest, min(license_id) AS license FROM known GROUP BY 1),
docs AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM docs),
found AS (SELECT k, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
          FROM (SELECT k, sha256({canonical_sql('line')}) AS digest FROM lines) JOIN digests USING (digest) GROUP BY k),
forms AS (SELECT k, doc_id, {canonical_sql('text')} AS form FROM docs),
whole AS (SELECT k, doc_id, CASE WHEN length(form) > 0 THEN sha256(form) END AS text_digest FROM forms)
SELECT w.doc_id, w.text_digest, d.license AS license_id, coalesce(f.notices, '') AS notices
FROM whole w LEFT JOIN digests d ON w.text_digest = d.digest LEFT JOIN found f USING (k)"""
