"""Licence scan: spellings of neighbours, rows without an id, full texts, notices."""
import re

import pytest
from pyspark.sql import functions as F

from qpanel.llm import licenses as L


def canonical(text: str) -> str:
    """The canonical form in plain Python, word by word."""
    kept = [x for x in text.translate(str.maketrans(L.UPPER, L.LOWER)).split("\n") if not re.search(L.COPYRIGHT_LINE, x)]
    words = re.sub("[^a-z0-9]+", " ", " ".join(kept)).split()
    for a, b in L.SPELLINGS:
        a, b, out, i = a.split(), b.split(), [], 0
        while i < len(words):
            hit = words[i:i + len(a)] == a
            out += b if hit else words[i:i + 1]
            i += len(a) if hit else 1
        words = out
    return " ".join(words)


def form(spark, text):
    return spark.range(1).select(L.whole_form(L.plain_lines(F.lit(text)))).first()[0]


TEXTS = ["licence licence licence", "Licence, licence\nLICENCES licence", "copyright owner copyright owner copyright owners",
         "sub licence sub-license, sublicence", "per cent per cent percent", "x licence", "licence", "", "  ", "a  b", "whilst whilst whilst a",
         "Copyright 2001 me\nlicence licenced\n(c) you", "non infringement non  infringement"]


@pytest.mark.parametrize("text", TEXTS)
def test_canonical_form_equals_plain_python(spark, text):
    assert form(spark, text) == canonical(text)


def scan(spark, rows):
    return L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()


def test_rows_without_or_with_a_shared_id_keep_their_own_notices(spark):
    notice = "prose\nReleased under the MIT License.\nprose"
    got = scan(spark, [(None, "nothing here"), (None, notice), (7, notice), (7, "plain"), (7, "Licensed under CC BY 4.0."), (8, None)])
    assert sorted((str(r.doc_id), r.notices) for r in got) == sorted(
        [("None", ""), ("None", "MIT"), ("7", "MIT"), ("7", ""), ("7", "CC-BY-4.0"), ("8", "")])


NOTICES = {
    "Licensed under the MIT license.": "MIT",
    '# Licensed under the Apache License, Version 2.0 (the "License");': "Apache-2.0",
    "This is free and unencumbered software released into the public domain.": "Unlicense",
    "// SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "This project is licensed under the GNU GPL v3": "GPL-3.0",
    "Distributed under a Creative Commons Attribution-ShareAlike 4.0 International Licence": "CC-BY-SA-4.0",
    "The licence of this text is not known.": "",
    "I was released under the care of MIT friends.": "",
}


def test_notices(spark):
    got = {r.doc_id: r.notices for r in scan(spark, [(i, f"before\n{t}\nafter") for i, t in enumerate(NOTICES)])}
    assert [got[i] for i in range(len(NOTICES))] == list(NOTICES.values())


def test_full_texts_however_they_are_wrapped(spark):
    full = [(i, t) for i, t in L.known_texts() if len(t) > 400]
    assert {"MIT", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "BSD-3-Clause"} <= {i for i, _ in full}
    rows = []
    for k, (_, t) in enumerate(full):
        lines = [x for x in t.split("\n") if not re.search(L.COPYRIGHT_LINE, x.lower())]
        rows += [(2 * k, "Copyright 2020 somebody\n" + re.sub(r"\blicense\b", "licence", "\n".join(lines))), (2 * k + 1, t.replace(" ", "   ").upper() + " and more")]
    got = {r.doc_id: r.license_id for r in scan(spark, rows)}
    assert [got[2 * k] for k in range(len(full))] == [i for i, _ in full]
    assert not [k for k in range(len(full)) if got[2 * k + 1]]


def test_known_texts_do_not_contradict(spark):
    forms = {}
    for i, t in L.known_texts():
        forms.setdefault(canonical(t), set()).add(i)
    assert all(len(ids) == 1 for ids in forms.values())
