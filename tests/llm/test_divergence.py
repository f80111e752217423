import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from qpanel.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows, min_docs, top):
    """The same by brute force: every pair, every term."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, d in docs[lang].items() if d >= min_docs}
        mine = sorted(s for g, s in groups if g == lang)
        whole = sum((counts[lang, s] for s in mine), Counter())

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(counts[lang, s]) for s in mine}
        for s in mine:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in mine if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def corpus(seed=1):
    draw = random.Random(seed)
    words = [a + b for a in ("on", "ÉTé", "Ba", "zu", "日本", "x") for b in ("", "der", "LY", "s", "ñ", "k", "qq")]
    rows = []
    for i in range(150):
        lang, source = draw.choice(["en", "en", "fr", None]), draw.choice(["a", "a", "b", "c", "d", None, ""])
        bias = words[(hash(source or "") % 3) * 5:] if source else words
        rows.append((i, " ".join(draw.choice(bias) + draw.choice(["", "-", "1", "."]) for _ in range(draw.randint(0, 30))), lang, source, 1))
    return rows + [(None, None, "en", "a", None), (3, "", "xx", "only", 0), (3, "", "xx", "also", 0), (3, "", "xx", "also", 0), (4, "1 2 3 --", "yy", None, 0)]


@pytest.mark.parametrize("small", [False, True])
def test_as_by_brute_force(spark, monkeypatch, small):
    if small:  # many tiles, parts, passed-on counts and skybands
        for name, value in (("TILE_TERMS", 4), ("TILE_SOURCES", 2), ("HELD", 20), ("KEEP", 8), ("PIECE", 7)):
            monkeypatch.setattr(divergence, name, value)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = divergence.audit_sources(docs.withColumns({c: F.lit("z") for c in ("n", "term", "whole", "tile", "v", "rank")}), min_docs=4, top=3).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 4, 3)


def test_skyband_keeps_the_first_of_any_increasing_score():
    draw = np.random.default_rng(3)
    for n, k in ((0, 2), (60, 1), (200, 4)):
        c, w = draw.integers(1, 8, n), draw.integers(1, 9, n)
        name = np.array([f"t{i}".encode() for i in draw.permutation(n)], object)
        kept = set(divergence.skyband(c, w, name, k).tolist())
        beaten = [sum(c[j] >= c[i] and w[j] <= w[i] and name[j] < name[i] for j in range(n)) for i in range(n)]
        assert kept == {i for i in range(n) if beaten[i] < k}


def test_shares_beyond_64_bits(spark):
    big = 4 * 10**15
    row = spark.createDataFrame([(big, 3 * big, 7)], "n long, total long, v long").select(divergence.share("n", "total", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 5) // (3 * big + 35)


def test_empty_table(spark):
    assert divergence.audit_sources(spark.createDataFrame([], SCHEMA)).collect() == []
