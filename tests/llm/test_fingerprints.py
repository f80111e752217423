"""Fingerprints recomputed in plain Python, with the reference hash functions."""
import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from qpanel.llm import fingerprints as fp
from qpanel.llm.common import documents

MASK = (1 << 64) - 1


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def xx(*values):
    """What xxhash64 gives for longs, ints (as (4, value)) and texts in a row."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[1].to_bytes(v[0], "little") if isinstance(v, tuple) else (v & MASK).to_bytes(8, "little")
        seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return seed


def digests(text):
    out = set()
    for line in text.split("\n"):
        words = [xx(w) for w in re.findall(r"\S+\s*", line.strip(" "), re.ASCII)]
        piece = []
        for i, h in enumerate(words):
            piece.append(h)
            if signed(h) % fp.EVERY == 0 or len(piece) == fp.LONGEST or i == len(words) - 1:
                top = xx(*piece) >> 24
                out.add(top << 24 | (xx(top) >> 9) & fp.CHECK)
                piece = []
    return out


def printed(items):
    cells = []
    for part in range(fp.PARTS):
        mine = [[0, 0] for _ in range(fp.SEGMENT)]
        for x in items:
            cell = mine[signed(xx(x >> 24, (4, part))) % fp.SEGMENT]
            cell[0] += 1
            cell[1] ^= x
        cells += [f"{n:X}.{x:x}" for n, x in mine]
    return ",".join(cells)


def plain(rows):
    """(doc_id, n_chars, sha, fingerprint, edited fingerprint, likenesses) of rows in order."""
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        tail = len(text) // 4
        edited = text[:len(text) - tail] + after[:tail]
        a, e, b = digests(text), digests(edited), digests(after)
        near = [1 - len(a ^ o) / (len(a) + len(o)) if a or o else 1.0 for o in (e, b)]
        yield i, len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(a), printed(e), *near


def same(got, rows):
    got = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i, n, sha, one, two, near_edited, near_next in plain(rows):
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, sha, one, two)
        assert r.near_edited == pytest.approx(near_edited, abs=1e-12) and r.near_next == pytest.approx(near_next, abs=1e-12)


def test_query_against_plain_python(spark, small):
    rows = sorted((r.doc_id, r.text or "") for r in documents(spark, small).collect())
    got = fp.op9_fingerprints(spark, small).collect()
    same(got, rows)
    assert all(r.tries >= 0 for r in got)          # no answer needed the digests themselves
    assert sum(r.near_edited > r.near_next + 0.3 for r in got) > 0.9 * len(got)


TEXTS = [(1, "one two three\n\tfour five  six seven"), (2, None), (3, ""), (4, " \n "), (5, "eins zwei drei vier " * 30), (6, "eins zwei drei vier " * 30 + "x"),
         (7, " ".join(f"w{i}" for i in range(9000))), (8, " ".join(f"w{i}" for i in range(9000) if i % 50)), (9, "x" * 100_000), (10, "é\u00a0ñ 日本 " * 7)]


@pytest.mark.parametrize("generations,retries,tries", [(6, 3, {0, 1}), (1, 1, {0, -1}), (3, 2, {0, 1, 2})])
def test_failures_are_retried_and_answers_stay_whole(spark, monkeypatch, generations, retries, tries):
    monkeypatch.setattr(fp, "GENERATIONS", generations)
    monkeypatch.setattr(fp, "RETRIES", retries)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    got = fp.fingerprints(docs.withColumns({c: F.lit("z") for c in ("bucket", "k", "info", "of", "cells", "part", "segment", "h", "digests")})).collect()
    same(got, [(i, t or "") for i, t in TEXTS])
    assert {r.tries for r in got} & tries


def test_peeling_gives_the_digests_of_either_version(spark):
    words = [f"w{i}" for i in range(3000)]
    pairs = [(0, " ".join(words), " ".join(words[300:])), (1, " ".join(words[:40]), " ".join(words[50:80])), (2, "a b", "a b"), (3, "", "q")]
    rows = spark.createDataFrame(pairs, "k int, text string, next_text string").select(
        F.col("k").cast("long").alias("bucket"), "k", F.col("k").alias("doc_id"), F.col("k").alias("next_id"), "text", "next_text",
        fp.digests(F.col("text")).alias("digests"), fp.digests(F.col("next_text")).alias("next_digests"))
    got = {(r.k, r.which): r for r in fp.recovered(fp.with_versions(rows)).collect()}
    for k, text, other in pairs:
        a, b = digests(text), digests(other)
        if a == b:
            assert (k, "next") not in got or not (got[k, "next"].only_text or got[k, "next"].only_other)
            continue
        r = got[k, "next"]
        assert r.whole and {x & MASK for x in r.only_text} == a - b and {x & MASK for x in r.only_other} == b - a
