"""Operators that SQL cannot express, against brute force on small tables."""
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from qpanel.llm import elias_fano, fingerprints, jaccard_join, language_id, language_model, packing, pii, quality
from qpanel.llm.common import documents, table
from tests_llm_helpers import components_of, shingles, words


def texts(spark, small):
    return {r.doc_id: r.text or "" for r in documents(spark, small).collect()}


def test_language_of_held_out_documents(spark, small):
    rows = language_id.op1_language_id(spark, "/root/testdata/sf0.01").join(
        documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)


def test_a_rare_language_is_learned_and_repeated_ids_stay_bounded(spark):
    rows = [(i, f"the quick dogs and cats number {i} went over the hill to the town", "en") for i in range(4000)]
    rows += [(10**6 + i, f"žluťoučký kůň číslo {i} pěl ďábelské ódy u řeky", "cs") for i in range(8)]
    rows += [(7, "the same row comes again and again", "en")] * 3000
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=200)
    assert model.langs == ["cs", "en"]
    new = spark.createDataFrame([(1, "kůň pěl ódy"), (2, "over the town and the hill")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(new, model, language_id.bucket_of("doc_id", 4) == 2).collect()}
    assert got == {1: "cs", 2: "en"}


def test_quality_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = quality.op10_quality(spark, d).join(table(spark, d, "labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    for label in (0, 1):
        mine = [r for r in held if r.quality == label]
        assert sum(r.predicted == label for r in mine) / len(mine) > 0.75
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    xs = [np.unique(np.append(rng.integers(10, 200, 12), y)) for y in (0, 1) * 40]
    y = np.array([-1, 1] * 40)
    w = quality.descend(xs, y, np.ones(200), cost=1.0, epochs=30)
    assert all(np.sign(w[x].sum()) == s for x, s in zip(xs, y, strict=True))


@pytest.mark.parametrize(("n", "top"), [(1, 1), (5, 10), (1000, 1 << 62), (5000, 6000), (40_000, 50), (3, (1 << 63) - 1)])
def test_elias_fano_round_trip(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    ef = elias_fano.EliasFano(elias_fano.EliasFano.encode(values, "x"), "x")
    assert (ef.get(np.arange(n)) == values).all()
    wanted = np.concatenate([values, rng.integers(0, top + top // 7 + 2, 500, dtype=np.uint64)])
    at = np.searchsorted(values, wanted)
    right = np.where((at < n) & (values[np.minimum(at, n - 1)] == wanted), at, -1)
    assert (ef.find(wanted) == right).all()


@pytest.mark.parametrize(("n", "top"), [(2, 5), (1000, 1 << 62), (5000, 6000), (4000, 1 << 20)])
def test_elias_fano_from_a_known_place(n, top):
    """The value after a position, and a search that goes on from the one
    before its range, near (within 64 bits) or far."""
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
    values[len(values) // 2:] += np.uint64(top // 2)         # a gap
    ef = elias_fano.EliasFano(elias_fano.EliasFano.encode(values, "x"), "x")
    i = np.arange(len(values) - 1)
    one, two = ef.get_two(i)
    assert (one == values[:-1]).all() and (two == values[1:]).all()
    start = np.concatenate([[0] * 200, rng.integers(1, len(values), 600)])
    end = np.minimum(start + rng.integers(1, 300, 800), len(values))
    bit = np.zeros(800, np.int64)
    bit[200:] = ef.place(start[200:] - 1) + 1
    for x in (values[rng.integers(start, end)], values[start] + rng.integers(0, top, 800, dtype=np.uint64), values[end - 1]):
        at = np.searchsorted(values, x)
        right = np.where((at < end) & (values[np.minimum(at, len(values) - 1)] == x), at, -1)
        assert (ef.find(x, start, end, bit) == right).all()
        assert (ef.find(x, start, end) == right).all()


@pytest.mark.parametrize("shard", [1 << 22, 3000])
def test_language_model(spark, small, shard, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_TOKENS", shard)  # small shards: hot contexts are split
    got = {r.doc_id: r for r in language_model.op2_language_model(spark, small).collect()}
    tokens = {i: ["<s>", *words(t), "</s>"] for i, t in texts(spark, small).items()}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    c1 = Counter(w for i in train for w in tokens[i][1:])
    total, distinct = sum(c1.values()), len(c1)
    k2 = c2 = Counter((a, b) for i in train for a, b in zip(tokens[i], tokens[i][1:], strict=False))
    k3 = c3 = Counter(((a, b), c) for i in train for a, b, c in zip(tokens[i], tokens[i][1:], tokens[i][2:], strict=False))

    def mass(counts, kept):
        seen, given = Counter(), Counter()
        for (a, _), v in counts.items():
            seen[a] += v
        for (a, _), v in kept.items():
            given[a] += v - language_model.DISCOUNT
        return seen, given

    (s2, g2), (s3, g3) = mass(c2, k2), mass(c3, k3)
    for i, t in tokens.items():
        base = full = 0.0
        for j in range(1, len(t)):
            p = (c1[t[j]] + 0.1) / (total + 0.1 * (distinct + 1))
            base += math.log10(p)
            for seen, given, kept, context in ((s2, g2, k2, t[j - 1]), (s3, g3, k3, tuple(t[j - 2:j]) if j > 1 else None)):
                if context in given:
                    p = max(0, kept.get((context, t[j]), 0) - language_model.DISCOUNT) / seen[context] + (1 - given[context] / seen[context]) * p
            full += math.log10(p)
        r = got[i]
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(t) - 1, total, sum(c1[w] > 0 for w in t[1:]))
        assert r.base_score == pytest.approx(base, rel=1e-9)
        # bytes hold a probability to half a step of 9 / 255 in log10
        assert abs(r.score - full) / (len(t) - 1) < 0.02


def test_packing(spark, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["one <|endoftext|> two", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext|", " <|ENDOFTEXT|> <|endoftext|>\n"]
    odd = {10**9 + k: t for k, t in enumerate(odd)}     # added tokens are matched in texts
    ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in (texts(spark, small) | odd).items()}
    more = spark.createDataFrame(list(odd.items()), "doc_id long, text string")
    docs = documents(spark, small).select("doc_id", "text").unionByName(more).repartition(3, "doc_id")
    pieces = packing.pack_documents(docs).toPandas()
    for i, mine in pieces.sort_values("start").groupby("doc_id"):
        assert (mine.doc_tokens == len(ids[i])).all() and mine.length.sum() == len(ids[i])
        for p in mine.itertuples():
            assert zlib.crc32(ids[i][p.start:p.start + p.length].tobytes()) == p.ids_crc32
    assert set(pieces.doc_id) == set(ids)
    for _, mine in pieces.sort_values("offset").groupby("sequence_id"):
        used = int(mine.length.sum())
        assert (mine.offset.values == np.append(0, mine.length.cumsum().values[:-1])).all()
        assert used <= 1024 and used & (used - 1) == 0 and len(mine) <= packing.SEGMENTS  # no padding at all


def test_packing_of_examples_keeps_them_whole_and_within_limits(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(t), int(t * s)) for i, (t, s) in enumerate(zip(rng.integers(1, 700, 400), rng.random(400), strict=True))]
    rows += [(400, 5000, 10), (401, None, None), (402, 100, 600)]
    got = packing.pack_examples(spark.createDataFrame(rows, "example_id long, tokens long, loss_tokens long").repartition(2, "example_id"), (1024, 8, 512)).toPandas()
    assert sorted(got.example_id) == list(range(403)) and set(got[got.oversize].example_id) == {400} | {
        i for i, _, loss in rows if (loss or 0) > 512}
    fine = got[~got.oversize].groupby("sequence_id").agg(t=("tokens", "sum"), n=("tokens", "size"), s=("loss_tokens", "sum"))
    assert fine.t.max() <= 1024 and fine.n.max() <= 8 and fine.s.max() <= 512
    assert len(fine) <= 1.25 * max(got[~got.oversize].tokens.sum() / 1024, got[~got.oversize].loss_tokens.sum() / 512, 400 / 8) + 2


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "phone" and not 9 <= len(digits) <= 15 \
                    or kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


ODD = ["a@b@c.de.fg, x..y@z-.q", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4", "4111 1111-1111 1111 4111  1111", "+1 ( - ) 555 123 4567 +12-3456789\n0 ++49.30.123456",
       "é+1 555 010 0000 4242424242424242é", "12-34-56 78 90 12 34 56", "@ @@ a@ @b.c", "+1 555\t010 0000 9", "1" * 5000, "5" * 30 + "." + "1" * 40 + ".1.1.1"]


def test_pii_patterns(spark, small):
    rows = list(enumerate([*ODD, *texts(spark, small).values()]))
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.base] == base_spans(rows[r.doc_id][1]), rows[r.doc_id][1][:80]


def test_pii_digest(spark, small):
    for r in pii.op5_pii(spark, small).collect():
        base = base_spans(texts(spark, small)[r.doc_id]) if r.doc_id < 40 else None
        if base is not None:
            assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(filter(None, r.spans.split(",")))
            assert r.n_email == sum(s.startswith("email") for s in base)


def test_pii_field_adds_what_patterns_miss(spark):
    said = ["contact jane [at] mills [dot] org today", "phone (212) 555-0188 today", "in 1998 there were 12,500 rows on page 12"]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).collect()}
    assert [(s.kind, said[0][s.start:s.end]) for s in found[0].added] == [("email", "jane [at] mills [dot] org")]
    assert [(s.kind, said[1][s.start:s.end]) for s in found[1].added] == [("phone", "(212) 555-0188")]
    assert found[2].added == [] and not any(r.base for r in found.values())


def test_viterbi_is_the_best_path():
    field = pii.fit(pii.training_runs(pii.labelled_table()[::8]))
    rng = np.random.default_rng(2)
    e = rng.normal(0, 2, (20, 3, len(pii.LABELS)))
    for path, x in zip(field.viterbi(e), e, strict=True):
        score = lambda a, b, c: field.start[a] + field.move[a, b] + field.move[b, c] + x[0, a] + x[1, b] + x[2, c]  # noqa: B023, E731
        k = range(len(pii.LABELS))
        assert score(*path) == pytest.approx(max(score(a, b, c) for a in k for b in k for c in k))


def test_jaccard_components(spark, small):
    rng = np.random.default_rng(4)
    rows = dict(texts(spark, small))
    vocabulary = [f"v{i}" for i in range(60)]
    for g in range(12):  # groups of near copies around the threshold, in chains and stars, with a common passage
        stem = list(rng.choice(vocabulary, 40)) + [f"common{i}" for i in range(12)]
        for _ in range(12):
            rows[1000 + len(rows)] = " ".join(stem)
            for k in rng.integers(0, len(stem), rng.integers(0, 3)):
                stem[k] = str(rng.choice(vocabulary)) if g % 2 else stem[k] + "x"
    sets = {i: shingles(t) for i, t in rows.items()}
    want = components_of(sets)
    got = jaccard_join.jaccard_components(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4, "doc_id")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert len(set(want.values())) < len(rows)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(9)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 400), dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.random()], rng.integers(0, 1 << 62, rng.integers(1, 100), dtype=np.uint64)]))
        d = len(np.setxor1d(x, y))
        assert jaccard_join.sketch_distance(jaccard_join.sketch(x), jaccard_join.sketch(y)) <= d


def test_buckets_do_not_change_the_next_document(spark, small, monkeypatch):
    docs = documents(spark, small)
    one = sorted(map(tuple, fingerprints.with_next(docs).drop("bucket", "k").collect()))
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(fingerprints, "COARSE", 5)
    assert sorted(map(tuple, fingerprints.with_next(docs).drop("bucket", "k").collect())) == one
