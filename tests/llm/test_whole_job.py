"""Cases in which an operator once did less than its whole job."""
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from qpanel.llm import fingerprints, jaccard_join, language_model
from qpanel.llm.common import documents
from tests_llm_helpers import words


def scored(spark, train, held):
    model = language_model.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(2))
    rows = spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")
    return {r.doc_id: r for r in language_model.score_texts(rows, model, F.lit(True)).collect()}


def test_a_text_that_nearly_repeats_one_training_text_scores_high(spark):
    train = [" ".join(f"w{(i * 37 + k * k * 11) % 400}" for k in range(80)) for i in range(30)]
    once = "a rare sentence stands in one single training text and in no other of them all"
    got = scored(spark, [*train, once], [once + " today", " ".join(reversed(once.split()))])
    assert got[0].score > got[0].base_score + 0.5 * got[0].n_tokens   # known bigrams and trigrams, each seen once
    assert got[0].score > got[1].score + 0.5 * got[0].n_tokens        # the same words in no known order


@pytest.mark.parametrize("shard", [1 << 22, 300])
def test_split_and_whole_contexts_share_one_formula(spark, small, shard, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_TOKENS", shard)
    tokens = {r.doc_id: ["<s>", *words(r.text or ""), "</s>"] for r in documents(spark, small).collect()}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10]
    c1 = Counter(w for t in train for w in t[1:])
    c2 = Counter(x for t in train for x in zip(t, t[1:], strict=False))
    c3 = Counter(((a, b), c) for t in train for a, b, c in zip(t, t[1:], t[2:], strict=False))
    levels = []
    for counts in (c2, c3):
        seen, types = Counter(), Counter()
        for (context, _), n in counts.items():
            seen[context] += n
            types[context] += 1
        levels.append((counts, seen, types))
    d, total = language_model.DISCOUNT, sum(c1.values())
    for r in language_model.op2_language_model(spark, small).collect():
        t, full = tokens[r.doc_id], 0.0
        for j in range(1, len(t)):
            p = (c1[t[j]] + 0.1) / (total + 0.1 * (len(c1) + 1))
            for (counts, seen, types), context in zip(levels, (t[j - 1], tuple(t[j - 2:j]) if j > 1 else None), strict=True):
                if context in seen:
                    p = max(0, counts[context, t[j]] - d) / seen[context] + d * types[context] / seen[context] * p
            full += math.log10(p)
        assert abs(r.score - full) / (len(t) - 1) < 0.02   # a byte holds a probability to half a step of 9 / 255


def test_pieces_meet_again_after_an_edit(spark):
    draw = random.Random(5)
    prose = [f"w{draw.randrange(997)}" for _ in range(6000)]
    pairs = []
    for n in (45, 50, 52, 54, 60, 200, 800, 6000):  # 200 characters and more, some around 256
        line = " ".join(prose[:n])
        pairs += [("front", f"Inserted {line}", line), ("end", f"{line} and some words more here", line)]
    spread = [w + "x" if k % 375 == 7 else w for k, w in enumerate(prose)]
    pairs.append(("spread", " ".join(spread), " ".join(prose)))   # one word in each sixteenth
    df = spark.createDataFrame(pairs, "what string, a string, b string").select(
        "what", F.length("b").alias("n"), fingerprints.paragraphs(F.col("a")).alias("a"), fingerprints.paragraphs(F.col("b")).alias("b"))
    for r in df.collect():
        a, b = set(r.a), set(r.b)
        assert 1 - len(a ^ b) / (len(a) + len(b)) >= 0.5, (r.what, r.n)
        assert len(b) >= r.n / 6 / fingerprints.LONGEST   # as many as the text needs


def test_one_row_of_each_component_with_null_and_repeated_ids(spark):
    def text(tag):
        return " ".join(f"{tag}{i}" for i in range(40))

    rows = [(None, text("a")), (None, text("a") + " more"),      # near copies, no id at all
            (None, text("b")),                                   # unique, no id
            (None, None), (None, ""), (4, "  "),                 # without words: all stay
            (7, text("c")), (7, text("c") + " more"), (7, text("c")),   # near copies and a repeated row under one id
            (7, text("d")),                                      # another text under that id
            (None, text("e")), (9, text("e") + " more")]         # the row with an id stays
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, F.coalesce("text", F.lit("")))
    kept = [(r.doc_id, (r.text or "").strip()) for r in jaccard_join.one_per_component(docs).collect()]
    letters = sorted((i is None, i or 0, t[:1]) for i, t in kept)
    assert letters == sorted([(True, 0, "a"), (True, 0, "b"), (True, 0, ""), (True, 0, ""), (False, 4, ""),
                              (False, 7, "c"), (False, 7, "d"), (False, 9, "e")])
