"""The pipeline's stages against brute force."""
from collections import Counter

import corpus_pipeline
from qpanel.llm import jaccard_join, quality
from qpanel.llm.common import documents, table, written
from tests_llm_helpers import components_of, shingles


def test_stages(spark):
    d = "/root/testdata/sf0.01"
    docs = documents(spark, d)
    seen = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, d), "test-stage")
        seen.append(docs.toPandas())
    raw, good, exact, near, mixed, packed = seen
    assert all(list(x.columns) == list(raw.columns) for x in seen[1:5])
    # 1: what the classifier predicts 1
    scored = quality.score(documents(spark, d), quality.learned(documents(spark, d), table(spark, d, "labels")), ["doc_id"]).toPandas()
    assert set(good.doc_id) == set(scored[scored.predicted == 1].doc_id)
    # 2: the largest id of each text
    assert sorted(exact.doc_id) == sorted(good.groupby("text").doc_id.max())
    # 3: the least id of each component
    roots = components_of({r.doc_id: shingles(r.text) for r in exact.itertuples()})
    assert set(near.doc_id) == {i for i, root in roots.items() if root == i}
    # 4: rows of the third, about as many, with the hot and the rare sources nearer to each other
    assert set(mixed.doc_id) <= set(near.doc_id) and abs(len(mixed) - len(near)) < 5 * len(near) ** 0.5
    # 5: every copy's ids once
    copies = Counter(mixed.doc_id)
    for i, mine in packed.groupby("doc_id"):
        assert mine.length.sum() == copies[i] * mine.doc_tokens.iloc[0]
    assert set(packed.doc_id) == set(mixed.doc_id)
    assert jaccard_join.SHINGLE == 5


def test_registered(spark):
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
