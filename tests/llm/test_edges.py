"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty
tables and extra columns with clashing names."""
import pytest

from qpanel.llm import (
    exact_dedup, fingerprints, jaccard_join, language_id, language_model, licenses, mixing, packing, pii, quality)
from qpanel.llm.common import bucket_of


def one(docs):
    held = bucket_of("doc_id", 4) == 2
    return language_id.predict(docs, language_id.train(docs.filter(~held)), held)


def two(docs):
    held = bucket_of("doc_id", 10) == 0
    return language_model.score_texts(docs, language_model.train(docs.filter(~held)), held)


def ten(docs):
    labels = docs.sparkSession.createDataFrame([(1, 1), (2, 0), (2, 1), (6, 0), (None, 1), (8, None)], "doc_id long, quality int")
    return quality.score(docs, quality.train(docs, labels), ["doc_id"])


OPERATORS = {
    "language_id": one, "language_model": two, "packing": packing.pack_documents, "exact_dedup": exact_dedup.exact_dedup,
    "pii": pii.find, "licenses": licenses.scan_licenses, "jaccard_join": jaccard_join.jaccard_components,
    "mixing": mixing.mix_sources, "fingerprints": fingerprints.fingerprints, "quality": ten,
}
ONE_ROW_EACH = set(OPERATORS) - {"packing", "mixing"}


def rows(df, keys=None):
    cols = keys or sorted(df.columns)
    return sorted(map(str, df.select(*cols).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_and_clashing_columns(edge, wide, name):
    plain = OPERATORS[name](edge).collect()
    if name in ONE_ROW_EACH:
        assert sorted(str(r["doc_id"]) for r in plain) == sorted(str(r["doc_id"]) for r in edge.collect())
    else:
        assert {r["doc_id"] for r in plain} <= {r["doc_id"] for r in edge.collect()}
    clash = OPERATORS[name](wide)
    assert rows(clash, plain[0].__fields__) == sorted(map(str, plain))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(nothing, name):
    assert OPERATORS[name](nothing).collect() == []


def test_defined_results(edge):
    dedup = {(r.doc_id, r.kept): r for r in exact_dedup.exact_dedup(edge).collect()}
    assert dedup[(2, True)].group_size == 3 and dedup[(1, False)].keep_id == 2 and (2, False) in dedup
    assert dedup[(6, True)].keep_id == 6 and dedup[(5, False)].keep_id == 6    # null counts as empty
    comp = {r.doc_id: r for r in jaccard_join.jaccard_components(edge).collect()}
    assert [comp[i].component_id for i in (1, 2, 3, 4)] == [1] * 4 and comp[5].n_shingles == 0 and comp[5].component_id == 5
    assert comp[12].component_id == 11 and comp[11].n_shingles == 1
    lang = {r.doc_id: r for r in one(edge).collect()}
    assert all(lang[i].lang_pred == "und" and lang[i].score == 0 for i in (5, 6, 7, 13))
    assert lang[10].lang_pred != "und"
    prints = {r.doc_id: r for r in fingerprints.fingerprints(edge).collect()}
    assert prints[1].fingerprint == prints[2].fingerprint != prints[3].fingerprint
    assert prints[11].near_next == 1.0 and prints[5].near_next == 1.0 and prints[5].n_chars == 0


def test_drop_copies_keeps_one_row_of_a_repeated_one(edge):
    kept = exact_dedup.drop_copies(edge)
    assert sorted(r.doc_id for r in kept.filter("text like 'The quick%bank%'").collect()) == [2, 3]
    assert kept.columns == edge.columns


def test_stages_keep_columns_whatever_their_names(edge, wide):
    for stage in (exact_dedup.drop_copies, jaccard_join.one_per_component):
        kept = stage(wide)
        assert kept.columns == wide.columns
        assert rows(kept, edge.columns) == rows(stage(edge), edge.columns)
