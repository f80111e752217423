"""Registry of the training-data queries and their DuckDB oracles."""
from __future__ import annotations

from qpanel.llm import (
    divergence, exact_dedup, fingerprints, hard_negatives, jaccard_join, language_id, language_model, licenses, mixing, packing, pii, quality, url_filter)

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_language_model": language_model.op2_language_model,
    "op3_packing": packing.op3_packing,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_pii": pii.op5_pii,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_poisson_mix": mixing.op8_poisson_mix,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_quality": quality.op10_quality,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_url_filter": url_filter.op12_url_filter,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op6_license_scan": licenses.ORACLE,
    "op8_poisson_mix": mixing.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_url_filter": url_filter.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
