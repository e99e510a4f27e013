"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from vocalith.llm import decontamination, hard_negatives, lexical_search, line_dedup, minhash, mixing, pii, quality_knn, quality_rules, sharding, simhash, token_files, toxicity

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_sharding": sharding.query,
    "op3_quality_classifier": quality_knn.query,
    "op4_mixing": mixing.query,
    "op5_decontamination": decontamination.query,
    "op6_simhash": simhash.query,
    "op7_token_files": token_files.query,
    "op8_line_dedup": line_dedup.query,
    "op9_pii": pii.query,
    "op10_quality_rules": quality_rules.query,
    "op11_lexical_search": lexical_search.query,
    "op12_minhash": minhash.query,
    "op13_hard_negatives": hard_negatives.query,
}
ORACLES = {
    "op5_decontamination": decontamination.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op12_minhash": minhash.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
