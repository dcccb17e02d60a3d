"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from lanespan.llm import chat_format, decontam, exact_dedup, hard_negatives, license_scan, lm_score, mixing, ngram_join, simhash, substring_dedup, token_alignment, token_counts, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_chat_format": chat_format.query,
    "op3_mixing": mixing.query,
    "op4_ngram_join": ngram_join.query,
    "op5_toxicity": toxicity.query,
    "op6_token_counts": token_counts.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_license_scan": license_scan.query,
    "op9_lm_score": lm_score.query,
    "op10_decontam": decontam.query,
    "op11_token_alignment": token_alignment.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_simhash": simhash.query,
}

ORACLE_SQL = {
    "op2_chat_format": chat_format.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op10_decontam": decontam.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
