"""Queries of the corpus operators and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from chainspark.llm import (
    conversation_repair,
    decontaminate,
    exact_dedup,
    jaccard_join,
    license_scan,
    line_dedup,
    lm_score,
    quality,
    secret_scan,
    sentencepiece_codec,
    spelling,
    suffix_dedup,
    token_counts,
)

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_sentencepiece": sentencepiece_codec.op4_sentencepiece,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

ORACLE_SQL = {
    "op5_line_dedup": line_dedup.SQL,
    "op6_jaccard_join": jaccard_join.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
