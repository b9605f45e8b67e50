"""Registered queries of the training-data operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from geoping.llm import decontaminate, jaccard_join, language_id, license_scan, line_dedup, mixing, periodic_runs, quality_grade, quality_rules, sentence_spans, suffix_dedup, tokenizer_alignment, toxicity

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op7_quality_classifier": quality_grade.op7_quality_classifier,
    "op5_toxicity": toxicity.op5_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op4_language_id": language_id.op4_language_id,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op10_sentence_spans": sentence_spans.op10_sentence_spans,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op11_tokenizer_alignment": tokenizer_alignment.op11_tokenizer_alignment,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}

ORACLE = {
    "op8_mixing": mixing.ORACLE_SQL,
    "op9_jaccard_join": jaccard_join.ORACLE_SQL,
    "op6_decontamination": decontaminate.ORACLE_SQL,
    "op13_line_dedup": line_dedup.ORACLE_SQL,
}
