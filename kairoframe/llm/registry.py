"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import conversation_trie, decontaminate, html_extract, language_id, license_scan, line_dedup, lm_score, near_dup, periodic_runs, quality, sentencepiece_codec, token_counts, toxicity

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_license_scans": license_scan.op3_license_scans,
    "op4_sentencepiece_codec": sentencepiece_codec.op4_sentencepiece_codec,
    "op5_html_extraction": html_extract.op5_html_extraction,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_lm_scoring": lm_score.op7_lm_scoring,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_near_dedup": near_dup.op9_near_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_conversation_prefix_trie": conversation_trie.op12_conversation_prefix_trie,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
SQL = {
    "op2_benchmark_decontamination": decontaminate.OP2_SQL,
    "op3_license_scans": license_scan.OP3_SQL,
    "op9_near_dedup": near_dup.OP9_SQL,
    "op11_line_dedup": line_dedup.OP11_SQL,
    "op12_conversation_prefix_trie": conversation_trie.OP12_SQL,
    "op13_periodic_runs": periodic_runs.OP13_SQL,
}
