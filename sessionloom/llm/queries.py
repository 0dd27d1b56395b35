"""The registered queries of this subpackage, and SQL where SQL can express one."""

from __future__ import annotations

from . import decontaminate, filter_audit, lm_scoring, near_dedup, packing, pii, prefix_trie, quality, substrings, token_counts, token_files, topk, toxicity

QUERIES = {
    "op1_pii": pii.query,
    "op2_quality": quality.query,
    "op3_decontaminate": decontaminate.query,
    "op4_near_dedup": near_dedup.query,
    "op5_lm_scoring": lm_scoring.query,
    "op6_toxicity": toxicity.query,
    "op7_topk": topk.query,
    "op8_token_files": token_files.query,
    "op9_token_counts": token_counts.query,
    "op10_packing": packing.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_suffix_dedup": substrings.query,
    "op13_filter_audit": filter_audit.query,
}

ORACLE_SQL: dict[str, str] = {
    "op4_near_dedup": near_dedup.SQL,
    "op7_topk": topk.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_suffix_dedup": substrings.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
