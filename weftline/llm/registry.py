"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from weftline.llm import conversation_repair, count_trees, exact_dedup, filter_audit, fingerprints, html_extract, language_id, line_dedup, near_dedup, packing, piece_sampling, pii, substring_dedup


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_minhash_near_dedup": near_dedup.op3_minhash_near_dedup,
        "op4_language_id": language_id.op4_language_id,
        "op5_sentencepiece_sampling": piece_sampling.op5_sentencepiece_sampling,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_document_fingerprints": fingerprints.op7_document_fingerprints,
        "op8_pii": pii.op8_pii,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_html_extraction": html_extract.op10_html_extraction,
        "op11_ngram_jaccard_join": count_trees.op11_ngram_jaccard_join,
        "op12_conversation_structure_repair": conversation_repair.op12_conversation_structure_repair,
        "op13_filter_interaction_audit": filter_audit.op13_filter_interaction_audit,
    }


def oracle_sql() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.SQL,
        "op2_line_dedup": line_dedup.SQL,
        "op11_ngram_jaccard_join": count_trees.SQL,
        "op12_conversation_structure_repair": conversation_repair.SQL,
        "op13_filter_interaction_audit": filter_audit.SQL,
    }
