"""Registered queries of the text operators and their DuckDB SQL."""

from __future__ import annotations

from chainlens.llm import (bpe, filter_audit, fingerprints, html_extract, lang_id, licenses, line_dedup, mixing, near_dedup,
                           qda, quality, resampling, token_store)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_outliers": quality.op2_quality_outliers,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_language_id": lang_id.op4_language_id,
    "op5_soft_mixing": mixing.op5_soft_mixing,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_token_store": token_store.op8_token_store,
    "op9_bpe": bpe.op9_bpe,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_target_resampling": resampling.op12_target_resampling,
    "op13_quality_qda": qda.op13_quality_qda,
}

# The others can't be put in SQL; they are tested against brute force.
ORACLE = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op3_near_dedup": near_dedup.ORACLE,
    "op6_license_scan": licenses.oracle(),
    "op11_filter_audit": filter_audit.ORACLE,
}
