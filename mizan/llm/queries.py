"""The registered queries of this package."""

from __future__ import annotations

from mizan.llm import byte_network, decontamination, erasure, filter_audit, fingerprints, language_id, line_dedup, near_dedup, packing, substring_dedup, surrogates, token_output, warc


def queries() -> dict:
    return {
        "op1_pii_surrogates": surrogates.op1_pii_surrogates,
        "op2_warc_zstd": warc.op2_warc_zstd,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_document_fingerprints": fingerprints.op4_document_fingerprints,
        "op5_token_output": token_output.op5_token_output,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op6_benchmark_decontamination": decontamination.op6_benchmark_decontamination,
        "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup,
        "op8_language_id": language_id.op8_language_id,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_quality_classifier": byte_network.op12_quality_classifier,
        "op13_cascading_erasure": erasure.op13_cascading_erasure,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_zstd": warc.ORACLE,
        "op3_substring_dedup": substring_dedup.ORACLE,
        "op7_minhash_near_dedup": near_dedup.ORACLE,
        "op10_line_dedup": line_dedup.ORACLE,
        "op11_filter_audit": filter_audit.ORACLE,
    }
