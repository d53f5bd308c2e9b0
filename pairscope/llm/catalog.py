"""The queries of the operators in this folder, and the SQL that states their results."""

from __future__ import annotations

from pairscope.llm import byte_bpe, decontaminate, exact_dedup, fill_middle, hard_negatives, language_id, licenses, pseudonyms, quality, simhash, substring_dedup, suffix_dedup, token_files


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            decontaminate.op1_decontamination,
            licenses.op2_license_scan,
            exact_dedup.op3_exact_dedup,
            simhash.op4_simhash_near_dedup,
            quality.op5_quality_classifier,
            token_files.op6_token_files,
            substring_dedup.op7_substring_dedup,
            pseudonyms.op8_pii_pseudonyms,
            suffix_dedup.op9_suffix_dedup,
            byte_bpe.op10_byte_bpe,
            language_id.op11_language_id,
            hard_negatives.op12_hard_negatives,
            fill_middle.op13_fill_middle,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": licenses.OP2_SQL,
        "op3_exact_dedup": exact_dedup.OP3_SQL,
        "op7_substring_dedup": substring_dedup.OP7_SQL,
        "op12_hard_negatives": hard_negatives.OP12_SQL,
        "op13_fill_middle": fill_middle.OP13_SQL,
    }
