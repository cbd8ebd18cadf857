"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontamination, exact_dedup, line_dedup, quality_classifier, quality_rules, secrets, simhash, substring_dedup, suffix_dedup, token_alignment, vector_codes, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_suffix_array_dedup": suffix_dedup.op2_suffix_array_dedup,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op3b_rule_ablations": quality_rules.op3b_rule_ablations,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_secret_scans": secrets.op7_secret_scans,
    "op8_benchmark_decontamination": decontamination.op8_benchmark_decontamination,
    "op9_bpe": bpe.op9_bpe,
    "op10_warc": warc.op10_warc,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
}

SQL = {
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op3b_rule_ablations": quality_rules.OP3B_SQL,
    "op8_benchmark_decontamination": decontamination.OP8_SQL,
    "op10_warc": warc.OP10_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_exact_dedup": exact_dedup.OP13_SQL,
}
