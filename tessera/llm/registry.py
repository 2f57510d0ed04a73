"""The corpus queries by name, and the SQL of those that SQL can express."""

from tessera.llm import decontaminate, licences, line_dedup, near_dedup, packing, quality_crf, quality_rules, secrets, substring_dedup, suffix_tree_lm

QUERIES = {"op1_secret_scan": secrets.op1_secret_scan, "op2_license_scan": licences.op2_license_scan, "op3_minhash_near_dedup": near_dedup.op3_minhash_near_dedup, "op4_quality_classifier": quality_crf.op4_quality_classifier, "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination, "op6_quality_rules": quality_rules.op6_quality_rules, "op7_substring_dedup": substring_dedup.op7_substring_dedup, "op8_lm_scoring": suffix_tree_lm.op8_lm_scoring, "op9_line_dedup": line_dedup.op9_line_dedup, "op10_packing": packing.op10_packing}
ORACLES = {"op2_license_scan": licences.oracle(), "op5_benchmark_decontamination": decontaminate.ORACLE, "op6_quality_rules": quality_rules.ORACLE, "op7_substring_dedup": substring_dedup.ORACLE, "op9_line_dedup": line_dedup.ORACLE}
