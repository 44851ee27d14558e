"""The queries of this subpackage and the SQL that gives their rows, where SQL can."""

from entivore.llm import exact_dedup, importance, licenses, line_dedup, mixing, ngram_join, packing, pii, quality_rank, quality_rules, spelling, token_count, warc

QUERIES = {
    "op1_source_mix": mixing.op1_source_mix,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_warc": warc.op3_warc,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_quality_rank": quality_rank.op6_quality_rank,
    "op7_token_counts": token_count.op7_token_counts,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_pii": pii.op9_pii,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_license_scan": licenses.op11_license_scan,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_importance": importance.op13_importance,
}
ORACLES = {
    "op1_source_mix": mixing.ORACLE,
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_warc": warc.ORACLE,
    "op11_license_scan": licenses.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_importance": importance.ORACLE,
}
