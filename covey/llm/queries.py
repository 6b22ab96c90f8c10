"""The queries of this subpackage and their SQL."""

from covey.llm import alignment, bpe, exact_dedup, language_id, line_dedup, mixing, ngram_join, quality_classifier, quality_rules, toxicity, url_filters, vector_codes, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_mixing": mixing.op3_mixing,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_language_id": language_id.op9_language_id,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_alignment": alignment.op11_alignment,
    "op12_warc": warc.op12_warc,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op4_ngram_join": ngram_join.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op7_url_filters": url_filters.OP7_SQL,
    "op12_warc": warc.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
