"""Registered queries of this subpackage and their SQL."""

from lumenclip.llm import bpe, collocations, jaccard, licenses, lines, media, packing, pages, quality, rules, shards, spellings, toxicity

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_byte_level_bpe": bpe.op4_byte_level_bpe,
    "op5_token_id_shards": shards.op5_token_id_shards,
    "op6_quality_rules": rules.op6_quality_rules,
    "op7_media_copies": media.op7_media_copies,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_ngram_jaccard_join": jaccard.op10_ngram_jaccard_join,
    "op11_spelling_groups": spellings.op11_spelling_groups,
    "op12_html_extraction": pages.op12_html_extraction,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES = {
    "op1_license_scan": licenses.OP1_SQL,
    "op2_line_dedup": lines.OP2_SQL,
    "op6_quality_rules": rules.OP6_SQL,
    "op11_spelling_groups": spellings.OP11_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
