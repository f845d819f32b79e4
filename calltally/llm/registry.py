"""The queries of this subpackage and their SQL."""

from . import alignment, fingerprints, jaccard_join, language_id, line_dedup, merkle, packing, pii, quality, sentencepiece_sampling, sharding, substring_dedup, url_filters

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_sentencepiece_sampling": sentencepiece_sampling.op2_sentencepiece_sampling,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_packing": packing.op4_packing,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_pii": pii.op6_pii,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_ngram_jaccard_join": jaccard_join.op9_ngram_jaccard_join,
    "op10_sharding": sharding.op10_sharding,
    "op11_language_id": language_id.op11_language_id,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_token_alignment": alignment.op13_token_alignment,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op8_url_filters": url_filters.ORACLE,
    "op9_ngram_jaccard_join": jaccard_join.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
}
