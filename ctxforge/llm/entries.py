"""Queries of this subpackage and the SQL that states some of them."""

from . import filter_audit, fingerprints, hard_negatives, mixing, near_dedup, packing, piece_encoding, pitman_yor, quality_ranker, quality_rules, secrets, substring_dedup, url_reputation

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_quality_ranker": quality_ranker.op2_quality_ranker,
    "op3_mixing": mixing.op3_mixing,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_packing": packing.op6_packing,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_url_reputation": url_reputation.op8_url_reputation,
    "op9_pitman_yor": pitman_yor.op9_pitman_yor,
    "op10_secrets": secrets.op10_secrets,
    "op11_piece_encoding": piece_encoding.op11_piece_encoding,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLES = {"op5_quality_rules": quality_rules.ORACLE, "op8_url_reputation": url_reputation.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
