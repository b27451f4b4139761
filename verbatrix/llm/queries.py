"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import jaccard_join, language_id, license_scan, mixing, negative_mining, packing, quality_crf, quality_rules, substring_dedup, turn_repair, url_filter, vector_search, wrapper_extraction

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_mixing": mixing.op3_mixing,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_quality_classifier": quality_crf.op5_quality_classifier,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_language_id": language_id.op7_language_id,
    "op8_vector_search": vector_search.op8_vector_search,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op10_jaccard_links": jaccard_join.op10_jaccard_links,
    "op11_wrapper_extraction": wrapper_extraction.op11_wrapper_extraction,
    "op12_turn_repair": turn_repair.op12_turn_repair,
    "op13_negative_mining": negative_mining.op13_negative_mining,
}

SQL: dict[str, str] = {
    "op4_license_scan": license_scan.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op8_vector_search": vector_search.SQL,
    "op10_jaccard_join": jaccard_join.SQL,
    "op12_turn_repair": turn_repair.SQL,
    "op13_negative_mining": negative_mining.SQL,
}
