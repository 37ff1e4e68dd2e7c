"""Queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from acct_health.llm import (
    conversation_repair,
    html_extract,
    jaccard_join,
    language_id,
    packing,
    prefix_trie,
    quality_rules,
    sentencepiece_codec,
    simhash_dedup,
    substring_dedup,
    topk,
    toxicity,
    url_filter,
)

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_norm_sorted_topk": topk.op2_norm_sorted_topk,
    "op3_sentencepiece_codec": sentencepiece_codec.op3_sentencepiece_codec,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_language_id": language_id.op5_language_id,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_simhash_dedup": simhash_dedup.op12_simhash_dedup,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

SQL = {
    "op1_url_filter": url_filter.ORACLE_SQL,
    "op2_norm_sorted_topk": topk.ORACLE_SQL,
    "op4_quality_rules": quality_rules.ORACLE_SQL,
    "op9_jaccard_join": jaccard_join.ORACLE_SQL,
    "op10_substring_dedup": substring_dedup.ORACLE_SQL,
    "op11_conversation_repair": conversation_repair.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
