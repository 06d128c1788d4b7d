"""The queries and SQL of this subpackage, by the names under which they are registered."""

from __future__ import annotations

from . import op1_packing, op2_chat, op3_mixing, op4_toxicity, op5_neardup, op6_urls, op7_quality, op8_secrets, op9_embeddings, op10_pii, op11_trie, op12_negatives, op13_fingerprints

QUERIES = {
    "op1_packing": op1_packing.op1_packing,
    "op2_chat_formatting": op2_chat.op2_chat_formatting,
    "op3_mixing": op3_mixing.op3_mixing,
    "op4_toxicity": op4_toxicity.op4_toxicity,
    "op5_near_duplicates": op5_neardup.op5_near_duplicates,
    "op6_url_filters": op6_urls.op6_url_filters,
    "op7_quality_rules": op7_quality.op7_quality_rules,
    "op8_secret_scans": op8_secrets.op8_secret_scans,
    "op9_embedding_near_duplicates": op9_embeddings.op9_embedding_near_duplicates,
    "op10_pii": op10_pii.op10_pii,
    "op11_conversation_trie": op11_trie.op11_conversation_trie,
    "op12_hard_negatives": op12_negatives.op12_hard_negatives,
    "op13_fingerprints": op13_fingerprints.op13_fingerprints,
}

SQL = {
    "op2_chat_formatting": op2_chat.SQL,
    "op6_url_filters": op6_urls.SQL,
    "op7_quality_rules": op7_quality.SQL,
    "op8_secret_scans": op8_secrets.SQL,
    "op9_embedding_near_duplicates": op9_embeddings.SQL,
    "op11_conversation_trie": op11_trie.SQL,
    "op12_hard_negatives": op12_negatives.SQL,
}
