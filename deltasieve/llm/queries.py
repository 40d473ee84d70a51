"""Queries over the driver's tables, one for each operator."""

from __future__ import annotations

from . import alignment, bpe, chat, embedding_dedup, exact_dedup, langid, lm_scoring, mixing, quality, simhash, substring_dedup, suffix_dedup, trie

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_chat_preferences": chat.op7_chat_preferences,
    "op8_simhash": simhash.op8_simhash,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_quality": quality.op10_quality,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_suffix_array": suffix_dedup.op13_suffix_array,
}
ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op7_chat_preferences": chat.OP7_SQL,
    "op9_embedding_dedup": embedding_dedup.OP9_SQL,
    "op12_prefix_trie": trie.OP12_SQL,
    "op13_suffix_array": suffix_dedup.OP13_SQL,
}
