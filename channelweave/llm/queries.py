"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from channelweave.llm import chat, decontaminate, embeddings, langid, mixing, pii, quality, ranking, repair, sharding, simhash, substring, warc

QUERIES = {
    "op1_pii_surrogates": pii.op1_pii_surrogates,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_language_id": langid.op3_language_id,
    "op4_chat_format": chat.op4_chat_format,
    "op5_embedding_dedup": embeddings.op5_embedding_dedup,
    "op6_simhash_dedup": simhash.op6_simhash_dedup,
    "op7_substring_dedup": substring.op7_substring_dedup,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_warc_transactions": warc.op9_warc_transactions,
    "op10_extendible_sharding": sharding.op10_extendible_sharding,
    "op11_ranked_search": ranking.op11_ranked_search,
    "op12_quality_rules": quality.op12_quality_rules,
    "op13_repair_conversations": repair.op13_repair_conversations,
}
ORACLE_SQL = {
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op4_chat_format": chat.OP4_SQL,
    "op7_substring_dedup": substring.OP7_SQL,
    "op9_warc_transactions": warc.OP9_SQL,
    "op10_extendible_sharding": sharding.OP10_SQL,
    "op11_ranked_search": ranking.OP11_SQL,
    "op12_quality_rules": quality.OP12_SQL,
    "op13_repair_conversations": repair.OP13_SQL,
}
