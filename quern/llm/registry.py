"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from quern.llm import audit, chat, decontaminate, langid, mixing, packing, pii, quality, simhash, spelling, suffix, tokens, toxicity

QUERIES = {
    "op1_source_mixing": mixing.op1_source_mixing,
    "op2_pii": pii.op2_pii,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_suffix_dedup": suffix.op4_suffix_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_language_id": langid.op6_language_id,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_token_shards": tokens.op8_token_shards,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_chat_rotation": chat.op10_chat_rotation,
    "op11_slack_packing": packing.op11_slack_packing,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLES = {"op7_quality_rules": quality.ORACLE, "op10_chat_rotation": chat.ORACLE, "op12_filter_audit": audit.ORACLE}
