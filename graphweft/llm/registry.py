"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from graphweft.llm import bpe, decontaminate, language_id, line_dedup, near_dedup, quality_model, quality_rules, suffix_dedup, token_store, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_quality_model": quality_model.op4_quality_model,
    "op5_token_store": token_store.op5_token_store,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_bpe": bpe.op7_bpe,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_warc_audit": warc.op9_warc_audit,
    "op10_language_id": language_id.op10_language_id,
}

ORACLES = {"op1_line_dedup": line_dedup.ORACLE, "op2_near_dedup": near_dedup.ORACLE, "op3_quality_rules": quality_rules.ORACLE, "op6_decontaminate": decontaminate.ORACLE, "op9_warc_audit": warc.ORACLE}
