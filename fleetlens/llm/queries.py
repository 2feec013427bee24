"""The registered queries of the operators and their check SQL."""

from __future__ import annotations

from fleetlens.llm import (
    bpe_lexicon, chat, decontaminate, hard_negatives, language, licenses, mixing, pii, pitman_yor, quality, resampling, simhash, token_counts,
)

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_lm_score": pitman_yor.op3_lm_score,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_personal_data": pii.op5_personal_data,
    "op6_language_id": language.op6_language_id,
    "op7_simhash": simhash.op7_simhash,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_chat_format": chat.op10_chat_format,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_resample": resampling.op12_resample,
    "op13_bpe": bpe_lexicon.op13_bpe,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE_SQL,
    "op10_chat_format": chat.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op12_resample": resampling.ORACLE_SQL,
}
