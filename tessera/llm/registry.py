"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from tessera.llm import align, bpe, chat, decontam, knn, langid, lines, pii, sharding, simhash, substrings, toxicity, whitening

QUERIES = {
    "op1_suffix_dedup": substrings.op1,
    "op2_knn": knn.op2,
    "op3_language_id": langid.op3,
    "op4_byte_bpe": bpe.op4,
    "op5_line_dedup": lines.op5,
    "op6_simhash": simhash.op6,
    "op7_decontaminate": decontam.op7,
    "op8_pii": pii.op8,
    "op9_chat_format": chat.op9,
    "op10_toxicity": toxicity.op10,
    "op11_sharding": sharding.op11,
    "op12_token_alignment": align.op12,
    "op13_whitening": whitening.op13,
}
ORACLE = {
    "op5_line_dedup": lines.SQL,
    "op9_chat_format": chat.SQL,
    "op11_sharding": sharding.SQL,
}
