"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pathlight.llm import bpe, chat, katz, licenses, media, mixing, ngram_join, pii, quality, toxicity

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_media": media.op2_media,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_bpe": bpe.op5_bpe,
    "op6_pii": pii.op6_pii,
    "op7_katz": katz.op7_katz,
    "op8_quality": quality.op8_quality,
    "op9_chat": chat.op9_chat,
    "op10_mixing": mixing.op10_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op8_quality": quality.ORACLE_SQL,
    "op9_chat": chat.ORACLE_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
}
