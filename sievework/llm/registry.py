"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, exact_dedup, filter_audit, hard_negatives, jaccard_join, language_id, licenses, maxent, mixing, quality, secrets_ledger, toxicity

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_maxent": maxent.op2_maxent,
    "op3_licenses": licenses.op3_licenses,
    "op4_bpe": bpe.op4_bpe,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_quality": quality.op7_quality,
    "op8_chat": chat.op8_chat,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mixing": mixing.op10_mixing,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_secret_ledger": secrets_ledger.op12_secret_ledger,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

SQL = {
    "op6_exact_dedup": exact_dedup.SQL,
    "op8_chat": chat.SQL,
    "op10_mixing": mixing.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_secret_ledger": secrets_ledger.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
