"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from graphloom.llm import chat_format, decontaminate, fingerprints, hard_negatives, histogram_packing, importance, katz, language_id, oracles, packing, secrets, simhash_dedup, substring_dedup, token_counts

QUERIES: dict[str, Callable] = {
    "op1_decontaminate": decontaminate.query,
    "op2_chat_format": chat_format.query,
    "op3_best_fit_packing": packing.query,
    "op4_document_fingerprints": fingerprints.query,
    "op5_language_id": language_id.query,
    "op6_katz_scores": katz.query,
    "op7_secret_scan": secrets.query,
    "op8_token_counts": token_counts.query,
    "op9_simhash_dedup": simhash_dedup.query,
    "op10_substring_dedup": substring_dedup.query,
    "op11_importance_resampling": importance.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_histogram_packing": histogram_packing.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": oracles.DECONTAMINATE,
    "op2_chat_format": oracles.CHAT,
    "op7_secret_scan": oracles.SECRETS,
    "op10_substring_dedup": oracles.SUBSTRINGS,
    "op12_hard_negatives": oracles.HARD_NEGATIVES,
}
