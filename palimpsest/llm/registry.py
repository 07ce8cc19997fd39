"""The registered queries of the training-data operators, one for each, and their DuckDB forms where SQL has one."""

from __future__ import annotations

from palimpsest.llm import byte_bpe, chat, chosen_path, decontaminate, exact_dedup, fixity, language_id, negatives, pii, quality, suffix_dedup, toxicity, whitening

_MODULES = (toxicity, quality, language_id, pii, decontaminate, suffix_dedup, fixity, chosen_path, exact_dedup, byte_bpe, chat, whitening, negatives)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
