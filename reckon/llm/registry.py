"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from . import ann, bpe, exact_search, hard_negatives, language, line_dedup, mixing, near_duplicates, quality, token_files, toxicity, vector_codes, vector_duplicates

MODULES = (quality, near_duplicates, token_files, bpe, ann, mixing, exact_search, toxicity, line_dedup, language, hard_negatives, vector_codes, vector_duplicates)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
