"""Masking of secrets and summary-row tests as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Parts of field names whose values are masked.
SECRET_NAMES = ("password", "secret", "token", "apikey", "api_key", "authorization", "credential")
#: Words that mark a summary row.
SUMMARY_WORDS = ("total", "grand total", "summary", "footer", "合计", "总计", "小计")


def holds_summary_word(cells: Column) -> Column:
    return F.exists(cells, lambda c: F.coalesce(F.lower(c).rlike("|".join(SUMMARY_WORDS)), F.lit(False)))


def sanitized(fields: Column, longest: int = 512) -> Column:
    """A map of strings with secret values masked and long ones cut."""
    secret = "|".join(SECRET_NAMES)
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).rlike(secret), F.lit("***")).otherwise(F.left(v, F.lit(longest))))


def scrubbed(message: Column, longest: int = 220) -> Column:
    """An error message without credentials."""
    named = F.regexp_replace(message, r"(?i)((?:" + "|".join(SECRET_NAMES) + r")\s*[=:]\s*)\S+", "$1***")
    return F.left(F.regexp_replace(named, r"(?i)(://[^:/\s]+:)[^@\s]+@", "$1***@"), F.lit(longest))
