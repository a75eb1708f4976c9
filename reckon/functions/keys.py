"""Business keys, statuses and money as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Spellings of statuses, trimmed and in lower case.
SUCCESS_WORDS = ("success", "thành công", "matched")
FAILED_WORDS = ("fail", "failed", "thất bại")
REVERSED_WORDS = ("reversed", "hoàn tiền")
STATUSES = ("SUCCESS", "FAILED", "PENDING", "REVERSED")
MONEY = "decimal(20,4)"


def filled(value: Column) -> Column:
    """The value without blanks around it, null if nothing is left; only spaces are trimmed."""
    return F.nullif(F.btrim(value), F.lit(""))


def partner_key(trace: Column, other_trace: Column, partner_id: Column) -> Column:
    return F.coalesce(filled(trace), filled(other_trace), filled(partner_id))


def status(value: Column) -> Column:
    word = F.lower(F.btrim(value))
    return (
        F.when(word.isin(*SUCCESS_WORDS), "SUCCESS")
        .when(word.isin(*FAILED_WORDS), "FAILED")
        .when(word.isin(*REVERSED_WORDS), "REVERSED")
        .otherwise("PENDING")
    )


def ingestion_key(ident: Column, trace: Column) -> Column:
    return F.coalesce(F.nullif(ident, F.lit("")), F.nullif(trace, F.lit("")))


def exact_money(text: Column) -> Column:
    """The amount of a text, null if it is none or would lose places in the stored scale."""
    wide = text.try_cast("decimal(38,22)")
    stored = text.try_cast(MONEY)
    return F.when(wide == stored, stored)


def plain_amount(amount: Column) -> Column:
    """An amount's text without trailing zeros, '0' for zero: equal amounts give equal texts."""
    text = amount.cast(MONEY).cast("string")
    return F.when(amount == 0, "0").otherwise(F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ""))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole as a decimal with two places, rounded half up; null if there is no whole."""
    hundred = (part.cast("decimal(20,0)") * 100).cast("decimal(24,6)")
    return F.when(whole > 0, F.round(hundred / whole.cast("decimal(20,0)"), 2)).cast("decimal(12,2)")


def fingerprint(*fields: Column) -> Column:
    """SHA-256 over fields, with nulls told apart from empty texts."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.concat(F.lit("="), f.cast("string")), F.lit("~")).alias(f"f{k}") for k, f in enumerate(fields)])), 256)


def canonical_metadata(fields: Column) -> Column:
    """A map of strings as JSON with sorted names; null and empty maps are equal, and so are numbers that differ in trailing zeros."""
    number = r"^-?\d+\.\d+$"
    plain = lambda v: F.when(v.rlike(number), F.regexp_replace(F.regexp_replace(v, "0+$", ""), r"\.$", "")).otherwise(v)
    entries = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.struct(e["key"].alias("key"), plain(e["value"]).alias("value")))
    return F.coalesce(F.to_json(entries), F.lit("[]"))


def payload_fingerprint(ident: Column, trace: Column, status: Column, amount: Column, currency: Column, at: Column, metadata: Column) -> Column:
    """The fingerprint of the business fields of a payload: equal for equal amounts and metadata, however they are spelled."""
    instant = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return fingerprint(F.coalesce(ident, F.lit("")), trace, status, plain_amount(amount), currency, instant, canonical_metadata(metadata))


def row_hash(cells: Column) -> Column:
    """128 bits over the cells of a row, as hexadecimal text; nulls are empty cells."""
    return F.md5(F.array_join(cells, "\x1f", ""))
