"""Timestamps and business days as Column expressions; instants are UTC without zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BUSINESS_ZONE = "Asia/Ho_Chi_Minh"
#: The accepted formats without offset and the shapes they require.
LOCAL_FORMATS = (
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
    ("dd/MM/yyyy HH:mm:ss", r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$"),
)
OFFSET_SHAPE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"


def _guarded(value: Column, shape: str, form: str) -> Column:
    return F.when(value.rlike(shape), F.try_to_timestamp(value, F.lit(form)).cast("timestamp_ntz"))


def offset_time(value: Column) -> Column:
    """The UTC instant of an ISO text with an offset, else null.

    The date and time are read apart from the offset, which may exceed the
    eighteen hours that zone parsers allow.
    """
    local = F.try_to_timestamp(F.substring(value, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")
    fraction = F.rpad(F.regexp_extract(value, r"\.(\d{1,6})", 1), 6, "0")
    micros = F.when(value.rlike(r"\.\d"), F.try_to_number(fraction, F.lit("999999")).cast("int")).otherwise(0)
    sign = F.when(F.substring(value, -6, 1) == "-", -1).otherwise(1)
    minutes = F.when(
        value.endswith("Z"), 0
    ).otherwise(sign * (F.expr("0") + F.substring(value, -5, 2).try_cast("int") * 60 + F.substring(value, -2, 2).try_cast("int")))
    shifted = F.timestamp_add("MICROSECOND", micros.cast("bigint"), F.timestamp_add("MINUTE", (-minutes).cast("bigint"), local))
    return F.when(value.rlike(OFFSET_SHAPE), shifted)


def local_time(value: Column) -> Column:
    """The time of a text in one of the local formats, else null."""
    return F.coalesce(*[_guarded(value, shape, form) for form, shape in LOCAL_FORMATS])


def canonical_time(value: Column, zone: str = BUSINESS_ZONE) -> Column:
    """The UTC instant of a text: by its offset, or read in ``zone``; null if it has neither shape."""
    return F.coalesce(offset_time(value), F.convert_timezone(F.lit(zone), F.lit("UTC"), local_time(value)))


def business_date(instant: Column, zone: str = BUSINESS_ZONE) -> Column:
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), instant))


def business_bounds(day: Column, zone: str = BUSINESS_ZONE) -> tuple[Column, Column]:
    """First and last microsecond of a local day in UTC, both inclusive."""
    start = F.convert_timezone(F.lit(zone), F.lit("UTC"), day.cast("timestamp_ntz"))
    after = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.date_add(day, 1).cast("timestamp_ntz"))
    return start, F.timestamp_add("MICROSECOND", F.lit(-1), after)


def seconds_between(later: Column, earlier: Column) -> Column:
    micros = F.timestamp_diff("MICROSECOND", earlier, later)
    return (micros.cast("decimal(26,0)") / 1000000).cast("decimal(20,6)")


def weekdays(first: Column, last: Column) -> Column:
    """The days from first to last without Saturdays and Sundays."""
    return F.filter(F.sequence(first, last), lambda d: ~F.dayofweek(d).isin(1, 7))
