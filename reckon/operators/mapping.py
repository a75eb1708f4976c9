"""Declarative field mappings compiled to Column expressions, and the row rules that follow.

A mapped row carries its fields, and ``errors``: an array of (code, field). Any
field error rejects the row, optional fields included.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import keys, times

#: Source spellings of statuses and what they mean, used where a mapping gives none.
STATUS_DEFAULTS = {
    "SUCCESS": "SUCCESS", "FAILED": "FAILED", "PENDING": "PENDING", "REVERSED": "REVERSED",
    "Thành công": "SUCCESS", "Thất bại": "FAILED", "Đang xử lý": "PENDING", "Đã hoàn tác": "REVERSED",
}
CANONICAL = ("id", "trace", "amount", "currency", "status", "transDate")
REQUIRED = ("id", "amount", "currency", "status")
_ERROR = "array<struct<code:string,field:string>>"


@dataclass(frozen=True)
class FieldMapping:
    """Where a field comes from: ``column`` (number from 1 or letters, or a key) or ``source_field``, and its type."""

    path: str
    type: str = "STRING"
    column: int | str | None = None
    source_field: str | None = None
    required: bool = False
    constant: str | None = None
    mapping: dict[str, str] = field(default_factory=dict)


def column_number(column: int | str) -> int:
    """The number from 1 of a column given by number, digits or spreadsheet letters."""
    text = str(column).strip().upper()
    if text.isdigit():
        return int(text)
    if not text.isascii() or not text.isalpha():
        raise ValueError(f"not a column: {column!r}")
    number = 0
    for letter in text:
        number = number * 26 + ord(letter) - ord("A") + 1
    return number


def column_letters(number: int) -> str:
    """Spreadsheet letters of a column number from 1."""
    out = ""
    while number > 0:
        number, rest = divmod(number - 1, 26)
        out = chr(ord("A") + rest) + out
    return out


def number_of(letters: Column) -> Column:
    """The number from 1 of a column given by digits or spreadsheet letters; null for other texts."""
    text = F.upper(F.trim(letters))
    number = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda n, c: n * 26 + F.ascii(c) - 64)
    return F.when(text.rlike("^[0-9]{1,18}$"), text.try_cast("long")).when(text.rlike("^[A-Z]{1,12}$"), number)


def letters_of(number: Column) -> Column:
    """Spreadsheet letters of a column number from 1 up to 12,356,630, which has five."""
    def step(acc: Column, _: Column) -> Column:
        at = acc["rest"] - 1
        more = acc["rest"] > 0
        letter = F.concat(F.char(F.pmod(at, F.lit(26)) + 65), acc["out"])
        return F.struct(F.when(more, F.floor(at / 26)).otherwise(F.lit(0).cast("long")).alias("rest"), F.when(more, letter).otherwise(acc["out"]).alias("out"))

    start = F.struct(number.cast("long").alias("rest"), F.lit("").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(5)), start, step, lambda acc: acc["out"])


def config_findings(mappings: DataFrame) -> DataFrame:
    """config, code, path: what keeps mappings from being compiled, over any number of configurations.

    ``mappings`` has a row a mapping: config, position, path, type, column, source_field, constant, pairs (entries of its table).
    """
    order = Window.partitionBy("config", "path").orderBy("position")  # within one configuration
    constant, mapped = F.col("type") == "CONSTANT", F.col("type") == "MAPPING"
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    codes = [
        F.when(F.col("_again"), "DUPLICATE_PATH"),
        F.when(constant & blank("constant"), "EMPTY_CONSTANT"),
        F.when(mapped & (F.coalesce("pairs", F.lit(0)) == 0), "EMPTY_MAPPING"),
        F.when(~constant & F.col("column").isNull() & blank("source_field"), "NO_SOURCE"),
        F.when(~constant & ~F.col("column").rlike("^([A-Za-z]+|[0-9]+)$"), "INVALID_COLUMN"),
    ]
    return mappings.withColumn("_again", F.row_number().over(order) > 1).select("config", F.explode(F.array_compact(F.array(*codes))).alias("code"), "path")


def config_scores(mappings: DataFrame) -> DataFrame:
    """config, findings, score: 100 less 15 for each finding, at least 0."""
    found = config_findings(mappings).groupBy(F.col("config").alias("_of")).agg(F.count("*").alias("findings"))
    every = mappings.select("config").distinct().join(found, F.col("config").eqNullSafe(F.col("_of")), "left")
    n = F.coalesce("findings", F.lit(0).cast("long"))
    return every.select("config", n.alias("findings"), F.greatest(F.lit(0), 100 - 15 * n).cast("int").alias("score"))


def gate_findings(files: DataFrame, mappings: DataFrame, expected: DataFrame) -> DataFrame:
    """file, outcome, code: what is wrong with the structure of each of many files; a file without findings has no row.

    ``files`` has file, config, headers; ``mappings`` as for ``config_findings``; ``expected`` has config, known (the
    headers that its configuration was approved for, or null).
    """
    fatal = F.lit("BATCH_FATAL")
    paths = mappings.groupBy(F.col("config").alias("_of")).agg(F.collect_set("path").alias("paths"))
    known = files.join(expected.select(F.col("config").alias("_with"), "known"), F.col("config") == F.col("_with"), "left").join(paths, F.col("config") == F.col("_of"), "left")
    absent = F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce("paths", F.array().cast("array<string>")))
    unmapped = known.select("file", F.explode(absent)).select("file", fatal.alias("outcome"), F.lit("REQUIRED_SCHEMA_PATH").alias("code"))
    appended = (F.size("headers") > F.size("known")) & (F.slice("headers", 1, F.greatest(F.size("known"), F.lit(1))) == F.col("known"))
    drifted = known.where(F.col("known").isNotNull() & (F.col("headers") != F.col("known"))).select("file", F.when(appended, "WARNING").otherwise(fatal).alias("outcome"), F.lit("SCHEMA_CONFIG_DRIFT").alias("code"))
    own = mappings.where("type <> 'CONSTANT'").select(F.col("config").alias("_of"), "column", "source_field")
    each = files.join(own, F.col("config") == F.col("_of"))
    named = F.array_contains("headers", F.coalesce("column", "source_field"))
    by_number = F.col("column").isNotNull() & (F.col("column").rlike("^[0-9]+$") | ~F.array_contains("headers", F.col("column")))
    there = F.when(by_number, number_of(F.col("column")) <= F.size("headers")).otherwise(named)
    missing = each.where(~F.coalesce(there, F.lit(False))).select("file", fatal.alias("outcome"), F.lit("MISSING_REQUIRED_SOURCE_COLUMN").alias("code"))
    return unmapped.unionByName(missing).unionByName(drifted)


def canonical_mappings(mappings: list[FieldMapping]) -> list[FieldMapping]:
    """Adds the currency constant and the default status map where they are missing."""
    out = [
        FieldMapping(m.path, "MAPPING", m.column, m.source_field, m.required, m.constant, dict(STATUS_DEFAULTS))
        if m.path == "status" and m.type == "STRING" else m
        for m in mappings
    ]
    if all(m.path != "currency" for m in out):
        out.append(FieldMapping("currency", "CONSTANT", required=True, constant="VND"))
    return out


def config_issues(mappings: list[FieldMapping]) -> list[tuple[str, str]]:
    """(code, path) of mappings that cannot be compiled; found before any row is read."""
    out, seen = [], set()
    for m in mappings:
        if m.path in seen:
            out.append(("DUPLICATE_PATH", m.path))
        seen.add(m.path)
        if m.type == "CONSTANT":
            if not m.constant:
                out.append(("EMPTY_CONSTANT", m.path))
            continue
        if m.type == "MAPPING" and not m.mapping:
            out.append(("EMPTY_MAPPING", m.path))
        if m.column is None and not m.source_field:
            out.append(("NO_SOURCE", m.path))
        if isinstance(m.column, str) and not re.fullmatch("[A-Za-z]+", m.column):
            out.append(("INVALID_COLUMN", m.path))
    return out


def mapping_score(errors: int, warnings: int) -> int:
    return max(0, min(100, 100 - 15 * errors - 5 * warnings))


def _source(m: FieldMapping, cells: str | None, record: str | None) -> tuple[Column, Column]:
    """The source text and whether its place exists."""
    if cells is not None and m.column is not None:
        n = column_number(m.column)
        return F.get(F.col(cells), F.lit(n - 1)), F.size(cells) >= n
    names = [m.source_field if m.column is None else str(m.column)]
    if isinstance(m.column, int):  # of records keyed by letters
        names.append(column_letters(m.column))
    elif m.column is not None and m.column.isdigit():  # of records keyed by numbers
        names.append(str(int(m.column)))
    value, there = F.lit(None).cast("string"), F.lit(False)
    for name in reversed(names):
        has = F.map_contains_key(F.col(record), F.lit(name))
        value, there = F.when(has, F.try_element_at(F.col(record), F.lit(name))).otherwise(value), has | there
    return value, there


def _found(faults: list[Column]) -> Column:
    """An array of the errors that are not null; without a lambda, which Spark would not compile."""
    none = F.array().cast(_ERROR)
    return F.concat(none, *[F.when(fault.isNotNull(), F.array(fault)).otherwise(none) for fault in faults])


def _error(code: str | Column, path: str) -> Column:
    return F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(path).alias("field"))


def _value(m: FieldMapping, cells: str | None, record: str | None, zone: str) -> Column:
    """The value of a field, null where it has none."""
    if m.type == "CONSTANT":
        return F.lit(m.constant or None).cast("string")
    raw, _ = _source(m, cells, record)
    if m.type == "DECIMAL" or m.path == "amount":
        return keys.exact_money(raw)  # null where the stored scale would change the amount
    if m.type == "DATE":
        return times.canonical_time(raw, zone)
    if m.type == "MAPPING":
        table = F.create_map(*[F.lit(x) for pair in m.mapping.items() for x in pair])
        return F.coalesce(F.try_element_at(table, raw), F.lit(m.mapping.get("others")))
    return F.nullif(raw, F.lit(""))


def _fault(m: FieldMapping, value: Column, cells: str | None, record: str | None) -> Column:
    """The error of a field whose value is ``value``, null if there is none."""
    missing = "MISSING_REQUIRED_FIELD" if m.required else "MALFORMED_ROW"
    if m.type == "CONSTANT":
        return F.when(value.isNull(), _error(missing, m.path))
    raw, there = _source(m, cells, record)
    absent = F.when(~F.coalesce(there, F.lit(False)), _error("MALFORMED_ROW", m.path))
    if m.type == "DECIMAL" or m.path == "amount":
        fault = F.when(raw.isNull(), _error(missing, m.path)).when(value.isNull(), _error("INVALID_AMOUNT", m.path))
    elif m.type == "DATE":
        empty = F.coalesce(F.trim(raw) == "", F.lit(True)) if m.path == "transDate" and not m.required else F.lit(False)
        fault = F.when(empty, None).when(raw.isNull(), _error(missing, m.path)).when(value.isNull(), _error("INVALID_TIMESTAMP", m.path))
    elif m.type == "MAPPING":
        code = "INVALID_STATUS" if m.path == "status" else "MALFORMED_ROW"
        fault = F.when(raw.isNull(), _error(missing, m.path)).when(value.isNull(), _error(code, m.path))
    else:
        fault = F.when(value.isNull(), _error(missing, m.path))
    return F.coalesce(absent, fault)


def compile_field(m: FieldMapping, cells: str | None, record: str | None, zone: str) -> tuple[Column, Column]:
    """The value of a field and its error, null if there is none."""
    value = _value(m, cells, record, zone)
    return value, _fault(m, value, cells, record)


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` with ``columns``, which are computed once a row, however often later columns and filters name them.

    They go through a generator of one row: a filter is never pushed below it, nor are projections merged with it, both of
    which would put the columns' expressions in the place of each of their names.
    """
    made = rows.select("*", F.inline(F.array(F.struct(*[c.alias(f"_once_{name}") for name, c in columns.items()]))))
    return made.withColumns({name: F.col(f"_once_{name}") for name in columns}).drop(*[f"_once_{name}" for name in columns])


def map_rows(rows: DataFrame, mappings: list[FieldMapping], cells: str | None = "cells", record: str | None = None, zone: str = times.BUSINESS_ZONE) -> DataFrame:
    """``rows`` with a column for each canonical field, ``extra`` (a map), ``nested`` (a map of maps, from paths ``a.b``) and ``errors``."""
    fields, faults, extra, inner, values = {}, [], [], {}, {}
    for k, m in enumerate(mappings):
        values[f"_value_{k}"] = _value(m, cells, record, zone)
        value = F.col(f"_value_{k}")
        faults.append(_fault(m, value, cells, record))
        if m.path in CANONICAL:
            fields[m.path] = value
            continue
        outer, _, name = m.path.partition(".")
        if name and outer != "extra":
            inner.setdefault(outer, []).extend([F.lit(name), value.cast("string")])
        else:
            extra += [F.lit(name or outer), value.cast("string")]
    kinds = {"amount": keys.MONEY, "transDate": "timestamp_ntz"}
    columns = {name: fields.get(name, F.lit(None)).cast(kinds.get(name, "string")) for name in CANONICAL}
    found = _found(faults)
    nested = F.create_map(*[x for outer, pairs in inner.items() for x in (F.lit(outer), F.create_map(*pairs))]) if inner else F.create_map().cast("map<string,map<string,string>>")
    extras = F.create_map(*extra) if extra else F.create_map().cast("map<string,string>")
    valued = once(rows, values) if values else rows
    mapped = once(valued, {**columns, "nested": nested, "extra": extras, "errors": found}).drop(*values)
    return once(mapped, {"errors": F.when(F.size("errors") > 0, F.col("errors")).otherwise(_missing())})


def field_trace(mappings: list[FieldMapping], cells: str | None = "cells", record: str | None = None, zone: str = times.BUSINESS_ZONE) -> Column:
    """An array of (path, source, value, error code), one for each mapping: how a row became its fields."""
    steps = []
    for m in mappings:
        value, fault = compile_field(m, cells, record, zone)
        source = F.lit(m.constant) if m.type == "CONSTANT" else _source(m, cells, record)[0]
        steps.append(F.struct(F.lit(m.path).alias("path"), source.cast("string").alias("source"), value.cast("string").alias("value"), fault["code"].alias("error")))
    return F.array(*steps)


def _missing() -> Column:
    """Errors of the canonical stage: required fields first, then the status's domain."""
    needed = _found([F.when(F.col(f).isNull(), _error("MISSING_REQUIRED_FIELD", f)) for f in REQUIRED])
    domain = _found([F.when(~F.col("status").isin(*keys.STATUSES), _error("INVALID_STATUS", "status"))])
    return F.when(F.size(needed) > 0, needed).otherwise(domain)


def violations(rows: DataFrame) -> DataFrame:
    """Adds ``violations`` to rows that mapped without error: every broken rule of a canonical row."""
    blank = [F.when(F.coalesce(F.trim(F.col(f)), F.lit("")) == "", _error("MISSING_REQUIRED_FIELD", f)) for f in ("id", "currency", "status")]
    rules = [
        *blank,
        F.when(F.col("amount").isNull(), _error("MISSING_REQUIRED_FIELD", "amount")).when(F.col("amount") < 0, _error("NEGATIVE_AMOUNT", "amount")),
        F.when(~F.col("status").isin(*keys.STATUSES) & (F.trim("status") != ""), _error("INVALID_STATUS", "status")),
    ]
    return once(rows, {"violations": F.when(F.size("errors") == 0, _found(rules)).otherwise(F.array().cast(_ERROR))})


def outcome(fatal: Column, conflict: Column, rejected: Column, warned: Column, equivalent: Column) -> Column:
    """The outcome of a row by precedence."""
    return (
        F.when(fatal, "BATCH_FATAL").when(conflict, "CONFLICTING_DUPLICATE").when(rejected, "REJECT")
        .when(warned, "WARNING").when(equivalent, "EQUIVALENT_DUPLICATE").otherwise("VALID")
    )


def quality_summary(rows: DataFrame, faults: str = "faults", result: str = "outcome", by: tuple[str, ...] = ()) -> DataFrame:
    """total, valid, rejected, warnings, fatal, decision and action over all rows, or for each value of ``by``, a file as a rule."""
    counts = rows.groupBy(*by).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(result) == o).alias(n) for o, n in (("VALID", "valid"), ("REJECT", "rejected"), ("WARNING", "warnings"), ("BATCH_FATAL", "fatal"), ("CONFLICTING_DUPLICATE", "conflicting"), ("EQUIVALENT_DUPLICATE", "equivalent"))],
    )
    decision = F.when(F.col("fatal") > 0, "FAIL").when(F.col("rejected") + F.col("warnings") + F.col("conflicting") > 0, "REVIEW").otherwise("PASS")
    action = F.when(F.col("decision") == "FAIL", "FAIL").when(F.col("decision") == "REVIEW", "HOLD_FOR_REVIEW").otherwise("CONTINUE")
    return counts.withColumn("decision", decision).withColumn("action", action)


def top_codes(rows: DataFrame, faults: str = "faults", limit: int = 10) -> DataFrame:
    """The commonest rule codes of all rows, the most frequent first."""
    each = rows.select(F.explode(F.col(faults)).alias("fault")).groupBy(F.col("fault.code").alias("code")).agg(F.count("*").alias("n"))
    return each.orderBy(F.desc("n"), "code").limit(limit)


def dry_run(rows: DataFrame, order: str, sample: int = 100, issues: int = 5) -> tuple[DataFrame, DataFrame]:
    """sampled, success, failed and whether all passed, over the first ``sample`` mapped rows; and their commonest codes."""
    first = rows.orderBy(order).limit(sample)
    counts = first.agg(F.count("*").alias("sampled"), F.count_if(F.size("faults") == 0).alias("success"))
    counts = counts.withColumn("failed", F.col("sampled") - F.col("success"))
    return counts.withColumn("passed", (F.col("sampled") > 0) & (F.col("failed") == 0)), top_codes(first, limit=issues)


def file_gate(mappings: list[FieldMapping], headers: list[str], expected: list[str] | None = None) -> list[tuple[str, str]]:
    """(outcome, code) of a file's structure: fatal if it cannot be mapped, a warning if columns were only appended."""
    out = []
    paths = {m.path for m in mappings}
    out += [("BATCH_FATAL", "REQUIRED_SCHEMA_PATH") for p in REQUIRED if p not in paths]
    for m in mappings:
        if m.type == "CONSTANT":
            continue
        if m.column is not None and (isinstance(m.column, int) or str(m.column).isdigit() or m.column not in headers):
            there = column_number(m.column) <= len(headers)
        else:
            there = (m.column or m.source_field) in headers
        if not there:
            out.append(("BATCH_FATAL", "MISSING_REQUIRED_SOURCE_COLUMN"))
    if expected is not None and headers != expected:
        appended = len(headers) > len(expected) and headers[: len(expected)] == expected
        out.append(("WARNING" if appended else "BATCH_FATAL", "SCHEMA_CONFIG_DRIFT"))
    return out
