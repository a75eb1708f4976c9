"""Delimited and JSON files, previews, signatures, file drops and staged pages."""

from __future__ import annotations

import hashlib
import json
import re
import time
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import holds_summary_word
from . import ranges


#: Rows of a file that are numbered together.
NUMBERED = 65_536


def kept(rows: DataFrame, start_row: int, cells: Column | None = None) -> DataFrame:
    """Rows from ``start_row`` on that are neither empty nor a summary, numbered as kept rows of their file."""
    look = F.col("cells") if cells is None else cells
    filled = F.exists("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != "")
    rows = rows.where((F.col("row") >= start_row) & filled & ~holds_summary_word(look))
    return numbered(rows, start_row)


def numbered(rows: DataFrame, first: int = 1) -> DataFrame:
    """``rows`` with ``ordinal``, their place in their file from ``first`` on; runs of ``NUMBERED`` rows are counted, then each in itself."""
    rows = rows.withColumn("_run", F.floor(F.col("row") / NUMBERED))
    counts = rows.groupBy(F.col("file").alias("_file"), F.col("_run").alias("_at")).agg(F.count("*").alias("_many"))
    before = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select("_file", "_at", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_before"))
    within = rows.withColumn("_place", F.row_number().over(Window.partitionBy("file", "_run").orderBy("row")))
    out = within.join(sums, (F.col("file") == F.col("_file")) & (F.col("_run") == F.col("_at")))
    return out.withColumn("ordinal", (F.col("_before") + F.col("_place") + first - 1).cast("long")).drop("_file", "_at", "_run", "_before", "_place")


def read_delimited(spark: SparkSession, path: str, separator: str = ",", start_row: int = 1) -> DataFrame:
    """file, row, cells, ordinal of the kept rows of UTF-8 files."""
    return kept(delimited(spark, path, separator), start_row)


def delimited(spark: SparkSession, path: str, separator: str = ",", range_bytes: int | None = None) -> DataFrame:
    """file, row, cells of all rows of UTF-8 files; large files are read by ranges, though quoted cells may hold line ends."""
    return ranges.delimited(spark, path, separator, range_bytes)


def read_json(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """file, row, cells (of lists and scalars), record (of objects, values as texts) of a root array or ``items``.

    Root arrays are read by ranges; a file with ``items``, a page as a rule, by one task.
    """
    each, others = ranges.json_items(spark, path, range_bytes)
    each = each.withColumn("literal", F.lit(True))  # an element stands as in its file
    if others:
        whole = spark.read.text(others, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.get_json_object("value", "$.items").alias("items"))
        items = whole.select("file", F.posexplode(F.from_json("items", "array<string>")).alias("at", "text"))
        each = each.unionByName(items.select("file", (F.col("at") + 1).cast("long").alias("row"), "text", F.lit(False).alias("literal")))
    item = F.col("text")
    plain = F.when(F.col("literal"), F.from_json(F.concat(F.lit("["), item, F.lit("]")), "array<string>")[0]).otherwise(item)
    kind = F.substring(item, 1, 1)
    cells = F.when(kind == "[", F.from_json(item, "array<string>")).when((kind != "{") & plain.isNotNull(), F.array(plain))
    record = F.when(kind == "{", F.from_json(item, "map<string,string>"))
    return each.select("file", "row", cells.alias("cells"), record.alias("record"), F.col("row").alias("ordinal"))


def raw(rows: DataFrame) -> DataFrame:
    """Rows as they stand in their file, from the first filled one on: blank and summary rows stay, ``ordinal`` counts from 1."""
    filled = F.exists("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != "")
    if "record" in rows.columns:
        filled = F.coalesce(filled, F.lit(False)) | F.col("record").isNotNull()
    first = rows.where(filled).groupBy(F.col("file").alias("_file")).agg(F.min("row").alias("_first"))
    return rows.join(first, (F.col("file") == F.col("_file")) & (F.col("row") >= F.col("_first"))).withColumn("ordinal", F.col("row") - F.col("_first") + 1).drop("_first", "_file")


def preview(rows: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` rows of each file, cells trimmed and null cells empty: what a person sees before a file is mapped."""
    return raw(rows).where(F.col("ordinal") <= n).withColumn("cells", F.transform("cells", lambda c: F.coalesce(F.trim(c), F.lit(""))))


def signature(headers: list[str], columns: int) -> str:
    """MD5 of a file's headers and number of columns: files of one structure share it."""
    return hashlib.md5(json.dumps([headers, columns], ensure_ascii=False).encode()).hexdigest()


def json_headers(rows: DataFrame, n: int = 20) -> list[str]:
    """Keys of the first n + 1 objects in the order of their first appearance."""
    out: dict[str, None] = {}
    for r in rows.orderBy("row").limit(n + 1).collect():
        out.update(dict.fromkeys(r["record"] or {}))
    return list(out)


def structures(rows: DataFrame, n: int = 10) -> DataFrame:
    """file, headers, columns, header_row, first_data_row, signature: the structure of each file of raw rows.

    Headers are a file's first filled row, or the names of its first n + 1 objects in the order of their appearance.
    """
    shown = preview(rows, n + 1)
    names = F.col("cells")
    if "record" in rows.columns:  # of n + 1 rows
        names = F.coalesce(F.map_keys("record"), names)
    line = F.struct("ordinal", "row", names.alias("names"))
    lists = shown.groupBy("file").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    every = F.col("lines")
    headers = every[0]["names"]
    if "record" in rows.columns:
        objects = shown.groupBy("file").agg(F.max(F.col("record").isNotNull()).alias("objects"))
        lists = lists.join(objects, "file")
        headers = F.when(F.col("objects"), F.array_distinct(F.flatten(every["names"]))).otherwise(headers)
    out = lists.select("file", headers.alias("headers"), every[0]["row"].alias("header_row"), F.coalesce(F.get(every, F.lit(1))["row"], every[0]["row"] + 1).alias("first_data_row"))
    body = F.concat(F.lit("["), F.concat(F.lit("["), F.array_join(F.transform("headers", lambda h: F.regexp_replace(F.to_json(F.array(h)), r"^\[|\]$", "")), ", "), F.lit("]")), F.lit(", "), F.size("headers").cast("string"), F.lit("]"))
    return out.select("file", "headers", F.size("headers").alias("columns"), "header_row", "first_data_row", F.md5(body).alias("signature"))


def row_at(rows: DataFrame, row: int) -> DataFrame:
    """The row of each file that a replay asks for, counted from the first filled one; no filter hides it."""
    return raw(rows).where(F.col("ordinal") == row)


def dated(template: str, day: date) -> str:
    """``template`` with ``{date:format}`` replaced by the day."""
    return re.sub(r"\{date:([^}]*)\}", lambda m: day.strftime(m.group(1)), template)


#: Letters of a date format and Spark's patterns for them.
_LETTERS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%j": "DDD", "%H": "HH", "%M": "mm", "%S": "ss"}


def dated_names(template: str, day: Column) -> Column:
    """``dated`` for a column of days."""
    parts, at = [], 0
    for m in re.finditer(r"\{date:([^}]*)\}", template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        for letter in re.findall(r"%.|[^%]+", m.group(1)):
            if letter[0] == "%" and letter not in _LETTERS:
                raise ValueError(f"no date format: {letter}")
            parts.append(F.date_format(day, _LETTERS[letter]) if letter in _LETTERS else F.lit(letter))
    return F.concat(*parts, F.lit(template[at:]))


def dropped_files(spark: SparkSession, folder: str, pattern: str, day: date, settle: float = 5.0) -> list[str]:
    """Files of a drop folder that match the day's pattern and kept their size for ``settle`` seconds, sorted.

    The listing is Spark's, which reads no contents and looks for the day's names only.
    """
    name = dated(pattern, day)

    def sizes() -> dict[str, int]:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder).select("path", "length")
        return {r["path"]: r["length"] for r in listed.collect()}

    before = sizes()
    time.sleep(settle if before else 0)
    after = sizes() if before else {}
    return sorted(path for path, size in before.items() if after.get(path) == size)


def staged_items(pages: DataFrame, items: str = "$.items") -> DataFrame:
    """page, row, record of staged API pages (page, created_at, body), each page's latest body, in page order."""
    last = pages.groupBy("page").agg(F.max_by("body", "created_at").alias("body"))
    each = last.select("page", F.posexplode(F.from_json(F.get_json_object("body", items), "array<string>")).alias("at", "item"))
    return each.select("page", (F.col("at") + 1).cast("long").alias("row"), F.from_json("item", "map<string,string>").alias("record"))


def check_cursors(pages: DataFrame, most: int = 100, cursor: str = "$.cursorAfter") -> None:
    """Refuses pages of which two have one next cursor, found at the path ``cursor``, or more pages than allowed."""
    seen = pages.select(F.get_json_object("body", cursor).alias("cursor"), "page").distinct()
    if seen.groupBy("cursor").count().where("cursor IS NOT NULL AND count > 1").limit(1).count():
        raise ValueError("a cursor is repeated")
    if seen.select("page").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} pages")


def staged(pages: DataFrame, earlier: DataFrame) -> DataFrame:
    """Pages to stage: the first of each unit key that is not staged already, with the status STAGED."""
    fresh = pages.join(earlier.select("unit").distinct(), "unit", "left_anti")
    fields = [c for c in pages.columns if c != "unit"]
    first = fresh.groupBy("unit").agg(F.min_by(F.struct(*fields), F.struct("created_at", "page")).alias("_r"))
    return first.select(*[F.col("unit") if c == "unit" else F.col(f"_r.{c}").alias(c) for c in pages.columns], F.lit("STAGED").alias("status"))


def consumed(pages: DataFrame, units: DataFrame) -> DataFrame:
    """``pages`` with the status of the staged ones among ``units`` set to CONSUMED."""
    hit = units.select("unit").distinct().withColumn("_hit", F.lit(True))
    status = F.when(F.col("_hit") & (F.col("status") == "STAGED"), "CONSUMED").otherwise(F.col("status"))
    return pages.join(hit, "unit", "left").withColumn("status", status).select(*pages.columns)


def for_replay(pages: DataFrame, stage: str | None = None) -> DataFrame:
    """All retained pages of a stage, or of every stage, staged or consumed; ``staged_items`` gives their records in page order."""
    kept = pages.where(F.col("status").isin("STAGED", "CONSUMED"))
    return kept if stage is None else kept.where(F.col("stage") == stage)
