"""Workbooks: the cells of a sheet, from its XML parts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.mapping import column_number
from .files import kept

ROWS = "file string, row long, cells array<string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Numbers of the built-in formats that show a date or a time.
DATE_FORMATS = (*range(14, 23), *range(45, 48))
#: Cells of a row that are searched for summary words.
LOOK = 3


def _sheet_part(book: zipfile.ZipFile, sheet: str | int) -> str:
    """The part of a sheet by name or index; the first where there is none such."""
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f"{_MAIN}sheets/{_MAIN}sheet")
    named = {s.get("name"): s for s in sheets}
    chosen = named.get(sheet) if isinstance(sheet, str) else sheets[sheet] if 0 <= sheet < len(sheets) else None
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = links[(chosen if chosen is not None else sheets[0]).get(_LINK)]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root.findall(f"{_MAIN}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date or a time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(f"{_MAIN}numFmt")}
    shows = {k for k, code in own.items() if re.search("[ymdhs]", re.sub(r'"[^"]*"|\\.|\[[^hms\]]*\]', "", code), re.IGNORECASE)}
    styles = root.find(f"{_MAIN}cellXfs")
    return {k for k, x in enumerate(styles if styles is not None else ()) if (n := int(x.get("numFmtId") or 0)) in shows or (n in DATE_FORMATS and n not in own)}


def _epoch(book: zipfile.ZipFile) -> datetime:
    """The day before serial number one; of books from 1900 shifted by the day that the format counts twice."""
    props = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}workbookPr")
    return datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else datetime(1899, 12, 30)


def _instant(serial: float, epoch: datetime) -> str:
    """A serial number as a local time that date fields can read; numbers below one are times of day."""
    if epoch.year == 1899 and 1 <= serial < 60:
        serial += 1
    at = epoch + timedelta(milliseconds=round(serial * 86_400_000))
    return at.strftime("%H:%M:%S") if 0 <= serial < 1 else at.strftime("%Y-%m-%d %H:%M:%S")


def _value(cell: ElementTree.Element, shared: list[str], dates: set[int], epoch: datetime) -> str | None:
    kind, raw = cell.get("t"), cell.findtext(f"{_MAIN}v")
    if kind == "inlineStr":
        raw = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    elif kind == "s" and raw is not None:
        raw = shared[int(raw)]
    elif kind == "b" and raw is not None:
        raw = "TRUE" if raw == "1" else "FALSE"
    elif kind in (None, "n") and raw is not None:
        number = float(raw)
        if int(cell.get("s") or 0) in dates:
            return _instant(number, epoch)
        raw = str(int(number)) if number.is_integer() and abs(number) < 1e15 else raw
    return raw or None


def sheet_names(content: bytes | IO[bytes]) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as book:
        return [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f"{_MAIN}sheets/{_MAIN}sheet")]


def sheet_rows(content: bytes | IO[bytes], sheet: str | int = 0) -> Iterator[tuple[int, list[str | None]]]:
    """Row number and cells of a sheet, a row at a time."""
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as book:
        shared, dates, epoch = _shared(book), _date_styles(book), _epoch(book)
        with book.open(_sheet_part(book, sheet)) as part:
            last = 0
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{_MAIN}row":
                    continue
                last = int(row.get("r") or last + 1)
                cells: list[str | None] = []
                for cell in row.findall(f"{_MAIN}c"):
                    letters = re.match(r"[A-Z]+", cell.get("r") or "")
                    at = column_number(letters.group()) - 1 if letters else len(cells)
                    cells += [None] * (at - len(cells) + 1)
                    cells[at] = _value(cell, shared, dates, epoch)
                yield last, cells
                row.clear()


def _rows(held: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*held)) or [(), (), ()]
    kinds = (pa.string(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "row", "cells"])


def read_workbook(spark: SparkSession, path: str, sheet: str | int = 0, start_row: int = 1) -> DataFrame:
    """file, row, cells, ordinal of the kept rows of workbooks."""
    return kept(workbook(spark, path, sheet), start_row, F.slice("cells", 1, LOOK))


def workbook(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """file, row, cells of all rows of workbooks; a workbook is read by one task, many in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held: list[tuple] = []
                for n, cells in sheet_rows(content, sheet):
                    held.append((name, n, cells))
                    if len(held) == 5000:
                        yield _rows(held)
                        held = []
                yield _rows(held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ROWS)
