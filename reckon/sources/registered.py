"""Spark data sources: a stream over cursor-linked pages, and workbooks with a partition for each large sheet or many small books.

``register`` makes them known to a session as ``cursor_pages`` and ``workbook``.
Files are opened with pyarrow's file systems, by the URI of their folder.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatch
from urllib.parse import quote
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..operators.mapping import column_letters
from ..session import ship
from . import xlsx

#: Pages of one run at most, and the places of items and of the next cursor in a page.
MOST_PAGES, ITEMS, NEXT = 100, "items", "cursorAfter"
#: Books that the driver opens to deal out their sheets, and partitions that all smaller books share, at most.
BOOKS = 256


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (CursorPages, Workbook):
        spark.dataSource.register(source)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _at(page: dict, path: str):
    """The value at a dotted path of a page; null where there is none."""
    found = page
    for name in path.split("."):
        found = found.get(name) if isinstance(found, dict) else None
    return found


# --- pages linked by cursors ---------------------------------------------------------------------------------


class PageAt(InputPartition):
    def __init__(self, page: int, cursor: str):
        self.page, self.cursor = page, cursor


class CursorPages(DataSource):
    """page, row, cursor, item (JSON) of pages landed in folders ``cursor=<cursor>`` of ``path``, from the empty cursor on.

    Options: ``items`` and ``next`` (dotted places in a page), ``maxPages``. A page names the next one's cursor, none if it
    is the last. A cursor that comes again, or more pages than allowed, fail the query. A batch takes all pages that have
    landed, a partition each.
    """

    @classmethod
    def name(cls) -> str:
        return "cursor_pages"

    def schema(self) -> str:
        return "page int, row int, cursor string, item string"

    def streamReader(self, schema) -> CursorStream:
        return CursorStream(self.options)


class CursorStream(DataSourceStreamReader):
    """Offsets are the cursor and number of the page to read next, and the cursors behind it; Spark's checkpoint keeps them."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.items, self.next = options.get("items", ITEMS), options.get("next", NEXT)
        self.most = int(options.get("maxPages", MOST_PAGES))
        self.now: dict | None = None

    def _page(self, cursor: str) -> dict | None:
        """The page of a cursor; none where it has not landed yet."""
        system, root = _opened(self.path)
        folder = f"{root}/cursor={quote(cursor, safe='') or '__HIVE_DEFAULT_PARTITION__'}"
        files = [f.path for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.is_file and f.base_name[0] not in "._" and f.size]
        if not files:
            return None
        with system.open_input_stream(sorted(files)[0]) as source:
            return json.loads(source.readall())

    def initialOffset(self) -> dict:
        return {"page": 1, "cursor": "", "seen": []}

    def latestOffset(self) -> dict:
        """Follows the cursors as far as pages have landed. A new reader begins at the first page, of ``maxPages`` at most: Spark does not tell it what its checkpoint holds."""
        now = self.now or self.initialOffset()
        while now["cursor"] is not None and (page := self._page(now["cursor"])) is not None:
            if now["page"] > self.most:
                raise ValueError(f"more than {self.most} pages")
            seen, then = [*now["seen"], now["cursor"]], _at(page, self.next)
            if then is not None and str(then) in seen:
                raise ValueError(f"cursor {then} is repeated")
            now = {"page": now["page"] + 1, "cursor": None if then is None else str(then), "seen": seen}
        self.now = now
        return now

    def partitions(self, start: dict, end: dict) -> list[PageAt]:
        return [PageAt(start["page"] + k, c) for k, c in enumerate(end["seen"][start["page"] - 1 :])]

    def read(self, partition: PageAt) -> Iterator[tuple]:
        for row, item in enumerate(_at(self._page(partition.cursor) or {}, self.items) or [], 1):
            yield partition.page, row, partition.cursor, json.dumps(item, ensure_ascii=False)

    def commit(self, end: dict) -> None:
        pass


# --- workbooks -----------------------------------------------------------------------------------------------


class SheetsOf(InputPartition):
    """Files, each with a sheet of it, or none for all that are wanted."""

    def __init__(self, sheets: list[tuple[str, str | None]]):
        self.sheets = sheets


class Workbook(DataSource):
    """file, sheet, row, cells of the sheets of workbooks. Options: ``path`` (its last part may be a pattern).

    Each sheet is a partition. Of more than ``BOOKS`` books, only those of more than an even share of all bytes are dealt out
    so, and the others in ``BOOKS`` partitions of like size; only their tasks open them. Filters on file and sheet choose the
    sheets that are opened, filters on row the rows that are made.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "file string, sheet string, row long, cells array<string>"

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options)


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, _, self.pattern = options["path"].rpartition("/")
        self.only: list[Filter] = []
        self.rows = (1, 1 << 62)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        low, high = self.rows
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("file",), ("sheet",)):
                self.only.append(f)
            elif f.__class__ in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) and f.attribute == ("row",) and f.value is not None:
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    high = min(high, f.value - isinstance(f, LessThan))
            else:
                yield f
        self.rows = (low, high)

    def _wanted(self, file: str, sheet: str | None) -> bool:
        of = {("file",): file, ("sheet",): sheet}
        return all(of[f.attribute] is None or of[f.attribute] in ((f.value,) if isinstance(f, EqualTo) else f.value) for f in self.only)

    def partitions(self) -> list[SheetsOf]:
        system, root = _opened(self.folder)
        listed = [f for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and fnmatch(f.base_name, self.pattern) and self._wanted(f.path, None)]
        share = sum(f.size for f in listed) / BOOKS if len(listed) > BOOKS else -1
        out, small = [], []
        for f in sorted(listed, key=lambda f: f.path):
            if f.size > share:  # of which there are fewer than BOOKS, if not all are
                out += [SheetsOf([(f.path, s)]) for s in self._sheets(system, f.path)]
            else:
                small.append(f)
        dealt: list[list] = [[] for _ in range(min(BOOKS, len(small)))]
        for k, f in enumerate(sorted(small, key=lambda f: (-f.size, f.path))):  # to and fro, so that sizes are alike
            turn, at = divmod(k, len(dealt))
            dealt[at if turn % 2 == 0 else -1 - at].append((f.path, None))
        return out + [SheetsOf(sheets) for sheets in dealt]

    def _sheets(self, system: fs.FileSystem, file: str) -> list[str]:
        with system.open_input_file(file) as source:  # of which the parts that name the sheets are read
            return [s for s in xlsx.sheet_names(source) if self._wanted(file, s)]

    def read(self, partition: SheetsOf) -> Iterator[tuple]:
        system, _ = _opened(self.folder)
        for file, named in partition.sheets:
            for sheet in [named] if named is not None else self._sheets(system, file):
                yield from self._rows(system, file, sheet)

    def _rows(self, system: fs.FileSystem, file: str, sheet: str) -> Iterator[tuple]:
        low, high = self.rows
        with system.open_input_file(file) as source:
            for row, cells in xlsx.sheet_rows(source, sheet):
                if row > high:
                    return
                if row >= low:
                    yield file, sheet, row, cells


def written_book(rows, folder: str, columns: list[str], sheet_of) -> pd.DataFrame:
    """Writes one group of rows as a workbook in ``folder``, a sheet ``s<n>`` for each value n of ``sheet_of``, with a header row; names the file."""
    main, link = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    system, root = _opened(folder)
    file = f"{root}/{rows.iloc[0]['book']}.xlsx"
    names = sorted(set(sheet_of))

    def cell(at: str, value) -> str:
        if value is None or value != value:
            return ""
        if isinstance(value, str):
            return f'<c r="{at}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        return f'<c r="{at}"><v>{value}</v></c>'

    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as out:
        listed = "".join(f'<sheet name="s{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1))
        out.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets>{listed}</sheets></workbook>')
        out.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        for k, n in enumerate(names, 1):
            lines = [columns, *rows.loc[sheet_of == n, columns].itertuples(index=False)]
            body = "".join(f'<row r="{r}">{"".join(cell(f"{column_letters(c)}{r}", v) for c, v in enumerate(line, 1))}</row>' for r, line in enumerate(lines, 1))
            out.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    with system.open_output_stream(file) as sink:
        sink.write(content.getvalue())
    return pd.DataFrame({"file": [file]})
