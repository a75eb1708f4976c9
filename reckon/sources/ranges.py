"""Delimited files and JSON arrays read by byte ranges, however large a file is.

Spark's text source deals a file's ranges over tasks and says where each begins;
pieces of a range (lines, or what lies between commas) come in order. What a
range begins with, be it inside quotes or deep in an array, is not known to it.
So a first pass takes each range as a small machine: the state that it leaves
for each state that it could be entered with, and the records that begin on the
way. Machines of a file are put together in order by prefix sums, which gives
every range its first state and row number. The second pass reads records; the
parts of those that lie across ranges meet by their row number.

What the driver holds, and sends to the tasks, is a few numbers for each range
(``spark.sql.files.maxPartitionBytes``), never what they hold. Smaller ranges
may be asked for; they grow with the files, so that there are no more than
``RANGES`` of them, up to that size.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import ship

#: Rows sent at once.
HELD = 4096
#: Ranges that all files are cut into, where a caller asks for smaller ones than Spark's; a range is a task of each pass.
RANGES = 256
#: A carriage return that no line feed follows ends a line too.
_RETURNS = re.compile("(?<=\r)(?!\n)")
_ENDS = re.compile("(?<=\n)|(?<=\r)(?!\n)")


def _pinned(spark: SparkSession, range_bytes: int | None) -> SparkSession:
    """A session with the same settings, in which files are cut alike whenever a plan runs: by default Spark looks at the cores that it has just then."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.files.minPartitionNum", spark.conf.get("spark.sql.files.minPartitionNum", None) or str(spark.sparkContext.defaultParallelism))
    if range_bytes:
        own.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
        own.conf.set("spark.sql.files.openCostInBytes", str(max(1, range_bytes // 16)))
    return own


def _grown(spark: SparkSession, path: str | list[str], range_bytes: int) -> int:
    """``range_bytes``, or as many bytes as leave no more than ``RANGES`` ranges, up to Spark's own size."""
    size, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()).groups()
    most = int(size) << 10 * " kmgtp".index(unit or " ")
    held = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("bytes")).first()["bytes"]  # listed, not read
    return max(range_bytes, min(most, -(-(held or 0) // RANGES)))


def pieces(spark: SparkSession, path: str | list[str], separator: str, range_bytes: int | None = None) -> DataFrame:
    """file, block (first byte of its range) and value of the pieces between separators; a range has ``range_bytes`` at least."""
    ship(spark)
    range_bytes = _grown(spark, path, range_bytes) if range_bytes else None
    text = _pinned(spark, range_bytes).read.option("lineSep", separator).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.col("_metadata.file_size").alias("size"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, Iterator[pa.Array]]]:
    """file, block, size and the arrays of pieces of each range; its pieces are neighbours."""
    held: list = [None, iter(batches)]  # a batch that waits

    def following() -> pa.RecordBatch | None:
        out, held[0] = held[0], None
        return out if out is not None and out.num_rows else next((b for b in held[1] if b.num_rows), None)

    def of(file: str, block: int) -> Iterator[pa.Array]:
        while (batch := following()) is not None:
            blocks, files = batch.column(1).to_numpy(), batch.column(0)
            other = np.flatnonzero((blocks != block) | ~pc.equal(files, file).to_numpy(zero_copy_only=False))
            end = int(other[0]) if len(other) else batch.num_rows
            if end:
                yield batch.column(2).slice(0, end)
            if end < batch.num_rows:
                held[0] = batch.slice(end)
                return

    while (batch := following()) is not None:
        held[0] = batch
        file, block = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
        own = of(file, block)
        yield file, block, batch.column(3)[0].as_py(), own
        for _ in own:  # what was not read
            pass


# --- delimited -----------------------------------------------------------------------------------------------


def _lines(values: list[str], first: bool) -> Iterator[str]:
    """Lines with their ends, as files read with ``newline=""`` give them."""
    for n, value in enumerate(values):
        if first and n == 0:
            value = value.removeprefix("﻿")
        line = value + "\n"
        if "\r" in value[:-1]:
            yield from _RETURNS.split(line)
        else:
            yield line


def _stays_quoted(line: str, quoted: bool, separator: str) -> bool:
    """Whether the csv module is inside quotes behind the line: if so, it takes a further line into the same row."""
    return sum(1 for _ in csv.reader(['"' + line if quoted else line, "end"], delimiter=separator)) == 1


def _wide_fields() -> None:
    csv.field_size_limit(sys.maxsize)


def _line_machines(separator: str) -> Callable:
    """For each range: the state left (1 inside quotes) and the rows begun, for both states that it could be entered with; bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _wide_fields()
        out = []
        for file, block, size, arrays in _runs(batches):
            state, rows, length = [False, True], [0, 0], 0
            for at, array in enumerate(arrays):
                length += pc.sum(pc.binary_length(array)).as_py() + len(array)
                odd = pc.or_(pc.match_substring(array, '"'), pc.match_substring(array, "\r")).to_numpy(zero_copy_only=False)
                last = 0
                for k in [*np.flatnonzero(odd).tolist(), len(array)]:
                    for entered in (0, 1):
                        rows[entered] += 0 if state[entered] else k - last
                    if k < len(array):
                        for line in _lines([array[k].as_py()], block == 0 and at == 0 and k == 0):
                            for entered in (0, 1):
                                rows[entered] += not state[entered]
                            state = [_stays_quoted(line, s, separator) if '"' in line else s for s in state]
                    last = k + 1
            out.append((file, block, size, length, *map(int, state), *rows))
        kinds = (pa.string(), *[pa.int64()] * 7)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 8, kinds)], names=["file", "block", "size", "length", "out0", "out1", "rows0", "rows1"])

    return run


def line_ranges(text: DataFrame, separator: str) -> DataFrame:
    """file, block, entered (1 inside quotes), row (rows begun before), left, whole (the file ends in a line end)."""
    made = text.mapInArrow(_line_machines(separator), "file string, block long, size long, length long, out0 long, out1 long, rows0 long, rows1 long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a range that is left alike from both states sets the state, one that swaps them turns it, others keep it
    fixed = F.when(F.col("out0") == F.col("out1"), F.col("out0"))
    turns = made.withColumn("turn", ((F.col("out0") == 1) & (F.col("out1") == 0)).cast("long")).withColumn("turned", F.sum("turn").over(Window.partitionBy("file").orderBy("block")))
    last = F.last(F.when(fixed.isNotNull(), F.struct(fixed.alias("state"), "turned")), ignorenulls=True).over(before)
    entered = turns.withColumn("last", last).withColumn(
        "entered", F.pmod(F.coalesce(F.col("last.state"), F.lit(0)) + F.col("turned") - F.col("turn") - F.coalesce(F.col("last.turned"), F.lit(0)), F.lit(2))
    )
    begun = F.when(F.col("entered") == 0, F.col("rows0")).otherwise(F.col("rows1"))
    left = F.when(F.col("entered") == 0, F.col("out0")).otherwise(F.col("out1"))
    length = F.sum("length").over(Window.partitionBy("file"))  # with a line end behind each line; a byte order mark of three bytes is not in it
    whole = (length == F.col("size")) | (length == F.col("size") - 3)
    return entered.select("file", "block", "entered", F.coalesce(F.sum(begun).over(before), F.lit(0)).alias("row"), left.alias("left"), whole.alias("whole"))


def _read_lines(separator: str, known: dict, parts: bool) -> Callable:
    """The whole rows of each range (file, row, cells), or with ``parts`` its pieces of rows that reach into other ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _wide_fields()
        for file, block, _, arrays in _runs(batches):
            entered, row, left, _ = known.value[file, block]
            if parts and not (entered or left):
                continue
            quoted, open_, lines, first = bool(entered), [], [], row + 1
            across, out = bool(entered), []
            for at, array in enumerate(arrays):
                for line in _lines(array.to_pylist(), block == 0 and at == 0):
                    if not quoted:
                        row += 1
                    open_.append(line)
                    if '"' in line:
                        quoted = _stays_quoted(line, quoted, separator)
                    if quoted:
                        continue
                    if across:
                        out.append((file, row, block, "".join(open_)))
                        across = False
                    else:
                        lines.extend(open_)
                    open_ = []
                    if len(lines) >= HELD:
                        if not parts:
                            yield _rows(file, first, csv.reader(lines, delimiter=separator))
                        lines, first = [], row + 1
            if open_:
                out.append((file, row, block, "".join(open_)))
            if parts:
                yield _parts(out)
            elif lines:
                yield _rows(file, first, csv.reader(lines, delimiter=separator))

    return run


def _rows(file: str, first: int, cells: Iterator[list[str]]) -> pa.RecordBatch:
    held = list(cells)
    return pa.RecordBatch.from_arrays([pa.array([file] * len(held), pa.string()), pa.array(range(first, first + len(held)), pa.int64()), pa.array(held, pa.list_(pa.string()))], names=["file", "row", "cells"])


def _parts(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, kinds)], names=["file", "row", "block", "text"])


PARTS = "file string, row long, block long, text string"


def _joined(parts: DataFrame, between: str) -> DataFrame:
    """file, row, text of rows whose parts lie in several ranges."""
    lists = parts.groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    return lists.select("file", "row", F.array_join(F.transform("parts", lambda p: p["text"]), between).alias("text"))


def delimited(spark: SparkSession, path: str, separator: str = ",", range_bytes: int | None = None) -> DataFrame:
    """file, row (from 1), cells of all rows of UTF-8 files, as Python's csv module reads them."""
    text = pieces(spark, path, "\n", range_bytes)
    found = line_ranges(text, separator).collect()  # a row a range
    known = spark.sparkContext.broadcast({(r["file"], r["block"]): (r["entered"], r["row"], r["left"], r["whole"]) for r in found})
    rows = text.mapInArrow(_read_lines(separator, known, False), "file string, row long, cells array<string>")
    if not any(r["entered"] or r["left"] for r in found):
        return rows
    ends = spark.createDataFrame(sorted({(r["file"], r["whole"]) for r in found}), "file string, whole boolean")
    joined = _joined(text.mapInArrow(_read_lines(separator, known, True), PARTS), "").join(F.broadcast(ends), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _wide_fields()
        for batch in batches:
            for file, row, value, whole in zip(*(batch.column(k).to_pylist() for k in range(4))):
                lines = [line for line in _ENDS.split(value) if line]
                if not whole and _unclosed(lines, separator):  # the file's last row, whose line end is ours
                    lines[-1] = lines[-1][:-1]
                yield _rows(file, row, csv.reader(lines, delimiter=separator))

    return rows.unionByName(joined.select("file", "row", "text", "whole").mapInArrow(run, "file string, row long, cells array<string>"))


def _unclosed(lines: list[str], separator: str) -> bool:
    return sum(1 for _ in csv.reader([*lines, "end"], delimiter=separator)) == 1


# --- JSON arrays ---------------------------------------------------------------------------------------------

_QUOTE, _SLASH = 34, 92
_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1


def _scanned(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At each piece's end: quotes seen (modulo 2), and the depth won outside and inside of strings if the array is entered outside of one."""
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = offsets[1:] - offsets[0]
    slash = raw == _SLASH
    # a quote is escaped behind an odd run of backslashes
    places = np.arange(len(raw))
    run = places - np.maximum.accumulate(np.where(slash, -1, places)) if len(raw) else places
    run = np.concatenate([[0], run[:-1]]) if len(raw) else run
    quote = (raw == _QUOTE) & (run % 2 == 0)
    parity = np.concatenate([[0], np.cumsum(quote) % 2])
    step = _STEP[raw]
    outside = np.concatenate([[0], np.cumsum(np.where(parity[1:] == 0, step, 0))])
    inside = np.concatenate([[0], np.cumsum(np.where(parity[1:] == 1, step, 0))])
    return parity[ends], outside[ends], inside[ends]


def _array_machines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range, entered outside and inside of a string: whether it is left inside, the depth won, and at how many pieces' ends outside of strings it has won which depth; the first character of a file."""
    out = []
    for file, block, _, arrays in _runs(batches):
        flip, won, counts, root, seen = 0, [0, 0], [{}, {}], None, False
        for array in arrays:
            if block == 0 and not seen:
                start = "".join(array.slice(0, 1).to_pylist()).removeprefix("﻿").lstrip()
                root, seen = start[:1] or None, True
            parity, outside, inside = _scanned(array)
            deep = (outside, inside) if flip == 0 else (inside, outside)
            for entered in (0, 1):
                free = ((parity + flip) % 2) == entered
                level, many = np.unique(won[entered] + deep[entered][free], return_counts=True)
                for v, m in zip(level.tolist(), many.tolist()):
                    counts[entered][v] = counts[entered].get(v, 0) + m
            won = [won[0] + int(deep[0][-1]), won[1] + int(deep[1][-1])]
            flip = (flip + int(parity[-1])) % 2
        out.append((file, block, root, flip, *won, *(list(c.items()) for c in counts)))
    kinds = (pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3, *[pa.map_(pa.int64(), pa.int64())] * 2)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 8, kinds)], names=["file", "block", "root", "flip", "won0", "won1", "at0", "at1"])


def array_ranges(text: DataFrame) -> DataFrame:
    """file, block, root, entered (1 inside a string), deep (the depth there), row (elements ended before) and last (elements of the file)."""
    made = text.mapInArrow(_array_machines, "file string, block long, root string, flip long, won0 long, won1 long, at0 map<long,long>, at1 map<long,long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    outside = F.col("entered") == 0
    entered = made.withColumn("entered", F.pmod(sums("flip"), F.lit(2))).withColumn("won", F.when(outside, F.col("won0")).otherwise(F.col("won1")))
    deep = entered.withColumn("deep", sums("won")).withColumn("at", F.when(outside, F.col("at0")).otherwise(F.col("at1")))
    ended = deep.withColumn("ended", F.coalesce(F.try_element_at("at", F.lit(1) - F.col("deep")), F.lit(0)))  # commas at depth 1
    every = Window.partitionBy("file")
    return ended.select("file", "block", F.max("root").over(every).alias("root"), "entered", "deep", sums("ended").alias("row"), (F.sum("ended").over(every) + 1).alias("last"))


def _read_items(known: dict, parts: bool) -> Callable:
    """The whole elements of each range of array files (file, row, text), or with ``parts`` those that reach into other ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, _, arrays in _runs(batches):
            root, entered, deep, row = known.value[file, block]
            if root != "[":
                continue
            open_, across = [], block > 0  # an element that an earlier range began
            for array in arrays:
                parity, outside, inside = _scanned(array)
                free = (parity + entered) % 2 == 0
                won = deep + (outside if entered == 0 else inside)
                ends = np.flatnonzero(free & (won == 1)).tolist()
                deep, entered = int(won[-1]), (entered + int(parity[-1])) % 2
                values, at, out = array.to_pylist(), 0, []
                for end in ends:
                    open_.extend(values[at : end + 1])
                    if across == parts:
                        out.append((file, row + 1, block, ",".join(open_)))
                    open_, across, at, row = [], False, end + 1, row + 1
                open_.extend(values[at:])
                yield _parts(out)
            if open_ and parts:  # what the next range ends, or the last element
                yield _parts([(file, row + 1, block, ",".join(open_))])

    return run


def json_items(spark: SparkSession, path: str, range_bytes: int | None = None) -> tuple[DataFrame, list[str]]:
    """file, row, text of the elements of files whose root is an array; and the other files."""
    text = pieces(spark, path, ",", range_bytes)
    found = array_ranges(text).collect()  # a row a range
    known = spark.sparkContext.broadcast({(r["file"], r["block"]): (r["root"], r["entered"], r["deep"], r["row"]) for r in found})
    whole = text.mapInArrow(_read_items(known, False), PARTS).select("file", "row", "text")
    items = whole.unionByName(_joined(text.mapInArrow(_read_items(known, True), PARTS), ","))
    last = spark.createDataFrame(sorted({(r["file"], r["last"]) for r in found if r["root"] == "["}), "file string, last long")
    item = F.col("text")
    item = F.when(F.col("row") == 1, F.regexp_replace(item, r"^[\s\x{FEFF}]*\[", "")).otherwise(item)
    item = F.when(F.col("row") == F.col("last"), F.regexp_replace(item, r"\]\s*$", "")).otherwise(item)
    items = items.join(F.broadcast(last), "file").select("file", "row", F.trim(item, F.lit(" \t\r\n")).alias("text"))
    return items.where("text <> ''"), sorted({r["file"] for r in found if r["root"] != "["})
