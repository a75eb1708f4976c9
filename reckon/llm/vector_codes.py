"""Product codes of vectors, with the nearest codebook entry found in a tree per part.

Components become whole numbers and vectors are cut into equal parts. Each part
position has a codebook, whose entries are refined in rounds: every part goes to
its nearest entry, and an entry becomes the floor of its parts' mean. Entries
lie in a vantage-point tree per part position. A part first descends to the leaf
on its side of every vantage point, which gives a distance to beat; then all
nodes are visited that could hold an entry as near (not only nearer, as ties go
to the lower index). Distances to vantage points are rounded outwards and only
rule nodes out; entries are compared by whole squared distances.

Codebooks are bounded (``ENTRIES`` times the length) and sent to the tasks;
tasks return sums per entry and component, which Spark adds up.

Defined results: rows whose vector is null, empty, or holds null or non-finite
components are dropped, and so are those of another length than the commonest
multiple of ``PARTS`` (the shorter on a tie). Each remaining row counts and is
returned, repeated ones too; those without vec_id come last when the first
entries are chosen, and equal ids in order of their vectors. With fewer rows than ``ENTRIES`` codebooks
are shorter. Whole vectors whose squared length reaches 2**51 raise an error that
names their vec_id, as sums would not be exact. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import broadcast_if_small, prepare, stored, table, tidied
from .vectors import finite, matrix, whole

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Entries in a leaf of a tree at most.
LEAF = 8
#: Vectors handled at once inside a task.
HELD = 8192


class Node(NamedTuple):
    """Entries of a leaf, or a vantage entry with its two sides and the distances that they span."""

    entries: np.ndarray
    sides: tuple = ()
    low: tuple = ()
    high: tuple = ()


def _outwards(squares: np.ndarray) -> tuple[float, float]:
    """Square roots of the smallest and the largest, rounded down and up."""
    return float(np.nextafter(np.sqrt(float(squares.min())), -np.inf)), float(np.nextafter(np.sqrt(float(squares.max())), np.inf))


def grown(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The tree over ``entries`` (indexes, ascending) of a codebook of whole numbers."""
    entries = np.arange(len(book)) if entries is None else entries
    if len(entries) <= LEAF:
        return Node(entries)
    spread = ((book[entries] - book[entries].mean(0)) ** 2).sum(1)
    far = int(spread.argmax())  # an entry at the edge parts the others best
    rest = np.delete(entries, far)
    squares = ((book[rest] - book[entries[far]]) ** 2).sum(1)
    order = np.argsort(squares, kind="stable")
    halves = order[: len(order) // 2], order[len(order) // 2 :]
    spans = [_outwards(squares[h]) for h in halves]
    sides = tuple(grown(book, np.sort(rest[h])) for h in halves)
    return Node(entries[far : far + 1], sides, tuple(s[0] for s in spans), tuple(s[1] for s in spans))


class Search:
    """The nearest entries of many parts at once."""

    def __init__(self, book: np.ndarray, rows: np.ndarray):
        self.book, self.rows = book, rows
        self.square = np.full(len(rows), np.iinfo(np.int64).max)
        self.index = np.full(len(rows), len(book))

    def compare(self, live: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Compares the rows ``live`` with ``entries`` exactly; the squared distances to the first."""
        squares = ((self.rows[live][:, None] - self.book[entries]) ** 2).sum(2)
        pick = squares.argmin(1)  # the first of equals, and entries ascend
        least, index = squares[np.arange(len(live)), pick], entries[pick]
        better = (least < self.square[live]) | ((least == self.square[live]) & (index < self.index[live]))
        self.square[live[better]], self.index[live[better]] = least[better], index[better]
        return squares[:, 0]

    def descend(self, node: Node, live: np.ndarray) -> None:
        if not len(live):
            return
        first = self.compare(live, node.entries)
        if node.sides:
            near = np.sqrt(first) * 2 <= node.high[0] + node.low[1]
            self.descend(node.sides[0], live[near])
            self.descend(node.sides[1], live[~near])

    def bound(self, node: Node, live: np.ndarray) -> None:
        if not len(live):
            return
        first = np.sqrt(self.compare(live, node.entries))
        if node.sides:
            for side, low, high in zip(node.sides, node.low, node.high):
                reach = np.sqrt(self.square[live]) * (1 + 2.0**-48)
                visit = (low - first * (1 + 2.0**-50) <= reach) & (first * (1 - 2.0**-50) - high <= reach)
                self.bound(side, live[visit])


def nearest(book: np.ndarray, tree: Node, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, ties to the lower one, and the squared distance."""
    found, every = Search(book, rows), np.arange(len(rows))
    found.descend(tree, every)
    found.bound(tree, every)
    return found.index, found.square


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to about ``HELD`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= HELD:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _assigned(books: np.ndarray, trees: list[Node], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and squared distances, a column a part."""
    width = books.shape[2]
    found = [nearest(book, tree, rows[:, p * width : (p + 1) * width]) for p, (book, tree) in enumerate(zip(books, trees))]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """``books`` (part, entry, component) with each entry the floor of its parts' mean; unused ones stay."""
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast((books, [grown(b) for b in books]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)  # the last is the count
        for batch in _held(batches):
            whole_ = matrix(batch).astype(np.int64)
            index, _ = _assigned(*shared.value, whole_)
            for p in range(parts):
                np.add.at(total[p], index[:, p], np.column_stack([whole_[:, p * width : (p + 1) * width], np.ones(len(whole_), np.int64)]))
        flat = total.ravel()
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(flat[used])], names=["place", "value"])

    sums = rows.select("embedding").mapInArrow(tidied(run), "place int, value long")
    total = np.zeros(books.size // width * (width + 1), object)
    for r in sums.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        total[r["place"]] = int(r["value"])
    total = total.reshape(parts, entries, width + 1)
    out = books.copy()
    for p, e in zip(*np.nonzero(total[:, :, width])):
        out[p, e] = [s // total[p, e, width] for s in total[p, e, :width]]
    return out


def written(books: np.ndarray) -> str:
    """SHA-256 of the components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of ``rows`` under final codebooks."""
    shared = rows.sparkSession.sparkContext.broadcast((books, [grown(b) for b in books]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _held(batches):
            index, square = _assigned(*shared.value, matrix(batch).astype(np.int64))
            code = [r.tobytes().hex() for r in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(square.sum(1))], names=["vec_id", "label", "code", "error"])

    kept = rows.select("vec_id", "label", "embedding")
    return kept.mapInArrow(tidied(run), kept.select("vec_id", "label").schema.add("code", "string").add("error", "long"))


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of the usable rows; at most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    prepare(vectors.sparkSession)
    rows = vectors.where(finite()).select("vec_id", "label", whole(scale, 2.0**51).alias("embedding"))
    lengths = rows.groupBy(F.size("embedding").alias("size")).count().where(F.col("size") % parts == 0)
    common = lengths.orderBy(F.desc("count"), "size").first()
    size = common["size"] if common else parts
    rows = rows.where(F.size("embedding") == size)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    start = np.array([r["embedding"] for r in first], np.int64).reshape(len(first), parts, size // parts)
    books = start.transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        books = refined(rows, books)
    out = stored(codes(rows, books), "codes") if len(first) else codes(rows, books)
    by_label = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = out.join(broadcast_if_small(by_label), F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(written(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _round(k: int, last: bool = False) -> str:
    """SQL of one assignment to codebook ``b{k}``, and of the codebook that follows."""
    assigned = f"""
d{k} AS (SELECT x.row, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS s FROM x JOIN b{k} b ON x.part = b.part AND x.pos = b.pos GROUP BY ALL),
a{k} AS (SELECT row, part, arg_min(entry, s * 64 + entry) AS entry, min(s) AS s FROM d{k} GROUP BY row, part)"""
    if last:
        return assigned
    return assigned + f""",
b{k + 1} AS (
  SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN (
    SELECT x.part, a.entry, x.pos, CAST(sum(x.v) // count(*) - CASE WHEN sum(x.v) < 0 AND sum(x.v) % count(*) <> 0 THEN 1 ELSE 0 END AS BIGINT) AS v
    FROM x JOIN a{k} a ON x.row = a.row AND x.part = a.part GROUP BY ALL) m
  ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)"""


ORACLE = {
    "op12_vector_codes": f"""
WITH v AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) AS row,
    list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
u AS (SELECT row, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS i, len(e) // 16 AS w FROM v),
x AS (SELECT row, i // w AS part, i % w AS pos, v FROM u),
b0 AS (SELECT part, row - 1 AS entry, pos, v FROM x WHERE row <= 64),{_round(0)},{_round(1)},{_round(2, last=True)},
h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS sha FROM b2),
c AS (SELECT row, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(s) AS BIGINT) AS error FROM a2 GROUP BY row)
SELECT v.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h.sha AS codebooks_sha256
FROM v JOIN c USING (row), h"""
}
