"""Token files in Simple-8b words.

A shard holds the ids of a range of documents in ascending doc_id order:

    8 bytes   magic
    words     unsigned 64-bit, little-endian: 4 bits of selector, 60 of payload
    index     for each block: offset of its first word, its number of words and of ids
              for each document: its id, whether that is null, its number of ids
    footer    numbers of words, blocks and documents, and the magic again

A selector packs a fixed count of ids in equal widths, first id in the lowest
bits. Selector 0 escapes: the next word holds one id of any size. Blocks of at
most ``BLOCK`` ids start at a word of their own, so that blocks decode apart
and each with vectorised operations. Tasks write a shard under a name of their
own and rename it, so a repeated task leaves the same file.

Defined results: a null text is empty, so its document is the end id alone;
null doc_ids come first; rows of equal doc_id are ordered by text; an empty
table gives no documents. Other columns are not written.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import prepare, shared_path, slices, table, text_column, tidied
from .pretokens import BLANK, CACHE, KINDS, SLICE, PieceCache, encoded

MAGIC = b"RKS8B001"
#: Ids in a block at most; it bounds what a reader must decode to reach one document.
BLOCK = 1 << 16
#: Ids in a word and their width, by selector from 1 on; selector 0 is the escape.
PACKS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNTS = np.array([1, *(c for c, _ in PACKS)], np.int64)
_FOOTER = struct.Struct("<QQQ8s")


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id (1 for 0): the exponent of its double, which is exact once ids beyond 2**52 are shifted."""
    big = ids >> np.uint64(52) > 0
    low = np.where(big, ids >> np.uint64(12), ids) if big.any() else ids
    out = np.maximum((low.astype(np.float64).view(np.int64) >> 52) - 1022, 1).astype(np.uint8)
    out[big] += 12
    return out


def pack(ids: np.ndarray) -> np.ndarray:
    """The Simple-8b words of unsigned 64-bit ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    width = _widths(ids)
    choice = np.zeros(n, np.int64)
    most = {1: width}

    def window(count: int) -> np.ndarray:
        """The largest width among ``count`` ids from each place; a window past the end never fits."""
        if count not in most:
            half = 1 << (count.bit_length() - 1)
            if half == count:
                half //= 2
            a, b = window(half), window(count - half)
            out = np.full(n, 255, np.uint8)
            if n >= count:
                out[: n - count + 1] = np.maximum(a[: n - count + 1], b[half : half + n - count + 1])
            most[count] = out
        return most[count]

    for selector in range(len(PACKS), 0, -1):
        count, bits = PACKS[selector - 1]
        if count <= n:
            choice[window(count) <= bits] = selector
    step = _COUNTS[choice].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    first = np.array(starts, np.int64)
    picked = choice[first]
    place = np.arange(len(first)) + np.concatenate([[0], np.cumsum(picked == 0)[:-1]])
    out = np.zeros(len(first) + int((picked == 0).sum()), np.uint64)
    for selector, (count, bits) in enumerate(PACKS, 1):
        own = np.flatnonzero(picked == selector)
        if len(own):
            word = np.full(len(own), selector, np.uint64) << np.uint64(60)
            for k in range(count):
                word |= ids[first[own] + k] << np.uint64(k * bits)
            out[place[own]] = word
    escaped = np.flatnonzero(picked == 0)
    out[place[escaped] + 1] = ids[first[escaped]]
    return out


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of Simple-8b words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for at in np.flatnonzero(selector == 0).tolist():  # escapes are rare; the word after one is not a selector
        if not raw[at]:
            raw[at + 1] = True
    selector[raw] = 0  # an escaped id may hold any bits there
    count = np.where(raw, 0, _COUNTS[selector])
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(begin[-1], np.uint64)
    for s, (n, bits) in enumerate(PACKS, 1):
        own = np.flatnonzero((selector == s) & ~raw)
        mask = np.uint64((1 << bits) - 1)
        for k in range(n if len(own) else 0):
            out[begin[own] + k] = (words[own] >> np.uint64(k * bits)) & mask
    own = np.flatnonzero((selector == 0) & ~raw)
    if len(own):
        out[begin[own]] = words[own + 1]
    return out


class ShardWriter:
    """Appends documents to a shard; only the ids of an unfinished block are held."""

    def __init__(self, stream):
        self.stream, self.held, self.n_held, self.at = stream, [], 0, 0
        self.blocks: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 16 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for at in range(0, whole, BLOCK):
            part = ids[at : at + BLOCK]
            words = pack(part)
            self.stream.write(words.astype("<u8").tobytes())
            self.blocks.append((self.at, len(words), len(part)))
            self.at += len(words)
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        self.stream.write(np.array(self.blocks, "<u8").tobytes())
        self.stream.write(np.array([x or 0 for x in self.doc_ids], "<i8").tobytes())
        self.stream.write(np.array([x is None for x in self.doc_ids], "<u1").tobytes())
        self.stream.write(np.array(self.sizes, "<u8").tobytes())
        self.stream.write(_FOOTER.pack(self.at, len(self.blocks), len(self.sizes), MAGIC))


class ShardReader:
    """Reads a shard's index at once and its blocks as they are asked for."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        stream.seek(size - _FOOTER.size)
        n_words, n_blocks, self.n_docs, magic = _FOOTER.unpack(stream.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        stream.seek(8 + 8 * n_words)
        self.blocks = np.frombuffer(stream.read(24 * n_blocks), "<u8").reshape(-1, 3).astype(np.int64)
        self.doc_ids = np.frombuffer(stream.read(8 * self.n_docs), "<i8")
        self.null = np.frombuffer(stream.read(self.n_docs), "<u1").astype(bool)
        self.sizes = np.frombuffer(stream.read(8 * self.n_docs), "<u8").astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.blocks[:, 2])])

    def block(self, k: int) -> np.ndarray:
        at, n, _ = self.blocks[k]
        self.stream.seek(8 + 8 * int(at))
        return unpack(np.frombuffer(self.stream.read(8 * int(n)), "<u8"))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start in the shard, ids, holding the ids of one document and one block."""
        block, held, start = 0, np.zeros(0, np.uint64), 0
        for doc_id, null, size in zip(self.doc_ids.tolist(), self.null.tolist(), self.sizes.tolist()):
            parts, have = [held], len(held)
            while have < size:
                parts.append(self.block(block))
                have += len(parts[-1])
                block += 1
            ids = np.concatenate(parts) if len(parts) > 1 else held
            held = ids[size:]
            yield None if null else doc_id, start, ids[:size]
            start += size


class LibraryTokenizer:
    """A byte-level BPE of the tokenizers library; each distinct piece of text is encoded once by a worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.line_end = self._batch(["\n"])[0]
        self.cache = PieceCache(self.pieces, 3 * CACHE)

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces end to end, and how many each has.

        A line end before and after a piece that ends in no white space is a piece of its own, so such
        pieces are encoded as the lines of one text; the line end's id tells them apart.
        """
        last = np.array([r[-1] for r in raws], np.uint8)
        solid = KINDS[last] != BLANK
        if len(self.line_end) != 1 or not solid.any():
            ids = self._batch([r.decode() for r in raws])
            return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)
        lines = np.array(self._batch([b"\n".join([r for r, x in zip(raws, solid.tolist()) if x]).decode()])[0] + self.line_end, np.uint32)
        ends = np.flatnonzero(lines == self.line_end[0])
        if solid.all():
            return lines[lines != self.line_end[0]], np.diff(ends, prepend=-1) - 1
        blank = self._batch([raws[k].decode() for k in np.flatnonzero(~solid).tolist()])
        many = np.zeros(len(raws), np.int64)
        many[solid], many[~solid] = np.diff(ends, prepend=-1) - 1, [len(x) for x in blank]
        whose = np.repeat(solid, many)
        out = np.zeros(len(whose), np.uint32)
        out[whose], out[~whose] = lines[lines != self.line_end[0]], [i for x in blank for i in x]
        return out, many

    def general(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: pa.Array | list) -> list[np.ndarray]:
        return encoded(texts, self.cache, self.general, spaced=True, lower=False)


@functools.lru_cache(2)
def load(path: str) -> LibraryTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return LibraryTokenizer(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> list[tuple[str, int, int]]:
    """Writes shards under ``folder`` and returns (file, documents, ids) of each, in order of doc_id.

    ``tokenizer`` must exist on every node. One row for each shard reaches the driver.
    """
    prepare(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        shard = TaskContext.get().partitionId()
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root)
        name = f"{root}/shard-{shard:06d}.s8b"
        draft = f"{name}.{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as stream:
            writer = ShardWriter(stream)
            for batch in batches:
                for part in slices(batch, limit=SLICE):
                    ids = bpe.encode(text_column(part))
                    for doc_id, x in zip(part.column(0).to_pylist(), ids):
                        writer.add(doc_id, np.append(x, np.uint32(end_id)))
            writer.close()
        files.move(draft, name)
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "file": [name], "docs": [len(writer.sizes)], "ids": [sum(writer.sizes)]},
            pa.schema([("shard", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]),
        )

    rows = ordered.mapInArrow(tidied(run), "shard long, file string, docs long, ids long").collect()
    return [(r["file"], r["docs"], r["ids"]) for r in sorted(rows, key=lambda r: r["shard"]) if r["docs"]]


def read(spark: SparkSession, folder: str, shards: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit) from the shards."""
    prepare(spark)
    starts = np.concatenate([[0], np.cumsum([n for _, _, n in shards])]).tolist()
    listed = spark.createDataFrame([(f, s) for (f, _, _), s in zip(shards, starts)], "file string, base long")
    listed = listed.repartition(max(1, len(shards)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input_file(name) as stream:
                    rows, size = [], 0
                    for doc_id, start, ids in ShardReader(stream).documents():
                        rows.append((doc_id, base + start, ids.astype("<u4").tobytes()))
                        size += len(ids)
                        if size > 1 << 20:
                            yield _rows(rows)
                            rows, size = [], 0
                    yield _rows(rows)

    return listed.mapInArrow(tidied(run), "doc_id long, start long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "ids"])


def checksum(ids: bytes) -> int:
    return zlib.crc32(ids)


def op3_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files read back."""
    folder = shared_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    shards = write(docs, tokenizer or vocabulary_path(), folder)
    out = read(spark, folder, shards)
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", "start", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
