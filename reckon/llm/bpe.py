"""BPE encoding with forced boundaries, and decoding.

A pair of bytes that occurs inside no token of the vocabulary can never be
merged across, so the encoder cuts there (as it does between the pieces of the
pre-tokeniser), encodes the fragments independently and concatenates: all new
fragments of a batch merge side by side, and equal words are encoded once while
a worker remembers them.

Defined results: a null or empty text has no ids and decodes to an empty text;
special tokens written in a text become their ids; ids beyond the vocabulary
are skipped by decoding. Columns ``ids`` and ``decoded`` of the input are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import prepare, slices, table, text_column, tidied
from .pretokens import SLICE, PieceCache, encoded

_END = "</w>"
#: The rank of a pair that never merges, slots of the table of merges (as a power of two), and the hash's factor.
NEVER, _TABLE, _SPREAD = (1 << 31) - 1, 18, np.int64(0x1E3779B97F4A7C15)


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself if printable, else the next free from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class WordBPE:
    """A byte-level BPE vocabulary with word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, signs = spec["model"]["vocab"], byte_signs()
        self.first = np.array([vocab[s] for s in signs], np.int64)
        self.final = np.array([vocab[s + _END] for s in signs], np.int64)
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self._tabulate([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.names = {i: t.encode() for t, i in (*vocab.items(), *self.special.items())}
        self.path, self.library = path, None
        self.byte = {s: b for b, s in enumerate(signs)}
        self.inside = np.zeros((256, 256), bool)
        for token in vocab:
            raw = [self.byte[c] for c in token.removesuffix(_END)]
            self.inside[raw[:-1], raw[1:]] = True
        self.cache = PieceCache(self.pieces)
        self.shown = pa.array([self.names.get(i) for i in range(max(self.names) + 1)], pa.binary())

    def _tabulate(self, merges: list[tuple[int, int, int]]) -> None:
        """Pairs, their ranks and what they become, in an open hash table."""
        self.keys = np.full(1 << _TABLE, -1, np.int64)
        self.rank = np.full(1 << _TABLE, NEVER, np.int32)
        self.into = np.zeros(1 << _TABLE, np.int64)
        for rank, (a, b, both) in enumerate(merges):
            key = a << 32 | b
            slot = (key * int(_SPREAD) % (1 << 64)) >> (64 - _TABLE)
            while self.keys[slot] >= 0:
                slot = (slot + 1) % (1 << _TABLE)
            self.keys[slot], self.rank[slot], self.into[slot] = key, rank, both

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NEVER`` without one) of each pair of ids, and its place in the table of merges."""
        key = left.astype(np.int64) << 32 | right
        slot = (key * _SPREAD) >> (64 - _TABLE) & ((1 << _TABLE) - 1)
        found = self.keys[slot]
        odd = np.flatnonzero((found != key) & (found >= 0))
        while len(odd):  # taken by another pair: the next slot
            slot[odd] = (slot[odd] + 1) & ((1 << _TABLE) - 1)
            found[odd] = self.keys[slot[odd]]
            odd = odd[(found[odd] != key[odd]) & (found[odd] >= 0)]
        return self.rank[slot], slot

    def merged(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged ids of fragments that lie end to end, and how many each has.

        In each round every fragment merges its pair of lowest rank wherever it occurs, left to right;
        fragments without a pair to merge are set aside.
        """
        whose = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(ids)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            inside = whose[1:] == whose[:-1]
            rank, slot = np.full(len(ids), NEVER, np.int32), np.zeros(len(ids), np.int64)
            at = np.flatnonzero(inside)
            rank[at], slot[at] = self._ranks(ids[at], ids[at + 1])
            first = np.concatenate([[0], np.flatnonzero(~inside) + 1])
            least = np.minimum.reduceat(rank, first)
            size = np.diff(first, append=len(ids))
            going = np.repeat(least < NEVER, size)
            if not going.all():
                done.append((ids[~going], whose[~going]))
            hit = going & (rank == np.repeat(least, size))
            where = np.flatnonzero(hit)
            touching = np.diff(where, prepend=-2) == 1  # a pair of equal ids may overlap itself
            if touching.any():
                run = np.maximum.accumulate(np.where(touching, 0, np.arange(len(where))))
                where = where[(np.arange(len(where)) - run) % 2 == 0]
            ids = ids.copy()
            ids[where] = self.into[slot[where]]
            going[where + 1] = False
            ids, whose = ids[going], whose[going]
        if not done:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        flat, owner = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        return flat[order].astype(np.uint32), np.bincount(owner, minlength=len(starts))

    def pieces(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised words end to end, each cut where the vocabulary forces a boundary, and how many each has."""
        size = np.array([len(r) for r in raws], np.int64)
        flat = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.cumsum(size)
        forced = np.ones(len(flat), bool)
        forced[1:] = ~self.inside[flat[:-1], flat[1:]]
        forced[ends[:-1]] = True
        ids = self.first[flat]
        ids[ends - 1] = self.final[flat[ends - 1]]
        starts = np.flatnonzero(forced)
        merged, many = self.merged(ids, starts)
        return merged, np.add.reduceat(many, np.searchsorted(starts, ends - size))

    def general(self, text: str) -> list[int]:
        """Ids of a text beyond the fast path: the library normalises and splits it, as its Unicode tables decide."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        out: list[int] = []
        for part in self.special_split.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                if words:
                    out.extend(self.pieces([bytes(map(self.byte.__getitem__, w)) for w, _ in words])[0].tolist())
        return out

    def encode(self, texts: pa.Array | list) -> list[np.ndarray]:
        return encoded(texts, self.cache, self.general, spaced=False, lower=True)

    def decode(self, ids: list[np.ndarray]) -> pa.Array:
        """The UTF-8 text of each row of ids."""
        sizes = [len(x) for x in ids]
        flat = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
        names = self.shown.take(pa.array(np.minimum(flat, len(self.shown) - 1)))
        inside = (flat < len(self.shown)) & names.is_valid().to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        if not inside.all():
            offsets = np.concatenate([[0], np.cumsum(inside)])[offsets]
            names = names.filter(pa.array(inside))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), names), b" ")


@functools.lru_cache(2)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids``: the ids of ``text`` as little-endian unsigned 32-bit integers. ``path`` must exist on every node."""
    prepare(docs.sparkSession)
    own = [c for c in docs.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                ids = [x.astype("<u4").tobytes() for x in bpe.encode(text_column(part))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], names=[*part.schema.names, "ids"])

    return docs.select(*own).mapInArrow(tidied(run), docs.select(*own).schema.add("ids", "binary"))


def decode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``decoded``: the tokens of ``ids``, joined by blanks as the vocabulary has no decoder."""
    prepare(docs.sparkSession)
    own = [c for c in docs.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            step = 100
            for at in range(0, len(column), step):
                text = bpe.decode([np.frombuffer(x or b"", "<u4") for x in column[at : at + step]])
                part = batch.slice(at, step)
                yield pa.RecordBatch.from_arrays([*part.columns, text.cast(pa.string())], names=[*part.schema.names, "decoded"])

    return docs.select(*own).mapInArrow(tidied(run), docs.select(*own).schema.add("decoded", "string"))


def digests(docs: DataFrame, path: str, own: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """``own`` columns, n_tokens, and the SHA-256 of the ids and of the text they decode to, of every document; with ``ids`` those too.

    One pass encodes and decodes, and no text leaves Python.
    """
    prepare(docs.sparkSession)
    held = docs.select(*own, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                coded = bpe.encode(part.column(len(own)).cast(pa.string()))
                raw = [x.astype("<u4").tobytes() for x in coded]
                shas = [pa.array([hashlib.sha256(x).hexdigest() for x in column], pa.string()) for column in (raw, bpe.decode(coded).to_pylist())]
                columns = [*part.columns[: len(own)], *([pa.array(raw, pa.binary())] if ids else []), pa.array([len(x) for x in coded], pa.int64()), *shas]
                yield pa.RecordBatch.from_arrays(columns, names=[*own, *(["ids"] if ids else []), "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = docs.select(*own).schema
    if ids:
        schema = schema.add("ids", "binary")
    return held.mapInArrow(tidied(run), schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string"))


def op4_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), path or vocabulary_path())
