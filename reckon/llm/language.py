"""Language identification by bit-sliced Bloom filters over byte n-grams.

Every slot of the filter holds a bit for each language, in as many words of 64
bits as the languages need, so ANDing the slots of
an n-gram gives all languages that contain it. A text's n-grams are counted
for each language by those bits; each count is corrected for the language's
false-positive rate, and the language with the largest share of n-grams wins.

Fitted on a bounded sample of labelled rows (``SAMPLE`` a language) of the
training part. Defined results: ``und`` with score 0 for a null text or one
without a letter; ties go to the language first in code-point order; with no
training rows every text is ``und``; languages are lower-cased nowhere, texts
are. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import mixed, prepare, slices, table, text_bytes, text_column, tidied

#: Rows sampled for each language to fit the filter.
SAMPLE = 600
#: Bytes in an n-gram, slots in the filter, and hash functions.
GRAM, SLOTS, HASHES = 4, 1 << 20, 3
#: Languages in a word of a slot, and languages whose samples are on the driver at once.
WORD = 64
#: An n-gram belongs to a language if its rate there is at least this share of its highest rate.
SHARE = 0.25
_LETTER = regex.compile(r"\p{L}")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2, F.lit(False))


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all byte n-grams of each row and where each row's begin."""
    many = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(many)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    value = np.zeros(len(raw) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        value = (value << np.uint64(8)) | raw[k : len(raw) - GRAM + 1 + k]
    if len(many) > 1:
        inside = np.ones(len(value), bool)
        for k in range(1, GRAM):
            edge = offsets[1:-1] - k
            inside[edge[(edge >= 0) & (edge < len(value))]] = False
        value = value[inside]
    return mixed(value), begin


#: Sampled texts of a language from which on n-grams seen once are left out; with fewer, all are learned.
FEW = 50


def _slot(hashes: np.ndarray, k: int) -> np.ndarray:
    return ((hashes >> np.uint64(20 * k)) % np.uint64(SLOTS)).astype(np.int64)


def lowered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.array([f" {x.lower()} " if x else "" for x in texts], pa.string()))


def fit(samples: Iterable[tuple[str, list[str]]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the filter's slots (a row for each ``WORD`` languages), and each language's false-positive rate."""
    by = {}
    for name, texts in samples:
        found, _ = grams(*lowered(texts))
        gram, count = np.unique(found, return_counts=True)
        often = count > (1 if len(texts) >= FEW else 0)
        by[name] = (gram[often], count[often] / max(1, count.sum()))
    names = sorted(by)
    counted = [by[name] for name in names]
    every = np.unique(np.concatenate([g for g, _ in counted])) if counted else np.zeros(0, np.uint64)
    top = np.zeros(len(every))
    for gram, rate in counted:
        at = np.searchsorted(every, gram)
        top[at] = np.maximum(top[at], rate)
    filled = np.zeros((-(-len(names) // WORD), SLOTS), np.uint64)
    for at, (gram, rate) in enumerate(counted):
        own = gram[rate >= SHARE * top[np.searchsorted(every, gram)]]
        for k in range(HASHES):
            filled[at // WORD, _slot(own, k)] |= np.uint64(1 << at % WORD)
    fill = np.array([np.count_nonzero(filled[at // WORD] & np.uint64(1 << at % WORD)) / SLOTS for at in range(len(names))])
    width = np.uint8 if len(names) <= 8 else np.uint64
    return names, filled.astype(width), fill**HASHES


def shares(model, texts: list[str | None]) -> np.ndarray:
    """For each text and language, the share of n-grams in the language, corrected for false positives."""
    names, filled, false = model
    found, begin = grams(*lowered(texts))
    slots = [_slot(found, k) for k in range(HASHES)]
    many = np.maximum(np.diff(begin), 1)
    out = np.zeros((len(texts), len(names)))
    for word, held in enumerate(filled):
        bits = held[slots[0]]
        for slot in slots[1:]:
            bits = bits & held[slot]
        for at in range(word * WORD, min(len(names), (word + 1) * WORD)):
            hit = np.concatenate([[0], np.cumsum((bits >> bits.dtype.type(at % WORD)) & bits.dtype.type(1), dtype=np.int64)])
            out[:, at] = (hit[begin[1:]] - hit[begin[:-1]]) / many
    return np.clip((out - false) / np.maximum(1 - false, 1e-9), 0, 1)


def train(docs: DataFrame, sample: int = SAMPLE):
    """The model from a sample of about ``sample`` rows of each language, chosen by hash."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    names = sorted(sizes)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30)) / float(1 << 30)

    def samples() -> Iterator[tuple[str, list[str]]]:
        for k in range(0, len(names), WORD):
            some = names[k : k + WORD]
            rate = F.element_at(F.create_map(*[F.lit(x) for name in some for x in (name, min(1.0, sample / sizes[name]))]), F.col("lang"))
            rows = known.where(F.col("lang").isin(some) & (draw < rate)).select("lang", "text").limit(3 * sample * len(some)).collect()
            by: dict[str, list[str]] = {name: [] for name in some}
            for r in rows:
                by[r["lang"]].append(r["text"])
            yield from ((name, texts) for name, texts in by.items() if texts)

    return fit(samples())


def identify(docs: DataFrame, model) -> DataFrame:
    """``docs`` with lang_pred and lang_score."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value[0]
        for batch in batches:
            for part in slices(batch):
                texts = text_column(part).to_pylist()
                plain = np.array([bool(x and _LETTER.search(x)) for x in texts], bool)
                pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                if names:
                    got = shares(shared.value, texts)
                    best = got.argmax(1)
                    top = got[np.arange(len(texts)), best]
                    pred[plain] = np.array(names, object)[best[plain]]
                    score[plain] = top[plain]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                    names=[*part.schema.names, "lang_pred", "lang_score"],
                )

    schema = docs.select(*own).schema.add("lang_pred", "string").add("lang_score", "double")
    return docs.select(*own).mapInArrow(tidied(run), schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out().alias("held_out"), F.col("lang_pred"), F.col("lang_score").alias("score"))
