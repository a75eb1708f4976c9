"""Toxicity by compression distance with two zstandard dictionaries.

One dictionary is trained on whole toxic texts, one on whole ordinary texts.
Every window of a text (two words and the blanks around them) is compressed with
the ordinary dictionary alone and with both; the bytes that the toxic one saves
are its compression distance. Windows that save ``theta`` bytes or more are
counted, and a logistic curve calibrated on labelled rows outside the
dictionaries' training turns counts into a score; theta is calibrated with it.

A toxic text is mostly ordinary, so the dictionaries are trained once more by
their own distances: the toxic one on the toxic rows' windows that the first pair
marks, and the ordinary one with the ordinary rows' windows that it marks
wrongly. Which windows are marked is decided by a threshold on the distance,
calibrated on the windows of the training rows.

zstandard stores very short inputs raw and seeks no match in the last bytes,
hence each window is followed by a tail that both dictionaries end with. A window
that has no run of 5 or 8 bytes (``OWN``) which only the toxic dictionary holds
counts as saving nothing, and is not compressed. Equal windows of a batch are
compressed once.

Fitted on a bounded sample of labelled rows (``TOXIC`` and ``ORDINARY``).
Defined results: a null text scores as an empty one; labels other than 0 and 1
are left out; without both classes the score is the share of toxic rows among
the sample (0 without labels). Other columns play no part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import _SPACE, prepare, slices, table, text_bytes, text_column, words, tidied
from .quality import held_out, known_labels, sampled

#: Labelled rows in the sample at most, toxic and ordinary.
TOXIC, ORDINARY = 2400, 4800
#: Words in a window.
WIDTH = 2
#: Dictionary sizes, room for ordinary windows that were marked wrongly, and the tail after each window.
TOXIC_BYTES, ORDINARY_BYTES, WRONG_BYTES, TAIL = 8192, 112640, 131072, bytes(range(200, 232))
#: Times that the dictionaries are trained again, and how many times as often a toxic row's window must be marked.
AGAIN, OFTENER = 4, 3.0
#: Shortest match that the compressor seeks, and the lengths of runs by which a window is seen to be worth compressing.
MATCH, OWN = 5, (5, 8)
_FIT = dict(window_log=18, min_match=MATCH, strategy=zstandard.STRATEGY_GREEDY, search_log=6, hash_log=17, chain_log=17, target_length=32)
_BARE = dict(write_content_size=False, write_dict_id=False, write_checksum=False)


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    theta: int
    weights: tuple[float, ...]  # bias, then of each of the features


def _grams(raw: np.ndarray, size: int) -> np.ndarray:
    """All runs of ``size`` bytes (eight at most) as whole numbers."""
    value = np.zeros(max(0, len(raw) - size + 1), np.uint64)
    for k in range(size if len(value) else 0):
        value = (value << np.uint64(8)) | raw[k : len(raw) - size + 1 + k]
    return value


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)


class Windows:
    """How many bytes the toxic dictionary saves on each window."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        settings = zstandard.ZstdCompressionParameters(**_FIT, **_BARE)
        self.both = []
        for content in (ordinary, ordinary + toxic):
            held = zstandard.ZstdCompressionDict(content + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=settings)
            self.both.append(zstandard.ZstdCompressor(dict_data=held, compression_params=settings))
        self.own = {}
        for size in OWN:
            only = np.setdiff1d(_grams(np.frombuffer(toxic, np.uint8), size), _grams(np.frombuffer(ordinary, np.uint8), size))
            slots = np.zeros(1 << 22, bool)
            slots[_slots(only)] = True
            self.own[size] = only, slots

    def compressed(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves on one window."""
        ordinary, both = self.both
        return max(0, len(ordinary.compress(window + TAIL)) - len(both.compress(window + TAIL)))

    def saved(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
        """Bytes saved on every window, where each text's begin, and what each compressed window saves."""
        raw, offsets = text_bytes(pa.array([f" {x.lower()} " if x else "" for x in texts], pa.string()))
        starts, ends, first = words(raw, offsets)
        many = -(-np.diff(first) // WIDTH)
        begin = np.concatenate([[0], np.cumsum(many)])
        if not begin[-1]:
            return np.zeros(0, np.int64), begin, {}
        row = np.repeat(np.arange(len(many)), many)
        at = first[row] + WIDTH * (np.arange(begin[-1]) - begin[row])
        low, high = starts[at] - 1, ends[np.minimum(at + WIDTH, first[row + 1]) - 1] + 1
        plain = np.where(_SPACE[raw], np.uint8(32), raw)
        some = np.zeros(begin[-1], bool)
        for size, (only, slots) in self.own.items():
            grams = _grams(plain, size)
            hit = slots[_slots(grams)]
            at_slot = np.flatnonzero(hit)
            hit[at_slot] = np.isin(grams[at_slot], only)
            hits = np.concatenate([[0], np.cumsum(hit)])
            last = len(hits) - 1
            some |= hits[np.clip(high - size + 1, 0, last)] > hits[np.minimum(low, last)]
        some = np.flatnonzero(some)
        data, known, out = plain.tobytes(), {}, np.zeros(begin[-1], np.int64)
        for k, a, b in zip(some.tolist(), low[some].tolist(), high[some].tolist()):
            window = data[a:b]
            value = known.get(window)
            if value is None:
                value = known[window] = self.compressed(window)
            out[k] = value
        return out, begin, known


def _dictionary(samples: list[bytes], size: int, d: int, k: int) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    samples = [x for x in samples if len(x) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, d=d, k=k).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b" "


def dictionaries(toxic: list[str], ordinary: list[str]) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of a toxic and an ordinary dictionary: trained on whole texts, then again on what the pair before marks."""
    there = _dictionary([x.lower().encode() for x in toxic], TOXIC_BYTES, 6, 16)
    base = here = _dictionary([x.lower().encode() for x in ordinary], ORDINARY_BYTES, 8, 32)
    yield there, here
    for _ in range(AGAIN):
        pair = Windows(there, here)
        (right, _, of_toxic), (wrong, _, of_ordinary) = pair.saved(toxic), pair.saved(ordinary)
        rates = [((right >= t).sum() / max(1, len(right)), (wrong >= t).sum() / max(1, len(wrong)), t) for t in range(1, 12)]
        theta = next((t for rate, other, t in rates if rate > 0 and rate >= OFTENER * other), None)
        if theta is None:
            return
        there = _dictionary([w for w, v in of_toxic.items() if v >= theta], TOXIC_BYTES, 6, 16)
        here = base + b"".join(w for w, v in of_ordinary.items() if v >= theta)[:WRONG_BYTES]
        yield there, here


def _features(saved: np.ndarray, first: np.ndarray, theta: int) -> np.ndarray:
    """Bias, logarithms of the windows that save theta and two bytes more, square root of the former's share, and the largest saving, of each text."""

    def counted(least: int) -> np.ndarray:
        hits = np.concatenate([[0], np.cumsum(saved >= least)])
        return (hits[first[1:]] - hits[first[:-1]]).astype(float)

    count = counted(theta)
    n = np.diff(first)
    most = np.zeros(len(n))
    filled = np.flatnonzero(n)
    if len(filled):
        most[filled] = np.maximum.reduceat(saved, first[:-1][filled])
    return np.stack([np.ones(len(n)), np.log1p(count), np.sqrt(count / np.maximum(n, 1)), np.clip(most, 0, 12) / 4, np.log1p(counted(theta + 2))], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights of a ridge-penalised logistic model by Newton's method, and its mean log loss."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Two thirds of each class train the dictionaries, the rest calibrates and chooses among the pairs and thresholds."""
    if not toxic or not ordinary:
        share = len(toxic) / (len(toxic) + len(ordinary)) if toxic else 0.0
        return Model(b"", b"", 0, (float(np.log((share + 1e-9) / (1 - share + 1e-9))),))
    n, m = -(-2 * len(toxic) // 3), -(-2 * len(ordinary) // 3)
    rest = (toxic[n:] or toxic) + (ordinary[m:] or ordinary)
    y = np.array([1.0] * len(toxic[n:] or toxic) + [0.0] * len(ordinary[m:] or ordinary))
    found = []
    for pair in dictionaries(toxic[:n], ordinary[:m]):
        saved, first, _ = Windows(*pair).saved(rest)
        found += [(*_logistic(_features(saved, first, t), y)[::-1], Model(*pair, t, ())) for t in range(1, 12)]
    _, weights, model = min(found, key=lambda f: f[0])
    return model._replace(weights=tuple(weights.tolist()))


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, ordinary: int = ORDINARY) -> Model:
    known = known_labels(labels, "toxic")
    drawn = [sampled(docs, known.where(f"label = {c}"), n, "toxic") for c, n in ((1, toxic), (0, ordinary))]
    texts = [[r["text"] for r in rows.select("text").collect()] for rows in drawn]
    return fit(*texts)


@functools.lru_cache(2)
def _windows(toxic: bytes, ordinary: bytes) -> Windows:
    return Windows(toxic, ordinary)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score: the probability that the text is toxic."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    own = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            for part in slices(batch):
                if m.toxic:
                    x = _features(*_windows(m.toxic, m.ordinary).saved(text_column(part).to_pylist())[:2], m.theta)
                else:
                    x = np.ones((part.num_rows, 1))
                p = 1 / (1 + np.exp(-np.clip(x @ np.array(m.weights), -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*part.schema.names, "score"])

    return docs.select(*own).mapInArrow(tidied(run), docs.select(*own).schema.add("score", "double"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
