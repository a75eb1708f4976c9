"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators of a linear hinge-loss model.

Features of a text are the hashed indicators of its words and of its byte
n-grams. Class counts of every feature come from all labelled training rows by
a Spark aggregation; the support vector machine is fitted by dual coordinate
descent on a bounded sample of them (``SAMPLE``), and its margins are mapped to
probabilities by logistic calibration on rows of the sample left out of the fit.

Defined results: a null text scores as an empty one; labels other than 0 and 1
are left out, and repeated label rows count once; with one class only, or no
labels, every score is the training share of label 1 (0.5 without labels).
Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import broadcast_if_small, prepare, slices, span_hashes, table, text_bytes, text_column, words, tidied

#: Hashed features, byte n-gram lengths, and labelled rows in the fit at most.
BITS, GRAMS, SAMPLE = 18, (3, 5), 3000
FEATURES = 1 << BITS
#: Longest run of one repeated word that has a feature of its own.
REPEATED = 4
#: Penalty of a margin error, passes of the descent, and weight of the model against its mean size.
PENALTY, PASSES, BLEND = 1.0, 25, 0.9


class Model(NamedTuple):
    weights: np.ndarray  # of each feature, the log-count ratio included
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float


def held_out() -> Column:
    return F.coalesce(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0, F.lit(False))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int32)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each row end to end, and where each row's begin.

    They are words, byte n-grams, and n-grams of one word repeated, whatever it is.
    """
    n = len(offsets) - 1
    starts, ends, first = words(raw, offsets)
    hashes = span_hashes(raw, starts, ends)
    kinds = [(_slots(hashes), first, 0)]
    same = np.concatenate([hashes[1:] == hashes[:-1], [False]]) if len(hashes) else np.zeros(0, bool)
    run = same.copy()
    for size in range(2, REPEATED + 1):
        kinds.append((np.where(run, size, 0).astype(np.int32), first, size - 1))
        run = same & np.concatenate([run[1:], [False]]) if len(run) else run
    for size in GRAMS:
        value = np.zeros(max(0, len(raw) - size + 1), np.uint64)
        for k in range(size if len(value) else 0):
            value = (value << np.uint64(8)) | raw[k : len(raw) - size + 1 + k]
        kinds.append((_slots(value * np.uint64(0xD6E8FEB86659FD93) + np.uint64(size)), offsets, size - 1))
    flag, out = np.zeros(FEATURES, bool), []
    for d in range(n):
        for slot, at, less in kinds:
            if at[d + 1] - less > at[d]:
                flag[slot[at[d] : at[d + 1] - less]] = True
        flag[0] = False
        own = np.flatnonzero(flag).astype(np.int32)
        flag[own] = False
        out.append(own)
    begin = np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)])
    return (np.concatenate(out) if out else np.zeros(0, np.int32)), begin


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label (0 or 1) of the training part, one row for each id."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out())
    return known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, text, label of all training rows."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(~held_out())
    return rows.join(broadcast_if_small(known_labels(labels, label)), "doc_id")


def sampled(docs: DataFrame, known: DataFrame, rows: int, salt: str) -> DataFrame:
    """doc_id, text, label of at most ``rows`` training rows: ids are drawn by hash first, then their texts are read."""
    drawn = known.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id").limit(rows)


def class_counts(rows: DataFrame) -> np.ndarray:
    """Rows of each class that hold each feature, over all of ``rows``; the last column counts the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, FEATURES + 1), np.int64)
        for batch in batches:
            for part in slices(batch):
                found, begin = features(*text_bytes(text_column(part)))
                label = np.array(part.column(part.schema.get_field_index("label")).to_pylist())
                of = np.repeat(label, np.diff(begin))
                for c in (0, 1):
                    sums[c, :FEATURES] += np.bincount(found[of == c], minlength=FEATURES)
                    sums[c, FEATURES] += int((label == c).sum())
        at = np.flatnonzero(sums.sum(0))
        columns = [pa.array(at, pa.int64()), pa.array(sums[0, at]), pa.array(sums[1, at])]
        yield pa.RecordBatch.from_arrays(columns, names=["feature", "n0", "n1"])

    prepare(rows.sparkSession)
    parts = rows.select("text", "label").mapInArrow(tidied(run), "feature long, n0 long, n1 long")
    got = parts.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    out = np.zeros((2, FEATURES + 1))
    out[:, got["feature"].to_numpy()] = np.stack([got["n0"].to_numpy(), got["n1"].to_numpy()])
    return out


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, seed: int = 1):
    """Dual coordinate descent for the L2-regularised hinge loss over unit rows ``ratio[features]`` and a bias."""
    values = [ratio[x] for x in rows]
    values = [v / (np.sqrt(v @ v) or 1.0) for v in values]
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    draw = np.random.default_rng(seed)
    for _ in range(PASSES):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            x, v, s = rows[i], values[i], y[i]
            slope = s * (w[x] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / 2.0, 0.0), cost[i])  # a unit row and the bias: squared length 2
            step = (new - alpha[i]) * s
            if step:
                w[x] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def _calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of label 1 over the margin, by Newton's method."""
    a, b = 1.0, 0.0
    target = np.where(label > 0, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([(p - target) @ margin, (p - target).sum()]) + np.array([1e-3 * a, 0])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * margin) @ margin + 1e-3, q @ margin], [q @ margin, q.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def margins(model: Model, found: np.ndarray, begin: np.ndarray) -> np.ndarray:
    value = model.ratio[found]
    sums = np.concatenate([[0], np.cumsum(model.weights[found] * value)])
    norms = np.concatenate([[0], np.cumsum(value * value)])
    size = np.sqrt(np.maximum(norms[begin[1:]] - norms[begin[:-1]], 1e-12))
    return (sums[begin[1:]] - sums[begin[:-1]]) / size + model.bias


def blended(w: np.ndarray) -> np.ndarray:
    """Weights between naive Bayes, whose weights over ratio-scaled features are one (the mean magnitude), and ``w``."""
    return (1 - BLEND) * np.abs(w).mean() + BLEND * w


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    rows = labelled(docs, labels, label)
    counts = class_counts(rows)
    n0, n1 = counts[:, FEATURES]
    if not n0 or not n1:
        share = (n1 + 0.5) / (n0 + n1 + 1) if n0 + n1 else 0.5
        zero = np.zeros(FEATURES, np.float32)
        return Model(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    p, q = counts[1, :FEATURES] + 1.0, counts[0, :FEATURES] + 1.0
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[counts[:, :FEATURES].sum(0) == 0] = 0
    drawn = sampled(docs, known_labels(labels, label), sample, label).select("text", "label").toArrow()
    found, begin = features(*text_bytes(drawn["text"].combine_chunks()))
    lists = [found[a:b] for a, b in zip(begin[:-1], begin[1:])]
    y = drawn["label"].to_numpy().astype(float) * 2 - 1
    fit, rest = np.arange(len(y)) % 4 != 0, np.arange(len(y)) % 4 == 0
    cost = PENALTY * len(y) / (2 * np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum())))
    w, bias = descend([x for x, k in zip(lists, fit) if k], y[fit], ratio, cost[fit])
    w = blended(w)
    model = Model(w.astype(np.float32), ratio.astype(np.float32), float(bias), 1.0, 0.0)
    margin = margins(model, found, begin)
    if len(set(y[rest])) == 2:
        model = model._replace(**dict(zip(("slope", "shift"), _calibrate(margin[rest], (y[rest] > 0).astype(float)))))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score: the probability of label 1."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch):
                margin = margins(m, *features(*text_bytes(text_column(part))))
                p = 1 / (1 + np.exp(-np.clip(m.slope * margin + m.shift, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p.astype(float))], names=[*part.schema.names, "score"])

    return docs.select(*own).mapInArrow(tidied(run), docs.select(*own).schema.add("score", "double"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
