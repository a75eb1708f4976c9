"""Approximate nearest neighbours by learned partitions.

A bounded sample gives a nearest-neighbour graph, which is split into balanced
parts with few cut edges. A small neural network learns each vector's part from
the parts of its neighbours. Every vector is stored under its most probable
part; a query is sent to its most probable parts, as many as the sample needs
for the target recall, and all vectors there are reranked by the exact cosine.
Parts of any size lie in bounded chunks. Vectors of another length than the
commonest meet all others of their length.

Parts are about ``PART`` vectors each, eight at least, and as many as ``SAMPLE``
can tell apart (a thousand); beyond, parts grow. Where vectors have no clusters,
neighbours lie in most parts and most are probed.

Defined results: only vectors of equal length are compared; rows of equal vec_id
are the query's own if they are its id, and otherwise count once, by their
highest score, as do several rows of one query; rows without id, null, empty,
zero, or with null or non-finite components take no part; finite components of
any size do, as vectors are scaled by powers of two first; ties go to the smaller
vec_id. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import prepare, stored, table, tidied
from .vectors import blocked, commonest_size, distinct_best, first_of_each, matrix, ranked, salted, scaled, usable

TOP, EVERY = 5, 50
#: Vectors in the sample at most, neighbours in its graph, and vectors in a part about.
SAMPLE, NEIGHBOURS, PART = 20_000, 10, 1500
#: Parts at least, and sampled vectors that each part needs.
LEAST, EACH = 8, 20
#: Vectors in a chunk and queries in a block, about.
CHUNK, BLOCK = 8192, 1024
#: Share of the sample's true neighbours that routing must reach.
RECALL = 0.93
HIDDEN, ROUNDS = 128, 40


class Router(NamedTuple):
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: np.ndarray
    probes: int

    def logits(self, unit: np.ndarray) -> np.ndarray:
        return np.maximum(unit @ self.a + self.b, 0) @ self.c + self.d


def _neighbours(unit: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(unit), k), np.int64)
    for at in range(0, len(unit), 512):
        near = unit[at : at + 512] @ unit.T
        near[np.arange(len(near)), at + np.arange(len(near))] = -2
        out[at : at + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(unit: np.ndarray, graph: np.ndarray, parts: int, draw: np.random.Generator) -> np.ndarray:
    """A part for each node, none above its share by a tenth: balanced centres first, then moves along the graph."""
    n = len(unit)
    room = -(-11 * n // (10 * parts))
    centres = unit[draw.permutation(n)[:parts]]
    label = np.zeros(n, np.int64)
    for _ in range(6):
        near = unit @ centres.T
        wish = np.argsort(-near, axis=1).astype(np.int32)
        sure = np.argsort(np.partition(near, -2, axis=1)[:, -2] - near.max(1)) if parts > 1 else np.arange(n)
        size = np.zeros(parts, np.int64)
        for i in sure.tolist():
            for p in wish[i]:
                if size[p] < room:
                    label[i] = p
                    size[p] += 1
                    break
        for p in range(parts):
            if size[p]:
                centres[p] = unit[label == p].mean(0)
    size = np.bincount(label, minlength=parts)
    for _ in range(4):
        for i in draw.permutation(n).tolist():
            votes = np.bincount(label[graph[i]], minlength=parts)
            p = int(votes.argmax())
            if p != label[i] and votes[p] > votes[label[i]] and size[p] < room:
                size[label[i]] -= 1
                size[p] += 1
                label[i] = p
    return label


def learn(unit: np.ndarray, target: np.ndarray, draw: np.random.Generator) -> Router:
    """A network of one hidden layer that predicts the distribution ``target`` over parts, by Adam."""
    parts = target.shape[1]
    weights = [
        draw.normal(0, 1, (unit.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        draw.normal(0, (2 / HIDDEN) ** 0.5, (HIDDEN, parts)),
        np.zeros(parts),
    ]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(ROUNDS):
        order = draw.permutation(len(unit))
        for at in range(0, len(order), 256):
            x, t = unit[order[at : at + 256]], target[order[at : at + 256]]
            hidden = np.maximum(x @ weights[0] + weights[1], 0)
            z = hidden @ weights[2] + weights[3]
            z = np.exp(z - z.max(1, keepdims=True))
            delta = (z / z.sum(1, keepdims=True) - t) / len(x)
            back = (delta @ weights[2].T) * (hidden > 0)
            step += 1
            for k, g in enumerate((x.T @ back, back.sum(0), hidden.T @ delta, delta.sum(0))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*weights, 1)


def fit(sample: np.ndarray, parts: int, top: int = TOP, recall: float = RECALL, seed: int = 5) -> Router:
    draw = np.random.default_rng(seed)
    sample = scaled(sample) if len(sample) else sample
    unit = np.unique(sample / np.sqrt((sample * sample).sum(1, keepdims=True)), axis=0)
    unit = unit[draw.permutation(len(unit))]
    parts = max(1, min(parts, len(unit) // EACH))
    if parts == 1:
        width = sample.shape[1] if sample.ndim == 2 else 1
        return Router(np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = _neighbours(unit, min(NEIGHBOURS, len(unit) - 1))
    label = balanced_parts(unit, graph, parts, draw)
    target = np.zeros((len(unit), parts))
    for column in (np.arange(len(unit))[:, None], graph):
        np.add.at(target, (np.arange(len(unit))[:, None], label[column]), 1.0)
    fitted = len(unit) * 4 // 5  # the rest shows how many parts a query must see
    router = learn(unit[:fitted], target[:fitted] / target[:fitted].sum(1, keepdims=True), draw)
    if recall >= 1:
        return router._replace(probes=parts)
    logits = router.logits(unit)
    own, wish = logits.argmax(1), np.argsort(-logits, axis=1)
    place = np.argsort(wish, axis=1)
    asked = np.arange(fitted, len(unit))
    near = unit[asked] @ unit.T
    near[np.arange(len(asked)), asked] = -2
    best = np.argpartition(-near, min(top, near.shape[1] - 1), axis=1)[:, :top]
    needed = np.sort(place[asked[:, None], own[best]].ravel()) + 1
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
    return router._replace(probes=probes)


def _routed(rows: DataFrame, router: Router, probes: int) -> DataFrame:
    """``rows`` (vec_id, embedding, size) with part: a row for each of the ``probes`` most probable parts.

    Vectors of another length than the router's have the part -1, in which all of their length meet.
    """
    shared = rows.sparkSession.sparkContext.broadcast(tuple(router))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Router(*shared.value)
        for batch in batches:
            fits = batch.column(2).to_numpy(zero_copy_only=False) == len(r.a)
            parts: list = [[-1]] * batch.num_rows
            if fits.any():
                x = scaled(matrix(batch.filter(pa.array(fits))))
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                wish = np.argsort(-r.logits(x), axis=1, kind="stable")[:, :probes]
                for k, w in zip(np.flatnonzero(fits).tolist(), wish.tolist()):
                    parts[k] = w
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32()))], names=["vec_id", "embedding", "size", "parts"])

    own = rows.select("vec_id", "embedding", "size")
    out = own.mapInArrow(tidied(run), "vec_id long, embedding array<double>, size int, parts array<int>")
    return out.select("vec_id", "embedding", "size", F.explode("parts").alias("part"))


def _cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Each row's cosine by sums that do not depend on the other rows, so equal vectors tie."""
    dot = (rows * query).sum(1)
    return dot / (np.sqrt((rows * rows).sum(1)) * np.sqrt((query * query).sum()))


def fitted(rows: DataFrame, k: int = TOP, sample: int = SAMPLE, part: int = PART, recall: float = RECALL) -> Router:
    """The router of ``rows`` (``usable`` vectors), from a sample of those of the commonest length."""
    common = rows.where(F.col("size") == commonest_size(rows))
    parts = max(LEAST, -(-common.count() // part))
    drawn = common.orderBy(F.xxhash64("vec_id", "embedding")).limit(min(sample, max(sample // 4, EACH * parts))).select("embedding").toArrow()
    if not len(drawn):
        return Router(np.zeros((1, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    return fit(matrix(drawn.combine_chunks().to_batches()[0]), parts, k, recall)


def search(vectors: DataFrame, queries, k: int = TOP, sample: int = SAMPLE, part: int = PART, chunk: int = CHUNK, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of ``vectors`` that meets ``queries``; with a recall of 1 all parts are probed."""
    prepare(vectors.sparkSession)
    rows = stored(usable(vectors, zero=False), "vectors")
    router = fitted(rows, k, sample, part, recall)
    index = stored(_routed(rows, router, 1), "index")
    asked = stored(_routed(rows.where(queries), router, router.probes), "queries")
    chunks, blocks = ({r["part"]: -(-r["count"] // size) for r in f.groupBy("part").count().collect()} for f, size in ((index, chunk), (asked, block)))
    parts = router.d.shape[0]

    def many(counts: dict) -> Column:
        return F.element_at(F.array(*[F.lit(counts.get(p, 1)) for p in range(-1, parts)]), F.col("part") + 2).cast("long")

    def every(counts: dict) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), many(counts) - 1))

    node = F.xxhash64("part", "chunk", "block", "size")
    left = index.withColumn("chunk", salted(many(chunks))).withColumn("block", every(blocks))
    right = asked.withColumn("block", salted(many(blocks))).withColumn("chunk", every(chunks)).withColumn("bound", F.lit(0.0))

    def held(ids: np.ndarray, rows_: np.ndarray):
        rows_ = scaled(rows_)
        return ids, rows_, rows_ / np.sqrt((rows_ * rows_).sum(1, keepdims=True))

    def best(chunk_, query_ids: np.ndarray, _, queries_: np.ndarray) -> list[tuple]:
        ids, rows_, unit = chunk_
        queries_ = scaled(queries_)
        near = (queries_ / np.sqrt((queries_ * queries_).sum(1, keepdims=True))) @ unit.T
        out = []
        for query_id, query, line in zip(query_ids.tolist(), queries_, near):
            line[ids == query_id] = -np.inf
            some = distinct_best(line, ids, k, 1e-9)
            score = _cosines(rows_[some], query)
            order = first_of_each(score, ids[some], k)
            out.extend((query_id, v, s) for v, s in zip(ids[some][order].tolist(), score[order].tolist()))
        return out

    return ranked(blocked(left.withColumn("node", node), right.withColumn("node", node), held, best, "double"), k)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
