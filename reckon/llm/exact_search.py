"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Every query first meets a bounded sample, whose k-th score bounds the final one
from below. Vectors lie in bounded chunks by a hash. In each chunk every
dimension has its list of components in order. A query walks the lists of its
non-zero dimensions from the end that its sign favours, several places at a
time, scores the vectors it meets in full, and stops once the bound on all
others (its inner product with the components at the lists' current places) is
below its k-th score so far, in the sample or the chunk. Chunks' results meet in
one ranking.

Defined results: components become floor(1024 * x) as whole numbers; only
vectors of equal length are compared; rows of equal vec_id are the query's own
if they are its id, and otherwise count once, by their highest score, as do
several rows of one query; rows without id, empty, null, or with null or
non-finite components take no part. Whole vectors whose squared length could reach
2**53 raise an error that names their vec_id. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import prepare, stored, table, tidied
from .vectors import blocked, commonest_size, distinct_best, first_of_each, matrix, ranked, salted, usable, whole

SCALE, TOP, EVERY = 1024, 10, 100
#: Vectors in a chunk and queries in a block, about.
CHUNK, BLOCK = 32_768, 8_192
#: Vectors in a chunk at least where there are fewer chunks than cores.
LEAST = 4_096
#: Vectors in the sample that gives each query its first bound.
SAMPLE = 8_192
#: Places of each list that a query reads at first; each further reading is twice as long.
STRIDE = 64


class Chunk:
    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(rows, self.order.T, 0).T.copy()
        self.single = len(np.unique(ids)) == len(ids)

    def top(self, query_id: int, bound: float, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows of distinct ids in the chunk, but for those below ``bound``."""
        n, used = len(self.ids), np.flatnonzero(query)
        seen = self.ids == query_id
        fall = query[used] > 0
        score = np.full(n, -np.inf)
        at, stride = 0, STRIDE
        if not len(used):  # every row scores 0
            score[~seen] = 0.0
        while len(used) and at < n:
            edge = np.where(fall, self.sorted[used, n - 1 - at], self.sorted[used, at])
            if edge @ query[used] < bound:
                break
            to = min(n, at + stride)
            fresh = np.zeros(n, bool)
            fresh[self.order[used[fall], n - to : n - at]] = True
            fresh[self.order[used[~fall], at:to]] = True
            met = np.flatnonzero(fresh & ~seen)
            seen[met] = True
            score[met] = self.rows[met] @ query
            at, stride = to, 2 * stride
            if seen.all():
                break
            if self.single and n > k:
                bound = max(bound, np.partition(score, -k)[-k])
            elif n > k:
                own = score[first_of_each(score, self.ids, k)]
                bound = max(bound, own[-1] if len(own) == k else -np.inf)
        row = np.flatnonzero(score >= max(bound, np.finfo(float).min))
        row = row[first_of_each(score[row], self.ids[row], k)]
        return self.ids[row], score[row]


def bounded(asked: DataFrame, drawn: list[tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """``asked`` with bound: the k-th score of each query among the sample's vectors of other ids, or the lowest double."""
    shared = asked.sparkSession.sparkContext.broadcast(drawn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = np.full(batch.num_rows, np.finfo(float).min)
            size, ids = batch.column(2).to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False)
            for others, rows in shared.value:
                for r in np.flatnonzero(size == rows.shape[1]).tolist():
                    score = np.where(others == ids[r], -np.inf, rows @ matrix(batch, r, r + 1)[0])
                    some = distinct_best(score, others, k)
                    some = some[first_of_each(score[some], others[some], k)]
                    if len(some) == k:
                        bound[r] = score[some[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound)], names=[*batch.schema.names, "bound"])

    return asked.select("vec_id", "embedding", "size").mapInArrow(tidied(run), "vec_id long, embedding array<double>, size int, bound double")


def search(vectors: DataFrame, queries, k: int = TOP, scale: int = SCALE, chunk: int = CHUNK, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` for each row of it that meets ``queries``.

    Scores are exact, as doubles hold all whole numbers below 2**53.
    """
    prepare(vectors.sparkSession)
    rows = stored(usable(vectors, zero=True).withColumn("embedding", whole(scale, 2.0**53)), "whole")
    common = commonest_size(rows)
    drawn = rows.where(F.col("size") == common).orderBy(F.xxhash64("vec_id", "embedding")).limit(sample).select("vec_id", "embedding").toArrow()
    known = []
    if len(drawn):
        batch = drawn.combine_chunks().to_batches()[0]
        known = [(batch.column(0).to_numpy(), matrix(batch))]
    asked = stored(bounded(rows.where(queries), known, k), "asked")
    n, q = rows.count(), asked.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, -(-n // chunk), min(cores, -(-n // LEAST)))
    blocks = max(1, -(-q // block))
    node = F.xxhash64("chunk", "block", "size")
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    left = rows.select("vec_id", "embedding", "size", salted(F.lit(chunks)).alias("chunk"), every(blocks).alias("block"))
    right = asked.select("vec_id", "embedding", "size", "bound", every(chunks).alias("chunk"), salted(F.lit(blocks)).alias("block"))

    def best(held: Chunk, query_ids: np.ndarray, bounds: np.ndarray, queries_: np.ndarray) -> list[tuple]:
        out = []
        for query_id, bound, query in zip(query_ids.tolist(), bounds.tolist(), queries_):
            got, score = held.top(query_id, bound, query, k)
            out.extend((query_id, v, int(s)) for v, s in zip(got.tolist(), score.tolist()))
        return out

    return ranked(blocked(left.withColumn("node", node), right.withColumn("node", node), Chunk, best, "long"), k)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = {
    "op7_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
}
