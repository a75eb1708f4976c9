"""Usable vectors, and searches of query blocks against bounded chunks of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import tidied


def finite() -> Column:
    """True where ``embedding`` has components, none of them null or non-finite."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & F.coalesce(fine, F.lit(False))


def whole(scale: int, limit: float) -> Column:
    """``embedding`` as whole numbers floor(scale * x), in doubles; an error naming the vec_id where the squared length could reach ``limit``."""
    x = F.transform("embedding", lambda c: c.cast("double") * scale)
    square = F.aggregate(x, F.lit(0.0), lambda s, c: s + (F.abs(c) + 1) * (F.abs(c) + 1))
    said = F.concat(F.lit("components too large for exact whole sums, vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    return F.when(square < limit, F.transform(x, lambda c: F.floor(c).cast("double"))).otherwise(F.raise_error(said).cast("array<double>"))


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id, embedding (doubles), size of rows with an id and finite components, repeated rows once.

    Empty vectors are left out, and vectors of zeros unless ``zero``.
    """
    x = F.col("embedding")
    keep = F.col("vec_id").isNotNull() & finite()
    if not zero:
        keep &= F.exists(x, lambda c: c != 0)
    rows = vectors.where(keep).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
    return rows.dropDuplicates().withColumn("size", F.size("embedding"))


def commonest_size(rows: DataFrame) -> int:
    """The length of most vectors, the shorter on a tie; 0 without any."""
    lengths = rows.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).collect()
    return lengths[0]["size"] if lengths else 0


def salted(many: Column) -> Column:
    """One of ``many`` chunks; rows of one id are dealt too."""
    return F.pmod(F.xxhash64("vec_id", "embedding"), F.greatest(many, F.lit(1)).cast("long"))


def matrix(batch: pa.RecordBatch, a: int = 0, b: int | None = None) -> np.ndarray:
    """The vectors of rows ``a`` to ``b``, which are of one length."""
    column = batch.column(batch.schema.get_field_index("embedding")).slice(a, None if b is None else b - a)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their largest components lie between 1/2 and 1; no digit is lost, and squares stay finite and above 0."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, keepdims=True))[1])


def distinct_best(score: np.ndarray, ids: np.ndarray, k: int, slack: float = 0.0) -> np.ndarray:
    """Rows that hold the ``k`` highest scores of distinct ids, and those within ``slack`` below."""
    many = k
    while True:
        if many >= len(score):
            return np.flatnonzero(score > -np.inf)
        some = np.flatnonzero(score >= max(np.partition(score, -many)[-many], np.finfo(float).min) - slack)
        if len(np.unique(ids[some])) >= k:
            return some
        many *= 4


def first_of_each(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores of distinct ids, in order, ties to the smaller id."""
    order = np.lexsort((ids, -score))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def blocked(vectors: DataFrame, queries: DataFrame, held_as: Callable, best: Callable[..., list[tuple]], score: str) -> DataFrame:
    """query_id, vec_id, score from ``best(held_as(ids, vectors), query ids, bounds, queries)`` on each chunk and query block.

    ``vectors`` and ``queries`` hold node, vec_id, embedding, queries also bound;
    equal nodes meet. A chunk is held while its queries stream past.
    """
    both = vectors.select("node", F.lit(0).alias("kind"), "vec_id", F.lit(0.0).alias("bound"), "embedding").unionByName(
        queries.select("node", F.lit(1).alias("kind"), "vec_id", "bound", "embedding")
    )
    both = both.repartition("node").sortWithinPartitions("node", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, ready = None, [], [], None
        for batch in batches:
            node, kind, vec, bound = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            mark = np.flatnonzero((node[1:] != node[:-1]) | (kind[1:] != kind[:-1])) + 1
            out: list[tuple] = []
            for a, b in zip([0, *mark.tolist()], [*mark.tolist(), len(node)]):
                if a == b:
                    continue
                if node[a] != now:
                    now, ids, held, ready = node[a], [], [], None
                if kind[a] == 0:
                    ids.append(vec[a:b])
                    held.append(matrix(batch, a, b))
                elif ids:
                    if ready is None:
                        ready = held_as(np.concatenate(ids), np.concatenate(held))
                    out.extend(best(ready, vec[a:b], bound[a:b], matrix(batch, a, b)))
            if out:
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.float64() if score == "double" else pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["query_id", "vec_id", "score"])

    return both.mapInArrow(tidied(run), f"query_id long, vec_id long, score {score}")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query, ties to the smaller vec_id.

    Several rows of one query id or of one vec_id count by their highest score.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
