"""Near duplicates among vectors of one label by randomised-rotation binary codes.

Equal vectors of a label form one class. A class's unit vector is turned by a
random rotation (one for each length, from a seed), and its code keeps the signs
of the turned components, a bit each, beside the cosine ``a`` between the vector
and its code. For another unit vector of cosine ``t`` to the first, its product
with the code is ``a t + sqrt(1 - a^2) sqrt(1 - t^2) u``, where ``u`` is the
cosine between what code and vector have beside the first vector. Divided by
``a``, the product is an unbiased estimate of ``t``; ``u`` is of the order of one
by the square root of the length, and never beyond one. A pair whose estimate
lies below what a cosine of the threshold allows at ``|u| = REACH`` is let go;
the others are computed again from the vectors themselves. With a reach of one
the bound is certain and no pair is lost.

Classes of a label lie in sides by a hash; square blocks of two sides hold the
codes of one and the vectors of the other, a bounded number of each. What leaves
a block are each class's links and one class that they lead to, never the pairs.

Defined results: rows that are equal in vec_id, label and vector are one vector;
vectors without vec_id, without label, null, empty, zero, or with null or
non-finite components link with nothing and are their own component; only
vectors of equal length are compared; n_links counts vectors, so other vectors
of the same vec_id too; component_id is the smallest vec_id that links lead to.
Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import prepare, stored, table, tidied
from .near_duplicates import components
from .vectors import finite, matrix, scaled

THRESHOLD = 0.98
#: Largest |u| (see above) for which pairs are kept: 1 is certain, less lets go of more pairs and may lose links.
REACH = 1.0
#: Classes along the side of a block at most, about, and rows of a side whose estimates are held at once.
SIDE, STRIP = 4096, 256
#: Pairs computed again at once.
PAIRS = 1 << 15

_TURNS: dict[int, np.ndarray] = {}


def rotation(size: int) -> np.ndarray:
    """A random rotation of vectors of ``size`` components, the same in every task."""
    if size not in _TURNS:
        turn, upper = np.linalg.qr(np.random.default_rng(size).normal(0, 1, (size, size)))
        _TURNS.clear()  # tasks meet few lengths at a time
        _TURNS[size] = turn * np.sign(np.diag(upper))
    return _TURNS[size]


def turned(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return (rows / np.sqrt((rows * rows).sum(1, keepdims=True))) @ rotation(rows.shape[1])


def coded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a row of packed bits each) of vectors and the cosines between the two."""
    x = turned(rows)
    return np.packbits(x >= 0, axis=1), np.minimum(np.abs(x).sum(1) / np.sqrt(x.shape[1]), 1.0)


def estimates(code: np.ndarray, near: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated cosines of ``others`` (``turned``, a row each) to the vectors of codes, a column each."""
    size = others.shape[1]
    signs = np.unpackbits(code, axis=1, count=size).astype(np.float64) * 2 - 1
    return (others @ signs.T) / (near * np.sqrt(size))


def least_estimate(near: np.ndarray, threshold: float, reach: float = REACH) -> np.ndarray:
    """The smallest estimate that a cosine of the threshold or above may have, for codes of cosines ``near``."""
    return threshold - reach * np.sqrt(1 - near * near) / near * np.sqrt(max(0.0, 1 - threshold * threshold)) - 1e-9


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


class Forest:
    """Components of the members of a block; merging costs one pass over them, at most once a member."""

    def __init__(self, n: int):
        self.lead = np.arange(n)

    def join(self, members: np.ndarray) -> None:
        leads = self.lead[members]
        if (leads != leads[0]).any():
            mark = np.zeros(len(self.lead), bool)
            mark[leads] = True
            self.lead[mark[self.lead]] = leads.min()


def linked(code: np.ndarray, near: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, reach: float = REACH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``right`` and of ``left`` (whose codes are given) with a cosine at the threshold or above, in strips."""
    least = least_estimate(near, threshold, reach)
    a, b = scaled(left), scaled(right)
    for at in range(0, len(right), STRIP):
        r, c = np.nonzero(estimates(code, near, turned(right[at : at + STRIP])) >= least)
        sure = np.zeros(len(r), bool)
        for k in range(0, len(r), PAIRS):
            some = slice(k, k + PAIRS)
            sure[some] = cosines(b[at + r[some]], a[c[some]]) >= threshold
        yield at + r[sure], c[sure]


def _encoded(classes: DataFrame) -> DataFrame:
    """``classes`` (key, node, embedding, n) with code and near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index("embedding"))
            sizes = np.diff(column.offsets.to_numpy())
            code: list = [None] * len(sizes)
            near = np.zeros(len(sizes))
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                bits, near[own] = coded(matrix(batch.take(pa.array(own))))
                for k, b in zip(own.tolist(), bits):
                    code[k] = b.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.binary()), pa.array(near)], names=[*batch.schema.names, "code", "near"])

    schema = classes.schema
    return classes.mapInArrow(tidied(run), "".join(f"{f.name} {f.dataType.simpleString()}, " for f in schema) + "code binary, near double")


def links(classes: DataFrame, threshold: float = THRESHOLD, reach: float = REACH, side: int = SIDE) -> DataFrame:
    """key, root, close: for each class and block, a class that links lead to and the linked vectors.

    ``classes`` holds key, group, embedding (doubles) and n, the vectors of the
    class; classes of equal group and length are compared.
    """
    sized = classes.groupBy("group", F.size("embedding").alias("size")).agg(F.count("*").alias("many")).where("many > 1")
    sized = stored(sized.select(F.col("group").alias("of"), F.col("size").alias("long"), F.ceil(F.col("many") / side).cast("int").alias("sides")), "groups")
    met = classes.join(sized, (F.col("group") == F.col("of")) & (F.size("embedding") == F.col("long")))
    met = met.withColumn("side", F.pmod(F.xxhash64("key"), F.col("sides")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other")
    met = _encoded(met.select("key", "group", "sides", "side", "n", "embedding")).select("*", other)
    lo, hi = F.least("side", "other"), F.greatest("side", "other")
    node = F.xxhash64("group", F.size("embedding"), lo, hi)
    # the half whose codes are kept comes first; in a diagonal block a class is in both
    half = F.when(F.col("side") == F.col("other"), F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("side") > F.col("other")).cast("int")))
    both = met.select(node.alias("node"), (F.col("side") == F.col("other")).alias("square"), F.explode(half).alias("half"), "key", "n", "near", "code", "embedding")
    both = both.repartition("node").sortWithinPartitions("node", "half", "key")

    def block(square: bool, left: tuple, right: tuple) -> Iterator[pa.RecordBatch]:
        (lkey, ln, near, code, rows), (rkey, rn, others) = left, right
        count = len(lkey) if square else len(lkey) + len(rkey)
        shift = 0 if square else len(lkey)
        forest, close = Forest(count), np.zeros(count, np.int64)
        for r, c in linked(code, near, rows, others, threshold, reach):
            if square:  # both halves are in one order, so each pair is met twice
                r, c = r[r > c], c[r > c]
            np.add.at(close, r + shift, ln[c])
            np.add.at(close, c, rn[r])
            for k in np.split(np.arange(len(r)), np.flatnonzero(np.diff(r)) + 1):
                if len(k):
                    forest.join(np.append(c[k], r[k[0]] + shift))
        keys = lkey if square else [*lkey, *rkey]
        some = np.flatnonzero(close).tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[k] for k in some], pa.binary()), pa.array([keys[forest.lead[k]] for k in some], pa.binary()), pa.array(close[some], pa.int64())], names=["key", "root", "close"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, square, held = None, False, ([], [])

        def met_() -> Iterator[pa.RecordBatch]:
            if held[0] and held[1]:
                keys, ns, nears, bits, rows = ([b[k] for b in held[0]] for k in range(5))
                left = sum(keys, []), np.concatenate(ns), np.concatenate(nears), np.concatenate(bits), np.concatenate(rows)
                keys, ns, _, _, rows = ([b[k] for b in held[1]] for k in range(5))
                yield from block(square, left, (sum(keys, []), np.concatenate(ns), np.concatenate(rows)))

        for batch in batches:
            node, square_, half = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            mark = np.flatnonzero((node[1:] != node[:-1]) | (half[1:] != half[:-1])) + 1
            for a, b in zip([0, *mark.tolist()], [*mark.tolist(), len(node)]):
                if a == b:
                    continue
                if node[a] != now:
                    yield from met_()
                    now, square, held = node[a], bool(square_[a]), ([], [])
                part = batch.slice(a, b - a)
                bits = np.array([np.frombuffer(x, np.uint8) for x in part.column(6).to_pylist()])
                held[half[a]].append((part.column(3).to_pylist(), part.column(4).to_numpy(), part.column(5).to_numpy(), bits, matrix(part)))
        yield from met_()

    return both.mapInArrow(tidied(run), "key binary, root binary, close long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, reach: float = REACH, side: int = SIDE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every distinct vector; groups are the values of ``label``."""
    prepare(vectors.sparkSession)
    x = F.col("embedding").cast("array<double>")
    some = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite() & F.exists("embedding", lambda c: c != 0)
    rows = vectors.select("vec_id", "label", x.alias("embedding")).dropDuplicates().withColumn("fit", F.coalesce(some, F.lit(False)))
    # two hashes of 64 bits tell classes apart
    key = F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(s), "label", "embedding")), 16, "0") for s in (1, 2)]))
    rows = stored(rows.select("vec_id", "label", F.when(F.col("fit"), key).alias("key"), F.when(F.col("fit"), F.col("embedding")).alias("embedding")), "vectors")
    fit = rows.where(F.col("key").isNotNull())
    firsts = F.first("label").alias("group"), F.first("embedding").alias("embedding")
    classes = stored(fit.groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), *firsts), "classes")
    found = stored(links(classes.select("key", "group", "n", "embedding"), threshold, reach, side), "links")
    root = components(found.where("key <> root").select(F.least("key", "root").alias("a"), F.greatest("key", "root").alias("b")))
    close = found.groupBy("key").agg(F.sum("close").alias("close"))
    by_key = classes.select("key", "n", "least").join(close, "key").join(root, "key").select("root", "key", "n", "least", "close")
    smallest = by_key.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = by_key.join(smallest, "root").select("key", "close", "component_id")
    own = classes.select("key", "n", "least").join(by_key, "key", "left").select("key", (F.col("n") - 1 + F.coalesce("close", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.select("vec_id", "key").join(own, "key", "left")  # a null key meets nothing
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op13_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = {
    "op13_vector_duplicates": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a),
o AS (SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(m.m, e.vec_id)) AS component_id
  FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN m ON m.a = e.vec_id)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM o"""
}
