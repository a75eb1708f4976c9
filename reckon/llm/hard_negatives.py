"""Hard negatives of anchors by vantage-point trees over norm-augmented vectors.

With one more component, ``sqrt(M^2 - |x|^2)`` for the largest length ``M``, the
distance of a row to an anchor (whose further component is 0) falls as their
inner product grows: ``d^2 = |q|^2 + M^2 - 2 q.x``. A window of scores becomes
an annulus around the anchor. A tree over a bounded sample deals the rows into
parts; the distances that each part spans around its vantage points are taken
over all its rows. Anchors go only to the parts that could hold a wanted row.
In a part, chunks of bounded size hold trees of their own, whose leaves are read
nearest first: those wholly inside all annuli are passed over, and reading ends
when no open leaf reaches an annulus, or what its k rows so far leave of it.
A first pass finds each anchor's positives, the nearest of its label; a second
the nearest rows of other labels in the window below each positive. The sample
gives both passes a first bound.

Defined results: rows with a null vec_id or label, a null or empty vector, or
null or non-finite components take no part; of several rows of one vec_id only
the least by (label, vector) does; only vectors of equal length are compared;
a positive of negative score has no window. Whole vectors whose squared length
reaches 2**51 raise an error that names their vec_id, as scores would not be
exact. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import prepare, stored, table, tidied
from .vectors import commonest_size, finite, matrix, whole

SCALE, POSITIVES, NEGATIVES, EVERY = 256, 5, 5, 100
#: Negatives lie between this share (in percent) of the positive's score and the score itself.
SHARE = 80
#: Rows in the sample at most, in a chunk about, and in a leaf of its tree at most.
SAMPLE, CHUNK, LEAF = 4096, 8192, 64
#: Leaves read at first; each further reading is twice as long.
STRIDE = 4
#: Anchors whose bounds to a tree are held at once.
BLOCK = 256


class Tree:
    """A vantage-point tree of equal halves over norm-augmented rows.

    ``vantage`` and ``height`` (the further component) are a row an inner node.
    ``above`` holds each leaf's inner nodes from the root, ``low`` and ``high``
    the distances that the leaf's rows span around them; ``members`` its rows.
    """

    def __init__(self, rows: np.ndarray, leaf: int, depth: int = 64):
        square = (rows * rows).sum(1)
        self.largest = float(square.max())
        heights = np.sqrt(self.largest - square)
        self.members, vantage, height, above, low, high, self.turns = [], [], [], [], [], [], []

        def split(own: np.ndarray, path: list, spans: list, turns: list) -> None:
            if len(own) <= leaf or len(path) == depth:
                self.members.append(own)
                above.append([n for n in path])
                low.append([s.min() for s in spans])
                high.append([s.max() for s in spans])
                self.turns.append(turns)
                return
            centre = rows[own].mean(0)
            v = own[((rows[own] - centre) ** 2).sum(1).argmax()]
            node = len(vantage)
            vantage.append(rows[v])
            height.append(heights[v])
            d = np.sqrt(((rows[own] - rows[v]) ** 2).sum(1) + (heights[own] - heights[v]) ** 2)
            order = np.argsort(d, kind="stable")
            half = len(own) // 2
            edge = (d[order[half - 1]] + d[order[half]]) / 2
            for far, part in enumerate((order[:half], order[half:])):
                split(own[part], [*path, node], [*(s[part] for s in spans), d[part]], [*turns, (node, bool(far), edge)])

        split(np.arange(len(rows)), [], [], [])
        deep = max(map(len, above))
        fill = lambda x, empty: np.array([[*r, *[empty] * (deep - len(r))] for r in x], float).reshape(len(x), deep)
        self.above, self.low, self.high = fill(above, 0).astype(int), fill(low, -np.inf), fill(high, np.inf)
        self.vantage, self.height = np.array(vantage).reshape(len(vantage), rows.shape[1]), np.array(height)

    def distances(self, rows: np.ndarray, height: np.ndarray | float) -> np.ndarray:
        """To the vantage points, a column each."""
        flat = (rows * rows).sum(1)[:, None] + (self.vantage * self.vantage).sum(1) - 2 * rows @ self.vantage.T
        return np.sqrt(np.maximum(flat, 0) + np.square(np.reshape(height, (-1, 1)) - self.height))

    def spans(self, anchors: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bounds on the distances of each anchor (height 0) to the rows of each leaf."""
        low, high = self.low if low is None else low, self.high if high is None else high
        if not len(self.vantage):
            return np.zeros((len(anchors), len(low))), np.full((len(anchors), len(low)), np.inf)
        d = self.distances(anchors, 0.0)[:, self.above]
        return np.maximum(np.maximum(low - d, d - high).max(2), 0), (d + high).min(2)

    def dealt(self, rows: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each of other rows, and their distances to its inner nodes."""
        leaf = np.zeros(len(rows), int)
        if not len(self.vantage):
            return leaf, np.zeros((len(rows), 0))
        d = self.distances(rows, height)
        for k, turns in enumerate(self.turns):
            inside = np.ones(len(rows), bool)
            for node, far, edge in turns:
                inside &= (d[:, node] > edge) == far
            leaf[inside] = k
        return leaf, np.take_along_axis(d, self.above[leaf], 1)


def radius(square: float, largest: float, score: np.ndarray | float) -> np.ndarray:
    """Distances at which an anchor of squared length ``square`` has ``score``; the squares are whole numbers."""
    return np.sqrt(np.maximum(square + largest - 2 * np.asarray(score, float), 0))


class Wanted(NamedTuple):
    """What an anchor looks for: rows of its label or of others, a bound and a top for each of its windows."""

    same: bool
    k: int
    least: np.ndarray
    most: np.ndarray

    def best(self, score: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
        """Places of the window's k highest scores, in order, ties to the smaller id."""
        inside = np.flatnonzero((score >= self.least[window]) & (score <= self.most[window]))
        if len(inside) > 4 * self.k:
            inside = inside[score[inside] >= np.partition(score[inside], -self.k)[-self.k]]
        return inside[np.lexsort((ids[inside], -score[inside]))][: self.k]


def slack(square: float, largest: float) -> float:
    """More than rounding can add to distances; what lies this near a bound is read."""
    return 1e-9 * (1 + np.sqrt(square) + np.sqrt(largest))


def annuli(square: float, largest: float, wanted: Wanted) -> tuple[np.ndarray, np.ndarray]:
    """Inner and outer distances of each window."""
    more = slack(square, largest)
    return radius(square, largest, wanted.most) - more, radius(square, largest, wanted.least) + more


def meets(near: np.ndarray, far: np.ndarray, inner: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """True where distances from ``near`` to ``far`` meet an annulus."""
    return ((near[:, None] <= reach) & (far[:, None] >= inner)).any(1)


class Chunk:
    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        tree = self.tree = Tree(rows, LEAF)
        order = np.concatenate(tree.members)
        self.edge = np.concatenate([[0], np.cumsum([len(m) for m in tree.members])])
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]

    def found(self, anchor: int, label: int, row: np.ndarray, near: np.ndarray, far: np.ndarray, wanted: Wanted) -> list[tuple[int, int, int]]:
        """(window, id, score) of the best rows of each window, given the distances that the leaves span."""
        square, largest = float(row @ row), self.tree.largest
        inner, reach = annuli(square, largest, wanted)
        leaves, stride = np.argsort(near, kind="stable"), STRIDE
        score, ids = np.zeros(0), np.zeros(0, np.int64)
        while True:
            leaves = leaves[meets(near[leaves], far[leaves], inner, reach)]
            if not len(leaves):
                break
            met = np.concatenate([np.arange(self.edge[k], self.edge[k + 1]) for k in leaves[:stride]])
            own = self.labels[met] == label
            met = met[(own == wanted.same) & (self.ids[met] != anchor)]
            fresh = self.rows[met] @ row
            some = (fresh >= wanted.least.min()) & (fresh <= wanted.most.max())
            score, ids = np.concatenate([score, fresh[some]]), np.concatenate([ids, self.ids[met[some]]])
            leaves, stride = leaves[stride:], 2 * stride
            for w in range(len(reach)):
                inside = score[(score >= wanted.least[w]) & (score <= wanted.most[w])]
                if len(inside) >= wanted.k:
                    reach[w] = radius(square, largest, np.partition(inside, -wanted.k)[-wanted.k]) + slack(square, largest)
        return [(w, int(ids[k]), int(score[k])) for w in range(len(wanted.least)) for k in wanted.best(score, ids, w).tolist()]


class Index(NamedTuple):
    """Rows in parts (``vec_id, label, embedding, part``), and what the driver knows of them: the tree, spans and sizes of parts, the sample."""

    rows: DataFrame
    size: int
    tree: Tree | None
    parts: dict[int, int]
    low: np.ndarray
    high: np.ndarray
    drawn: tuple[np.ndarray, np.ndarray, np.ndarray]


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label (long), embedding (whole numbers) of the rows that take part."""
    fit = vectors.where(finite() & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = fit.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), whole(scale, 2.0**51).alias("embedding")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.embedding")


def indexed(rows: DataFrame, sample: int = SAMPLE, chunk: int = CHUNK) -> Index:
    """``rows`` (stored) in parts of about ``chunk`` rows, as many as the sample can tell apart."""
    sized = rows.withColumn("size", F.size("embedding"))
    common = commonest_size(sized)
    own = sized.where(F.col("size") == common)
    drawn = own.orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(sample).toArrow()
    if not len(drawn):
        return Index(rows.withColumn("part", F.lit(0)), 0, None, {}, np.zeros((0, 0)), np.zeros((0, 0)), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0))))
    batch = drawn.combine_chunks().to_batches()[0]
    known = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch)
    many, largest = own.agg(F.count("*"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, c: s + c * c))).first()
    tree = Tree(known[2], 1, max(0, int(np.ceil(np.log2(many / chunk)))))
    square = (tree.vantage * tree.vantage).sum(1)
    tree.height, tree.largest = np.sqrt(largest - square), largest  # heights by the largest length of all rows; any edges will do, as spans are taken over all
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch)
            leaf, d = shared.value.dealt(x, np.sqrt(largest - (x * x).sum(1)))
            spans = pa.array(d.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(leaf.astype(np.int32)), spans], names=["vec_id", "label", "embedding", "part", "spans"])

    kind = "vec_id long, label long, embedding array<double>, part int, spans array<double>"
    rest = sized.where(F.col("size") != common).select("vec_id", "label", "embedding", (-F.col("size")).alias("part"), F.array().cast("array<double>").alias("spans"))
    parted = stored(own.select("vec_id", "label", "embedding").mapInArrow(tidied(run), kind).unionByName(rest), "parts")
    deep = tree.above.shape[1]
    spans = [f(F.get("spans", F.lit(k))).alias(f"{n}{k}") for n, f in (("low", F.min), ("high", F.max)) for k in range(deep)]
    counted = parted.groupBy("part").agg(F.count("*").alias("many"), *spans).collect()  # a row a part, and one a further length
    low, high = np.full((len(tree.members), deep), np.inf), np.full((len(tree.members), deep), -np.inf)
    for r in counted:
        if r["part"] >= 0:
            low[r["part"]], high[r["part"]] = ([r[f"{n}{k}"] for k in range(deep)] for n in ("low", "high"))
    return Index(parted.drop("spans"), common, tree, {r["part"]: -(-r["many"] // chunk) for r in counted}, low, high, known)


def _sampled(index: Index, k: int) -> Callable[..., Wanted]:
    """A function that raises an anchor's bounds to its k-th scores in the sample."""
    ids, labels, rows = index.drawn

    def raised(anchor: int, label: int, row: np.ndarray, wanted: Wanted) -> Wanted:
        if not len(ids) or len(row) != rows.shape[1]:
            return wanted
        some = ((labels == label) == wanted.same) & (ids != anchor)
        score = rows[some] @ row
        least = wanted.least.copy()
        for w in range(len(least)):
            inside = score[(score >= least[w]) & (score <= wanted.most[w])]
            if len(inside) >= k:
                least[w] = np.partition(inside, -k)[-k]
        return wanted._replace(least=least)

    return raised


_LOWEST = -(2.0**62)


def nearest(index: Index, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """vec_id, window, found_id, score: the k best rows of each anchor's windows, those of its label if ``same``.

    ``anchors`` holds vec_id, label, embedding, least and most (arrays of whole
    numbers in doubles, an entry a window).
    """
    raised = _sampled(index, k)
    shared = anchors.sparkSession.sparkContext.broadcast((index.tree, index.low, index.high, index.parts))
    size = index.size

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, low, high, parts = shared.value
        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            leasts, mosts, nodes = [], [], []
            for r in range(batch.num_rows):
                row = matrix(batch, r, r + 1)[0]
                wanted = Wanted(same, k, *(np.array(batch.column(c)[r].as_py(), float) for c in (3, 4)))
                wanted = raised(int(ids[r]), int(labels[r]), row, wanted)
                if tree is None or len(row) != size:
                    open_ = [-len(row)]
                else:
                    near, far = (x[0] for x in tree.spans(row[None], low, high))
                    open_ = np.flatnonzero(meets(near, far, *annuli(float(row @ row), tree.largest, wanted))).tolist()
                leasts.append(wanted.least.tolist())
                mosts.append(wanted.most.tolist())
                nodes.append([{"part": p, "salt": s} for p in open_ for s in range(parts.get(p, 0))])
            kind = pa.list_(pa.struct([("part", pa.int32()), ("salt", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(leasts, pa.list_(pa.float64())), pa.array(mosts, pa.list_(pa.float64())), pa.array(nodes, kind)],
                names=["vec_id", "label", "embedding", "least", "most", "nodes"],
            )

    own = anchors.select("vec_id", "label", "embedding", "least", "most")
    sent = own.mapInArrow(tidied(routed), "vec_id long, label long, embedding array<double>, least array<double>, most array<double>, nodes array<struct<part:int,salt:int>>")
    sent = sent.select("*", F.explode("nodes").alias("node")).select(F.lit(1).alias("kind"), "node.part", "node.salt", "vec_id", "label", "embedding", "least", "most")
    salts = F.create_map(*[F.lit(x) for pair in index.parts.items() for x in pair]) if index.parts else F.create_map(F.lit(0), F.lit(1))
    salt = F.pmod(F.xxhash64("vec_id"), F.coalesce(F.element_at(salts, F.col("part")), F.lit(1))).cast("int")
    none = F.lit(None).cast("array<double>")
    held = index.rows.select(F.lit(0).alias("kind"), "part", salt.alias("salt"), "vec_id", "label", "embedding", none.alias("least"), none.alias("most"))
    both = held.unionByName(sent).withColumn("node", F.xxhash64("part", "salt"))
    both = both.select("node", "kind", "vec_id", "label", "embedding", "least", "most").repartition("node").sortWithinPartitions("node", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, ready = None, [], None
        for batch in batches:
            node, kind, ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            mark = np.flatnonzero((node[1:] != node[:-1]) | (kind[1:] != kind[:-1])) + 1
            out: list[tuple] = []
            for a, b in zip([0, *mark.tolist()], [*mark.tolist(), len(node)]):
                if a == b:
                    continue
                if node[a] != now:
                    now, kept, ready = node[a], [], None
                if kind[a] == 0:
                    kept.append((ids[a:b], labels[a:b], matrix(batch, a, b)))
                    continue
                if not kept:
                    continue
                ready = ready or Chunk(*(np.concatenate([p[c] for p in kept]) for c in range(3)))
                for at in range(a, b, BLOCK):
                    rows = matrix(batch, at, min(b, at + BLOCK))
                    near, far = ready.tree.spans(rows)
                    for r, row in enumerate(rows):
                        wanted = Wanted(same, k, *(np.array(batch.column(c)[at + r].as_py(), float) for c in (5, 6)))
                        anchor, label = int(ids[at + r]), int(labels[at + r])
                        out.extend((anchor, *f) for f in ready.found(anchor, label, row, near[r], far[r], wanted))
            if out:
                kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["vec_id", "window", "found_id", "score"])

    found = both.mapInArrow(tidied(run), "vec_id long, window int, found_id long, score long")
    order = Window.partitionBy("vec_id", "window").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = SHARE, scale: int = SCALE, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of ``vectors`` that meet ``anchors``."""
    prepare(vectors.sparkSession)
    rows = stored(usable(vectors, scale), "whole")
    index = indexed(rows, sample, chunk)
    array = lambda x: F.array(F.lit(x))
    asked = stored(rows.where(anchors).select("vec_id", "label", "embedding"), "anchors")
    near = stored(nearest(index, asked.select("*", array(_LOWEST).alias("least"), array(-_LOWEST).alias("most")), True, positives), "positives")
    # a whole n has share * p <= 100 * n exactly if n >= ceil(share * p / 100)
    least = F.ceil(F.col("score").cast("decimal(20,0)") * share / 100).cast("double")
    own = near.where("score >= 0").select("vec_id", F.struct((F.col("rank") - 1).alias("rank"), least.alias("least"), F.col("score").cast("double").alias("most")).alias("w"))
    windows = own.groupBy("vec_id").agg(F.sort_array(F.collect_list("w")).alias("w"))  # at most ``positives`` of an anchor
    second = asked.join(windows, "vec_id").select("vec_id", "label", "embedding", F.col("w.least").alias("least"), F.col("w.most").alias("most"))
    found = nearest(index, second, False, negatives)
    named = near.where("score >= 0").select("vec_id", (F.col("rank") - 1).alias("window"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = found.join(named, ["vec_id", "window"])
    return joined.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    relabelled = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return mined(relabelled, F.col("vec_id") % EVERY == 0)


ORACLE = {
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
}
