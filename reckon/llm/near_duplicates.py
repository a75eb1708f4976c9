"""N-gram Jaccard join by chosen paths.

Texts are sets of ``WIDTH``-word shingles. Equal texts form one class. Each
class has a MinHash signature whose coordinates are the tokens of its set. In
every run a node of the recursion samples a few coordinates, and classes that
share a sampled token go to the same child; nodes of one class end, small nodes
are compared by brute force, larger ones split again. After ``DEPTH`` splits, or
where splitting would not part a node, it is compared in square blocks, so no
class is ever left out. Runs are repeated until pairs at the threshold are
found with the target recall. Pairs whose signatures agree enough are compared
on their whole sets; what leaves a block are each class's links and one class
that they lead to, never the pairs.

Defined results: a text of one to four words has one shingle of all its words;
a null text or one without words has none and links to nothing, not even to its
copies; class_id is the smallest non-null doc_id of all documents linked
directly or through others (a null one only if all are null), n_links counts
the other documents at the threshold or above. Repeated rows are copies of each
other. Columns of the input of other names are kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import broadcast_if_small, checkpointed, prepare, shingles, slices, stored, table, text_bytes, text_column, tidied

WIDTH, THRESHOLD = 5, 0.8
#: Coordinates of a signature, tokens sampled at a node, and splits before square blocks.
COORDINATES, SAMPLED, DEPTH = 64, 2, 2
#: A large node is dense if a sampled token keeps this share of its classes together.
DENSE = 0.5
#: Classes in a node that is compared at once, and classes along the side of a square block.
SMALL = 256
#: Share of pairs at the threshold that the runs must find.
RECALL = 0.9999
#: Signatures of pairs worth comparing agree in at least this share of coordinates (six standard deviations below 0.8).
AGREE = 0.5


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL, sampled: int = SAMPLED, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold that is split ``depth`` times is found with the target recall."""
    lost = 0.0
    for _ in range(depth):
        lost = (1 - threshold + threshold * lost) ** sampled
    return int(np.ceil(np.log(1 - recall) / np.log(lost)))


def signature(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """MinHash signatures of non-empty sets, a row each."""
    draw = np.random.default_rng(11)
    times = draw.integers(1 << 31, 1 << 32, COORDINATES, dtype=np.uint64) | np.uint64(1)
    low, high = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begin) - 1, COORDINATES), np.uint32)
    for k, t in enumerate(times):
        value = low * np.uint32(t)
        value ^= high
        value *= np.uint32(0x85EBCA6B)
        value ^= value >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(value, begin[:-1])
    return out


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, key (MD5 of the text), sig (null for a text without words) of every document."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = text_column(part)
                raw, offsets = text_bytes(texts)
                found, begin = shingles(raw, offsets, WIDTH)
                full = np.flatnonzero(np.diff(begin))
                sig: list = [None] * part.num_rows
                if len(full):
                    rows = signature(found, np.concatenate([begin[full], begin[-1:]]))
                    for r, x in zip(full.tolist(), rows):
                        sig[r] = x.astype("<u4").tobytes()
                data = raw.tobytes()
                key = [hashlib.md5(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "key", "sig"]
                )

    out = docs.select("doc_id", "text")
    schema = out.select("doc_id").schema.add("key", "binary").add("sig", "binary")
    return out.mapInArrow(tidied(run), schema)


def _children(nodes: DataFrame, sampled: int) -> DataFrame:
    """path, key, parent and held (classes of the parent) of the children of ``path, key, sig, held``."""
    picks = [F.pmod(F.xxhash64("path", F.lit(k)), F.lit(COORDINATES)).cast("int") for k in range(sampled)]

    def child(pick: Column) -> Column:
        return F.xxhash64("path", pick, F.substring("sig", pick * 4 + 1, 4))

    children = F.array_distinct(F.array(*[child(p) for p in picks]))
    return nodes.select(F.explode(children).alias("path"), "key", F.col("path").alias("parent"), "held")


def buckets(sets: DataFrame, runs: int, sampled: int = SAMPLED, depth: int = DEPTH, small: int = SMALL) -> DataFrame:
    """path, key, side, sides: nodes to compare; side is the block of the class in a node beyond ``small``.

    A large node whose tokens keep most of its classes together is not split
    further, as its classes are alike and splitting would not part them.
    """
    roots = F.explode(F.transform(F.sequence(F.lit(1), F.lit(runs)), lambda r: F.xxhash64(F.lit("run"), r)))
    nodes = sets.select(roots.alias("path"), "key", "sig", F.lit(None).cast("long").alias("held"))
    leaves = []
    sides = F.ceil(F.col("count") / small).cast("int")
    side = F.pmod(F.hash("key"), sides)
    for level in range(1, depth + 1):
        split = _children(nodes, sampled)
        sized = split.groupBy("path").agg(F.count("*").alias("count"), F.first("parent").alias("parent"), F.first("held").alias("held"))
        dense = sized.groupBy("parent").agg((F.max("count") >= DENSE * F.first("held")).alias("dense"))
        if level > 1:
            dense = stored(dense, "dense")
            whole = kept.join(dense.where("dense"), kept["path"] == dense["parent"], "left_semi")
            leaves.append(whole.select("path", "key", side.alias("side"), sides.alias("sides")))
            split = split.join(dense.where("NOT dense").select("parent"), "parent", "left_semi")
        split = stored(split.select("path", "key").join(sized.where("count > 1").select("path", "count"), "path"), f"level{level}")
        last = level == depth
        done = split if last else split.where(F.col("count") <= small)
        leaves.append(done.select("path", "key", side.alias("side"), sides.alias("sides")))
        kept = split.where(F.col("count") > small)
        if last or kept.isEmpty():
            break
        nodes = kept.select("path", "key", F.col("count").alias("held")).join(sets, "key")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def _blocks(members: DataFrame) -> DataFrame:
    """node, half and the members' columns: each class once for every square block of its node that it is in.

    A node of s sides has the blocks (i, j), i <= j. half is 2 in a diagonal
    block, else 0 on its side i and 1 on its side j; pairs of one half of an
    off-diagonal block meet elsewhere.
    """
    wide = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    lo, hi = F.least("side", "other"), F.greatest("side", "other")
    half = F.when(F.col("side") == F.col("other"), 2).otherwise((F.col("side") > F.col("other")).cast("int"))
    return wide.select(F.xxhash64("path", lo, hi).alias("node"), "path", "key", half.alias("half"))


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[list]]:
    """The columns of each run of equal first values in sorted batches, a run at a time."""
    held: list[list] = [[] for _ in names]
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
        first = columns[0]
        edges = [0, *(k for k in range(1, len(first)) if first[k] != first[k - 1]), len(first)] if first else [0]
        for a, b in zip(edges, edges[1:]):
            if held[0] and held[0][-1] != first[a]:
                yield held
                held = [[] for _ in names]
            for h, c in zip(held, columns):
                h.extend(c[a:b])
    if held[0]:
        yield held


def _pairs(path: int, half: list[int], sig: list[bytes], paths: list[list[int]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of a block whose signatures agree and that meet in no node of a smaller path."""
    rows = np.frombuffer(b"".join(sig), "<u4").reshape(-1, COORDINATES)
    half_ = np.array(half)
    whole = half_[0] == 2
    left = np.arange(len(half)) if whole else np.flatnonzero(half_ == 0)
    right = left if whole else np.flatnonzero(half_ == 1)
    before = [frozenset(p for p in own if p < path) for own in paths]
    a, b = [], []
    for k, i in enumerate(left.tolist()):
        others = right[k + 1 :] if whole else right
        near = others[(rows[others] == rows[i]).sum(1) >= least]
        for j in near.tolist():
            if before[i].isdisjoint(before[j]):
                a.append(i)
                b.append(j)
    return np.array(a, np.int64), np.array(b, np.int64)


def candidates(blocks: DataFrame, sets: DataFrame, agree: float = AGREE) -> DataFrame:
    """node, path, half, key: the classes of each block that have a partner there to be compared with."""
    placed = blocks.join(sets.select("key", "sig", "paths"), "key").repartition("node").sortWithinPartitions("node")
    least = int(np.ceil(agree * COORDINATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for node, path, half, key, sig, paths in _grouped(batches, ["node", "path", "half", "key", "sig", "paths"]):
            if len(node) < 2:
                continue
            a, b = _pairs(path[0], half, sig, paths, least)
            out.extend((node[k], path[k], half[k], key[k]) for k in np.unique(np.concatenate([a, b])).tolist())
            if len(out) > 10_000:
                yield _batch(out, _PLACED)
                out = []
        yield _batch(out, _PLACED)

    return placed.mapInArrow(tidied(run), "node long, path long, half int, key binary")


_PLACED = pa.schema([("node", pa.int64()), ("path", pa.int64()), ("half", pa.int32()), ("key", pa.binary())])
_LINKED = pa.schema([("key", pa.binary()), ("root", pa.binary()), ("near", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [() for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (a, b): pair by pair, or for many pairs of few sets all at once."""
    if len(a) < 8 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist())])
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(token[-1]) + 1, 4096):
        at, to = np.searchsorted(token, [low, low + 4096])
        some = np.zeros((len(sets), 4096), np.float32)
        some[owner[at:to], token[at:to] - low] = 1
        both += some @ some.T
    return both[a, b]


def links(docs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """key, root, near: for each class and block, a class that links lead to and the linked documents.

    ``sets`` holds key, sig, n. Every pair of classes at the threshold is counted
    in one block, the first in which it meets; whole sets are compared.
    """
    members = stored(buckets(sets.select("key", "sig"), runs_needed(threshold, recall)), "nodes")
    paths = members.groupBy("key").agg(F.collect_set("path").alias("paths"))
    known = stored(sets.join(paths, "key"), "paths")
    asked = stored(candidates(_blocks(members), known), "asked")
    wanted = stored(asked.select("key").distinct(), "wanted")
    keyed = docs.where(F.col("text").isNotNull()).select(F.unhex(F.md5("text")).alias("key"), "text")
    texts = keyed.join(broadcast_if_small(wanted, 500_000), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    both = asked.join(texts, "key").join(known, "key").repartition("node").sortWithinPartitions("node")
    least = int(np.ceil(AGREE * COORDINATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, path, half, key, text, sig, paths_, n in _grouped(batches, ["node", "path", "half", "key", "text", "sig", "paths", "n"]):
            a, b = _pairs(path[0], half, sig, paths_, least)
            if not len(a):
                continue
            found, begin = shingles(*text_bytes(pa.array(text, pa.string())), WIDTH)
            own = [np.unique(found[x:y]) for x, y in zip(begin[:-1].tolist(), begin[1:].tolist())]
            size = np.array([len(x) for x in own])
            shared = _shared(own, a, b)
            linked = shared >= threshold * (size[a] + size[b] - shared) - 1e-9
            a, b, many = a[linked], b[linked], np.array(n)
            near = np.bincount(a, many[b], len(key)) + np.bincount(b, many[a], len(key))
            lead = list(range(len(key)))

            def root(k: int) -> int:
                while lead[k] != k:
                    lead[k] = lead[lead[k]]
                    k = lead[k]
                return k

            for i, j in zip(a.tolist(), b.tolist()):
                lead[root(i)] = root(j)
            yield _batch([(key[k], key[root(k)], int(near[k])) for k in np.flatnonzero(near).tolist()], _LINKED)

    return both.mapInArrow(tidied(run), "key binary, root binary, near long")


def components(edges: DataFrame) -> DataFrame:
    """key, root: the smallest key of each node's component, by alternating large and small stars."""
    now = checkpointed(edges.select("a", "b"))
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        now = checkpointed(small.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == (seen["n"], seen["s"]):
            return now.select(F.col("b").alias("key"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("key"), F.col("a").alias("root")).distinct())
        mark = (seen["n"], seen["s"])


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, copy_id (smallest doc_id of equal texts), class_id, n_links, key, and leader (key of the class's text that stays) for every document."""
    every = stored(classes(docs), "signatures")
    full = every.where(F.col("sig").isNotNull())
    sets = stored(full.groupBy("key").agg(F.first("sig").alias("sig"), F.count("*").alias("n"), F.min("doc_id").alias("copy_id")), "classes")
    sized = sets.select("key", "n", "copy_id")
    found = stored(links(docs, sets.select("key", "sig", "n"), threshold, recall), "links")
    root = components(found.where("key <> root").select(F.least("key", "root").alias("a"), F.greatest("key", "root").alias("b")))
    reach = found.groupBy("key").agg(F.sum("near").alias("near"))
    by_key = sized.join(root, "key", "left").join(reach, "key", "left").withColumn("root", F.coalesce("root", "key"))
    first = F.min(F.struct(F.col("copy_id").isNull().alias("last"), "copy_id", "key"))["key"]
    linked = by_key.where(F.col("near").isNotNull()).groupBy("root").agg(F.min("copy_id").alias("least"), first.alias("leader"))
    by_key = by_key.join(linked, "root", "left").select(
        "key",
        "copy_id",
        F.coalesce("least", "copy_id").alias("class_id"),
        F.coalesce("leader", "key").alias("leader"),
        (F.col("n") - 1 + F.coalesce("near", F.lit(0))).cast("long").alias("n_links"),
    )
    alone = every.where(F.col("sig").isNull()).select("doc_id", F.col("doc_id").alias("copy_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("binary").alias("leader"))
    return full.select("doc_id", "key").join(by_key, "key").select("doc_id", "copy_id", "class_id", "n_links", "key", "leader").unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest (doc_id, key), null ids last, and of its repeated rows one."""
    found = near_duplicates(docs, threshold, recall).where(F.col("key").isNotNull())
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("leader"))
    gone = stored(found.where(~stays).select(F.col("doc_id").alias("gone"), F.col("key").alias("gone_key")).distinct(), "gone")
    again = stored(found.groupBy("doc_id", "key").count().where("count > 1").select(F.col("doc_id").alias("again"), F.col("key").alias("again_key")), "again")
    # a text without words has no key, and is never a copy
    nested = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.unhex(F.md5("text")).alias("key"))
    kept = nested.join(broadcast_if_small(gone), F.col("id").eqNullSafe(F.col("gone")) & (F.col("key") == F.col("gone_key")), "left_anti")
    if not again.isEmpty():
        same = F.col("id").eqNullSafe(F.col("again")) & (F.col("key") == F.col("again_key"))
        once = kept.join(again, same, "left_semi").dropDuplicates(["id", "key"])
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return kept.select(*[F.col(f"doc.{c}").alias(c) for c in docs.columns])


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copy_id")
