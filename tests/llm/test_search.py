import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reckon.llm import ann, exact_search

KIND = "vec_id long, embedding array<float>, label int, node long, part int, score double"


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(0, 1, (900, 12)).astype(np.float32)
    x[200:500] = x[200]  # a large group of equal vectors
    rows = [(k, [float(c) for c in v], 0, 1, 2, 3.0) for k, v in enumerate(x)]
    odd = [(1000, None, 0, 1, 2, 3.0), (1100, [0.0] * 12, 0, 1, 2, 3.0), (1200, [float("nan")] + [1.0] * 11, 0, 1, 2, 3.0), (1300, [None] + [1.0] * 11, 0, 1, 2, 3.0),
           (None, [1.0] * 12, 0, 1, 2, 3.0), (1400, [float("inf")] + [1.0] * 11, 0, 1, 2, 3.0), (1500, [1.0, 2.0], 0, 1, 2, 3.0), (1600, [], 0, 1, 2, 3.0)]
    return spark.createDataFrame(rows + odd, KIND), x.astype(float)


def test_exact_search_equals_brute_force(vectors):
    table, x = vectors
    whole = np.floor(1024 * np.concatenate([x, np.zeros((1, 12))]))
    ids = np.array([*range(900), 1100])
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in exact_search.search(table, F.col("vec_id") % 100 == 0, chunk=128, block=4).collect()}
    want = {}
    for q in [*range(0, 900, 100), 1100]:
        score = whole @ whole[np.flatnonzero(ids == q)[0]]
        other = np.flatnonzero(ids != q)
        for rank, k in enumerate(other[np.lexsort((ids[other], -score[other]))][:10], 1):
            want[q, rank] = (int(ids[k]), int(score[k]))
    assert got == want


def test_learned_partitions_reach_the_recall(vectors):
    table, x = vectors
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = ann.search(table, F.col("vec_id") % 50 == 0, part=100, chunk=64, block=4).collect()
    hit = total = 0
    for q in range(0, 900, 50):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        score = np.array([(unit[k] * unit[q]).sum() for k in range(900)])
        score[q] = -9
        best = set(np.lexsort((np.arange(900), -np.round(score, 12)))[:5].tolist())
        hit, total = hit + len(best & {v for _, v, _ in own}), total + 5
        assert all(abs(s - score[v]) < 1e-12 for _, v, s in own)
    assert hit / total >= 0.9 and not {r["query_id"] for r in rows} & {1000, 1100, 1200, 1300, 1400, 1500, 1600}


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in df.collect())


@pytest.mark.parametrize("module, score", [(ann, lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))), (exact_search, lambda a, b: float(np.floor(1024 * a) @ np.floor(1024 * b)))])
def test_repeated_ids_and_other_lengths(spark, module, score):
    draw = np.random.default_rng(8)
    pool = [(int(k), draw.normal(0, 1, 6 if k % 3 else 4).round(3)) for k in draw.integers(0, 60, 150)]
    pool += [pool[0]] * 40 + [(0, x + 0.125) for _, x in pool[3:9]]  # repeated rows, and a query of several vectors
    rows = spark.createDataFrame([(k, [float(c) for c in x], 0, 1, 2, 3.0) for k, x in pool], "vec_id long, embedding array<double>, label int, node long, part int, score double")
    want = []
    for q in sorted({k for k, _ in pool if k % 10 == 0}):
        best = {}
        for k, x in pool:
            for _, y in ((i, y) for i, y in pool if i == q and k != q and len(x) == len(y)):
                best[k] = max(best.get(k, -np.inf), round(score(x, y), 12))
        order = sorted(best, key=lambda k: (-best[k], k))[: module.TOP]
        want += [(q, rank, k, best[k]) for rank, k in enumerate(order, 1)]
    exact = {"recall": 1.0} if module is ann else {}
    assert found(module.search(rows, F.col("vec_id") % 10 == 0, chunk=16, block=2, **exact)) == want


def test_bounds_from_the_sample_change_no_result(vectors):
    table, _ = vectors
    some = F.col("vec_id") % 25 == 0
    assert found(exact_search.search(table, some, chunk=64, sample=0)) == found(exact_search.search(table, some, chunk=64, sample=500)) == found(exact_search.search(table, some, sample=5000))


@pytest.fixture(scope="module")
def clusters(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(0, 1, (60, 24))
    x = (centres[draw.integers(0, 60, 6000)] + draw.normal(0, 0.25, (6000, 24))).astype(np.float32)
    return spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<float>"), x.astype(float)


def recall(rows, x, ids, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = {}
    for r in rows:
        near.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in ids:
        score = unit @ unit[q]
        score[q] = -9
        hit += len(near[q] & set(np.argsort(-score, kind="stable")[:k].tolist()))
    return hit / (k * len(ids))


def test_few_parts_are_probed_where_vectors_have_clusters(clusters):
    table, x = clusters
    router = ann.fitted(ann.usable(table, zero=False), part=250)
    assert router.d.shape[0] == 24 and router.probes < 12
    rows = ann.search(table, F.col("vec_id") % 50 == 0, part=250, chunk=512).collect()
    assert recall(rows, x, range(0, 6000, 50)) >= 0.9


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, folder):
    path = f"/root/testdata/{folder}"
    table = spark.read.parquet(f"{path}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(table["embedding"]).astype(float)
    assert table["vec_id"].tolist() == list(range(table["vec_id"][0], table["vec_id"][0] + len(x)))
    low = int(table["vec_id"][0])
    got = [{"query_id": r["query_id"] - low, "vec_id": r["vec_id"] - low} for r in ann.op5_ann(spark, path).collect()]
    assert recall(got, x, [k for k in range(len(x)) if (k + low) % 50 == 0]) >= 0.9
    router = ann.fitted(ann.usable(spark.read.parquet(f"{path}/embeddings.parquet"), zero=False))
    assert router.d.shape[0] == 8 and 1 <= router.probes < 8


def test_few_or_no_vectors(spark, vectors):
    table, _ = vectors
    empty = table.limit(0)
    assert ann.search(empty, F.col("vec_id") >= 0).count() == 0 and exact_search.search(empty, F.col("vec_id") >= 0).count() == 0
    two = table.where("vec_id < 2")
    assert [(r["query_id"], r["vec_id"]) for r in ann.search(two, F.col("vec_id") == 0).collect()] == [(0, 1)]
    assert [(r["query_id"], r["vec_id"]) for r in exact_search.search(two, F.col("vec_id") == 0).collect()] == [(0, 1)]


def test_parts_are_balanced():
    draw = np.random.default_rng(1)
    unit = draw.normal(0, 1, (400, 6))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = ann.balanced_parts(unit, ann._neighbours(unit, 5), 8, draw)
    assert np.bincount(label, minlength=8).max() <= 55


def test_parts_follow_the_graph():
    draw = np.random.default_rng(2)
    unit = np.repeat(draw.normal(0, 1, (16, 12)), 50, axis=0) + draw.normal(0, 0.1, (800, 12))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    graph = ann._neighbours(unit, 8)
    label = ann.balanced_parts(unit, graph, 8, draw)
    cut = (label[graph] != label[:, None]).mean()
    mixed_up = draw.permutation(label)
    assert cut < 0.2 < 0.8 < (mixed_up[graph] != mixed_up[:, None]).mean() and np.bincount(label, minlength=8).max() <= 110


def test_extreme_finite_components(spark):
    draw = np.random.default_rng(13)
    x = draw.normal(0, 1, (40, 6))
    sizes = [10.0 ** int(k) for k in draw.integers(-290, 290, 40)]
    rows = spark.createDataFrame([(k, [float(c) * s for c in v]) for k, (v, s) in enumerate(zip(x, sizes))], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.search(rows, F.col("vec_id") == 3, recall=1.0).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = [k for k in np.argsort(-(unit @ unit[3])) if k != 3][:5]
    assert [got[3, r][0] for r in range(1, 6)] == order and all(abs(got[3, r][1] - unit[k] @ unit[3]) < 1e-12 for r, k in enumerate(order, 1))
    with pytest.raises(PySparkException, match="vec_id"):
        exact_search.search(rows, F.col("vec_id") == 3).collect()
    near = rows.where(F.forall("embedding", lambda c: F.abs(c) < 1000))
    assert exact_search.search(near, F.col("vec_id") >= 0).count() > 0
