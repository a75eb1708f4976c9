import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from reckon.llm import line_dedup, mixing, near_duplicates

from .conftest import prose, row, KIND


def oracle(sql, rows):
    table = "documents"  # noqa: F841
    connection = duckdb.connect()
    connection.register("documents", rows.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    found = connection.execute(sql)
    names = sorted(c[0] for c in found.description)
    return sorted(map(repr, found.df()[names].astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None))), names


@pytest.fixture(scope="module")
def lines(spark):
    draw = random.Random(5)
    pool = [prose(k, draw.choice([2, 5, 12, 60])) for k in range(60)]
    passage = [pool[k] for k in (1, 2, 3, 4)]
    rows = []
    for k in range(150):
        own = [draw.choice(pool) for _ in range(draw.randrange(1, 12))]
        if k % 5 == 0:
            own[1:1] = passage
        rows.append(row(k, "\n".join(own), source=f"s{k % 4}"))
    return spark.createDataFrame(rows + rows[:3], KIND)


@pytest.mark.parametrize("which", ["lines", "odd"])
def test_line_dedup_equals_sql(which, request):
    docs = request.getfixturevalue(which)
    out = line_dedup.dedup_lines(docs)
    assert set(docs.columns) <= set(out.columns)
    want, names = oracle(line_dedup.ORACLE["op9_line_dedup"], docs)
    got = out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5")).select(*names).collect()
    norm = lambda xs: sorted(repr(tuple(int(x) if isinstance(x, (int, float)) else x for x in r)) for r in xs)
    assert norm(got) == norm(eval(w) for w in want)


def longest_runs(texts):
    """Each text without the lines of any longest run that equals an earlier one, found by comparing all places."""
    where, out = [(d, k) for d, t in enumerate(texts) for k in range(len(t))], []
    starts = defaultdict(list)
    gone = [set() for _ in texts]
    for d, j in where:
        for e, i in starts[texts[d][j]]:
            n = 0
            while j + n < len(texts[d]) and i + n < len(texts[e]) and texts[d][j + n] == texts[e][i + n]:
                n += 1
            run = texts[d][j : j + n]
            if n >= 2 and any(x.strip() for x in run) or len(run[0].split()) >= 50:
                gone[d] |= set(range(j, j + n))
        starts[texts[d][j]].append((d, j))
    for d, t in enumerate(texts):
        out.append("\n".join(x for k, x in enumerate(t) if k not in gone[d]))
    return out


def test_planted_runs_go_whatever_stands_around_them(spark):
    draw, texts = random.Random(3), []
    shapes = [(1, 60), (2, 30), (2, 3), (3, 20), (4, 15), (4, 2), (5, 8), (8, 10), (12, 10)]
    passages = [[prose(10_000 * k + j, words) for j in range(n)] for k, (n, words) in enumerate(shapes * 4)]
    passages += [["head " + str(k), "", "", "", "", prose(k, 4)] for k in range(4)]
    for k, passage in enumerate(passages):
        for copy in range(3):
            before, after = ([prose(1_000_000 + 1000 * k + 100 * copy + 10 * s + j, 12) for j in range(draw.randrange(4))] for s in (1, 2))
            texts.append([*before, *passage, *after])
    docs = spark.createDataFrame([row(k, "\n".join(t)) for k, t in enumerate(texts)], KIND)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert [got[k] for k in range(len(texts))] == longest_runs(texts)
    later = [(k, x) for k, t in enumerate(texts) if k % 3 for x in passages[k // 3] if x.strip()]
    assert not any(x in got[k].split("\n") for k, x in later)
    assert got[0] == "\n".join(texts[0])


def test_a_passage_in_most_rows_goes_from_all_but_the_first(spark):
    passage = [prose(k, 20) for k in range(3)]
    texts = [[prose(100 + k, 9), *passage, prose(900 + k, 9)] if k % 4 else [prose(100 + k, 9), prose(900 + k, 9)] for k in range(400)]
    docs = spark.createDataFrame([row(k, "\n".join(t)) for k, t in enumerate(texts)] * 2, KIND)
    got = {(r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect()}
    stays = lambda k: k % 4 == 0 or k == 1
    assert got == {(k, "\n".join(t if stays(k) else [t[0], t[-1]]), 0 if stays(k) else 3) for k, t in enumerate(texts)}


@pytest.mark.parametrize("which", ["lines", "odd"])
def test_mixing_equals_sql(which, request):
    docs = request.getfixturevalue(which)
    want, names = oracle(mixing.ORACLE["op6_source_mixing"], docs)
    got = mixing.mix(docs).select(*names).collect()
    norm = lambda xs: sorted(repr(tuple(round(float(x), 6) if x is not None else None for x in r)) for r in xs)
    assert norm(got) == norm(eval(w) for w in want)


def test_mix_comes_near_its_targets(spark):
    docs = spark.createDataFrame([row(k, prose(k, 5 + k % 40), source=f"s{k % 3}") for k in range(3000)], KIND)
    out = mixing.mix(docs, keep=True)
    assert set(docs.columns) - {"size"} <= set(out.columns)
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.max(F.col("taken") / F.col("size")).alias("m")).collect():
        assert abs(r["t"] - r["w"]) <= 45 and r["m"] <= 2


def test_empty_tables(none):
    assert line_dedup.dedup_lines(none).count() == 0 and mixing.mix(none).count() == 0
    assert near_duplicates.near_duplicates(none).count() == 0 and near_duplicates.keep_one(none).count() == 0


def brute(docs, threshold=0.8):
    sets = []
    for doc_id, text in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
        sets.append((doc_id, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    lead = list(range(len(sets)))

    def root(k):
        while lead[k] != k:
            k = lead[k]
        return k

    n = defaultdict(int)
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) >= threshold * len(x | y):
                n[a] += 1
                n[b] += 1
                lead[root(a)] = root(b)
    ids = defaultdict(list)
    for k, (doc_id, _) in enumerate(sets):
        ids[root(k)].append(doc_id)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted((repr((doc_id, least[root(k)], n[k])) for k, (doc_id, _) in enumerate(sets)))


@pytest.fixture(scope="module")
def copies(spark):
    draw, rows = random.Random(9), []
    base = prose(77, 120).split()
    for k in range(300):
        if k % 3 == 0:  # one large group of near copies
            w = list(base)
            for _ in range(draw.randrange(0, 3)):
                w[draw.randrange(len(w))] = f"new{k}"
            rows.append(row(k, " ".join(w)))
        elif k % 3 == 1:
            rows.append(row(k, prose(k // 12, 60)))
        else:
            rows.append(row(k, prose(1000 + k, draw.randrange(1, 40)) + " " + " ".join(base[:30])))
    return spark.createDataFrame(rows, KIND)


@pytest.mark.parametrize("which", ["copies", "odd"])
def test_near_duplicates_equal_brute_force(which, request, monkeypatch):
    docs = request.getfixturevalue(which)
    monkeypatch.setattr(near_duplicates, "SMALL", 16)
    monkeypatch.setattr(near_duplicates.buckets, "__defaults__", (2, 2, 16))
    got = sorted(repr((r["doc_id"], r["class_id"], r["n_links"])) for r in near_duplicates.near_duplicates(docs).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_one_of_each_group_stays(copies, odd):
    kept = near_duplicates.keep_one(copies)
    classes = near_duplicates.near_duplicates(copies).select("class_id").distinct().count()
    assert kept.columns == copies.columns and kept.count() == classes
    assert sorted(str(r["doc_id"]) for r in near_duplicates.keep_one(odd).collect()) == sorted(map(str, [1, 2, 3, 4, 5, 8, 9, None]))


def test_one_stays_of_near_copies_with_equal_or_null_ids(spark):
    base = prose(5, 60).split()
    near = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in (0, 1, 58, 59)]
    same = [row(3, near[0]), row(3, near[1]), row(3, near[1]), row(4, near[2])]
    nulls = [row(None, x.upper()) for x in (*near, near[0])]
    for rows, ids in ((same, [3]), (nulls, [None]), (same + nulls, [3, None])):
        kept = near_duplicates.keep_one(spark.createDataFrame(rows, KIND)).collect()
        assert sorted((r["doc_id"] for r in kept), key=str) == ids


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(bytes([k]), bytes([k + 1])) for k in range(20)] + [(bytes([50]), bytes([51]))], "a binary, b binary")
    got = {bytes(r["key"]): bytes(r["root"]) for r in near_duplicates.components(edges).collect()}
    assert got == {**{bytes([k]): bytes([0]) for k in range(21)}, bytes([50]): bytes([50]), bytes([51]): bytes([50])}
