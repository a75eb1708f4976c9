import hashlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reckon.llm import hard_negatives, vector_codes, vector_duplicates

KIND = "vec_id long, embedding array<double>, label int, part int, node string, key string, rank int, score double, n int, row int, code string, least int"
REST = (1, "n", "k", 2, 0.5, 3, 4, "c", 5)
NAN, INF = float("nan"), float("inf")


def rows_of(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], label, *REST) for i, x, label in rows], KIND)


def unfit(size):
    """Rows that take no part: null, empty, with null and non-finite components."""
    return [(9001, None, 1), (9002, [], 1), (9003, [None] + [1.0] * (size - 1), 1), (9004, [NAN] + [1.0] * (size - 1), 1), (9005, [INF] + [1.0] * (size - 1), 1), (9006, [-INF] * size, None)]


# --- product codes -------------------------------------------------------------------------------------------


def coded(rows, parts, entries, rounds, scale=256):
    """vec_id, code, error, label_error, hash by brute force; rows in their order of choice."""
    x = np.array([[int(np.floor(scale * c)) for c in v] for _, v, _ in rows], object)
    w = x.shape[1] // parts
    books = [[list(r[p * w : (p + 1) * w]) for r in x[:entries]] for p in range(parts)]

    def assigned():
        out = []
        for r in x:
            line = []
            for p in range(parts):
                d = [sum((a - b) ** 2 for a, b in zip(r[p * w : (p + 1) * w], e)) for e in books[p]]
                line.append((d.index(min(d)), min(d)))
            out.append(line)
        return out

    for _ in range(rounds):
        got = assigned()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[k][p * w : (p + 1) * w] for k in range(len(x)) if got[k][p][0] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    got = assigned()
    error = [sum(d for _, d in line) for line in got]
    sums = {}
    for (_, _, label), e in zip(rows, error):
        sums[label] = sums.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for e, _ in line), err, sums[label], sha) for (i, _, label), line, err in zip(rows, got, error)]


def told(df):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect()), key=str)


@pytest.mark.parametrize("entries, parts, many", [(64, 4, 400), (20, 2, 90), (64, 4, 30), (1, 2, 10)])
def test_codes_equal_brute_force(spark, entries, parts, many):
    draw = np.random.default_rng(entries + many)
    x = draw.normal(0, 0.1, (many, 12)).round(2)
    x[many // 3 : many // 2] = x[0]  # a group of copies
    rows = [(int(k), v.tolist(), None if k % 5 == 0 else int(k % 3)) for k, v in enumerate(x)]
    shuffled = [rows[k] for k in draw.permutation(many)]
    got = told(vector_codes.compressed(rows_of(spark, shuffled + unfit(12)), parts, entries))
    assert got == sorted(coded(rows, parts, entries, 2), key=str)


def test_codes_of_repeated_ids_and_other_lengths(spark):
    draw = np.random.default_rng(2)
    base = [(int(k // 3), draw.normal(0, 1, 8).round(1).tolist(), 1) for k in range(60)]
    rows = sorted(base + base[:5] + [(None, [0.5] * 8, None), (None, [0.25] * 8, 2)], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    got = told(vector_codes.compressed(rows_of(spark, rows[::-1] + [(7, [1.0] * 6, 1), (8, [1.0] * 12, 1)]), 4, 10))
    assert got == sorted(coded(rows, 4, 10, 2), key=str)


def test_codes_of_empty_tables_and_of_too_large_components(spark):
    assert vector_codes.compressed(rows_of(spark, [])).count() == 0
    assert vector_codes.compressed(rows_of(spark, unfit(16))).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(PySparkException, match="vec_id 77"):
        vector_codes.compressed(rows_of(spark, [(77, [1e300] * 16, 1)])).collect()


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_nearest_entries_with_ties(spread):
    draw = np.random.default_rng(spread)
    for width in (1, 2, 4):
        book = draw.integers(-spread, spread + 1, (64, width))  # many equal entries and equal distances
        rows = draw.integers(-2 * spread, 2 * spread + 1, (500, width))
        index, square = vector_codes.nearest(book, vector_codes.grown(book), rows)
        every = ((rows[:, None] - book) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (square == every.min(1)).all()


# --- near duplicates -----------------------------------------------------------------------------------------


def grouped(rows, threshold=0.98):
    """vec_id, n_links, component_id, kept of distinct rows by brute force."""
    seen = sorted({(i, None if v is None else tuple(v), label) for i, v, label in rows}, key=str)
    fit = lambda r: r[0] is not None and r[2] is not None and r[1] and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1])
    unit = [None if not fit(r) else np.array(r[1]) / np.abs(r[1]).max() for r in seen]
    near = [[] for _ in seen]
    for a in range(len(seen)):
        for b in range(len(seen)):
            if a != b and unit[a] is not None and unit[b] is not None and seen[a][2] == seen[b][2] and len(unit[a]) == len(unit[b]):
                if unit[a] @ unit[b] / np.sqrt((unit[a] @ unit[a]) * (unit[b] @ unit[b])) >= threshold:
                    near[a].append(b)
    least = [r[0] for r in seen]
    while True:
        now = [min([least[a], *(least[b] for b in near[a])]) if near[a] else least[a] for a in range(len(seen))]
        if now == least:
            break
        least = now
    return sorted(((r[0], len(n), c, r[0] == c) for r, n, c in zip(seen, near, least)), key=str)


def listed(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def copies():
    """Clusters at many angles, a hot label, exact copies, scaled copies, extreme lengths."""
    draw = np.random.default_rng(6)
    rows = []
    for c in range(12):
        centre = draw.normal(0, 1, 16)
        for k in range(15):
            rows.append((len(rows) * 3 % 1009, (centre + draw.normal(0, 0.02 + 0.015 * c, 16)).tolist(), c % 2))
    rows += [(2000 + k, rows[0][1], 0) for k in range(40)] + [(2100 + k, [c * 2.0**k for c in rows[1][1]], 0) for k in (-1000, -3, 900)]
    rows += [(2200, [c * 1e-200 for c in rows[20][1]], 0), (2201, rows[0][1], 1), (2202, rows[0][1], None), (2203, [0.0] * 16, 0), (2204, [1.0, 2.0], 0), (2205, [1.0, 2.0], 0)]
    rows += [(2300, rows[2][1], 0), (2300, rows[40][1], 0), (2300, rows[40][1], 0), (None, rows[0][1], 0), *unfit(16)]
    return rows


@pytest.mark.parametrize("side", [4096, 50, 7])
def test_near_duplicates_equal_brute_force(spark, copies, side):
    want = grouped(copies)
    assert max(n for _, n, _, _ in want) > 40
    assert listed(vector_duplicates.near_duplicates(rows_of(spark, copies), side=side)) == want


def test_near_duplicates_of_no_rows(spark):
    assert vector_duplicates.near_duplicates(rows_of(spark, [])).count() == 0
    alone = [r for r in unfit(4)]
    assert listed(vector_duplicates.near_duplicates(rows_of(spark, alone))) == grouped(alone)


def test_estimates_are_unbiased_and_bounded():
    draw = np.random.default_rng(9)
    size, gaps = 64, []
    for cosine in (0.0, 0.5, 0.9, 0.98):
        a = draw.normal(0, 1, (400, size))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        other = draw.normal(0, 1, (400, size))
        other -= (other * a).sum(1, keepdims=True) * a
        b = cosine * a + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
        code, near = vector_duplicates.coded(a)
        got = np.diag(vector_duplicates.estimates(code, near, vector_duplicates.turned(b)))
        gaps.append(abs(got.mean() - cosine))
        assert (got >= vector_duplicates.least_estimate(near, cosine)).all()
        if cosine == 0.98:  # and few unrelated pairs are let through
            assert (vector_duplicates.estimates(code, near, vector_duplicates.turned(a)) >= vector_duplicates.least_estimate(near, cosine)).mean() < 0.005
    assert max(gaps) < 0.02


# --- hard negatives ------------------------------------------------------------------------------------------


def triples(rows, every, positives=5, negatives=5, share=80):
    """The operator's rows by brute force; ``rows`` of one id differ in (label, vector)."""
    best = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(c is not None and np.isfinite(c) for c in v):
            key = label, [int(np.floor(256 * c)) for c in v]
            best[i] = min(best.get(i, key), key)
    out = []
    for a, (label, x) in best.items():
        if a % every:
            continue
        score = {b: sum(p * q for p, q in zip(x, y)) for b, (_, y) in best.items() if b != a and len(y) == len(x)}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if best[b][0] == label][:positives]:
            inside = [b for b in order if best[b][0] != label and share * score[p] <= 100 * score[b] <= 100 * score[p]]
            out += [(a, p, rank, b, score[p], score[b]) for rank, b in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


@pytest.fixture(scope="module")
def labelled():
    draw = np.random.default_rng(12)
    centres = draw.normal(0, 1, (8, 10))
    rows = [(int(k), (centres[k % 8] + draw.normal(0, 0.4, 10)).round(2).tolist(), int(draw.integers(0, 4)) if k % 3 else 0) for k in range(700)]
    rows += [(700 + k, rows[0][1], k % 2) for k in range(120)]  # a group of copies over two labels
    rows += [(900 + k, [0.0] * 10, k % 2) for k in range(30)] + [(1000 + k, draw.normal(0, 1, 4).round(2).tolist(), k % 3) for k in range(60)]
    rows += [(40, rows[3][1], 3), (40, rows[3][1], 3), (80, rows[9][1], 0), (None, rows[0][1], 1), (1100, rows[0][1], None), *unfit(10)]
    return rows


@pytest.mark.parametrize("chunk, sample", [(8192, 4096), (64, 300), (64, 1), (20, 64)])
def test_hard_negatives_equal_brute_force(spark, labelled, chunk, sample):
    want = triples(labelled, 20)
    assert len(want) > 300
    assert mined(hard_negatives.mined(rows_of(spark, labelled), F.col("vec_id") % 20 == 0, sample=sample, chunk=chunk)) == want


def test_annuli_pass_leaves_over():
    draw = np.random.default_rng(3)
    rows = np.floor(256 * (np.repeat(draw.normal(0, 1, (30, 8)), 60, axis=0) + draw.normal(0, 0.05, (1800, 8))))
    chunk = hard_negatives.Chunk(np.arange(1800), np.zeros(1800, np.int64), rows)
    near, far = chunk.tree.spans(chunk.rows[:1])
    wanted = hard_negatives.Wanted(True, 5, np.array([0.9 * rows[0] @ rows[0]]), np.array([float(rows[0] @ rows[0])]))
    met = hard_negatives.meets(near[0], far[0], *hard_negatives.annuli(float(chunk.rows[0] @ chunk.rows[0]), chunk.tree.largest, wanted))
    assert met.sum() < 0.5 * len(met)
    d = np.sqrt(((chunk.rows - chunk.rows[0]) ** 2).sum(1) + (chunk.tree.largest - (chunk.rows**2).sum(1)))
    for k in range(len(near[0])):  # spans hold all of a leaf
        own = d[chunk.edge[k] : chunk.edge[k + 1]]
        assert near[0, k] - 1e-6 <= own.min() and own.max() <= far[0, k] + 1e-6


def test_hard_negatives_of_few_rows_and_too_large_components(spark):
    every = F.col("vec_id") >= 0
    assert hard_negatives.mined(rows_of(spark, []), every).count() == 0
    assert mined(hard_negatives.mined(rows_of(spark, [(0, [1.0], 1), *unfit(1)]), every)) == []
    few = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [-1.0, 0.0], 2)]
    assert mined(hard_negatives.mined(rows_of(spark, few), every)) == triples(few, 1)
    with pytest.raises(PySparkException, match="vec_id 5"):
        hard_negatives.mined(rows_of(spark, [(5, [1e300, 0.0], 1)]), every).collect()
