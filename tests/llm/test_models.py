import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reckon.llm import language, quality, toxicity

from .conftest import prose, row, KIND

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    draw, docs, labels = random.Random(2), [], []
    for k in range(400):
        bad, toxic = k % 4 == 0, k % 7 == 0
        words = prose(k, draw.randrange(20, 80)).split()
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(4):
                words.insert(draw.randrange(len(words)), draw.choice(["vilest", "rotter", "cad"]))
        docs.append(row(k, " ".join(words)))
        labels.append((k, int(not bad), int(toxic)))
    labels += [(1, 1, 0), (None, 1, 1), (5, None, None), (6, 7, 7)]
    return spark.createDataFrame(docs, KIND), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_rows_are_told_apart(labelled, module, label):
    docs, labels = labelled
    model = module.train(docs, labels)
    scored = module.score(docs, model).join(labels.where(f"{label} IN (0, 1)").dropDuplicates(["doc_id"]), "doc_id").where(quality.held_out())
    rows = scored.select(label, "score").collect()
    assert len(rows) > 50 and np.mean([(r["score"] >= 0.5) == bool(r[label]) for r in rows]) > 0.95


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows_and_labels(labelled, odd, none, module, label):
    docs, labels = labelled
    model = module.train(docs, labels)
    out = module.score(odd, model)
    assert out.count() == odd.count() and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0 and set(out.columns) == set(odd.columns)
    blank = {round(r["score"], 9) for r in out.where("text IS NULL OR text = ''").collect()}
    assert len(blank) == 1
    one = module.train(docs, labels.where(f"{label} = 1"))
    assert module.score(docs, one).where("score < 0.5").count() == 0
    assert module.score(none, module.train(none, labels.limit(0))).count() == 0


def test_descent_reaches_the_optimum():
    draw = np.random.default_rng(0)
    ratio = draw.normal(0, 1, 40)
    rows = [np.sort(draw.choice(40, 8, False)) for _ in range(80)]
    x = np.zeros((80, 40))
    for k, r in enumerate(rows):
        x[k, r] = ratio[r] / np.linalg.norm(ratio[r])
    y = np.where(x @ draw.normal(0, 1, 40) > 0, 1.0, -1.0)
    w, bias = quality.descend(rows, y, ratio, np.full(80, 1.0))

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()

    best = loss(w, bias)
    assert all(loss(w + draw.normal(0, 0.02, 40), bias + draw.normal(0, 0.02)) > best - 0.02 for _ in range(100))


def test_languages(spark, odd, none):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = language.op10_language_id(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    model = language.train(docs)
    out = {(r["doc_id"], r["text"]): (r["lang_pred"], r["lang_score"]) for r in language.identify(odd, model).collect()}
    assert all(out[k] == ("und", 0.0) for k in ((1, None), (2, ""), (3, " \n\t ")))
    assert language.identify(none, language.train(none)).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, language.train(none)).collect()} == {"und"}


def test_filter_has_no_false_negatives():
    texts = {"x": ["abcd abcd efgh efgh"], "y": ["wxyz wxyz qrst qrst"]}
    model = language.fit(list(texts.items()))
    got = language.shares(model, ["abcd efgh", "wxyz qrst"])
    assert got[0, 0] > got[0, 1] and got[1, 1] > got[1, 0]


def test_more_languages_than_bits_of_a_word(spark):
    alphabet = "abcdefghijklmnopqrstuvwxyz"

    def text(lang, seed):
        draw, own = random.Random(lang), random.Random(1000 * lang + seed)
        words = ["".join(draw.choice(alphabet) for _ in range(7)) for _ in range(30)]
        return " ".join(own.choice(words) for _ in range(40))

    rows = [(100 * lang + k, text(lang, k), f"l{lang:03}") for lang in range(150) for k in range(8 if lang % 2 else 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert len(model[0]) == 150 and model[1].shape == (3, language.SLOTS)
    assert language.identify(docs, model).where("lang_pred <> lang OR lang_score < 0.5").count() == 0


def test_only_letters_have_a_language(spark):
    texts = ["\u00b2 \u00bd \u2167", "12_3", "\u0663\u0664", "\u0301", "\u24d0", "\u00aa", "\u65e5", "x"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.fit([("x", ["xx xx xx xx"])])
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    assert [got[k] for k in range(8)] == ["und"] * 5 + ["x"] * 3


def test_filter_counts_equal_sets_of_grams():
    def grams(text):
        raw = f" {text.lower()} ".encode()
        return [raw[k : k + language.GRAM] for k in range(len(raw) - language.GRAM + 1)]

    samples = {f"l{k}": [" ".join(f"{chr(97 + (k + j) % 26)}{prose(10 * k + j, 1)}" for j in range(12))] * 2 for k in range(70)}
    model = language.fit(samples.items())
    counts = {name: {} for name in samples}
    for name, texts in samples.items():
        for g in (g for t in texts for g in grams(t)):
            counts[name][g] = counts[name].get(g, 0) + 1
    rate = {name: {g: n / sum(c.values()) for g, n in c.items() if n > 1} for name, c in counts.items()}
    top = {}
    for own in rate.values():
        for g, r in own.items():
            top[g] = max(top.get(g, 0), r)
    texts = [prose(k, 20) + " axba0 bxce1" for k in range(30)]
    got = language.shares(model, texts)
    names, filled, false = model
    for at, name in enumerate(names):
        own = {g for g, r in rate[name].items() if r >= language.SHARE * top[g]}
        bits = {tuple(int(language._slot(language.grams(np.frombuffer(g, np.uint8), np.array([0, 4]))[0], k)[0]) for k in range(language.HASHES)) for g in own}
        slots = [{b[k] for b in bits} for k in range(language.HASHES)]
        fill = np.mean([len(set().union(*slots))]) / language.SLOTS
        assert false[at] == pytest.approx(fill**language.HASHES)
        for row, text in enumerate(texts):
            found = grams(text)
            hit = sum(all(int(language._slot(language.grams(np.frombuffer(g, np.uint8), np.array([0, 4]))[0], k)[0]) in set().union(*slots) for k in range(language.HASHES)) for g in found) if row < 2 else None
            exact = sum(g in own for g in found) / len(found)
            if hit is not None:
                assert got[row, at] == pytest.approx(max(0.0, (hit / len(found) - false[at]) / (1 - false[at])))
            assert abs(got[row, at] - exact) < 0.05


def test_class_counts_equal_brute_force(spark, labelled):
    docs, labels = labelled
    rows = quality.labelled(docs, labels, "quality")
    counts = quality.class_counts(rows)
    want = np.zeros((2, quality.FEATURES + 1))
    for r in rows.collect():
        raw = r["text"].encode()
        words, slots = raw.split(), set()
        one = lambda b: int(quality._slots(quality.span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)])))[0])
        slots |= {one(w) for w in words}
        for size in range(2, quality.REPEATED + 1):
            if any(len(set(words[k : k + size])) == 1 for k in range(len(words) - size + 1)):
                slots.add(size)
        for size in quality.GRAMS:
            for k in range(len(raw) - size + 1):
                value = int.from_bytes(raw[k : k + size], "big")
                slots.add(int(quality._slots(np.array([(value * 0xD6E8FEB86659FD93 + size) % 2**64], np.uint64))[0]))
        want[r["label"], list(slots - {0})] += 1
        want[r["label"], quality.FEATURES] += 1
    assert np.array_equal(counts, want)
    p, q = want[1, :-1] + 1, want[0, :-1] + 1
    ratio = np.where(want[:, :-1].sum(0) > 0, np.log(p / p.sum()) - np.log(q / q.sum()), 0)
    assert np.allclose(quality.train(docs, labels).ratio, ratio, atol=1e-5)


def test_savings_equal_the_compressors(labelled):
    docs, _ = labelled
    texts = [r["text"] for r in docs.limit(60).collect()] + [None, "", " \n ", "cad", "A  \t rotter\nvilest cad x y"]
    pair = next(iter(toxicity.dictionaries(["a vilest cad, a rotter"] * 9 + texts[:20], texts[20:50])))
    windows = toxicity.Windows(*pair)
    runs = lambda x: {x[k : k + n] for n in toxicity.OWN for k in range(len(x) - n + 1)}
    only = runs(pair[0]) - runs(pair[1])
    compressors = []
    for content in (pair[1], pair[1] + pair[0]):
        held = toxicity.zstandard.ZstdCompressionDict(content + toxicity.TAIL, dict_type=toxicity.zstandard.DICT_TYPE_RAWCONTENT)
        settings = toxicity.zstandard.ZstdCompressionParameters(**toxicity._FIT, **toxicity._BARE)
        compressors.append(toxicity.zstandard.ZstdCompressor(dict_data=held, compression_params=settings))
    saved, begin, _ = windows.saved(texts)
    some = 0
    for k, text in enumerate(texts):
        low = f" {text.lower()} " if text else ""
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\n\v\f\r]+", low)]
        want = []
        for at in range(0, len(spans), toxicity.WIDTH):
            part = spans[at : at + toxicity.WIDTH]
            window = re.sub(r"[\t\n\v\f\r]", " ", low[part[0][0] - 1 : part[-1][1] + 1]).encode()
            passes = bool(runs(window) & only)
            a, b = (len(c.compress(window + toxicity.TAIL)) for c in compressors)
            want.append(max(0, a - b) if passes else 0)
        assert saved[begin[k] : begin[k + 1]].tolist() == want
        some += sum(want)
    assert some > 0


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic IN (0, 1)").dropDuplicates(["doc_id"])
    rows = toxicity.op8_toxicity(spark, folder).where("held_out").join(labels, "doc_id").select("toxic", "score").toPandas()
    rank = rows["score"].rank()
    n = (rows["toxic"] == 1).sum()
    assert (rank[rows["toxic"] == 1].sum() - n * (n + 1) / 2) / (n * (len(rows) - n)) > 0.78


def test_blended_weights_lean_on_naive_bayes_for_both_classes():
    w = np.array([0.4, -0.2, 0.0])
    ratio = np.array([1.0, -1.0, -2.0])
    got = quality.blended(w)
    assert np.allclose(got, 0.9 * w + 0.1 * 0.2)
    assert (got * ratio)[2] < 0  # a feature of class 0 that was never fitted speaks for class 0


def test_a_language_of_one_short_text_is_learned():
    names, filled, false = language.fit([("en", ["the cat sat on the mat and the dog ran " * 3] * 60), ("rare", ["zebra quux flimp wozzle"])])
    assert names[language.shares((names, filled, false), ["zebra quux flimp wozzle"])[0].argmax()] == "rare"
