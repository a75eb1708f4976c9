import random

import pytest
from pyspark.sql import functions as F

from reckon.operators import filters
from reckon.streaming import ingest

KIND = "k string, day string, at long, note string"


def kept(batches):
    """What a store holds after the batches, and the counts of each, by plain Python; the last field tells valid rows."""
    held, counts = {}, []
    for n, rows in enumerate(batches):
        first = {}
        for k, day, at, note, fine in rows:
            if fine and (k, day or None) not in held:
                first[(k, day or None)] = min(first.get((k, day or None), (at, note)), (at, note))
        held |= {key: (*row, n) for key, row in first.items()}
        failed = sum(not r[4] for r in rows)
        counts.append({"input": len(rows), "failed": failed, "inserted": len(first), "repeated": len(rows) - failed - len(first)})
    return sorted(((*key, *row) for key, row in held.items()), key=str), counts


def drawn(seed, batches, rows):
    draw = random.Random(seed)
    days = ["2024-01-01", "2024-01-02", None, "", "a/b=c%"]
    return [[(draw.choice([*map(str, range(40)), None]), draw.choice(days), n * 10_000 + at, f"r{at}", draw.random() > 0.2) for at in range(rows)] for n in range(batches)]


def stored(spark, target):
    got = ingest.stored_rows(spark, target, spark.createDataFrame([], KIND).schema)
    return sorted(((r["k"], r["day"] or None, r["at"], r["note"], r["batch"]) for r in got.collect()), key=str)


@pytest.mark.parametrize("by", ["day", None])
def test_many_batches_equal_a_plain_store(spark, tmp_path, by):
    batches = [[(k, day if by else day or None, *rest) for k, day, *rest in rows] for rows in drawn(3, 11, 40)]
    target, counts = str(tmp_path / "store"), []
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, KIND + ", fine boolean")
        for _ in range(2 if n in (4, 10) else 1):  # two are tried twice
            got = ingest.append(frame, n, target, ["k", "day"], "at", by, F.col("fine"))
        counts.append(got)
    want, expected = kept(batches)
    assert counts == expected and stored(spark, target) == want
    assert ingest.Store(spark, target).names("_folders") == ["0-7", "10-10", "8-8", "9-9"]
    with pytest.raises(ValueError):
        ingest.append(frame, 5, target, ["k", "day"], "at", by)


def test_new_keys_open_no_folder_and_old_ones_only_theirs(spark, tmp_path):
    target = str(tmp_path / "store")
    rows = [(str(k), f"d{k % 30}", k, "x") for k in range(3000)]
    ingest.append(spark.createDataFrame(rows, KIND), 0, target, ["k", "day"], "at", "day")
    store = ingest.Store(spark, target)

    def opened(rows):
        return sorted(p.rsplit("/", 1)[-1] for p in ingest._possible(store, spark.createDataFrame(rows, KIND), ["k", "day"], "day", store.ranges(1)))

    assert opened([(str(k), f"d{k % 30}", k, "x") for k in range(5000, 5005)]) == [] and opened([("7", "d40", 1, "x")]) == []
    assert opened([("7", "d7", 1, "x"), ("8", "d8", 1, "x"), ("7", "d8", 1, "x")]) == ["day=d7", "day=d8"]
    assert ingest.append(spark.createDataFrame([("7", "d7", 1, "x"), ("9999", "d7", 2, "x")], KIND), 1, target, ["k", "day"], "at", "day")["inserted"] == 1


def test_batches_of_more_values_than_are_listed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "MOST_FOLDERS", 3)
    target = str(tmp_path / "store")
    rows = [(str(k), f"d{k % 9}", k, "x") for k in range(90)]
    for n in range(2):
        got = ingest.append(spark.createDataFrame(rows + [("new", f"d{n}", 1, "x")], KIND), n, target, ["k", "day"], "at", "day")
        assert (got["inserted"], got["repeated"]) == ((91, 0), (1, 90))[n]


def test_empty_batches(spark, tmp_path):
    target, empty = str(tmp_path / "store"), spark.createDataFrame([], KIND)
    for n in range(2):
        assert ingest.append(empty, n, target, ["k", "day"], "at", "day") == {"input": 0, "failed": 0, "inserted": 0, "repeated": 0}
    assert ingest.append_batch(empty, 2, target, ["k", "day"], "at").count() == 0 and stored(spark, target) == []


def test_filters_lose_no_key_and_refuse_most_others(spark):
    keys = spark.range(20_000).select((F.col("id") % 3).alias("folder"), filters.key_hash(F.col("id")).alias("hash"))
    sets = keys.groupBy("folder").agg(F.count("*").alias("n")).select("folder", filters.blocks(F.col("n")).alias("blocks"))
    made = filters.built(keys, sets, ["folder"])
    assert filters.maybe(keys.join(sets, "folder"), made, ["folder"]).count() == 20_000
    others = spark.range(20_000, 40_000).select((F.col("id") % 3).alias("folder"), filters.key_hash(F.col("id")).alias("hash"))
    assert filters.maybe(others.join(sets, "folder"), made, ["folder"]).count() < 500
