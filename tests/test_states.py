import random

import pytest
from pyspark.sql import functions as F

from reckon.operators import folds, recovery
from reckon.streaming import ingest

LOG = "record_id string, event_id long, at timestamp_ntz, to_status string, actor string"


def logged(seed, n):
    """Events of a hot record, of others and of none; event ids come again, and times tie."""
    draw = random.Random(seed)
    out = []
    for k in range(n):
        record = draw.choice(["hot", "hot", "a", "b", None])
        out.append((record, draw.randrange(n), 1_700_000_000 + draw.randrange(n // 2), draw.choice([*recovery.TRANSITIONS, "REPROCESSING", "BAD", None]), f"p{k}"))
    return out


def frame(spark, rows):
    raw = spark.createDataFrame(rows, "record_id string, event_id long, s long, to_status string, actor string")
    return raw.select("record_id", "event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("at"), "to_status", "actor")


def walked(rows):
    """(record, event, before, after, result, times) by plain Python."""
    out, by = [], {}
    for r in rows:
        by.setdefault(r[0], {}).setdefault(r[1], []).append(r)
    for record, events in by.items():
        now = "PENDING"
        firsts = [min(e, key=lambda r: (r[2], r[3] is not None, r[3] or "", r[4])) for e in events.values()]
        for first in sorted(firsts, key=lambda r: (r[2], r[1])):
            fine = first[3] in recovery.TRANSITIONS[now]
            then = first[3] if fine else now
            out.append((record, first[1], now, then, "APPLIED" if fine else "REFUSED", 1))
            if len(events[first[1]]) > 1:
                out.append((record, first[1], then, then, "REPEATED", len(events[first[1]]) - 1))
            now = then
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_status_changes_equal_a_plain_walk(spark, partitions):
    rows = logged(4, 500)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = recovery.status_changes(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(((r["record_id"], r["event_id"], r["before"], r["after"], r["result"], r["times"]) for r in got), key=str) == walked(rows)


def test_folds_of_no_events_and_of_one_key(spark):
    table = {"off": {"x": "on"}, "on": {"x": "off"}}
    empty = spark.createDataFrame([], "k string, n int, s string")
    assert folds.folded(empty, ["k"], ["n"], "s", table, "off").count() == 0
    one = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "x").alias("s"), F.lit(1).alias("before_"))
    got = folds.folded(one, ["k"], ["n"], "s", table, "off").orderBy("n").collect()
    state = "off"
    for r in got:
        then = table[state].get(r["s"], state)
        assert (r["before"], r["after"], r["applied"]) == (state, then, r["s"] == "x")
        state = then


def run(spark, frames, tmp_path, follow, name):
    """The rows that ``follow`` gives for a stream of the frames, a file each."""
    path = str(tmp_path / name)
    out = []
    for n, rows in enumerate(frames):
        rows.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        query = follow(stream).writeStream.option("checkpointLocation", str(tmp_path / f"{name}-at")).foreachBatch(lambda b, _: out.extend(b.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
    return out


def test_status_follows_a_stream(spark, tmp_path):
    steps = [[("a", 1, "REPROCESSING"), ("b", 2, "RESOLVED")], [("a", 1, "REPROCESSING"), ("a", 3, "RESOLVED"), ("b", 4, "REPROCESSING")], [("a", 5, "PENDING"), ("b", 6, "REJECTED")]]
    frames = [frame(spark, [(r, e, 1_700_000_000 + e, s, "x") for r, e, s in step]) for step in steps]
    got = run(spark, frames, tmp_path, recovery.follow_status, "log")
    assert sorted((r["record_id"], r["event_id"], r["before"], r["after"], r["result"]) for r in got) == sorted([
        ("a", 1, "PENDING", "REPROCESSING", "APPLIED"), ("b", 2, "PENDING", "PENDING", "REFUSED"), ("a", 1, "REPROCESSING", "REPROCESSING", "REPEATED"),
        ("a", 3, "REPROCESSING", "RESOLVED", "APPLIED"), ("b", 4, "PENDING", "REPROCESSING", "APPLIED"), ("a", 5, "RESOLVED", "RESOLVED", "REFUSED"), ("b", 6, "REPROCESSING", "REJECTED", "APPLIED"),
    ])


UNITS = "stream string, position long, key string, hash string, outcome string"


def test_units_run_in_order_and_resume(spark):
    rows = [("s", k, f"k{k}", f"h{k}", "FAILED" if k == 5 else "COMPLETED") for k in range(9)] + [("t", 1, "x", "y", "COMPLETED"), ("t", 2, "z", "w", None), (None, 1, "n", "n", "SKIPPED")]
    units = spark.createDataFrame(rows, UNITS)
    marks = spark.createDataFrame([("s", "k1", None), ("t", None, "none")], "stream string, done_key string, done_hash string")
    planned = ingest.ordered_units(units, marks)
    got = {(r["stream"], r["position"]): r["status"] for r in planned.collect()}
    assert [got["s", k] for k in range(9)] == ["DONE", "DONE", "COMPLETED", "COMPLETED", "COMPLETED", "FAILED", "WAITING", "WAITING", "WAITING"]
    assert (got["t", 1], got["t", 2], got[None, 1]) == ("COMPLETED", "FAILED", "SKIPPED")
    then = ingest.advanced(planned, marks)
    assert sorted(map(tuple, then.collect()), key=str) == sorted([("s", "k4", "h4", "k5"), ("t", "x", "y", "z"), (None, "n", "n", None)], key=str)
    mended = units.withColumn("outcome", F.lit("COMPLETED"))
    again = {(r["stream"], r["position"]): r["status"] for r in ingest.ordered_units(mended, then).collect()}
    assert [again["s", k] for k in range(9)] == ["DONE"] * 5 + ["COMPLETED"] * 4 and again[None, 1] == "DONE"


def test_units_follow_a_stream(spark, tmp_path):
    steps = [[("s", 1, "a", "COMPLETED"), ("s", 2, "b", "FAILED"), ("s", 3, "c", "COMPLETED"), ("t", 1, "a", "COMPLETED")], [("s", 3, "c", "COMPLETED"), ("t", 1, "a", "COMPLETED")], [("s", 2, "b", "COMPLETED"), ("s", 3, "c", "SKIPPED")]]
    frames = [spark.createDataFrame([(s, p, k, None, o) for s, p, k, o in step], UNITS) for step in steps]
    got = run(spark, frames, tmp_path, ingest.follow_units, "units")
    assert sorted((r["stream"], r["position"], r["status"]) for r in got) == sorted([
        ("s", 1, "COMPLETED"), ("s", 2, "FAILED"), ("s", 3, "WAITING"), ("t", 1, "COMPLETED"), ("s", 3, "WAITING"), ("t", 1, "DONE"), ("s", 2, "COMPLETED"), ("s", 3, "SKIPPED"),
    ])
