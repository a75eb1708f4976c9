from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from reckon.functions import times
from reckon.operators import match

DAY = datetime(2026, 8, 10, 3)
P = "id string, identify string, partner_id string, partner_trace string, partner_metadata map<string,string>, partner_amount decimal(20,4), partner_status string, reconciliation_date timestamp_ntz, partner_trans_date timestamp_ntz, timestamp_basis string, source_file_id string"
I = "id string, partner string, partner_txn_id string, amount decimal(20,4), status string, transaction_time timestamp_ntz"


def p(id, trace, amount="10", status="SUCCESS", at=DAY, other=None, pid="", file="F1"):
    return (id, "A", pid, trace, {"vspTransId": other}, Decimal(amount), status, DAY, at, "CANONICAL_UTC", file)


def i(id, key, amount="10", status="SUCCESS", at=DAY):
    return (id, "A", key, Decimal(amount), status, at)


def run(spark, partner, internal, **options):
    rows = match.reconcile(spark.createDataFrame(partner, P), spark.createDataFrame(internal, I), **options).collect()
    return {r["reconciliation_key"]: r for r in rows if r["reconciliation_key"]}, [r for r in rows if not r["reconciliation_key"]]


def test_outcomes(spark):
    partner = [
        p("1", "ok"), p("2", "bad", status="Thất bại"), p("3", "rev", status=" hoàn tiền "), p("4", "amt", "11"), p("5", "st", status="fail"),
        p("6", "both", "11", "fail"), p("7", "only"), p("8", "pend"), p("9", "ppend", status="???"), p("10", "two"), p("11", "two"),
        p("12", "calm"), p("13", None, other=" v "), p("14", "  ", other=None, pid="pid"), p("15", " pad "), p("16", "", other="", pid=" "),
    ]
    internal = [
        i("a", "ok"), i("b", "bad", status="FAILED"), i("c", "rev", status="REVERSED"), i("d", "amt"), i("e", "st"), i("f", "both"), i("g", "alone"),
        i("h", "pend", status="PENDING"), i("j", "ppend"), i("k", "two"), i("l", "calm"), i("m", "calm", status="PENDING"), i("n", "v"), i("o", "pid"),
        i("q", "pad"), i("r", "dup"), i("s", "dup"), i("t", None), i("u", " "),
    ]
    keyed, none = run(spark, partner, internal)
    assert {k: r["reconciliation_status"] for k, r in keyed.items()} == {
        "ok": "MATCHED", "bad": "MATCHED_FAILED", "rev": "MATCHED_REVERSED", "amt": "AMOUNT_MISMATCH", "st": "STATUS_MISMATCH", "both": "MULTIPLE_MISMATCH",
        "only": "MISSING_INTERNAL", "alone": "MISSING_PARTNER", "pend": "MISSING_INTERNAL", "ppend": "STATUS_MISMATCH", "two": "AMBIGUOUS_KEY", "calm": "MATCHED",
        "v": "MATCHED", "pid": "MATCHED", "pad": "MATCHED", "dup": "AMBIGUOUS_KEY",
    }
    two = keyed["two"]
    assert (two["ambiguous_partner_record_ids"], two["ambiguous_internal_record_ids"]) == (["10", "11"], ["k"])
    assert two["partner_amount"] is None and two["timestamp_status"] == "NOT_EVALUATED"
    assert sorted((r["ambiguous_partner_record_ids"], r["ambiguous_internal_record_ids"]) for r in none) == [([], ["t"]), ([], ["u"]), (["16"], [])]


@pytest.mark.parametrize("delta, expected", [(0, "MATCHED"), (299, "MATCHED"), (300, "MATCHED"), (300.000001, "MISMATCH"), (-301, "MISMATCH")])
def test_timestamp_evidence(spark, delta, expected):
    keyed, _ = run(spark, [p("1", "k", at=DAY + timedelta(seconds=delta))], [i("a", "k")])
    assert keyed["k"]["timestamp_status"] == expected
    assert keyed["k"]["timestamp_delta_seconds"] == Decimal(str(delta)).quantize(Decimal("0.000001"))


def test_missing_timestamp(spark):
    assert run(spark, [p("1", "k", at=None)], [i("a", "k")])[0]["k"]["timestamp_status"] == "NOT_AVAILABLE"


def test_file_scope_leaves_other_internals_out(spark):
    partner, internal = [p("1", "x"), p("2", "y", file="F2")], [i("a", "x"), i("b", "y"), i("c", "z"), i("d", None)]
    keyed, none = run(spark, partner, internal, scope="REPLACEMENT", source_file="F1")
    assert {k: r["reconciliation_status"] for k, r in keyed.items()} == {"x": "MATCHED"} and none == []
    keyed, none = run(spark, partner, internal, source_file="F1")
    assert {k: r["reconciliation_status"] for k, r in keyed.items()} == {"x": "MATCHED", "y": "MISSING_PARTNER", "z": "MISSING_PARTNER"} and len(none) == 1


def test_business_day(spark):
    first, last = times.business_bounds(F.lit("2026-08-10").cast("date"))
    row = spark.range(1).select(first.alias("a"), last.alias("b")).first()
    assert row["a"] == datetime(2026, 8, 9, 17) and row["b"] == datetime(2026, 8, 10, 16, 59, 59, 999999)


def test_results_replace_only_their_days(spark, tmp_path):
    path = str(tmp_path / "results")
    a = spark.createDataFrame([("A", "2026-01-01", 1), ("B", "2026-01-01", 2)], "partner string, date string, n int")
    match.write_results(a, path)
    match.write_results(a.where("partner = 'A'").withColumn("n", F.lit(9)), path)
    assert {(r["partner"], r["n"]) for r in spark.read.parquet(path).collect()} == {("A", 9), ("B", 2)}


def test_surviving_rows(spark):
    old = spark.createDataFrame([("A", DAY.date(), "x", "F1"), ("A", DAY.date(), "y", "F2"), ("A", DAY.date(), "z", "F2"), ("B", DAY.date(), "x", "F1")], "partner string, date date, reconciliation_key string, source_file_id string")
    partner = spark.createDataFrame([p("1", "x"), p("2", "y")], P)
    keys = lambda scope, file: sorted((r["partner"], r["reconciliation_key"]) for r in match.surviving(old, partner, scope, file, "A", DAY.date()).collect())
    assert keys("FULL_SNAPSHOT", None) == [("B", "x")]
    assert keys("UNCONFIRMED", "F1") == [("A", "y"), ("A", "z"), ("B", "x")]
    assert keys("REPLACEMENT", "F1") == [("A", "z"), ("B", "x")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.sampled_from(["SUCCESS", "fail", "x"])), max_size=8), st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.sampled_from(["SUCCESS", "fail", "x"])), max_size=8))
def test_every_eligible_row_is_in_one_result(spark, left, right):
    partner = [p(f"p{k}", key, status=s) for k, (key, s) in enumerate(left)]
    internal = [i(f"i{k}", key, status=s) for k, (key, s) in enumerate(right)]
    rows = match.reconcile(spark.createDataFrame(partner, P), spark.createDataFrame(internal, I)).collect()
    seen = [x for r in rows for x in [r["partner_record_id"], r["internal_record_id"], *(r["ambiguous_partner_record_ids"] or []), *(r["ambiguous_internal_record_ids"] or [])] if x]
    assert sorted(seen) == sorted([f"p{k}" for k in range(len(left))] + [f"i{k}" for k, (_, s) in enumerate(right) if s != "x"])


def test_rows_without_key_partner_or_day_match_nothing_and_are_all_kept(spark):
    partner = [p("1", None), p("1", None), p("2", None), (*p("3", "k")[:1], None, *p("3", "k")[2:])]
    internal = [i("a", None), (*i("b", "k")[:1], None, *i("b", "k")[2:])]
    rows = match.reconcile(spark.createDataFrame(partner, P), spark.createDataFrame(internal, I))
    got = sorted(map(str, ((r["reconciliation_status"], r["ambiguous_partner_record_ids"] or [r["partner_record_id"]], r["ambiguous_internal_record_ids"] or [r["internal_record_id"]]) for r in rows.collect())))
    assert got == sorted(map(str, [
        ("MISSING_INTERNAL", ["3"], [None]), ("MISSING_PARTNER", [None], ["b"]),
        ("UNMAPPED_SKIPPED", ["1"], [None]), ("UNMAPPED_SKIPPED", ["1"], [None]), ("UNMAPPED_SKIPPED", ["2"], [None]), ("UNMAPPED_SKIPPED", [None], ["a"]),
    ]))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # each side once
