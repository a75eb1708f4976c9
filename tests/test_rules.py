from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reckon.functions import keys, text, times
from reckon.operators import dedupe, mapping, metrics, profile, recovery, scope
from reckon.plans import catalog

M = mapping.FieldMapping


def test_mapping_errors(spark):
    fields = mapping.canonical_mappings([M("id", column="A", required=True), M("amount", "DECIMAL", column=2, required=True), M("status", column="3", required=True), M("transDate", "DATE", column="D"), M("extra.note", column=5)])
    rows = spark.createDataFrame([
        (["a", "1.5", "Thành công", "2024-01-02", "n"],), (["", "x", "nope", "2024-13-01", ""],), (["b", "-1", "FAILED", "", "n"],), (["c", None, "FAILED", None, "n"],), (["d", "1"],),
    ], "cells array<string>")
    got = mapping.violations(mapping.map_rows(rows, fields)).collect()
    codes = [([e["code"] for e in r["errors"]], [e["code"] for e in r["violations"]]) for r in got]
    assert codes[0] == ([], []) and got[0]["amount"] == Decimal("1.5000") and got[0]["currency"] == "VND" and got[0]["extra"] == {"note": "n"}
    assert got[0]["transDate"] == datetime(2024, 1, 1, 17)
    assert codes[1] == (["MISSING_REQUIRED_FIELD", "INVALID_AMOUNT", "INVALID_STATUS", "INVALID_TIMESTAMP", "MALFORMED_ROW"], [])
    assert codes[2] == ([], ["NEGATIVE_AMOUNT"]) and got[2]["transDate"] is None
    assert codes[3] == (["MISSING_REQUIRED_FIELD"], [])
    assert codes[4][0][:1] == ["MALFORMED_ROW"]


@pytest.mark.parametrize("value, expected", [
    ("2024-01-02", datetime(2024, 1, 1, 17)), ("02/01/2024", datetime(2024, 1, 1, 17)), ("2024-01-02 07:00:00", datetime(2024, 1, 2)),
    ("2024-01-02T07:00:00+07:00", datetime(2024, 1, 2)), ("2024-01-02T00:00:00.5Z", datetime(2024, 1, 2, 0, 0, 0, 500000)), ("2024-01-02T00:00:00-23:30", datetime(2024, 1, 2, 23, 30)),
    ("2024-02-30", None), ("2024/01/02 00:00:00", None), ("2024-1-2", None), ("", None), ("2024-01-02T00:00:00+25:00", None), ("2024-01-02T00:00:00", None),
])
def test_timestamps(spark, value, expected):
    assert spark.createDataFrame([(value,)], "v string").select(times.canonical_time(F.col("v")).alias("t")).first()["t"] == expected


def test_config_and_file_gate():
    bad = [M("id", column=1), M("id", column=2), M("x", "CONSTANT"), M("y", "MAPPING", column=1), M("z")]
    assert [c for c, _ in mapping.config_issues(bad)] == ["DUPLICATE_PATH", "EMPTY_CONSTANT", "EMPTY_MAPPING", "NO_SOURCE"]
    good = [M("id", column="A"), M("amount", column=2), M("currency", "CONSTANT", constant="VND"), M("status", column="Status")]
    assert mapping.file_gate(good, ["Id", "Amount", "Status"]) == []
    assert mapping.file_gate(good, ["Id", "Amount", "Status", "New"], ["Id", "Amount", "Status"]) == [("WARNING", "SCHEMA_CONFIG_DRIFT")]
    assert ("BATCH_FATAL", "MISSING_REQUIRED_SOURCE_COLUMN") in mapping.file_gate(good, ["Id"])
    assert [mapping.column_number(c) for c in ("A", "z", "AA", 3, "12")] == [1, 26, 27, 3, 12]
    assert (mapping.mapping_score(2, 1), mapping.mapping_score(9, 0)) == (65, 0)


def test_duplicates_balance(spark):
    kind = "k string, ordinal int, fingerprint string"
    held = spark.createDataFrame([("a", 0, "x")], kind)
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "x"), ("b", 4, "x"), ("b", 5, "z"), ("c", 6, "x")], kind)
    got = {r["ordinal"]: r["result"] for r in dedupe.classified(rows, held, ["k"]).collect()}
    assert got == {1: "EQUIVALENT", 2: "CONFLICTING", 3: "INSERTED", 4: "EQUIVALENT", 5: "CONFLICTING", 6: "INSERTED"}
    assert sorted(r["ordinal"] for r in dedupe.insertable(rows, held, ["k"]).collect()) == [3, 6]
    assert all(r["balanced"] for r in dedupe.accounting(dedupe.classified(rows, held, ["k"]), []).collect())


def test_fingerprints_ignore_trailing_zeros(spark):
    rows = spark.createDataFrame([("100.0",), ("100.00",), ("101",), ("0",), ("0.00",), ("1000",)], "v string").select(keys.plain_amount(F.col("v").cast("decimal(20,4)")).alias("t"))
    assert [r["t"] for r in rows.collect()] == ["100", "100", "101", "0", "0", "1000"]


@pytest.mark.parametrize("counts, files, expected", [
    ((0, 0, 0, 0), 0, ("UNCONFIRMED", 0.2)), ((5, 0, 0, 5), 0, ("FULL_SNAPSHOT", 0.92)), ((5, 0, 0, 5), 1, ("UNCONFIRMED", 0.55)), ((5, 5, 0, 5), 1, ("INCREMENTAL_APPEND", 0.98)),
    ((6, 5, 5, 1), 1, ("REPLACEMENT", 0.96)), ((10, 20, 8, 2), 1, ("REPLACEMENT", 0.86)), ((10, 20, 4, 6), 1, ("INCREMENTAL_APPEND", 0.9)), ((10, 20, 6, 4), 1, ("UNCONFIRMED", 0.55)),
])
def test_key_scope(spark, counts, files, expected):
    row = scope.key_scope(spark.createDataFrame([counts], "incoming int, historical int, overlap int, fresh int"), F.lit(files)).first()
    assert (row["scope"], float(row["confidence"])) == expected


def test_retry_and_states(spark):
    row = spark.range(1).select(
        recovery.retry_delay(F.lit("fetch_timeout"), F.lit(2)).alias("a"), recovery.retry_delay(F.lit("fetch_timeout"), F.lit(3)).alias("b"), recovery.retry_delay(F.lit("other"), F.lit(0)).alias("c"),
        recovery.issue_type(F.lit("invalid_amount")).alias("d"), recovery.transition_allowed(F.lit("RESOLVED"), F.lit("PENDING")).alias("e"), recovery.partner_state(F.lit(False), F.lit(1)).alias("f"),
        scope.overridden(F.lit("INCREMENTAL_APPEND"), F.lit(10_000), F.lit(9_800)).alias("g"), text.scrubbed(F.lit("password=abc at db://u:pw@h")).alias("h"),
    ).first()
    assert tuple(row) == (120, None, None, "FORMAT", False, "BLOCKED", True, "password=*** at db://u:***@h")
    assert recovery.backfill_days(date(2026, 8, 7), date(2026, 8, 10)) == [date(2026, 8, 7), date(2026, 8, 10)]
    with pytest.raises(ValueError):
        recovery.backfill_days(date(2026, 8, 8), date(2026, 8, 9))


def test_rates_and_bands(spark):
    rows = spark.createDataFrame([("A", "MATCHED", Decimal(0), Decimal(5))] * 4 + [("A", "AMOUNT_MISMATCH", Decimal(200000), Decimal(1))], "partner string, reconciliation_status string, partner_amount decimal(20,4), internal_amount decimal(20,4)")
    assert metrics.summary(rows, ["partner"]).first()["mismatch_rate"] == Decimal("20.00")
    got = {r["band"]: (r["n"], r["total"]) for r in metrics.groups(rows, metrics.band(metrics.group_amount()), "band").collect()}
    assert got == {"0-100k": (4, Decimal(20)), "100k-1M": (1, Decimal(200000))}


def test_latest_and_pages(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 1, 4)], "s string, t int, id int")
    assert sorted(r["id"] for r in metrics.latest(rows, ["s"], "t", "id").collect()) == [3, 4]
    assert [r["id"] for r in metrics.page_after(rows, "t", "id", (1, 1), 2).collect()] == [4, 2, 3]
    assert [r["id"] for r in metrics.page(rows, ["t", "id"], 1, 2).collect()] == [4, 2]


def test_profile_report(spark):
    from reckon.operators import profile

    rows = spark.createDataFrame([("a", 1), ("N/A", 2), (None, 2)], "x string, y int")
    data, text = profile.report({"columns": profile.columns(rows, ["x", "y"])})
    assert '"missing": 2' in data and "| x | 3 | 2 | 1 |" in text


def test_quantiles_of_histograms_are_exact_without_one_group_in_one_task(spark):
    import random

    from reckon.operators import profile

    draw = random.Random(1)
    rows = [(g, float(x)) for g in ("a", None) for x in [draw.choice([draw.random(), draw.random() * 1e-9, -1e300, 7.0, 1e300]) for _ in range(2001)]] + [("one", 3.0)]
    points = spark.createDataFrame(rows, "g string, x double").groupBy("g", "x").agg(F.count("*").alias("n"))
    at = [0.0, 0.25, 0.3333, 0.5, 0.95, 1.0]
    got = {r["g"]: r["q"] for r in profile.quantiles(points, ["g"], "x", "n", at).collect()}
    want = {r["g"]: r["q"] for r in points.groupBy("g").agg(F.expr(f"percentile(x, array({', '.join(map(str, at))}), n)").alias("q")).collect()}
    assert got == want
    plan = profile.amounts(points.where("g = 'a' AND abs(x) < 10"), "x")._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_fingerprints_of_large_days_are_not_collected_in_a_row(spark):
    day = F.when(F.col("id") % 10 < 9, F.lit("hot")).when(F.col("id") % 20 < 10, F.lit("cold"))
    key = F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 5000))
    results = spark.range(30_000).select(day.alias("date"), key.alias("reconciliation_key"), F.lit("MATCHED").alias("reconciliation_status"))
    each = F.concat_ws(":", F.coalesce("reconciliation_key", F.lit("")), "reconciliation_status")
    want = results.groupBy("date").agg(F.md5(F.array_join(F.array_sort(F.collect_list(each)), ",")).alias("fingerprint"))
    got = metrics.results_fingerprint(results, ["date"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_only_reprocessing_follows_pending(spark):
    from reckon.operators import recovery

    states = list(recovery.TRANSITIONS)
    rows = spark.createDataFrame([(a, b) for a in states for b in states], "a string, b string")
    got = {(r["a"], r["b"]) for r in rows.where(recovery.transition_allowed(F.col("a"), F.col("b"))).collect()}
    assert got == {("PENDING", "REPROCESSING"), *(("REPROCESSING", x) for x in ("PENDING", "RESOLVED", "REJECTED"))}


def test_quarantine_store_appends_and_purges(spark, tmp_path):
    from datetime import datetime

    from reckon.operators import recovery

    spark.sparkContext.setCheckpointDir(str(tmp_path / "cut"))
    at = datetime(2024, 1, 1)
    rows = [(k, at, s, ["INVALID_AMOUNT"], "ERROR", datetime(2024, 1, 1 + k)) for k, s in enumerate(["PENDING", "RESOLVED", "RESOLVED", "REJECTED", "RESOLVED"])]
    records = spark.createDataFrame(rows, "id long, created_at timestamp, status string, codes array<string>, severity string, resolved_at timestamp")
    path = str(tmp_path / "store")
    recovery.append(records, path)
    recovery.append(records.where("id = 0").withColumn("id", F.lit(9).cast("long")), path)
    ids = lambda: sorted(r["id"] for r in spark.read.parquet(path).collect())
    assert ids() == [0, 1, 2, 3, 4, 9]
    assert recovery.purge(spark, path, F.lit("2024-04-02 00:00:00").cast("timestamp"), 10) == 2 and ids() == [0, 3, 4, 9]
    assert recovery.purge(spark, path, F.lit("2026-01-01 00:00:00").cast("timestamp"), 1) == 1 and ids() == [0, 3, 9]
    assert recovery.purge(spark, path, F.lit("2023-01-01 00:00:00").cast("timestamp")) == 0


def test_amounts_keep_their_places_or_are_errors(spark):
    values = ["1.2345", "1.23450000", "1.23451", "-0.00001", "", "x", None, "NaN", "9999999999999999.9999", "99999999999999999"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(keys.exact_money(F.col("v")).alias("a"))
    assert [r["a"] for r in rows.collect()] == [Decimal("1.2345"), Decimal("1.2345"), None, None, None, None, None, None, Decimal("9999999999999999.9999"), None]


def test_columns_of_records(spark):
    fields = [M("id", column=28), M("trace", column="7"), M("note.x", source_field="n"), M("extra.y", source_field="n"), M("plain", source_field="n")]
    rows = spark.createDataFrame([({"AB": "1", "7": "t", "n": "v"},), ({"28": "2", "AB": "no", "n": "w"},)], "record map<string,string>")
    got = mapping.map_rows(rows, fields, None, "record").collect()
    assert [(r["id"], r["trace"], r["nested"], r["extra"]) for r in got] == [("1", "t", {"note": {"x": "v"}}, {"y": "v", "plain": "v"}), ("2", None, {"note": {"x": "w"}}, {"y": "w", "plain": "w"})]
    assert [mapping.column_letters(n) for n in (1, 26, 27, 52, 702, 703)] == ["A", "Z", "AA", "AZ", "ZZ", "AAA"]
    assert ("INVALID_COLUMN", "id") in mapping.config_issues([M("id", column="A1")]) and mapping.config_issues([M("id", column="ab")]) == []


def test_configurations_and_gates_of_many_files_equal_those_of_one(spark):
    sets = {
        "good": [M("id", column="A"), M("amount", column=2), M("currency", "CONSTANT", constant="VND"), M("status", source_field="Status")],
        "bad": [M("id", column="A"), M("id", column="B"), M("status", "MAPPING", column="C"), M("currency", "CONSTANT"), M("trace")],
        "none": [],
    }
    rows = [(c, k, m.path, m.type, None if m.column is None else str(m.column), m.source_field, m.constant, len(m.mapping)) for c, maps in sets.items() for k, m in enumerate(maps)]
    maps = spark.createDataFrame(rows, "config string, position int, path string, type string, column string, source_field string, constant string, pairs int")
    got = sorted(tuple(r) for r in mapping.config_findings(maps).collect())
    assert got == sorted((c, *f) for c, m in sets.items() for f in mapping.config_issues(m))
    assert {r["config"]: r["score"] for r in mapping.config_scores(maps).collect()} == {c: mapping.mapping_score(len(mapping.config_issues(m)), 0) for c, m in sets.items() if m}
    known = ["Id", "Amount", "Status"]
    shapes = {"same": known, "more": [*known, "New"], "other": ["Key", *known[1:]], "short": known[:1], "empty": []}
    files = spark.createDataFrame([(f"{c}/{s}", c, h) for c in sets for s, h in shapes.items()], "file string, config string, headers array<string>")
    expected = spark.createDataFrame([(c, known) for c in sets if c != "bad"], "config string, known array<string>")
    found = sorted(tuple(r) for r in mapping.gate_findings(files, maps, expected).collect())
    assert found == sorted((f"{c}/{s}", *f) for c, m in sets.items() for s, h in shapes.items() for f in mapping.file_gate(m, h, known if c != "bad" else None))


def test_column_numbers_as_expressions(spark):
    numbers = [1, 26, 27, 52, 53, 702, 703, 18278, 18279, 12356630]
    rows = spark.createDataFrame([(n, mapping.column_letters(n)) for n in numbers], "n long, letters string")
    assert all(r["l"] == r["letters"] and r["b"] == r["n"] for r in rows.select("*", mapping.letters_of(F.col("n")).alias("l"), mapping.number_of(F.lower("letters")).alias("b")).collect())
    odd = spark.createDataFrame([("A1",), ("",), (None,), ("7",)], "x string")
    assert [r[0] for r in odd.select(mapping.number_of(F.col("x"))).collect()] == [None, None, None, 7]


def test_observed_columns_and_their_drift(spark):
    rows = [(str(k), None if k % 3 else "1.5", "2024-01-0%d" % (k % 9 + 1), "x" if k == 7 else "7", "") for k in range(300)]
    frame = spark.createDataFrame(rows, "a string, b string, c string, d string, e string").repartition(5)
    got = {r["name"]: tuple(r)[1:] for r in profile.observed(frame, list("abcde"), 100).collect()}
    assert got == {"a": (300, 0, "integer", None, True), "b": (300, 200, "decimal", 1, False), "c": (300, 0, "instant", 9, False), "d": (300, 0, "text", 2, False), "e": (300, 300, None, 0, False)}
    exact = {r["name"]: r["distinct_values"] for r in profile.observed(frame, list("abcde"), 300).collect()}
    assert exact["a"] == 300
    found = profile.drift(profile.observed(frame, list("abcde")), [("a", "decimal", True), ("b", "integer", True), ("c", "text", True), ("d", "integer", False), ("e", "text", False), ("f", "text", True)])
    assert {r["name"]: r["drift"] for r in found.collect()} == {"a": None, "b": "TYPE", "c": None, "d": "TYPE", "e": None, "f": "MISSING"}
    none = profile.observed(frame.limit(0), ["a"]).collect()
    assert [tuple(r) for r in none] == [("a", 0, 0, None, 0, False)]


@pytest.mark.parametrize("name, reads", [("quarantine_filter", 1), ("quarantine_issue_types", 1), ("quarantine_overdue", 3)])
def test_filters_on_mapped_rows_do_not_evaluate_their_texts_again(spark, name, reads):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().upper()
    once = plan(spark.range(1).select(times.canonical_time(F.col("id").cast("string")))).count("RLIKE")
    d = "/root/testdata/sf0.001"
    assert once and plan(catalog.cells(spark, d).limit(1)).count("RLIKE") == 0
    assert plan(entry.queries()[name](spark, d)).count("RLIKE") <= once * reads
