"""The registered queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import keys, text, times
from ..operators import dedupe, mapping, match, metrics, profile, recovery, scope
from . import workload
from .workload import RELATIONS, results_sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def results(spark: SparkSession, d: str, **options) -> DataFrame:
    return match.reconcile(workload.partner_transaction(spark, d), workload.internal_transaction(spark, d), **options)


def flat(rows: DataFrame) -> DataFrame:
    """Results with the id arrays as texts, the form that is compared with SQL."""
    return rows.select(
        *[c for c in rows.columns if not c.startswith("ambiguous_")],
        F.array_join("ambiguous_partner_record_ids", ",").alias("partner_ids"),
        F.array_join("ambiguous_internal_record_ids", ",").alias("internal_ids"),
    )


FULL = "WITH " + results_sql()
BY = ["partner"]

# Reconciliation


@query(FULL + " SELECT * FROM results")
def recon_full_snapshot(spark, d):
    return flat(results(spark, d))


@query(FULL + " SELECT partner, reconciliation_status, count(*) AS n FROM results GROUP BY ALL")
def recon_by_status(spark, d):
    return metrics.counts(results(spark, d), "reconciliation_status", BY)


@query(FULL + " SELECT partner, date, reconciliation_key, partner_ids, internal_ids FROM results WHERE reconciliation_status = 'AMBIGUOUS_KEY'")
def recon_ambiguous(spark, d):
    return flat(results(spark, d)).where("reconciliation_status = 'AMBIGUOUS_KEY'").select("partner", "date", "reconciliation_key", "partner_ids", "internal_ids")


@query(FULL + " SELECT partner, date, partner_ids, internal_ids FROM results WHERE reconciliation_status = 'UNMAPPED_SKIPPED'")
def recon_unmapped(spark, d):
    return flat(results(spark, d)).where("reconciliation_status = 'UNMAPPED_SKIPPED'").select("partner", "date", "partner_ids", "internal_ids")


@query(FULL + """ SELECT timestamp_status, count(*) AS n, min(timestamp_delta_seconds) AS least, max(timestamp_delta_seconds) AS greatest FROM results GROUP BY ALL""")
def recon_timestamp_evidence(spark, d):
    return results(spark, d).groupBy("timestamp_status").agg(
        F.count("*").alias("n"), F.min("timestamp_delta_seconds").alias("least"), F.max("timestamp_delta_seconds").alias("greatest")
    )


@query("WITH " + results_sql("F3", "INCREMENTAL_APPEND") + " SELECT partner, reconciliation_status, source_file_id, count(*) AS n FROM results GROUP BY ALL")
def recon_incremental_scope(spark, d):
    rows = results(spark, d, scope="INCREMENTAL_APPEND", source_file="F3")
    return rows.groupBy("partner", "reconciliation_status", "source_file_id").agg(F.count("*").alias("n"))


@query("WITH " + results_sql("F3") + " SELECT partner, reconciliation_status, source_file_id, count(*) AS n FROM results GROUP BY ALL")
def recon_file_snapshot(spark, d):
    rows = results(spark, d, source_file="F3")
    return rows.groupBy("partner", "reconciliation_status", "source_file_id").agg(F.count("*").alias("n"))


@query(f"WITH {RELATIONS} SELECT partner, date, count(*) AS excluded FROM i_all WHERE status = 'PENDING' GROUP BY ALL")
def recon_excluded_internal(spark, d):
    return match.excluded_internal(workload.internal_transaction(spark, d))


_DAY = "1998-01-05"


@query(f"WITH {results_sql()} SELECT partner, reconciliation_status, count(*) AS n FROM results WHERE date = DATE '{_DAY}' GROUP BY ALL")
def recon_one_day(spark, d):
    p = match.one_day(workload.partner_transaction(spark, d), "reconciliation_date", _DAY)
    i = match.one_day(workload.internal_transaction(spark, d), "transaction_time", _DAY)
    return metrics.counts(match.reconcile(p, i), "reconciliation_status", BY)


@query(f"""WITH {results_sql()}, hit AS (SELECT DISTINCT key FROM p WHERE partner = 'BUILDING' AND file = 'F3' AND key IS NOT NULL)
SELECT partner, count(*) AS kept FROM results
WHERE NOT (partner = 'BUILDING' AND date = DATE '{_DAY}' AND (coalesce(source_file_id = 'F3', false) OR reconciliation_key IN (SELECT key FROM hit))) OR reconciliation_key IS NULL AND NOT (partner = 'BUILDING' AND date = DATE '{_DAY}' AND coalesce(source_file_id = 'F3', false)) GROUP BY ALL""")
def recon_replace_scope(spark, d):
    left = match.surviving(results(spark, d), workload.partner_transaction(spark, d), "REPLACEMENT", "F3", "BUILDING", _DAY)
    return left.groupBy("partner").agg(F.count("*").alias("kept"))


@query("""WITH a AS (SELECT l_orderkey AS k, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,4))) AS DECIMAL(20,4)) AS amount, count(*) AS n FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(20,4)) AS amount FROM orders)
SELECT CASE WHEN a.k IS NULL THEN 'MISSING_LINES' WHEN b.k IS NULL THEN 'MISSING_ORDER' WHEN a.amount = b.amount THEN 'MATCHED' ELSE 'AMOUNT_MISMATCH' END AS result,
count(*) AS orders, CAST(coalesce(sum(abs(a.amount - b.amount)), 0) AS DECIMAL(38,4)) AS gap FROM a FULL OUTER JOIN b ON a.k = b.k GROUP BY 1""")
def recon_order_lines(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice").cast(keys.MONEY)).cast(keys.MONEY).alias("a"), F.count("*").alias("n"))
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast(keys.MONEY).alias("b"))
    result = F.when(F.col("n").isNull(), "MISSING_LINES").when(F.col("b").isNull(), "MISSING_ORDER").when(F.col("a") == F.col("b"), "MATCHED").otherwise("AMOUNT_MISMATCH")
    gap = F.coalesce(F.sum(F.abs(F.col("a") - F.col("b"))), F.lit(0)).cast("decimal(38,4)")
    return a.join(b, "k", "full_outer").groupBy(result.alias("result")).agg(F.count("*").alias("orders"), gap.alias("gap"))


# Keys, statuses, days


@query(f"WITH {RELATIONS} SELECT partner, count(*) AS n, count(key) AS keyed, count(DISTINCT key) AS distinct_keys FROM p GROUP BY ALL")
def key_normalize(spark, d):
    side = match.partner_side(workload.partner_transaction(spark, d))
    return side.groupBy("partner").agg(F.count("*").alias("n"), F.count("key").alias("keyed"), F.count_distinct("key").alias("distinct_keys"))


@query(f"WITH {RELATIONS} SELECT partner_status AS spelled, status, count(*) AS n FROM p JOIN partner_transaction t ON p.id = t.id GROUP BY ALL")
def status_normalize(spark, d):
    rows = workload.partner_transaction(spark, d).select(F.col("partner_status").alias("spelled"), keys.status(F.col("partner_status")).alias("status"))
    return rows.groupBy("spelled", "status").agg(F.count("*").alias("n"))


@query("""SELECT day, CAST(day AS TIMESTAMP) - INTERVAL 7 HOUR AS first_at, CAST(day AS TIMESTAMP) + INTERVAL 17 HOUR - INTERVAL 1 MICROSECOND AS last_at,
count(*) AS n FROM (SELECT CAST(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 7 HOUR AS DATE) AS day FROM orders) GROUP BY 1""")
def business_day_bounds(spark, d):
    days = table(spark, d, "orders").groupBy(times.business_date(F.col("o_orderdate").cast("timestamp_ntz")).alias("day")).agg(F.count("*").alias("n"))
    first, last = times.business_bounds(F.col("day"))
    return days.select("day", first.alias("first_at"), last.alias("last_at"), "n")


# Mapping and rules. Rows are lists of cells made of the events, some malformed.

_TYPES = {"click": "SUCCESS", "view": "FAILED", "others": "PENDING"}


def cells(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    amount = F.when(k % 13 == 0, "abc").when(k % 13 == 1, "").when(k % 13 == 2, "-5").otherwise(F.concat(F.lit(""), (k % 1000).cast("string"), F.lit(".25")))
    state = F.when(k % 7 == 0, "Thành công").when(k % 7 == 1, "BAD").when(k % 7 == 2, "Thất bại").otherwise("SUCCESS")
    day = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    when = F.when(k % 11 == 0, "2024-13-45").when(k % 11 == 1, F.date_format("ts", "dd/MM/yyyy")).when(k % 11 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+07:00'")).otherwise(day)
    ident = F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("E"), k.cast("string")))
    return table(spark, d, "events").select("event_id", "ts", "event_type", F.array(ident, F.concat(F.lit("T"), k.cast("string")), amount, state, when).alias("cells"))


FIELDS = mapping.canonical_mappings([
    mapping.FieldMapping("id", column="A", required=True),
    mapping.FieldMapping("trace", column=2),
    mapping.FieldMapping("amount", "DECIMAL", column="3", required=True),
    mapping.FieldMapping("status", column="D", required=True),
    mapping.FieldMapping("transDate", "DATE", column=5),
])

_ROWS = """
e AS (SELECT event_id AS k, CAST(ts AS TIMESTAMP) AS ts, event_type,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'E' || event_id END AS id, 'T' || event_id AS trace,
  CASE WHEN event_id % 13 IN (0, 1) THEN NULL WHEN event_id % 13 = 2 THEN CAST(-5 AS DECIMAL(20,4)) ELSE CAST((event_id % 1000) || '.25' AS DECIMAL(20,4)) END AS amount,
  CASE event_id % 7 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN NULL WHEN 2 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 11 = 1 THEN date_trunc('day', CAST(ts AS TIMESTAMP)) - INTERVAL 7 HOUR
    ELSE date_trunc('second', CAST(ts AS TIMESTAMP)) - INTERVAL 7 HOUR END AS tm FROM events),
m AS (SELECT *, list_filter([CASE WHEN id IS NULL THEN 'MISSING_REQUIRED_FIELD' END, CASE WHEN amount IS NULL THEN 'INVALID_AMOUNT' END,
  CASE WHEN status IS NULL THEN 'INVALID_STATUS' END, CASE WHEN tm IS NULL THEN 'INVALID_TIMESTAMP' END], lambda x: x IS NOT NULL) AS errors FROM e),
v AS (SELECT *, CASE WHEN len(errors) = 0 AND amount < 0 THEN ['NEGATIVE_AMOUNT'] ELSE [] END AS violations FROM m)"""


def mapped(spark: SparkSession, d: str) -> DataFrame:
    return mapping.violations(mapping.map_rows(cells(spark, d), FIELDS))


def _codes(column: str) -> Column:
    return F.array_join(F.transform(column, lambda e: e["code"]), ",")


@query(f"WITH {_ROWS} SELECT k AS event_id, id, trace, amount, status, tm AS \"transDate\", array_to_string(errors, ',') AS errors FROM m")
def map_positional(spark, d):
    return mapped(spark, d).select("event_id", "id", "trace", "amount", "status", "transDate", _codes("errors").alias("errors"))


@query("""SELECT event_id, CAST(event_id AS VARCHAR) AS id, CAST(value AS DECIMAL(20,4)) AS amount,
CASE event_type WHEN 'click' THEN 'SUCCESS' WHEN 'view' THEN 'FAILED' ELSE 'PENDING' END AS status, event_type AS kind, CASE WHEN event_id % 5 = 0 THEN 'MALFORMED_ROW' ELSE '' END AS errors FROM events""")
def map_object(spark, d):
    fields = {"id": F.col("event_id").cast("string"), "value": F.col("value").cast(keys.MONEY).cast("string"), "kind": F.col("event_type")}
    full = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    record = F.when(F.col("event_id") % 5 == 0, full).otherwise(F.map_concat(full, F.create_map(F.lit("note"), F.lit("n"))))
    maps = mapping.canonical_mappings([
        mapping.FieldMapping("id", source_field="id", required=True), mapping.FieldMapping("amount", "DECIMAL", source_field="value", required=True),
        mapping.FieldMapping("status", "MAPPING", source_field="kind", required=True, mapping=_TYPES),
        mapping.FieldMapping("extra.kind", source_field="kind"), mapping.FieldMapping("extra.note", source_field="note"),
    ])
    rows = mapping.map_rows(table(spark, d, "events").withColumn("record", record), maps, None, "record")
    return rows.select("event_id", "id", "amount", "status", F.col("extra")["kind"].alias("kind"), _codes("errors").alias("errors"))


@query(f"""WITH {_ROWS}, t AS (SELECT 'id' AS path, CASE WHEN id IS NULL THEN 'MISSING_REQUIRED_FIELD' END AS error, id IS NOT NULL AS there FROM m
UNION ALL SELECT 'trace', NULL, true FROM m UNION ALL SELECT 'amount', CASE WHEN amount IS NULL THEN 'INVALID_AMOUNT' END, amount IS NOT NULL FROM m
UNION ALL SELECT 'status', CASE WHEN status IS NULL THEN 'INVALID_STATUS' END, status IS NOT NULL FROM m UNION ALL SELECT 'transDate', CASE WHEN tm IS NULL THEN 'INVALID_TIMESTAMP' END, tm IS NOT NULL FROM m
UNION ALL SELECT 'currency', NULL, true FROM m) SELECT path, error, count(*) AS n, count(*) FILTER (WHERE there) AS filled FROM t GROUP BY ALL""")
def map_field_trace(spark, d):
    each = cells(spark, d).select(F.explode(mapping.field_trace(FIELDS)).alias("t"))
    return each.groupBy(F.col("t.path").alias("path"), F.col("t.error").alias("error")).agg(F.count("*").alias("n"), F.count("t.value").alias("filled"))


@query("SELECT event_type, CASE event_type WHEN 'click' THEN 'SUCCESS' WHEN 'view' THEN 'FAILED' ELSE 'PENDING' END AS status, count(*) AS n FROM events GROUP BY ALL")
def map_enum_others(spark, d):
    m = mapping.FieldMapping("status", "MAPPING", column=1, required=True, mapping=_TYPES)
    value, _ = mapping.compile_field(m, "cells", None, times.BUSINESS_ZONE)
    rows = table(spark, d, "events").withColumn("cells", F.array("event_type"))
    return rows.groupBy("event_type", value.alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {_ROWS} SELECT CAST(tm + INTERVAL 7 HOUR AS DATE) AS day, count(*) AS n, min(tm) AS first_at, max(tm) AS last_at FROM m GROUP BY 1")
def parse_timestamps(spark, d):
    at = times.canonical_time(F.get("cells", F.lit(4)))
    rows = cells(spark, d).select(at.alias("at"))
    return rows.groupBy(times.business_date(F.col("at")).alias("day")).agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


@query(f"WITH {_ROWS} SELECT amount IS NULL AS invalid, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,4)) AS total FROM e GROUP BY ALL")
def coerce_amount(spark, d):
    amount = F.get("cells", F.lit(2)).try_cast(keys.MONEY)
    return cells(spark, d).groupBy(amount.isNull().alias("invalid")).agg(F.count("*").alias("n"), F.sum(amount).cast("decimal(38,4)").alias("total"))


@query(f"WITH {_ROWS} SELECT k AS event_id, array_to_string(violations, ',') AS violations FROM v WHERE len(errors) = 0")
def row_violations(spark, d):
    return mapped(spark, d).where("size(errors) = 0").select("event_id", _codes("violations").alias("violations"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    return ruled(cells(spark, d))


def ruled(rows: DataFrame) -> DataFrame:
    """Rows of cells mapped, with the rules that they break and their outcome."""
    rows = mapping.violations(mapping.map_rows(rows, FIELDS)).withColumn("faults", F.concat("errors", "violations"))
    no = F.lit(False)
    return rows.withColumn("outcome", mapping.outcome(no, no, F.size("faults") > 0, no, no))


@query(f"WITH {_ROWS} SELECT CASE WHEN len(errors) + len(violations) > 0 THEN 'REJECT' ELSE 'VALID' END AS outcome, count(*) AS n FROM v GROUP BY 1")
def row_outcome(spark, d):
    return judged(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""WITH {_ROWS}, s AS (SELECT count(*) AS total, count(*) FILTER (WHERE len(errors) + len(violations) = 0) AS valid FROM v)
SELECT total, valid, total - valid AS rejected, CASE WHEN total > valid THEN 'REVIEW' ELSE 'PASS' END AS decision, CASE WHEN total > valid THEN 'HOLD_FOR_REVIEW' ELSE 'CONTINUE' END AS action FROM s""")
def quality_decision(spark, d):
    return mapping.quality_summary(judged(spark, d)).select("total", "valid", "rejected", "decision", "action")


@query(f"""WITH {_ROWS}, f AS (SELECT k % 7 AS file, len(errors) + len(violations) > 0 AS bad, k % 70 = 1 AS torn FROM v WHERE k % 7 <> 0 OR len(errors) + len(violations) = 0),
s AS (SELECT file, count(*) AS total, count(*) FILTER (WHERE NOT torn AND NOT bad) AS valid, count(*) FILTER (WHERE NOT torn AND bad) AS rejected, count(*) FILTER (WHERE torn) AS fatal FROM f GROUP BY 1)
SELECT *, CASE WHEN fatal > 0 THEN 'FAIL' WHEN rejected > 0 THEN 'REVIEW' ELSE 'PASS' END AS decision, CASE WHEN fatal > 0 THEN 'FAIL' WHEN rejected > 0 THEN 'HOLD_FOR_REVIEW' ELSE 'CONTINUE' END AS action FROM s""")
def quality_decisions(spark, d):
    """A decision for each of seven files: one of good rows alone, one with rows that are fatal, the others with rejected rows."""
    k = F.col("event_id")
    rows = judged(spark, d).withColumn("file", k % 7).where((k % 7 != 0) | (F.col("outcome") == "VALID"))
    rows = rows.withColumn("outcome", F.when(k % 70 == 1, "BATCH_FATAL").otherwise(F.col("outcome")))
    return mapping.quality_summary(rows, by=("file",)).select("file", "total", "valid", "rejected", "fatal", "decision", "action")


@query(f"WITH {_ROWS} SELECT code, count(*) AS n FROM (SELECT unnest(list_concat(errors, violations)) AS code FROM v) GROUP BY 1 ORDER BY n DESC, code LIMIT 10")
def top_rule_codes(spark, d):
    return mapping.top_codes(judged(spark, d))


# Duplicates. The batch is the line items in order; keys repeat by nature.


def batch(spark: SparkSession, d: str) -> DataFrame:
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    row = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*order))
    lines = table(spark, d, "lineitem").withColumn("ordinal", row)
    amount = F.round(F.col("l_quantity"), 0).cast("long")
    return lines.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), "ordinal", amount.alias("amount"), "l_returnflag",
        keys.fingerprint(amount, F.col("l_returnflag")).alias("fingerprint"),
    )


_BATCH = """
b AS (SELECT l_orderkey AS k, l_linenumber AS line, CAST(round(l_quantity) AS BIGINT) AS amount, l_returnflag,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS ordinal FROM lineitem),
f AS (SELECT * FROM b WHERE ordinal = 1),
held AS (SELECT k, line, amount, l_returnflag FROM f WHERE k % 10 = 0),
c AS (SELECT b.k, b.line, b.ordinal, CASE WHEN h.k IS NULL AND b.ordinal = 1 THEN 'INSERTED'
  WHEN coalesce(h.amount, f.amount) = b.amount AND coalesce(h.l_returnflag, f.l_returnflag) = b.l_returnflag THEN 'EQUIVALENT' ELSE 'CONFLICTING' END AS result
  FROM b JOIN f USING (k, line) LEFT JOIN held h USING (k, line))"""


def _held(rows: DataFrame) -> DataFrame:
    return dedupe.first_of_batch(rows.where("k % 10 = 0"), ["k", "line"])


@query(f"WITH {_BATCH} SELECT k, line, CAST(ordinal AS INTEGER) AS ordinal, amount FROM f WHERE k % 10 <> 0")
def dedupe_first_wins(spark, d):
    rows = batch(spark, d)
    return dedupe.insertable(rows, _held(rows), ["k", "line"]).select("k", "line", "ordinal", "amount")


@query(f"WITH {_BATCH} SELECT result, count(*) AS n, count(DISTINCT k) AS orders FROM c GROUP BY 1")
def dedupe_classify(spark, d):
    rows = batch(spark, d)
    return dedupe.classified(rows, _held(rows), ["k", "line"]).groupBy("result").agg(F.count("*").alias("n"), F.count_distinct("k").alias("orders"))


@query(f"""WITH {_BATCH} SELECT line, count(*) AS input, count(*) FILTER (WHERE result = 'INSERTED') AS inserted, count(*) FILTER (WHERE result = 'EQUIVALENT') AS equivalent,
count(*) FILTER (WHERE result = 'CONFLICTING') AS conflicting, true AS balanced FROM c GROUP BY 1""")
def dedupe_accounting(spark, d):
    rows = batch(spark, d)
    return dedupe.accounting(dedupe.classified(rows, _held(rows), ["k", "line"]), ["line"])


@query(f"WITH {_BATCH} SELECT count(*) AS n, count(DISTINCT (amount, l_returnflag)) AS payloads FROM b")
def fingerprint_equality(spark, d):
    return batch(spark, d).agg(F.count("*").alias("n"), F.count_distinct("fingerprint").alias("payloads"))


@query(f"""WITH {_BATCH}, x AS (SELECT *, row_number() OVER (PARTITION BY k, line, amount, l_returnflag ORDER BY ordinal) AS seen FROM b)
SELECT count(*) FILTER (WHERE seen > 1) AS exact_duplicates, count(*) FILTER (WHERE x.ordinal > 1 AND x.amount = f.amount AND x.l_returnflag = f.l_returnflag) AS key_same_payload,
count(*) FILTER (WHERE x.ordinal > 1 AND NOT (x.amount = f.amount AND x.l_returnflag = f.l_returnflag)) AS key_other_payload FROM x JOIN f USING (k, line)""")
def profile_duplicates(spark, d):
    rows = batch(spark, d).withColumn("row_hash", keys.fingerprint(F.col("k"), F.col("line"), F.col("fingerprint")))
    return dedupe.in_file_duplicates(rows, ["k", "line"], "row_hash", "ordinal")


@query(f"WITH {RELATIONS} SELECT CASE WHEN key IN (SELECT key FROM p WHERE key LIKE '%7') AND partner = 'BUILDING' THEN 'F9' ELSE file END AS source_file_id, count(*) AS n FROM p GROUP BY 1")
def rebind_source_file(spark, d):
    rows = match.partner_side(workload.partner_transaction(spark, d)).withColumnRenamed("file", "source_file_id")
    chosen = rows.where("key LIKE '%7' AND partner = 'BUILDING'")
    return dedupe.rebind(rows, chosen, ["partner", "key"], "F9").groupBy("source_file_id").agg(F.count("*").alias("n"))


# Scope. Incoming keys are the users of a day, historical ones those of the day before.

_KEYS = """
u AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events WHERE user_id IS NOT NULL),
h AS (SELECT day + 1 AS day, user_id FROM u),
s AS (SELECT coalesce(u.day, h.day) AS day, count(u.user_id) AS incoming, count(h.user_id) AS historical,
  count(*) FILTER (WHERE u.user_id IS NOT NULL AND h.user_id IS NOT NULL) AS overlap, count(*) FILTER (WHERE u.user_id IS NOT NULL AND h.user_id IS NULL) AS fresh
  FROM u FULL OUTER JOIN h ON CAST(u.day AS DATE) = CAST(h.day AS DATE) AND u.user_id = h.user_id GROUP BY 1)"""


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "events").select(F.to_date("ts").alias("day"), "user_id").distinct()
    return scope.overlaps(now, now.withColumn("day", F.date_add("day", 1)), ["day"], "user_id")


@query(f"WITH {_KEYS} SELECT CAST(day AS DATE) AS day, incoming, historical, overlap, fresh FROM s")
def scope_overlap(spark, d):
    return _overlaps(spark, d)


@query(f"""WITH {_KEYS}, r AS (SELECT *, overlap / nullif(incoming, 0) AS share, overlap / nullif(historical, 0) AS cover, fresh / nullif(incoming, 0) AS novel FROM s)
SELECT CAST(day AS DATE) AS day, CASE WHEN incoming = 0 THEN 'UNCONFIRMED' WHEN historical = 0 THEN 'FULL_SNAPSHOT' WHEN overlap = 0 THEN 'INCREMENTAL_APPEND' WHEN cover = 1 AND fresh > 0 THEN 'REPLACEMENT'
WHEN share >= 0.8 THEN 'REPLACEMENT' WHEN fresh > 0 AND (novel >= 0.5 OR share < 0.5) THEN 'INCREMENTAL_APPEND' ELSE 'UNCONFIRMED' END AS scope,
CAST(CASE WHEN incoming = 0 THEN 0.2 WHEN historical = 0 THEN 0.92 WHEN overlap = 0 THEN 0.98 WHEN cover = 1 AND fresh > 0 THEN 0.96
WHEN share >= 0.8 THEN 0.86 WHEN fresh > 0 AND (novel >= 0.5 OR share < 0.5) THEN 0.9 ELSE 0.55 END AS DECIMAL(4,2)) AS confidence FROM r""")
def scope_classify(spark, d):
    files = F.when(F.col("historical") > 0, 1).otherwise(0)
    return scope.key_scope(_overlaps(spark, d), files).select("day", "scope", "confidence")


@query(f"""WITH {RELATIONS}, a AS (SELECT partner, date, count(*) AS received FROM p GROUP BY ALL), b AS (SELECT partner, date, count(*) AS internals FROM i_all GROUP BY ALL),
c AS (SELECT coalesce(a.partner, b.partner) AS partner, coalesce(a.date, b.date) AS date, coalesce(received, 0) AS received, coalesce(internals, 0) AS internals FROM a FULL OUTER JOIN b ON a.partner = b.partner AND a.date = b.date),
g AS (SELECT *, greatest(internals, received) AS larger, abs(internals - received) AS gap FROM c),
n AS (SELECT *, gap <= greatest(10, floor(larger * 0.05)) OR gap <= larger * 0.05 AS near FROM g)
SELECT partner, date, CASE WHEN received > 0 AND internals > 0 AND NOT near AND received < internals * 0.8 THEN 'INCREMENTAL_APPEND' ELSE 'FULL_SNAPSHOT' END AS scope,
CAST(CASE WHEN received <= 0 THEN 0.34 WHEN internals <= 0 THEN 0.9 WHEN near THEN 0.82 WHEN received < internals * 0.8 THEN 0.72 ELSE 0.62 END AS DECIMAL(4,2)) AS probability FROM n""")
def scope_by_counts(spark, d):
    a = match.partner_side(workload.partner_transaction(spark, d)).groupBy("partner", "date").agg(F.count("*").alias("received"))
    b = match.internal_side(workload.internal_transaction(spark, d)).groupBy("partner", "date").agg(F.count("*").alias("internals"))
    both = a.join(b, ["partner", "date"], "full_outer").fillna(0, ["received", "internals"])
    name, sure = scope.count_scope(F.col("internals"), F.col("received"))
    return both.select("partner", "date", name.alias("scope"), sure.alias("probability"))


# Statistics over results


@query(FULL + " SELECT partner, date, reconciliation_status, count(*) AS n FROM results GROUP BY ALL")
def stats_by_status(spark, d):
    return metrics.counts(results(spark, d), "reconciliation_status", ["partner", "date"])


@query(FULL + " SELECT partner, timestamp_status, count(*) AS n FROM results GROUP BY ALL")
def stats_by_timestamp(spark, d):
    return metrics.counts(results(spark, d), "timestamp_status", BY)


@query(FULL + " SELECT partner, CAST(coalesce(sum(partner_amount), 0) AS DECIMAL(38,4)) AS partner_total, CAST(coalesce(sum(internal_amount), 0) AS DECIMAL(38,4)) AS internal_total FROM results GROUP BY 1")
def stats_totals(spark, d):
    return metrics.totals(results(spark, d), BY)


_MISMATCH = "reconciliation_status IN ('AMOUNT_MISMATCH', 'STATUS_MISMATCH', 'MULTIPLE_MISMATCH')"
_GAP = f"CAST(coalesce(sum(CASE WHEN {_MISMATCH} THEN abs(partner_amount - internal_amount) END), 0) AS DECIMAL(38,4))"
_IS_MATCHED = "reconciliation_status IN ('MATCHED', 'MATCHED_FAILED', 'MATCHED_REVERSED')"


def _rate(part: str, whole: str) -> str:
    """100 * part / whole rounded half up to two places, in whole-number arithmetic."""
    return f"CAST(CASE WHEN {whole} > 0 THEN CAST((CAST({part} AS BIGINT) * 20000 + {whole}) // (2 * {whole}) AS DECIMAL(14,2)) / 100 END AS DECIMAL(12,2))"


@query(FULL + f" SELECT partner, date, {_GAP} AS mismatch_total FROM results GROUP BY ALL")
def stats_abs_mismatch(spark, d):
    return results(spark, d).groupBy("partner", "date").agg(metrics.mismatch_amount().alias("mismatch_total"))


@query(FULL + f", s AS (SELECT partner, count(*) AS total, count(*) FILTER (WHERE {_IS_MATCHED}) AS matched, {_GAP} AS mismatch_total FROM results GROUP BY 1) SELECT *, {_rate('(total - matched)', 'total')} AS mismatch_rate FROM s")
def summary_metrics(spark, d):
    return metrics.summary(results(spark, d), BY)


@query(FULL + f", s AS (SELECT partner, {_GAP} AS s, count(*) FILTER (WHERE {_MISMATCH}) AS n FROM results GROUP BY 1) SELECT partner, n, CAST(CASE WHEN n > 0 THEN CAST((CAST(s * 10000 AS HUGEINT) + 50 * n) // (100 * n) AS DECIMAL(38,2)) / 100 END AS DECIMAL(24,2)) AS avg_mismatch FROM s")
def avg_mismatch(spark, d):
    return metrics.average_mismatch(results(spark, d), BY)


_AMOUNT = "coalesce(CASE WHEN partner_amount <> 0 THEN partner_amount END, internal_amount)"
_TWO = "reconciliation_status IN ('AMOUNT_MISMATCH', 'MULTIPLE_MISMATCH')"


def _groups_sql(key: str, name: str) -> str:
    gap = f"CASE WHEN {_TWO} THEN abs(partner_amount - internal_amount) END"
    return FULL + f""", g AS (SELECT {key} AS {name}, count(*) AS n, CAST(coalesce(sum({_AMOUNT}), 0) AS DECIMAL(38,4)) AS total, CAST(min({gap}) AS DECIMAL(24,4)) AS least_gap,
CAST(max({gap}) AS DECIMAL(24,4)) AS greatest_gap, CAST(sum({gap}) AS DECIMAL(30,4)) AS s, count({gap}) AS c, CAST(sum(count(*)) OVER () AS BIGINT) AS everything FROM results GROUP BY 1)
SELECT {name}, n, total, least_gap, greatest_gap, CAST(CASE WHEN c > 0 THEN CAST((CAST(s * 10000 AS HUGEINT) + 50 * c) // (100 * c) AS DECIMAL(38,2)) / 100 END AS DECIMAL(24,2)) AS mean_gap, {_rate('n', 'everything')} AS share FROM g"""


@query(_groups_sql("reconciliation_status", "status"))
def group_status(spark, d):
    return metrics.groups(results(spark, d), F.col("reconciliation_status"), "status")


_BAND = f"CASE WHEN {_AMOUNT} >= 0 AND {_AMOUNT} < 100000 THEN '0-100k' WHEN {_AMOUNT} >= 100000 AND {_AMOUNT} < 1000000 THEN '100k-1M' WHEN {_AMOUNT} IS NOT NULL THEN '1M+' END"


@query(_groups_sql(_BAND, "band"))
def group_amount_band(spark, d):
    return metrics.groups(results(spark, d), metrics.band(metrics.group_amount()), "band")


@query(_groups_sql("partner", "partner"))
def group_partner(spark, d):
    return metrics.groups(results(spark, d), F.col("partner"), "partner")


@query(FULL + ", g AS (SELECT partner, reconciliation_status AS s, count(*) AS n FROM results GROUP BY ALL) SELECT partner, count(*) AS kinds, (SELECT x.s FROM g x WHERE x.partner = g.partner ORDER BY x.n DESC, x.s DESC LIMIT 1) AS largest FROM g GROUP BY partner")
def largest_group(spark, d):
    g = metrics.counts(results(spark, d), "reconciliation_status", BY)
    return g.groupBy("partner").agg(F.count("*").alias("kinds"), F.max_by("reconciliation_status", F.struct("n", "reconciliation_status")).alias("largest"))


@query(FULL + f""", w AS (SELECT partner, count(*) AS total, count(*) FILTER (WHERE {_IS_MATCHED}) AS matched, count(*) FILTER (WHERE reconciliation_status = 'MISSING_INTERNAL') AS mi,
count(*) FILTER (WHERE reconciliation_status = 'MISSING_PARTNER') AS mp, count(*) FILTER (WHERE {_TWO}) AS am, count(*) FILTER (WHERE reconciliation_status = 'STATUS_MISMATCH') AS sm,
avg(CASE WHEN {_TWO} THEN abs(partner_amount - internal_amount) END) AS gap FROM results GROUP BY 1),
x AS (SELECT *, {_rate('(total - matched)', 'total')} AS rate FROM w),
l AS (SELECT partner, gap, 'missing_internal' AS kind, mi AS n FROM x UNION ALL SELECT partner, gap, 'missing_partner', mp FROM x UNION ALL SELECT partner, gap, 'amount_mismatch_cluster', am FROM x
UNION ALL SELECT partner, gap, 'status_mismatch_cluster', sm FROM x UNION ALL SELECT partner, gap, 'high_mismatch_rate', CASE WHEN rate > 5 THEN CAST(floor(total * rate / 100) AS BIGINT) ELSE 0 END FROM x)
SELECT partner, kind, n, CASE WHEN kind = 'amount_mismatch_cluster' THEN CASE WHEN gap < 100000 THEN '0-100k' WHEN gap < 1000000 THEN '100k-1M' ELSE '1M+' END ELSE 'N/A' END AS amount_range,
CASE WHEN n > 10 THEN 'high' WHEN n > 5 THEN 'medium' ELSE 'low' END AS severity FROM l WHERE n > 0""")
def anomalies(spark, d):
    return metrics.anomalies(results(spark, d), BY)


@query(FULL + f", s AS (SELECT partner, date, {_rate(f'count(*) FILTER (WHERE NOT {_IS_MATCHED})', 'count(*)')} AS rate FROM results GROUP BY ALL) SELECT CASE WHEN rate > 20 THEN 'critical' WHEN rate > 10 THEN 'high' WHEN rate > 5 THEN 'medium' WHEN rate > 0 THEN 'low' END AS severity, count(*) AS days FROM s GROUP BY 1")
def severity_of_days(spark, d):
    days = metrics.summary(results(spark, d), ["partner", "date"])
    return days.groupBy(metrics.severity_of_rate(F.col("mismatch_rate")).alias("severity")).agg(F.count("*").alias("days"))


@query(FULL + f", s AS (SELECT partner, count(*) FILTER (WHERE timestamp_status = 'MISMATCH') AS late, count(*) FILTER (WHERE timestamp_status IN ('MATCHED', 'MISMATCH')) AS seen FROM results GROUP BY 1) SELECT partner, late, seen, {_rate('late', 'seen')} AS rate FROM s")
def timestamp_mismatch_rate(spark, d):
    s = results(spark, d).groupBy("partner").agg(F.count_if(F.col("timestamp_status") == "MISMATCH").alias("late"), F.count_if(F.col("timestamp_status").isin("MATCHED", "MISMATCH")).alias("seen"))
    return s.withColumn("rate", keys.percent(F.col("late"), F.col("seen")))


@query(FULL + """, s AS (SELECT partner, reconciliation_status, reconciliation_key, partner_record_id, internal_record_id, CASE reconciliation_status WHEN 'AMOUNT_MISMATCH' THEN 1 WHEN 'STATUS_MISMATCH' THEN 2 ELSE 3 END AS status_order,
CAST(row_number() OVER (PARTITION BY partner, reconciliation_status ORDER BY reconciliation_key NULLS LAST, partner_record_id NULLS LAST, internal_record_id NULLS LAST) AS INTEGER) AS place
FROM results WHERE reconciliation_status IN ('AMOUNT_MISMATCH', 'STATUS_MISMATCH', 'MISSING_PARTNER')) SELECT * FROM s WHERE place <= 3""")
def error_samples_topn(spark, d):
    rows = metrics.samples(results(spark, d), BY, ["AMOUNT_MISMATCH", "STATUS_MISMATCH", "MISSING_PARTNER"], 3)
    return rows.select("partner", "reconciliation_status", "reconciliation_key", "partner_record_id", "internal_record_id", "status_order", "place")


_RUNS = """
r AS (SELECT user_id AS stream, CAST(ts AS TIMESTAMP) AS seen_at, event_id AS id, event_type AS status, value FROM events WHERE user_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seen_at DESC, id DESC) AS place FROM r)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("user_id IS NOT NULL").select(F.col("user_id").alias("stream"), F.col("ts").alias("seen_at"), F.col("event_id").alias("id"), F.col("event_type").alias("status"))


@query(f"WITH {_RUNS} SELECT stream, seen_at, id, status FROM n WHERE place = 1")
def latest_context(spark, d):
    return metrics.latest(runs(spark, d), ["stream"], "seen_at", "id")


@query(FULL + " SELECT partner, date, reconciliation_key, partner_record_id, internal_record_id, reconciliation_status FROM results ORDER BY reconciliation_key NULLS LAST, partner NULLS LAST, partner_record_id NULLS LAST, internal_record_id NULLS LAST, date LIMIT 50 OFFSET 100")
def page_offset(spark, d):
    rows = results(spark, d).select("partner", "date", "reconciliation_key", "partner_record_id", "internal_record_id", "reconciliation_status")
    return metrics.page(rows, ["reconciliation_key", "partner", "partner_record_id", "internal_record_id", "date"], 100, 50)


@query(f"WITH {_RUNS} SELECT stream, seen_at, id, status FROM r WHERE seen_at > TIMESTAMP '2024-01-15 00:00:00' OR seen_at = TIMESTAMP '2024-01-15 00:00:00' AND id > 5 ORDER BY seen_at, id LIMIT 51")
def page_keyset(spark, d):
    return metrics.page_after(runs(spark, d), "seen_at", "id", ("2024-01-15 00:00:00", 5), 50)


@query(f"WITH {RELATIONS} SELECT DISTINCT partner, date FROM p")
def distinct_partners(spark, d):
    return match.partner_side(workload.partner_transaction(spark, d)).select("partner", "date").distinct()


@query(FULL + " SELECT date, md5(string_agg(coalesce(reconciliation_key, '') || ':' || reconciliation_status, ',' ORDER BY coalesce(reconciliation_key, '') || ':' || reconciliation_status)) AS fingerprint FROM results GROUP BY 1")
def results_fingerprint(spark, d):
    return metrics.results_fingerprint(results(spark, d), ["date"])


@query(f"""WITH {RELATIONS}, a AS (SELECT partner, count(*) AS partner_rows FROM p GROUP BY 1), b AS (SELECT partner, count(*) AS internal_rows FROM i_all GROUP BY 1)
SELECT partner, partner_rows, internal_rows FROM a FULL OUTER JOIN b USING (partner)""")
def data_stats(spark, d):
    a = match.partner_side(workload.partner_transaction(spark, d)).groupBy("partner").agg(F.count("*").alias("partner_rows"))
    b = match.internal_side(workload.internal_transaction(spark, d)).groupBy("partner").agg(F.count("*").alias("internal_rows"))
    return a.join(b, "partner", "full_outer")


@query(FULL + """, a AS (SELECT file, count(*) AS rows_stored FROM p GROUP BY 1), b AS (SELECT source_file_id AS file, count(*) AS rows_matched FROM results WHERE source_file_id IS NOT NULL GROUP BY 1)
SELECT file, greatest(coalesce(rows_stored, 0), coalesce(rows_matched, 0)) AS records FROM a FULL OUTER JOIN b USING (file)""")
def file_record_counts(spark, d):
    p, i = workload.partner_transaction(spark, d), workload.internal_transaction(spark, d)
    a = p.groupBy(F.col("source_file_id").alias("file")).agg(F.count("*").alias("rows_stored"))
    b = match.reconcile(p, i).where("source_file_id IS NOT NULL").groupBy(F.col("source_file_id").alias("file")).agg(F.count("*").alias("rows_matched"))
    return a.join(b, "file", "full_outer").select("file", F.greatest(F.coalesce("rows_stored", F.lit(0)), F.coalesce("rows_matched", F.lit(0))).alias("records"))


# Quarantine and recovery. Records are the rejected rows of the mapping.

_NOW = "2024-01-20 00:00:00"


def quarantine(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    rows = judged(spark, d).where("outcome = 'REJECT'")
    status = F.element_at(F.array(*map(F.lit, recovery.TRANSITIONS)), (k % 4 + 1).cast("int"))
    rows = rows.select(k.alias("id"), F.col("ts").cast("timestamp_ntz").alias("created_at"), status.alias("status"), F.transform("faults", lambda e: e["code"]).alias("codes"),
                       F.when(k % 9 == 0, "FATAL").otherwise("ERROR").alias("severity"), F.col("ts").cast("timestamp_ntz").alias("resolved_at"), (k % 30).alias("run"))
    return recovery.with_defaults(rows)


_QUARANTINE = _ROWS + """,
q AS (SELECT k AS id, ts AS created_at, ['PENDING', 'REPROCESSING', 'RESOLVED', 'REJECTED'][k % 4 + 1] AS status, list_concat(errors, violations) AS codes,
  CASE WHEN k % 9 = 0 THEN 'HIGH' ELSE 'NORMAL' END AS priority, ts + INTERVAL 1 DAY AS due_at, k % 30 AS run FROM v WHERE len(errors) + len(violations) > 0)"""


@query(f"""WITH {_QUARANTINE} SELECT priority, count(*) AS total, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'REPROCESSING') AS reprocessing, count(*) FILTER (WHERE status = 'RESOLVED') AS resolved,
count(*) FILTER (WHERE status = 'REJECTED') AS rejected, count(*) FILTER (WHERE status IN ('PENDING', 'REPROCESSING') AND due_at < TIMESTAMP '{_NOW}') AS overdue,
count(*) FILTER (WHERE status IN ('PENDING', 'REPROCESSING') AND priority = 'HIGH') AS high_priority FROM q GROUP BY 1""")
def quarantine_summary(spark, d):
    return recovery.queue_summary(quarantine(spark, d), F.lit(_NOW).cast("timestamp_ntz"), ["priority"])


_ISSUE = "CASE WHEN c = 'MISSING_REQUIRED_FIELD' THEN 'REQUIRED_FIELD' WHEN c IN ('MALFORMED_ROW', 'INVALID_AMOUNT', 'NEGATIVE_AMOUNT', 'INVALID_TIMESTAMP', 'INVALID_STATUS') THEN 'FORMAT' ELSE 'OTHER' END"


@query(f"""WITH {_QUARANTINE}, o AS (SELECT * FROM q ORDER BY created_at, id LIMIT 2000), x AS (SELECT run, id, created_at, unnest(codes) AS c FROM o)
SELECT run AS group_key, count(DISTINCT id) AS records, array_to_string(list_sort(list(DISTINCT {_ISSUE})), ',') AS issue_types, min(created_at) AS oldest FROM x GROUP BY 1""")
def quarantine_groups(spark, d):
    return recovery.group_queue(quarantine(spark, d), F.col("run"))


@query(f"WITH {_QUARANTINE}, x AS (SELECT unnest(codes) AS c FROM q) SELECT {_ISSUE} AS issue_type, c AS code, count(*) AS n FROM x GROUP BY ALL")
def quarantine_issue_types(spark, d):
    each = quarantine(spark, d).select(F.explode("codes").alias("code"))
    return each.groupBy(recovery.issue_type(F.col("code")).alias("issue_type"), "code").agg(F.count("*").alias("n"))


@query("""SELECT event_type, a AS attempts, CASE WHEN event_type = 'click' AND a < 3 THEN CAST(least(3600, 60 * pow(2, greatest(a - 1, 0))) AS INTEGER) END AS delay, count(*) AS n
FROM (SELECT event_type, CAST(event_id % 5 AS INTEGER) AS a FROM events) GROUP BY ALL""")
def retry_backoff(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.col("event_id") % 5).cast("int").alias("attempts"))
    code = F.when(F.col("event_type") == "click", "fetch_timeout").otherwise("bad_credentials")
    return rows.groupBy("event_type", "attempts", recovery.retry_delay(code, F.col("attempts")).alias("delay")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, count(*) AS days FROM (SELECT o_orderkey, unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 AS INTEGER), INTERVAL 1 DAY)) AS day FROM orders)
WHERE dayofweek(day) NOT IN (0, 6) GROUP BY 1""")
def backfill_dates(spark, d):
    first = F.to_date("o_orderdate")
    days = times.weekdays(first, F.date_add(first, (F.col("o_orderkey") % 20).cast("int")))
    return table(spark, d, "orders").select("o_orderkey", F.size(days).cast("long").alias("days")).where("days > 0")


@query("""WITH s AS (SELECT ['BLOCKED', 'FAILED', 'PROCESSING', 'DISCOVERED', NULL][event_id % 5 + 1] AS cp, ['COMPLETED', 'WAITING_REVIEW', 'RUNNING', NULL][event_id % 4 + 1] AS run, event_id % 3 = 0 AS replayed, event_id % 2 = 0 AS skipped FROM events)
SELECT CASE WHEN run = 'COMPLETED' AND replayed THEN 'REPLAYED' WHEN run = 'WAITING_REVIEW' THEN 'WAITING_REVIEW' WHEN cp IN ('BLOCKED', 'FAILED', 'PROCESSING') THEN cp WHEN cp = 'DISCOVERED' AND skipped THEN 'PENDING'
WHEN cp IS NOT NULL AND run = 'COMPLETED' THEN 'COMPLETED' WHEN run = 'RUNNING' THEN 'PROCESSING' ELSE coalesce(run, 'IDLE') END AS state, count(*) AS n FROM s GROUP BY 1""")
def recovery_status(spark, d):
    k = F.col("event_id")

    def pick(*names):
        return F.element_at(F.array(*[F.lit(n).cast("string") for n in names]), (k % len(names) + 1).cast("int"))

    state = recovery.recovery_status(pick("BLOCKED", "FAILED", "PROCESSING", "DISCOVERED", None), pick("COMPLETED", "WAITING_REVIEW", "RUNNING", None), k % 3 == 0, k % 2 == 0)
    return table(spark, d, "events").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


# Profiles


@query("""SELECT 'props' AS name, count(*) AS total, count(*) FILTER (WHERE props IS NULL OR lower(trim(props)) IN ('', 'null', 'none', 'nan', 'n/a', 'na')) AS missing, count(DISTINCT CASE WHEN NOT (props IS NULL OR lower(trim(props)) IN ('', 'null', 'none', 'nan', 'n/a', 'na')) THEN props END) AS distinct_values FROM events
UNION ALL SELECT 'event_type', count(*), count(*) FILTER (WHERE event_type IS NULL), count(DISTINCT event_type) FROM events UNION ALL SELECT 'user_id', count(*), count(*) FILTER (WHERE user_id IS NULL), count(DISTINCT user_id) FROM events""")
def profile_columns(spark, d):
    return profile.columns(table(spark, d, "events"), ["props", "event_type", "user_id"])


@query("""WITH a AS (SELECT CAST(o_totalprice AS DECIMAL(20,4)) AS x FROM orders), s AS (SELECT count(*) AS n, min(x) AS least, max(x) AS greatest, quantile_cont(CAST(x AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(x AS DOUBLE), 0.5) AS median,
quantile_cont(CAST(x AS DOUBLE), 0.75) AS q3, quantile_cont(CAST(x AS DOUBLE), 0.95) AS p95, quantile_cont(CAST(x AS DOUBLE), 0.99) AS p99 FROM a), f AS (SELECT *, q3 + 1.5 * (q3 - q1) AS fence FROM s)
SELECT n, least, greatest, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(p95, 4) AS p95, round(p99, 4) AS p99, round(fence, 4) AS fence, (SELECT count(*) FROM a WHERE x > fence) AS outliers FROM f""")
def profile_amount(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_totalprice").cast(keys.MONEY).alias("x"))
    out = profile.amounts(rows, "x")
    return out.select("n", "least", "greatest", *[F.round(c, 4).alias(c) for c in (*profile.QUANTILES, "fence")], "outliers")


@query("""WITH g AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, min(CAST(ts AS TIMESTAMP)) AS lo, max(CAST(ts AS TIMESTAMP)) AS hi FROM events GROUP BY 1)
SELECT min(lo) AS first_at, max(hi) AS last_at, count(*) AS days, min(n) AS least_rows, quantile_cont(CAST(n AS DOUBLE), 0.5) AS median_rows, max(n) AS most_rows FROM g""")
def profile_daily(spark, d):
    return profile.daily(table(spark, d, "events"), "ts")


@query("""SELECT 'has_user' AS rule, count(*) AS n, count(*) FILTER (WHERE user_id IS NULL) AS broken, CASE WHEN count(*) FILTER (WHERE user_id IS NULL) = 0 THEN 'PASS' ELSE 'REVIEW' END AS decision FROM events
UNION ALL SELECT 'small_value', count(*), count(*) FILTER (WHERE NOT coalesce(value < 50, false)), CASE WHEN count(*) FILTER (WHERE NOT coalesce(value < 50, false)) = 0 THEN 'PASS' ELSE 'REVIEW' END FROM events""")
def profile_rules(spark, d):
    return profile.rule_results(table(spark, d, "events"), {"has_user": F.col("user_id").isNotNull(), "small_value": F.col("value") < 50})


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS \"F\", count(*) FILTER (WHERE l_linestatus = 'O') AS \"O\", count(*) AS total FROM lineitem GROUP BY 1")
def eda_crosstab(spark, d):
    return profile.crosstab(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("SELECT l_partkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def eda_entity_consistency(spark, d):
    return profile.inconsistent(table(spark, d, "lineitem"), "l_partkey", "l_returnflag")


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(20,4))) AS DECIMAL(38,4)) AS total, CAST(min(o_totalprice) AS DECIMAL(20,4)) AS least, CAST(max(o_totalprice) AS DECIMAL(20,4)) AS greatest FROM orders GROUP BY ALL""")
def eda_group_stats(spark, d):
    x = F.col("o_totalprice").cast(keys.MONEY)
    return table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.sum(x).cast("decimal(38,4)").alias("total"), F.min(x).alias("least"), F.max(x).alias("greatest"))


@query("""SELECT o_orderpriority, round(quantile_cont(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, 0.5), 4) AS f, round(quantile_cont(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END, 0.5), 4) AS o,
round(quantile_cont(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END, 0.5), 4) AS p FROM orders GROUP BY 1""")
def eda_pivot_median(spark, d):
    wide = profile.medians(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "o_totalprice")
    return wide.select("o_orderpriority", *[F.round(c, 4).alias(c.lower()) for c in "FOP"])


@query("""SELECT o_custkey, count(*) AS n, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, CAST(sum(CAST(o_totalprice AS DECIMAL(20,4))) AS DECIMAL(38,4)) AS total, min(CAST(o_orderdate AS TIMESTAMP)) AS first_at, max(CAST(o_orderdate AS TIMESTAMP)) AS last_at FROM orders GROUP BY 1""")
def eda_activity(spark, d):
    at = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("o_orderdate")).alias("days"), F.sum(F.col("o_totalprice").cast(keys.MONEY)).cast("decimal(38,4)").alias("total"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(q1, 4) AS q1, round(q3, 4) AS q3, count(*) FILTER (WHERE l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) AS outliers FROM lineitem JOIN q USING (l_returnflag) GROUP BY ALL""")
def eda_iqr_outliers(spark, d):
    out = profile.outliers_by_group(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")
    return out.select("l_returnflag", F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"), "outliers")


@query("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(20,4)) AS amount FROM orders ORDER BY amount DESC, o_orderkey LIMIT 20")
def eda_topk(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast(keys.MONEY).alias("amount")).orderBy(F.desc("amount"), "o_orderkey").limit(20)


@query("SELECT hour(CAST(ts AS TIMESTAMP)) AS hour, dayname(CAST(ts AS TIMESTAMP)) AS day, count(*) AS n, round(sum(ln(1 + abs(value))), 3) AS log_total FROM events GROUP BY ALL")
def eda_hours(spark, d):
    day = F.date_format("ts", "EEEE")
    return table(spark, d, "events").groupBy(F.hour("ts").cast("long").alias("hour"), day.alias("day")).agg(F.count("*").alias("n"), F.round(F.sum(F.log1p(F.abs(F.col("value")))), 3).alias("log_total"))


@query("""SELECT l_partkey % 100 AS band, count(*) FILTER (WHERE l_discount BETWEEN 0 AND 0.05) AS inside, count(*) FILTER (WHERE NOT l_discount BETWEEN 0 AND 0.05) AS outside FROM lineitem GROUP BY 1""")
def eda_range_check(spark, d):
    ok = F.col("l_discount").between(0, 0.05)
    return table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 100).alias("band")).agg(F.count_if(ok).alias("inside"), F.count_if(~ok).alias("outside"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 512 THEN substr(text, 1, 512) ELSE text END AS text, '***' AS token FROM conversations")
def sanitize_rows(spark, d):
    rows = table(spark, d, "conversations").withColumn("m", F.create_map(F.lit("text"), F.col("text"), F.lit("api_token"), F.lit("s3cret")))
    clean = text.sanitized(F.col("m"))
    return rows.select("conv_id", "turn", clean["text"].alias("text"), clean["api_token"].alias("token"))


# Extensions beyond the settlement domain


@query("""SELECT time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS start_at, event_type, count(*) AS n FROM events GROUP BY ALL""")
def ext_hourly_events(spark, d):
    w = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start_at"), "event_type", "n")


@query(FULL + " SELECT partner, reconciliation_status, count(*) AS n FROM results GROUP BY ROLLUP (partner, reconciliation_status)")
def ext_status_rollup(spark, d):
    return results(spark, d).rollup("partner", "reconciliation_status").agg(F.count("*").alias("n"))
