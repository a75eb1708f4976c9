"""Registered queries of operations: quarantine rules, jobs, file health, dry runs, columns and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import keys
from ..operators import mapping, match, metrics, profile, queues, recovery
from ..session import shared_path
from ..streaming import ingest
from . import catalog, workload
from .catalog import _NOW, _QUARANTINE, _ROWS, FULL, query
from .desk import _PACKETS, packets
from .workload import RELATIONS, table


def _pick(k: F.Column, *values: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


_STATES = "['PENDING', 'REPROCESSING', 'RESOLVED', 'REJECTED']"


@query(f"""WITH s AS (SELECT {_STATES}[event_id % 4 + 1] AS now, {_STATES}[event_id // 4 % 4 + 1] AS next FROM events)
SELECT now, next, now = 'PENDING' AND next = 'REPROCESSING' OR now = 'REPROCESSING' AND next <> 'REPROCESSING' AS allowed, count(*) AS n FROM s GROUP BY ALL""")
def quarantine_transitions(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select(_pick(k, *recovery.TRANSITIONS).alias("now"), _pick(F.floor(k / 4), *recovery.TRANSITIONS).alias("next"))
    return rows.withColumn("allowed", recovery.transition_allowed(F.col("now"), F.col("next"))).groupBy("now", "next", "allowed").agg(F.count("*").alias("n"))


_LOG = """WITH RECURSIVE l AS (SELECT CASE WHEN event_id % 10 < 3 THEN 0 ELSE user_id END AS record_id, event_id - CASE WHEN event_id % 9 = 8 THEN 8 ELSE 0 END AS id, CAST(ts AS TIMESTAMP) AS tm,
  ['REPROCESSING', 'PENDING', 'RESOLVED', 'REPROCESSING', 'REPROCESSING', 'REJECTED', 'PENDING', 'REPROCESSING', 'BAD', NULL][event_id % 71 % 10 + 1] AS target FROM events),
f AS (SELECT record_id, id, min(tm) AS tm, arg_min(coalesce(target, ''), tm) AS target, count(*) AS times FROM l GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY tm, id) AS k FROM f),
s AS (SELECT record_id, 0 AS k, 'PENDING' AS state, 'PENDING' AS was, false AS fine, CAST(0 AS BIGINT) AS times FROM n WHERE k = 1
  UNION ALL SELECT n.record_id, n.k, CASE WHEN s.state = 'PENDING' AND n.target = 'REPROCESSING' OR s.state = 'REPROCESSING' AND n.target IN ('PENDING', 'RESOLVED', 'REJECTED') THEN n.target ELSE s.state END, s.state,
    s.state = 'PENDING' AND n.target = 'REPROCESSING' OR s.state = 'REPROCESSING' AND n.target IN ('PENDING', 'RESOLVED', 'REJECTED'), n.times FROM s JOIN n ON n.record_id IS NOT DISTINCT FROM s.record_id AND n.k = s.k + 1)"""


def quarantine_log(spark: SparkSession, d: str) -> DataFrame:
    """A log of status changes made of the events: a third of it is of one record, and some event ids come again."""
    k = F.col("event_id")
    names = ("REPROCESSING", "PENDING", "RESOLVED", "REPROCESSING", "REPROCESSING", "REJECTED", "PENDING", "REPROCESSING", "BAD")
    again = F.when(k % 9 == 8, 8).otherwise(0)
    record = F.when(k % 10 < 3, 0).otherwise(F.col("user_id"))
    return table(spark, d, "events").select(record.alias("record_id"), (k - again).alias("event_id"), F.col("ts").alias("at"), F.get(F.array(*map(F.lit, names)), (k % 71 % 10).cast("int")).alias("to_status"))


@query(_LOG + """ SELECT record_id, arg_max(state, k) AS status, count(*) FILTER (WHERE fine AND state = 'REPROCESSING') AS attempts, count(*) FILTER (WHERE fine) AS applied,
count(*) FILTER (WHERE NOT fine AND k > 0) AS refused, CAST(coalesce(sum(times - 1) FILTER (WHERE k > 0), 0) AS BIGINT) AS repeated FROM s GROUP BY record_id""")
def quarantine_folded(spark, d):
    return recovery.latest_status(recovery.status_changes(quarantine_log(spark, d)))


@query(_LOG + """ SELECT was AS before, state AS after, fine AS applied, count(*) AS n FROM s WHERE k > 0 GROUP BY ALL""")
def quarantine_paths(spark, d):
    """Every change that the log's events made or were refused."""
    changes = recovery.status_changes(quarantine_log(spark, d)).where("result <> 'REPEATED'")
    return changes.groupBy("before", "after", (F.col("result") == "APPLIED").alias("applied")).agg(F.count("*").alias("n"))


_UNITS = """WITH u AS (SELECT CASE WHEN event_id % 10 < 3 THEN 0 ELSE user_id END AS stream, event_id AS position, 'k' || event_id AS key, event_type, 'h' || event_id // 3 AS hash,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'FAILED' ELSE 'WAITING_REVIEW' END WHEN event_id % 7 = 0 THEN 'SKIPPED' ELSE 'COMPLETED' END AS outcome FROM events),
c AS (SELECT stream, CASE WHEN stream % 3 = 0 THEN min(key) FILTER (WHERE position % 2 = 0) END AS done_key, CASE WHEN stream % 3 = 1 THEN max(hash) END AS done_hash FROM u WHERE stream % 3 < 2 GROUP BY 1),
m AS (SELECT u.stream, min(position) FILTER (WHERE key = done_key OR hash = done_hash) AS done FROM u LEFT JOIN c USING (stream) GROUP BY 1),
r AS (SELECT u.*, done IS NULL OR position > done AS runs FROM u JOIN m USING (stream)),
t AS (SELECT stream, min(position) FILTER (WHERE runs AND outcome NOT IN ('COMPLETED', 'SKIPPED')) AS stop FROM r GROUP BY 1),
p AS (SELECT r.*, CASE WHEN NOT runs THEN 'DONE' WHEN position > stop THEN 'WAITING' ELSE outcome END AS status FROM r JOIN t USING (stream))"""


def units(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Units of as many streams as events have users, one of them with a third of all units, and the checkpoints of two streams in three."""
    k = F.col("event_id")
    failed = F.when(k % 2 == 0, "FAILED").otherwise("WAITING_REVIEW")
    outcome = F.when((F.col("event_type") == "error") & (k % 3 == 0), failed).when(k % 7 == 0, "SKIPPED").otherwise("COMPLETED")
    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    each = table(spark, d, "events").select(F.when(k % 10 < 3, 0).otherwise(F.col("user_id")).alias("stream"), k.alias("position"), name("k", k).alias("key"), name("h", F.floor(k / 3)).alias("hash"), outcome.alias("outcome"))
    at = F.min(F.when(F.col("position") % 2 == 0, F.col("key")))
    marks = each.where("stream % 3 < 2").groupBy("stream").agg(at.alias("k"), F.max("hash").alias("h"))
    return each, marks.select("stream", F.when(F.col("stream") % 3 == 0, F.col("k")).alias("done_key"), F.when(F.col("stream") % 3 == 1, F.col("h")).alias("done_hash"))


@query(_UNITS + " SELECT stream, status, count(*) AS n, min(position) AS first, max(position) AS last FROM p GROUP BY ALL")
def ordered_units(spark, d):
    planned = ingest.ordered_units(*units(spark, d))
    return planned.groupBy("stream", "status").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.max("position").alias("last"))


@query(_UNITS + """, a AS (SELECT stream, arg_max(key, position) FILTER (WHERE status IN ('COMPLETED', 'SKIPPED')) AS k, arg_max(hash, position) FILTER (WHERE status IN ('COMPLETED', 'SKIPPED')) AS h,
  max(key) FILTER (WHERE status IN ('FAILED', 'WAITING_REVIEW')) AS held_at FROM p GROUP BY 1),
b AS (SELECT a.stream, held_at, CASE WHEN k IS NULL THEN done_key ELSE k END AS done_key, CASE WHEN k IS NULL THEN done_hash ELSE h END AS done_hash FROM a LEFT JOIN c USING (stream)),
x AS (SELECT u.* FROM u), m2 AS (SELECT u.stream, min(position) FILTER (WHERE key = done_key OR hash = done_hash) AS done FROM u LEFT JOIN b USING (stream) GROUP BY 1)
SELECT stream, done_key, done_hash, held_at, count(*) FILTER (WHERE done IS NULL OR position > done) AS ahead FROM b JOIN m2 USING (stream) JOIN u USING (stream) GROUP BY ALL""")
def units_resumed(spark, d):
    """Checkpoints behind a run, and the units that the next run has ahead of it."""
    each, marks = units(spark, d)
    then = ingest.advanced(ingest.ordered_units(each, marks), marks)
    ahead = ingest.ordered_units(each, then).groupBy("stream").agg(F.count_if(F.col("status") != "DONE").alias("ahead"))
    return then.join(ahead, "stream").select("stream", "done_key", "done_hash", "held_at", "ahead")


@query(f"""WITH {_QUARANTINE} SELECT 'late' AS kind, status, count(*) AS n FROM q WHERE status IN ('PENDING', 'REPROCESSING') AND due_at <= TIMESTAMP '{_NOW}' GROUP BY ALL
UNION ALL SELECT 'early', status, count(*) FROM q WHERE due_at > TIMESTAMP '{_NOW}' GROUP BY ALL UNION ALL SELECT 'rejected', status, count(*) FROM q WHERE status = 'REJECTED' AND due_at <= TIMESTAMP '{_NOW}' GROUP BY ALL""")
def quarantine_overdue(spark, d):
    q, now = catalog.quarantine(spark, d), F.lit(_NOW).cast("timestamp_ntz")
    found = {"late": recovery.overdue(q, now, True), "early": recovery.overdue(q, now, False), "rejected": recovery.overdue(q, now, True, "REJECTED")}
    parts = [rows.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "status", "n") for kind, rows in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_LATER = "2024-12-01 00:00:00"


@query(f"""WITH {_QUARANTINE}, x AS (SELECT id, status, created_at + to_days(CASE status WHEN 'RESOLVED' THEN 90 WHEN 'REJECTED' THEN 365 END) AS expires_at FROM q)
SELECT id, status, expires_at FROM x WHERE expires_at <= TIMESTAMP '{_LATER}' ORDER BY expires_at, id LIMIT 100""")
def quarantine_expired(spark, d):
    return recovery.expired(catalog.quarantine(spark, d), F.lit(_LATER).cast("timestamp_ntz")).select("id", "status", "expires_at")


@query(f"""WITH {_QUARANTINE}, f AS (SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS created_at, CASE event_type WHEN 'click' THEN 'COMPLETED' WHEN 'view' THEN 'FAILED' ELSE 'PROCESSING' END AS status FROM events),
n AS (SELECT * FROM f ORDER BY created_at DESC, id DESC LIMIT 50)
SELECT count(*) AS returned_files, count(*) FILTER (WHERE status = 'COMPLETED') AS completed_files, count(*) FILTER (WHERE status = 'FAILED') AS failed_files,
  (SELECT least(50, count(*)) FROM q WHERE status = 'PENDING') AS pending_quarantine FROM n""")
def ingestion_operations(spark, d):
    kind = F.col("event_type")
    status = F.when(kind == "click", "COMPLETED").when(kind == "view", "FAILED").otherwise("PROCESSING")
    files = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), status.alias("status"))
    return queues.file_operations(files, catalog.quarantine(spark, d).where("status = 'PENDING'"))


@query(f"""WITH {_PACKETS}, c AS (SELECT DISTINCT partner, source FROM k),
p AS (SELECT partner, source, created_at AS checkpoint_at, id AS checkpoint FROM (SELECT *, row_number() OVER (PARTITION BY partner, source ORDER BY created_at DESC, id DESC) AS n FROM k WHERE status = 'APPROVED') WHERE n = 1),
r AS (SELECT partner, source, created_at AS run_at, id AS run FROM (SELECT *, row_number() OVER (PARTITION BY partner, source ORDER BY created_at DESC, id DESC) AS n FROM k WHERE delivery = 7) WHERE n = 1)
SELECT partner, source, checkpoint_at, checkpoint, run_at, run FROM c LEFT JOIN p USING (partner, source) LEFT JOIN r USING (partner, source)""")
def jobs_with_checkpoints(spark, d):
    k = packets(spark, d)
    checkpoints = k.where("status = 'APPROVED'").select("partner", "source", F.col("created_at").alias("checkpoint_at"), F.col("id").alias("checkpoint"))
    runs = k.where("delivery = 7").select("partner", "source", F.col("created_at").alias("run_at"), F.col("id").alias("run"))
    once = [metrics.latest(rows, ["partner", "source"], at, ident) for rows, at, ident in ((checkpoints, "checkpoint_at", "checkpoint"), (runs, "run_at", "run"))]
    return queues.jobs(k.select("partner", "source").distinct(), *once, ["partner", "source"])


@query(f"""WITH {RELATIONS} SELECT id, transaction_time, amount FROM internal_transaction WHERE partner = 'BUILDING' AND transaction_time BETWEEN TIMESTAMP '1995-03-01 00:00:00' AND TIMESTAMP '1995-06-30 23:59:59'
ORDER BY transaction_time, id LIMIT 40""")
def internal_by_time(spark, d):
    first, last = (F.lit(t).cast("timestamp_ntz") for t in ("1995-03-01 00:00:00", "1995-06-30 23:59:59"))
    return metrics.in_period(workload.internal_transaction(spark, d), "BUILDING", "transaction_time", first, last, 40).select("id", "transaction_time", "amount")


@query(f"""WITH {_QUARANTINE}, er AS (SELECT run, id, codes[1] AS code FROM q), n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY id) AS place, count(*) OVER (PARTITION BY run) AS errors FROM er)
SELECT run, id, code, CAST(place AS INTEGER) AS place, errors, greatest(errors - 5, 0) AS dropped FROM n WHERE place <= 5""")
def bounded_error_samples(spark, d):
    errors = catalog.quarantine(spark, d).select("run", "id", F.get("codes", F.lit(0)).alias("code"))
    return queues.bounded_errors(errors, ["run"], ["id"])


@query("""WITH f AS (SELECT event_id AS k, ['', '  ', event_type, CAST(event_id AS VARCHAR), CASE WHEN event_id % 3 = 0 THEN 'x' || event_id ELSE '' END] AS cells FROM events ORDER BY event_id LIMIT 10),
l AS (SELECT k, unnest(cells) AS v, generate_subscripts(cells, 1) AS c FROM f),
s AS (SELECT c, count(*) FILTER (WHERE trim(v) <> '') AS filled, list(trim(v) ORDER BY k) FILTER (WHERE trim(v) <> '') AS own FROM l GROUP BY 1),
h AS (SELECT * FROM (VALUES (1, ''), (2, 'Ngày'), (3, '--'), (4, 'Id'), (5, 'Note'), (6, 'Unused')) AS t(c, header)),
j AS (SELECT h.c, h.header, coalesce(filled, 0) AS filled, coalesce(own[1:3], []) AS own FROM h LEFT JOIN s ON h.c = s.c WHERE header <> '' OR filled > 0)
SELECT CAST(c AS INTEGER) AS "column", header, filled, array_to_string(own, ',') AS samples, CASE WHEN regexp_matches(header, '[A-Za-zÀ-ỹ0-9]') THEN 2 ELSE 0 END + least(filled, 3) AS priority FROM j""")
def candidate_columns(spark, d):
    k = F.col("event_id")
    cells = F.array(F.lit(""), F.lit("  "), F.col("event_type"), k.cast("string"), F.when(k % 3 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(""))
    out = queues.candidate_columns(table(spark, d, "events").select(k.alias("k"), cells.alias("cells")), ["", "Ngày", "--", "Id", "Note", "Unused"], "k")
    return out.withColumn("samples", F.array_join("samples", ","))


@query("""WITH r AS (SELECT 'T' || o_orderkey AS a, CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE CAST(CAST(o_totalprice AS DECIMAL(20,4)) AS VARCHAR) END AS b FROM orders),
s AS (SELECT count(*) AS a, count(*) FILTER (WHERE trim(b) <> '') AS b FROM r)
SELECT 'amount' AS role, 2 AS "column", 5 * b AS score FROM s UNION ALL SELECT 'id', 1, a + 10 FROM s UNION ALL SELECT 'trace', 1, a FROM s UNION ALL SELECT 'status', 1, a FROM s UNION ALL SELECT 'transDate', 1, a FROM s""")
def column_roles_sparse(spark, d):
    price = F.when(F.col("o_orderkey") % 5 == 0, "  ").otherwise(F.col("o_totalprice").cast("decimal(20,4)").cast("string"))
    cells = F.array(F.concat(F.lit("T"), F.col("o_orderkey").cast("string")), price, F.lit(" "))
    return queues.best_columns(queues.column_scores(table(spark, d, "orders").select(cells.alias("cells")), ["Transaction", "Sum", "Comment", "Trang thai"]))


@query("""SELECT 4 AS "column", 'status' AS role, 10 AS score UNION ALL SELECT 3, 'amount', 10""")
def column_roles_headers_only(spark, d):
    cells = table(spark, d, "orders").select(F.array(F.lit(" "), F.lit(None).cast("string")).alias("cells"))
    return queues.best_columns(queues.column_scores(cells, ["A", "B", "Total", "Trang thai"]))


@query(f"""WITH {_ROWS}, f AS (SELECT *, len(errors) + len(violations) > 0 AS bad, row_number() OVER (PARTITION BY trace ORDER BY k) AS seen, tm IS NULL AS undated, amount IS NOT NULL AND amount > 900 AS large FROM v),
x AS (SELECT f.*, count(*) OVER (PARTITION BY k % 2000, event_type) > 1 AS twice, count(DISTINCT amount) OVER (PARTITION BY k % 2000, event_type) > 1 AS unlike FROM f)
SELECT CASE WHEN undated AND k % 17 = 0 THEN 'BATCH_FATAL' WHEN twice AND unlike THEN 'CONFLICTING_DUPLICATE' WHEN bad THEN 'REJECT' WHEN large THEN 'WARNING' WHEN twice THEN 'EQUIVALENT_DUPLICATE' ELSE 'VALID' END AS outcome, count(*) AS n FROM x GROUP BY 1""")
def row_outcome_precedence(spark, d):
    rows = catalog.judged(spark, d)
    key = [(F.col("event_id") % 2000).alias("_slot"), F.col("event_type").alias("_type")]
    groups = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.count_distinct("amount").alias("_amounts"))
    rows = rows.join(groups, (F.col("event_id") % 2000 == F.col("_slot")) & (F.col("event_type") == F.col("_type")))
    fatal = F.col("transDate").isNull() & (F.col("event_id") % 17 == 0)
    large = F.coalesce(F.col("amount") > 900, F.lit(False))
    found = mapping.outcome(fatal, (F.col("_n") > 1) & (F.col("_amounts") > 1), F.size("faults") > 0, large, F.col("_n") > 1)
    return rows.select(found.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id AS stream, date_trunc('day', CAST(ts AS TIMESTAMP)) AS seen_at, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS source FROM events WHERE user_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seen_at DESC, source) AS place FROM s) SELECT stream, seen_at, source FROM n WHERE place = 1""")
def latest_of_three(spark, d):
    every = table(spark, d, "events").where("user_id IS NOT NULL")
    kinds = (F.col("event_type") == "click", F.col("event_type") == "view", ~F.col("event_type").isin("click", "view"))
    rows = [every.where(c).select(F.col("user_id").alias("stream"), F.date_trunc("day", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("seen_at"), F.lit(k).alias("source")) for k, c in enumerate(kinds)]
    return queues.newest_of(rows, ["stream"], "seen_at")


@query(f"""WITH {_ROWS}, f AS (SELECT * FROM v ORDER BY k LIMIT 100), s AS (SELECT count(*) AS sampled, count(*) FILTER (WHERE len(errors) + len(violations) = 0) AS success FROM f),
c AS (SELECT code, count(*) AS n FROM (SELECT unnest(list_concat(errors, violations)) AS code FROM f) GROUP BY 1 ORDER BY n DESC, code LIMIT 5)
SELECT sampled, success, sampled - success AS failed, sampled > 0 AND sampled = success AS passed, code, n FROM s LEFT JOIN c ON true""")
def dry_run(spark, d):
    counts, issues = mapping.dry_run(catalog.judged(spark, d), "event_id")
    return counts.join(F.broadcast(issues), F.lit(True), "left")  # a row and five


@query("""WITH c AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN md5(event_type) END AS known, CASE WHEN event_id % 3 <> 0 THEN md5(CASE WHEN event_id % 5 = 0 THEN 'new' ELSE event_type END) END AS seen,
CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 2 END AS a, event_id % 2 AS b FROM events)
SELECT CASE WHEN known IS NOT NULL AND seen IS NOT NULL THEN known <> seen ELSE a IS DISTINCT FROM b END AS stale, count(*) AS n FROM c GROUP BY 1""")
def config_staleness(spark, d):
    k, kind = F.col("event_id"), F.col("event_type")
    known, seen = F.when(k % 4 != 0, F.md5(kind)), F.when(k % 3 != 0, F.md5(F.when(k % 5 == 0, "new").otherwise(kind)))
    rows = table(spark, d, "events").select(queues.stale(known, seen, F.when(k % 7 != 0, k % 2), k % 2).alias("stale"))
    return rows.groupBy("stale").agg(F.count("*").alias("n"))


@query(FULL + """, r AS (SELECT *, CASE WHEN partner IN ('BUILDING', 'MACHINERY') THEN 'R2' ELSE 'R1' END AS run FROM results WHERE partner IS NOT NULL)
SELECT 'run' AS asked, run, source_file_id, count(*) AS n FROM r WHERE run IN ('R2', 'R3') GROUP BY ALL UNION ALL SELECT 'file', run, source_file_id, count(*) FROM r WHERE source_file_id = 'F3' GROUP BY ALL""")
def results_by_run_or_file(spark, d):
    """Results stored by one run, those of two partners again by another: read back by run, or by file."""
    path = shared_path(spark, "results")
    rows = catalog.results(spark, d).where("partner IS NOT NULL").select("partner", F.trunc("date", "year").alias("date"), "source_file_id")  # a folder a year
    match.write_results(rows, path, "R1")
    match.write_results(rows.where(F.col("partner").isin("BUILDING", "MACHINERY")), path, "R2")
    back = spark.read.schema("source_file_id string, run_id string, partner string, date date").parquet(path)
    both = {"run": queues.by_run_or_file(back, ["R2", "R3"], "F3"), "file": queues.by_run_or_file(back, None, "F3")}
    parts = [r.groupBy(F.col("run_id").alias("run"), "source_file_id").agg(F.count("*").alias("n")).select(F.lit(a).alias("asked"), "run", "source_file_id", "n") for a, r in both.items()]
    return parts[0].unionByName(parts[1])


@query(f"""WITH {_QUARANTINE}, x AS (SELECT id, status, created_at + to_days(CASE status WHEN 'RESOLVED' THEN 90 WHEN 'REJECTED' THEN 365 END) AS expires_at FROM q),
g AS (SELECT id FROM x WHERE expires_at <= TIMESTAMP '{_LATER}' ORDER BY expires_at, id LIMIT 100)
SELECT status, count(*) AS n FROM x WHERE id NOT IN (SELECT id FROM g) GROUP BY 1""")
def quarantine_purged(spark, d):
    """A store of records added twice, as after a retry, and purged of the hundred longest expired."""
    path = shared_path(spark, "quarantine")
    records = catalog.quarantine(spark, d).drop("priority", "due_at", "expires_at").withColumn("resolved_at", F.col("created_at"))
    for _ in range(2):
        recovery.append(records, path)
    recovery.purge(spark, path, F.lit(_LATER).cast("timestamp_ntz"))
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("n"))


@query(FULL + """, g AS (SELECT partner, reconciliation_status AS s, count(*) AS n FROM results GROUP BY ALL)
SELECT partner, count(*) AS kinds, sum(n) AS total, CAST(coalesce(sum(n) FILTER (WHERE s IN ('AMOUNT_MISMATCH', 'STATUS_MISMATCH', 'MULTIPLE_MISMATCH')), 0) AS BIGINT) AS mismatches FROM g GROUP BY 1""")
def mismatch_groups(spark, d):
    g = metrics.counts(catalog.results(spark, d), "reconciliation_status", ["partner"])
    unlike = F.when(F.col("reconciliation_status").isin("AMOUNT_MISMATCH", "STATUS_MISMATCH", "MULTIPLE_MISMATCH"), F.col("n")).otherwise(0)
    return g.groupBy("partner").agg(F.count("*").alias("kinds"), F.sum("n").alias("total"), F.sum(unlike).alias("mismatches"))


@query("""SELECT count(l_extendedprice) AS count, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 3) AS std, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, max(l_extendedprice) AS max FROM lineitem""")
def eda_describe(spark, d):
    out = profile.described(table(spark, d, "lineitem"), "l_extendedprice")
    return out.select(*[F.round(c, 3 if c == "std" else 4).alias(c) if c not in ("count", "min", "max") else F.col(c) for c in out.columns])


@query("SELECT o_orderpriority, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM orders GROUP BY 1")
def eda_value_counts(spark, d):
    return profile.value_counts(table(spark, d, "orders"), "o_orderpriority")


@query("""WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), p AS (SELECT CAST(least(floor((CAST(o_totalprice AS DOUBLE) - lo) / (CAST(hi AS DOUBLE) - lo) * 20), 19) AS INTEGER) AS bin, lo, hi FROM orders, b)
SELECT bin, round(min(lo + bin * (hi - lo) / 20), 4) AS lower, count(*) AS n FROM p GROUP BY 1""")
def eda_histogram(spark, d):
    return profile.histogram(table(spark, d, "orders"), "o_totalprice", 20).withColumn("lower", F.round("lower", 4))


@query("""SELECT coalesce(l_returnflag, 'All') AS l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS "F", count(*) FILTER (WHERE l_linestatus = 'O') AS "O", count(*) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def eda_crosstab_margins(spark, d):
    return profile.crosstab_with_margins(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(count(*) FILTER (WHERE o_totalprice > q3 + 1.5 * (q3 - q1)) / count(*), 8) AS outlier_rate FROM orders, q""")
def profile_amount_rates(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("x"))
    whole = profile.amounts(rows, "x").select("n", F.round(F.col("outliers") / F.col("n"), 8).alias("outlier_rate"))
    return whole.join(F.broadcast(rows.agg(F.round(F.avg("x"), 4).alias("mean"))), F.lit(True))  # a row each


@query("""WITH f AS (SELECT user_id, min(event_id) AS k FROM events WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY 2 LIMIT 5)
SELECT count(*) AS n, count(*) FILTER (WHERE user_id IS NULL) AS missing, count(*) FILTER (WHERE user_id IS NULL) / count(*) AS rate, (SELECT string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY k) FROM f) AS samples FROM events""")
def profile_samples(spark, d):
    return profile.samples(table(spark, d, "events"), "user_id", "event_id").withColumn("samples", F.array_join("samples", ","))


_TEXT = """CASE event_id % 4 WHEN 0 THEN strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 1 THEN strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') || '.250+07:00' ELSE 'n/a' END"""


@query(f"""WITH t AS (SELECT {_TEXT} AS t FROM events) SELECT count(*) AS n, count(*) FILTER (WHERE t LIKE '%.250+07:00') AS sub_second, count(*) FILTER (WHERE NOT (t LIKE '%Z' OR t LIKE '%+07:00')) AS zone_missing FROM t WHERE t <> 'n/a'""")
def profile_instants(spark, d):
    k, ts = F.col("event_id"), F.col("ts")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k % 4 == 0, F.concat(iso, F.lit("Z"))).when(k % 4 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k % 4 == 2, F.concat(iso, F.lit(".250+07:00"))).otherwise("n/a")
    return profile.instants(table(spark, d, "events").select(text.alias("t")), "t")


@query(f"WITH {_ROWS} SELECT count(*) AS n, count(*) FILTER (WHERE len(errors) + len(violations) > 0) AS rejected, 100.0::DOUBLE * count(*) FILTER (WHERE len(errors) + len(violations) = 0) / count(*) AS score FROM v")
def profile_score(spark, d):
    return profile.quality_score(catalog.judged(spark, d), F.size("faults") > 0)


_CELLS = """WITH e AS (SELECT CAST(event_id AS VARCHAR) AS ident, CASE WHEN event_id % 97 = 5 THEN 'n/a' WHEN event_id % 97 = 6 THEN 'u' || user_id ELSE CAST(user_id AS VARCHAR) END AS user_text,
  CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 50 AS VARCHAR) ELSE (event_id % 50) || '.5' END AS amount, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS moment, '' AS nothing, event_type AS kind FROM events)"""


def text_cells(spark: SparkSession, d: str) -> DataFrame:
    """Events as a file's texts: one column has drifted, one is empty."""
    k = F.col("event_id")
    user = F.when(k % 97 == 5, "n/a").when(k % 97 == 6, F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string"))
    amount = F.concat((k % 50).cast("string"), F.when(k % 2 == 0, "").otherwise(".5"))
    return table(spark, d, "events").select(k.cast("string").alias("ident"), user.alias("user_text"), amount.alias("amount"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("moment"), F.lit("").alias("nothing"), F.col("event_type").alias("kind"))


_TEXTS = ["ident", "user_text", "amount", "moment", "nothing", "kind"]


@query(_CELLS + f""", c AS ({" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS total, count(*) FILTER (WHERE {c} IN ('', 'n/a')) AS missing, count(DISTINCT CASE WHEN {c} NOT IN ('', 'n/a') THEN {c} END) AS n FROM e" for c in _TEXTS)})
SELECT name, total, missing, CASE name WHEN 'ident' THEN 'integer' WHEN 'amount' THEN 'decimal' WHEN 'moment' THEN 'instant' WHEN 'nothing' THEN NULL ELSE 'text' END AS type,
  CASE WHEN n <= 120 THEN n END AS distinct_values, n > 120 AS saturated FROM c""")
def profile_observed(spark, d):
    """Types and distinct values, those counted up to 120 so that some columns go beyond."""
    return profile.observed(text_cells(spark, d), _TEXTS, 120)


@query(_CELLS + """ SELECT unnest(['ident', 'user_text', 'amount', 'moment', 'nothing', 'kind', 'gone', 'maybe']) AS name, unnest(['integer', 'integer', 'decimal', 'instant', 'text', NULL, 'text', 'text']) AS expected,
unnest(['integer', 'text', 'decimal', 'instant', NULL, 'text', NULL, NULL]) AS type, unnest([NULL, CASE WHEN bool_or(NOT regexp_full_match(user_text, '[0-9]+|n/a')) THEN 'TYPE' END, NULL, NULL, 'EMPTY', 'UNEXPECTED', 'MISSING', 'OPTIONAL_MISSING']) AS drift FROM e""")
def profile_drift(spark, d):
    expected = [("ident", "integer", True), ("user_text", "integer", True), ("amount", "decimal", True), ("moment", "instant", True), ("nothing", "text", True), ("gone", "text", True), ("maybe", "text", False)]
    return profile.drift(profile.observed(text_cells(spark, d), _TEXTS), expected)
