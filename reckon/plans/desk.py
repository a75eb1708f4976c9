"""Registered queries of the review desk: packets, runs, claims, feeds, filters and column roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import match, metrics, queues
from . import catalog, workload
from .catalog import FULL, _ROWS, query
from .workload import RELATIONS, table

_PACKETS = """
k AS (SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS created_at, user_id % 5 AS partner, event_type AS source, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id % 50 END AS delivery,
  CASE WHEN event_id % 30 = 0 THEN 'APPROVED' ELSE 'PENDING' END AS status FROM events WHERE user_id IS NOT NULL)"""


def packets(spark: SparkSession, d: str) -> DataFrame:
    k, u = F.col("event_id"), F.col("user_id")
    return table(spark, d, "events").where("user_id IS NOT NULL").select(
        k.alias("id"), F.col("ts").alias("created_at"), (u % 5).alias("partner"), F.col("event_type").alias("source"),
        F.when(k % 4 != 0, u % 50).alias("delivery"), F.when(k % 30 == 0, "APPROVED").otherwise("PENDING").alias("status"),
    )


def _visible(spark: SparkSession, d: str) -> DataFrame:
    every = packets(spark, d)
    return queues.visible_packets(every.where("status = 'PENDING'"), every.where("status = 'APPROVED'"), ["partner", "source"], ["delivery"])


_VISIBLE = _PACKETS + """,
w AS (SELECT *, row_number() OVER (PARTITION BY partner, source ORDER BY created_at DESC, id DESC) AS n FROM k WHERE status = 'PENDING'
  AND NOT EXISTS (SELECT 1 FROM k a WHERE a.status = 'APPROVED' AND a.partner = k.partner AND a.source = k.source AND a.delivery IS NOT DISTINCT FROM k.delivery))"""


@query(f"WITH {_VISIBLE} SELECT id, partner, source, delivery, created_at FROM w WHERE n = 1")
def packets_visible(spark, d):
    return _visible(spark, d).select("id", "partner", "source", "delivery", "created_at")


@query(f"WITH {_VISIBLE} SELECT partner, count(*) AS pending FROM w WHERE n = 1 GROUP BY 1")
def packets_pending_by_partner(spark, d):
    return _visible(spark, d).groupBy("partner").agg(F.count("*").alias("pending"))


@query("""WITH s AS (SELECT user_id AS stream, event_type, event_id AS id, CAST(ts AS TIMESTAMP) AS seen_at, CASE event_type WHEN 'click' THEN 0 ELSE 1 END AS rank FROM events WHERE user_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seen_at DESC, rank) AS place, count(*) OVER (PARTITION BY stream, seen_at, rank) AS ties FROM s) SELECT stream, seen_at FROM n WHERE place = 1""")
def latest_of_sources(spark, d):
    runs = catalog.runs(spark, d)
    return queues.newest_of([runs.where("status = 'click'"), runs.where("status <> 'click'")], ["stream"], "seen_at").select("stream", "seen_at")


@query("""WITH a AS (SELECT event_id, 0 AS s, value FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, 1, value + 1 FROM events WHERE event_id % 2 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s) AS place FROM a) SELECT event_id, value FROM n WHERE place = 1""")
def merged_attempts(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return queues.merged_attempts(e.where("event_id % 3 <> 0"), e.where("event_id % 2 = 0").withColumn("value", F.col("value") + 1), "event_id", ["value"])


@query("""WITH f AS (SELECT 'event' AS kind, event_id AS id, CAST(ts AS TIMESTAMP) AS tm FROM events UNION ALL SELECT 'order', o_orderkey, CAST(o_orderdate AS TIMESTAMP) FROM orders)
SELECT kind, id, tm AS "at" FROM f ORDER BY tm DESC, kind, id LIMIT 40""")
def activity_feed(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("at"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    return queues.feed({"event": e, "order": o}, 40)


@query("""SELECT event_id, user_id FROM events e WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_id % 2 = 1 AND c.event_id % 5 <> 0 AND c.user_id = e.user_id AND c.event_type = e.event_type)""")
def file_claims(spark, d):
    e = table(spark, d, "events").withColumn("status", F.when(F.col("event_id") % 5 == 0, "FAILED").otherwise("DONE"))
    return queues.claimable(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"]).select("event_id", "user_id")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'unit' || event_id ELSE sha256('{"page":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"' || (event_id % 7) || '"' END || ',"partner":"' || event_type || '"}') END AS key FROM events""")
def fetch_unit_keys(spark, d):
    k = F.col("event_id")
    explicit = F.when(k % 4 == 0, F.concat(F.lit(" unit"), k.cast("string"), F.lit(" "))).otherwise("  ")
    key = queues.unit_key(explicit, {"partner": F.col("event_type"), "page": F.when(k % 3 != 0, k % 7)})
    return table(spark, d, "events").select("event_id", key.alias("key"))


@query(f"""WITH {_ROWS} SELECT event_type, count(*) AS input, count(*) FILTER (WHERE len(errors) + len(violations) = 0) AS stored, count(*) FILTER (WHERE len(errors) + len(violations) > 0) AS rejected,
CASE WHEN count(*) FILTER (WHERE len(errors) + len(violations) > 0) > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status FROM v GROUP BY 1""")
def run_counters(spark, d):
    return queues.stage_counters(catalog.judged(spark, d), ["event_type"], "outcome")


@query(f"""WITH {_ROWS} SELECT event_type, round(count(*) FILTER (WHERE len(errors) + len(violations) > 0) / count(*), 6) AS error_rate FROM v GROUP BY 1""")
def config_error_rate(spark, d):
    c = queues.stage_counters(catalog.judged(spark, d), ["event_type"], "outcome")
    return c.select("event_type", F.round(queues.error_rate(F.col("input"), F.col("rejected")), 6).alias("error_rate"))


@query(f"""WITH {RELATIONS} SELECT partner, date, key, amount, status FROM p WHERE partner IN ('BUILDING', 'MACHINERY') AND amount >= 1000 AND amount <= 150000 AND date >= DATE '1998-01-01' AND file = 'F3'""")
def dynamic_filters(spark, d):
    side = match.partner_side(workload.partner_transaction(spark, d))
    return queues.filtered(side, partner=["BUILDING", "MACHINERY"], amount=(1000, 150000), date=(F.lit("1998-01-01").cast("date"), None), file="F3", status=None).select("partner", "date", "key", "amount", "status")


@query("""SELECT event_id, event_type FROM events WHERE CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(ts AS DATE) END = DATE '2024-01-10' OR event_type = 'view' AND event_id % 6 = 0""")
def audit_filter(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", F.col("event_type").alias("kind"), F.when(F.col("event_id") % 6 != 0, F.to_date("ts")).alias("date"))
    return queues.audited(rows, "2024-01-10", None, ("view",)).select("event_id", "event_type")


@query(f"WITH {_ROWS}, q AS (SELECT k, ts, list_concat(errors, violations) AS codes FROM v) SELECT k AS event_id FROM q WHERE len(codes) > 0 AND list_has_any(codes, ['MISSING_REQUIRED_FIELD']) AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15'")
def quarantine_filter(spark, d):
    rows = catalog.quarantine(spark, d).where(F.exists("codes", lambda c: c.isin(*catalog.recovery.ISSUE_CODES["REQUIRED_FIELD"])))
    first, after = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 00:00:00", "2024-01-15 00:00:00"))
    return rows.where((F.col("created_at") >= first) & (F.col("created_at") < after)).select(F.col("id").alias("event_id"))


@query(f"WITH {RELATIONS}, x AS (SELECT DISTINCT key FROM p WHERE file = 'F2' AND key IS NOT NULL) SELECT partner, count(*) AS known FROM i_all WHERE key IN (SELECT key FROM x) GROUP BY 1")
def existing_keys(spark, d):
    wanted = match.partner_side(workload.partner_transaction(spark, d)).where("file = 'F2' AND key IS NOT NULL").select("key").distinct()
    return match.internal_side(workload.internal_transaction(spark, d)).join(wanted, "key", "left_semi").groupBy("partner").agg(F.count("*").alias("known"))


@query(FULL + """, s AS (SELECT reconciliation_status AS status, count(*) AS samples, avg(CASE WHEN reconciliation_status IN ('AMOUNT_MISMATCH', 'MULTIPLE_MISMATCH') THEN abs(partner_amount - internal_amount) END) AS gap FROM results GROUP BY 1)
SELECT status, samples, CASE WHEN gap IS NULL THEN 'N/A' WHEN gap < 100000 THEN '0-100k' WHEN gap < 1000000 THEN '100k-1M' ELSE '1M+' END AS amount_range FROM s""")
def error_signals(spark, d):
    gap = F.avg(F.when(metrics.status_is("AMOUNT_MISMATCH", "MULTIPLE_MISMATCH"), metrics.difference()))
    s = catalog.results(spark, d).groupBy(F.col("reconciliation_status").alias("status")).agg(F.count("*").alias("samples"), gap.alias("gap"))
    return s.select("status", "samples", F.coalesce(metrics.band(F.col("gap")), F.lit("N/A")).alias("amount_range"))


@query("""WITH r AS (SELECT 'T' || o_orderkey AS a, CAST(CAST(o_totalprice AS DECIMAL(20,4)) AS VARCHAR) AS b, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' ELSE 'FAILED' END AS c, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d') AS d FROM orders),
n AS (SELECT count(*) AS n FROM r), s AS (
SELECT 'amount' AS role, 2 AS "column", 5 * n + 10 AS score FROM n UNION ALL SELECT 'transDate', 4, 5 * n + 10 FROM n UNION ALL SELECT 'status', 3, 5 * n + 10 FROM n UNION ALL SELECT 'id', 1, n + 10 FROM n UNION ALL SELECT 'trace', 1, n FROM n)
SELECT role, "column", score FROM s""")
def column_roles(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "SUCCESS").otherwise("FAILED")
    cells = F.array(F.concat(F.lit("T"), F.col("o_orderkey").cast("string")), F.col("o_totalprice").cast("decimal(20,4)").cast("string"), state, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return queues.best_columns(queues.column_scores(table(spark, d, "orders").select(cells.alias("cells")), ["Transaction", "Amount", "Status", "Date"]))


@query("""WITH i AS (SELECT event_id AS id, ['low', 'medium', 'high', 'critical'][event_id % 4 + 1] AS severity, event_id % 12 AS rate, event_id % 50 AS affected, 40 AS total, 15 AS actual FROM events),
f AS (SELECT id, CASE WHEN severity = 'critical' AND rate < 5 THEN 'high' WHEN severity IN ('high', 'critical') AND rate < 1 THEN 'high' WHEN severity IN ('high', 'critical') AND rate < 5 THEN 'low' END AS risk, 'severity' AS field FROM i
UNION ALL SELECT id, CASE WHEN affected > total THEN 'high' END, 'total' FROM i UNION ALL SELECT id, CASE WHEN affected > 30 THEN 'high' WHEN affected > 22.5 THEN 'low' END, 'actual' FROM i)
SELECT field, risk, count(*) AS n FROM f WHERE risk IS NOT NULL GROUP BY ALL""")
def guardrail_findings(spark, d):
    k = F.col("event_id")
    severity = F.element_at(F.array(*map(F.lit, queues.SEVERITIES)), (k % 4 + 1).cast("int"))
    rows = table(spark, d, "events").select(k.alias("id"), severity.alias("severity"), (k % 12).alias("rate"), (k % 50).alias("affected"), F.lit(40).alias("total"), F.lit(15).alias("actual"))
    return queues.guardrails(rows).groupBy("field", "risk").agg(F.count("*").alias("n"))
