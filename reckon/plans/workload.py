"""Settlement relations derived from the order tables, as DataFrames and as SQL.

Partner rows vary spellings, blank keys and copies by order number; internal
rows drop, change, repeat and delay some, so that every outcome occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

STATUS_TEXT = {
    "F": ("SUCCESS", "Thành công", " matched "),
    "O": ("FAILED", "Thất bại", "Fail"),
    "P": ("REVERSED", "hoàn tiền", "PENDING"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf_dir, "orders").join(segment, "o_custkey").select(
        F.col("o_orderkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.col("o_totalprice").cast("decimal(20,4)").alias("amount"),
        F.col("o_orderstatus").alias("letter"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"),
    )


def _spelled(letter: F.Column, k: F.Column) -> F.Column:
    out = F.lit("PENDING")
    for c, words in STATUS_TEXT.items():
        out = F.when(letter == c, F.element_at(F.array(*map(F.lit, words)), (k % 3 + 1).cast("int"))).otherwise(out)
    return out


def partner_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    name = F.concat(F.lit("T"), k.cast("string"))
    rows = _orders(spark, sf_dir).withColumn("copy", F.explode(F.when(k % 17 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))))
    return rows.select(
        F.concat(F.lit("P"), k.cast("string"), F.col("copy")).alias("id"),
        F.col("segment").alias("identify"),
        F.when(k % 22 == 1, "").otherwise(name).alias("partner_id"),
        F.when(k % 11 == 0, None).when(k % 11 == 1, "   ").when(k % 11 == 2, F.concat(F.lit("  "), name, F.lit(" "))).otherwise(name).alias("partner_trace"),
        F.create_map(F.lit("vspTransId"), F.when(k % 11 == 0, name)).alias("partner_metadata"),
        F.col("amount").alias("partner_amount"),
        F.lit("VND").alias("partner_currency"),
        _spelled(F.col("letter"), k).alias("partner_status"),
        F.col("at").alias("reconciliation_date"),
        F.when(k % 19 != 0, F.col("at")).alias("partner_trans_date"),
        F.lit("CANONICAL_UTC").alias("timestamp_basis"),
        F.concat(F.lit("F"), (k % 7).cast("string")).alias("source_file_id"),
    )


def internal_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    name = F.concat(F.lit("T"), k.cast("string"))
    rows = _orders(spark, sf_dir).where(k % 23 != 0)
    rows = rows.withColumn("copy", F.explode(F.when(k % 37 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))))
    shift = F.element_at(F.array(*map(F.lit, (0, 299, 300, 301, 0))), (k % 5 + 1).cast("int"))
    flipped = F.when(k % 31 == 0, F.when(F.col("letter") == "F", "O").otherwise("F")).otherwise(F.col("letter"))
    return rows.select(
        F.concat(F.lit("I"), k.cast("string"), F.col("copy")).alias("id"),
        F.col("segment").alias("partner"),
        F.when(k % 41 == 0, " ").when(k % 3 == 0, F.concat(F.lit(" "), name)).otherwise(name).alias("partner_txn_id"),
        F.when(k % 29 == 0, F.col("amount") + F.lit(5).cast("decimal(20,4)")).otherwise(F.col("amount")).cast("decimal(20,4)").alias("amount"),
        F.lit("VND").alias("currency"),
        F.when(k % 43 == 0, "PENDING").otherwise(_spelled(flipped, k)).alias("status"),
        F.timestamp_add("SECOND", shift.cast("bigint"), F.col("at")).alias("transaction_time"),
    )


def _case(letter: str) -> str:
    arms = " ".join(f"WHEN '{c}' THEN [{', '.join(repr(w) for w in words)}][k % 3 + 1]" for c, words in STATUS_TEXT.items())
    return f"CASE {letter} {arms} ELSE 'PENDING' END"


_STATUS = (
    "CASE WHEN lower(trim({0}, ' ')) IN ('success', 'thành công', 'matched') THEN 'SUCCESS' "
    "WHEN lower(trim({0}, ' ')) IN ('fail', 'failed', 'thất bại') THEN 'FAILED' "
    "WHEN lower(trim({0}, ' ')) IN ('reversed', 'hoàn tiền') THEN 'REVERSED' ELSE 'PENDING' END"
)
#: The relations as common table expressions; dates are local days seven hours ahead of UTC.
RELATIONS = f"""
o AS (SELECT o_orderkey AS k, c_mktsegment AS segment, CAST(o_totalprice AS DECIMAL(20,4)) AS amount, o_orderstatus AS letter, CAST(o_orderdate AS TIMESTAMP) AS tm
  FROM orders JOIN customer ON o_custkey = c_custkey),
partner_transaction AS (
  SELECT 'P' || k || copy AS id, segment AS identify, CASE WHEN k % 22 = 1 THEN '' ELSE 'T' || k END AS partner_id,
    CASE WHEN k % 11 = 0 THEN NULL WHEN k % 11 = 1 THEN '   ' WHEN k % 11 = 2 THEN '  T' || k || ' ' ELSE 'T' || k END AS partner_trace,
    CASE WHEN k % 11 = 0 THEN 'T' || k END AS vsp, amount AS partner_amount, {_case('letter')} AS partner_status,
    tm AS reconciliation_date, CASE WHEN k % 19 <> 0 THEN tm END AS partner_trans_date, 'F' || (k % 7) AS source_file_id
  FROM (SELECT *, unnest(CASE WHEN k % 17 = 0 THEN ['a', 'b'] ELSE ['a'] END) AS copy FROM o)),
internal_transaction AS (
  SELECT 'I' || k || copy AS id, segment AS partner, CASE WHEN k % 41 = 0 THEN ' ' WHEN k % 3 = 0 THEN ' T' || k ELSE 'T' || k END AS partner_txn_id,
    CAST(CASE WHEN k % 29 = 0 THEN amount + 5 ELSE amount END AS DECIMAL(20,4)) AS amount,
    CASE WHEN k % 43 = 0 THEN 'PENDING' ELSE {_case("(CASE WHEN k % 31 = 0 THEN CASE WHEN letter = 'F' THEN 'O' ELSE 'F' END ELSE letter END)")} END AS status,
    tm + to_seconds(CAST([0, 299, 300, 301, 0][k % 5 + 1] AS BIGINT)) AS transaction_time
  FROM (SELECT *, unnest(CASE WHEN k % 37 = 0 THEN ['a', 'b'] ELSE ['a'] END) AS copy FROM o WHERE k % 23 <> 0)),
p AS (SELECT identify AS partner, CAST(reconciliation_date + INTERVAL 7 HOUR AS DATE) AS date,
    coalesce(nullif(trim(partner_trace, ' '), ''), nullif(trim(vsp, ' '), ''), nullif(trim(partner_id, ' '), '')) AS key,
    id, partner_amount AS amount, {_STATUS.format('partner_status')} AS status, partner_trans_date AS tm, source_file_id AS file FROM partner_transaction),
i_all AS (SELECT partner, CAST(transaction_time + INTERVAL 7 HOUR AS DATE) AS date, nullif(trim(partner_txn_id, ' '), '') AS key,
    id, amount, {_STATUS.format('status')} AS status, transaction_time AS tm FROM internal_transaction)"""


def results_sql(file: str | None = None, scope: str = "FULL_SNAPSHOT") -> str:
    """Common table expressions that end with ``results``: the outcome of every key and keyless row."""
    own = f"WHERE file = '{file}'" if file else ""
    semi = " AND (partner, date, key) IN (SELECT partner, date, key FROM pf WHERE key IS NOT NULL)" if file and scope != "FULL_SNAPSHOT" else ""
    lineage = f"'{file}'" if file else "NULL"
    return f"""{RELATIONS},
pf AS (SELECT * FROM p {own}),
i AS (SELECT * FROM i_all WHERE status <> 'PENDING'{semi}),
pg AS (SELECT partner, date, key, count(*) AS n, list_sort(list(id)) AS ids, min(id) AS id, min(amount) AS amount, min(status) AS status, min(tm) AS tm, min(file) AS file FROM pf WHERE key IS NOT NULL GROUP BY ALL),
ig AS (SELECT partner, date, key, count(*) AS n, list_sort(list(id)) AS ids, min(id) AS id, min(amount) AS amount, min(status) AS status, min(tm) AS tm FROM i WHERE key IS NOT NULL GROUP BY ALL),
j AS (SELECT coalesce(pg.partner, ig.partner) AS partner, coalesce(pg.date, ig.date) AS date, coalesce(pg.key, ig.key) AS reconciliation_key,
    coalesce(pg.n, 0) > 1 OR coalesce(ig.n, 0) > 1 AS ambiguous, pg.n AS pn, ig.n AS inn, pg.ids AS pids, ig.ids AS iids, pg.id AS pid, ig.id AS iid,
    pg.amount AS pa, ig.amount AS ia, pg.status AS ps, ig.status AS ist, pg.tm AS pat, ig.tm AS iat, pg.file AS file
  FROM pg FULL OUTER JOIN ig ON pg.partner = ig.partner AND pg.date = ig.date AND pg.key = ig.key),
results AS (
  SELECT partner, date, reconciliation_key, CASE WHEN NOT ambiguous THEN pa END AS partner_amount, CASE WHEN NOT ambiguous THEN ia END AS internal_amount,
    CASE WHEN NOT ambiguous THEN ps END AS partner_status, CASE WHEN NOT ambiguous THEN ist END AS internal_status,
    CASE WHEN ambiguous THEN 'AMBIGUOUS_KEY' WHEN inn IS NULL THEN 'MISSING_INTERNAL' WHEN pn IS NULL THEN 'MISSING_PARTNER'
      WHEN pa = ia AND ps = ist THEN CASE ps WHEN 'FAILED' THEN 'MATCHED_FAILED' WHEN 'REVERSED' THEN 'MATCHED_REVERSED' ELSE 'MATCHED' END
      WHEN pa <> ia AND ps <> ist THEN 'MULTIPLE_MISMATCH' WHEN pa <> ia THEN 'AMOUNT_MISMATCH' ELSE 'STATUS_MISMATCH' END AS reconciliation_status,
    CASE WHEN NOT ambiguous THEN pid END AS partner_record_id, CASE WHEN NOT ambiguous THEN iid END AS internal_record_id,
    CASE WHEN NOT ambiguous THEN pat END AS partner_trans_date, CASE WHEN NOT ambiguous THEN iat END AS internal_transaction_time,
    CASE WHEN ambiguous OR pn IS NULL OR inn IS NULL THEN 'NOT_EVALUATED' WHEN pat IS NULL OR iat IS NULL THEN 'NOT_AVAILABLE'
      WHEN abs(epoch_us(pat) - epoch_us(iat)) <= 300000000 THEN 'MATCHED' ELSE 'MISMATCH' END AS timestamp_status,
    CAST(CASE WHEN NOT ambiguous THEN CAST(epoch_us(pat) - epoch_us(iat) AS DECIMAL(26,0)) / 1000000 END AS DECIMAL(20,6)) AS timestamp_delta_seconds,
    coalesce(CASE WHEN NOT ambiguous THEN file END, {lineage}) AS source_file_id,
    CASE WHEN ambiguous THEN coalesce(array_to_string(pids, ','), '') END AS partner_ids, CASE WHEN ambiguous THEN coalesce(array_to_string(iids, ','), '') END AS internal_ids
  FROM j
  UNION ALL SELECT partner, date, NULL, NULL, NULL, NULL, NULL, 'UNMAPPED_SKIPPED', NULL, NULL, NULL, NULL, 'NOT_EVALUATED', NULL, {lineage}, id, '' FROM pf WHERE key IS NULL
  UNION ALL SELECT partner, date, NULL, NULL, NULL, NULL, NULL, 'UNMAPPED_SKIPPED', NULL, NULL, NULL, NULL, 'NOT_EVALUATED', NULL, {lineage}, '', id FROM i WHERE key IS NULL)"""
