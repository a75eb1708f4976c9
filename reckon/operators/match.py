"""Reconciliation of partner with internal transactions, over any number of partner days in one plan.

Each side is scanned once and aggregated to a row for each (partner, date, key);
one full outer join on those keys, which keeps the aggregations' partitioning,
gives every outcome. Keys with several rows on a side give one ambiguous row; rows
without a key go through the same pass, spread by their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keys, times

SCOPES = ("FULL_SNAPSHOT", "INCREMENTAL_APPEND", "REPLACEMENT", "UNCONFIRMED")
MATCHED = ("MATCHED", "MATCHED_FAILED", "MATCHED_REVERSED")
TOLERANCE_SECONDS = 300
KEYS = ["partner", "date", "key"]


def partner_side(partner: DataFrame, zone: str = times.BUSINESS_ZONE) -> DataFrame:
    """partner, date, key, id, amount, status, at, basis, file of partner transactions."""
    return partner.select(
        F.col("identify").alias("partner"),
        times.business_date(F.col("reconciliation_date"), zone).alias("date"),
        keys.partner_key(F.col("partner_trace"), F.col("partner_metadata")["vspTransId"], F.col("partner_id")).alias("key"),
        "id",
        F.col("partner_amount").cast(keys.MONEY).alias("amount"),
        keys.status(F.col("partner_status")).alias("status"),
        F.col("partner_trans_date").alias("at"),
        F.col("timestamp_basis").alias("basis"),
        F.col("source_file_id").alias("file"),
    )


def internal_side(internal: DataFrame, zone: str = times.BUSINESS_ZONE) -> DataFrame:
    """The same columns of internal transactions, with those still pending."""
    return internal.select(
        "partner",
        times.business_date(F.col("transaction_time"), zone).alias("date"),
        keys.filled(F.col("partner_txn_id")).alias("key"),
        "id",
        F.col("amount").cast(keys.MONEY).alias("amount"),
        keys.status(F.col("status")).alias("status"),
        F.col("transaction_time").alias("at"),
    )


def excluded_internal(internal: DataFrame) -> DataFrame:
    """Pending internal rows by partner and day: they take no part in matching."""
    return internal_side(internal).where("status = 'PENDING'").groupBy("partner", "date").agg(F.count("*").alias("excluded"))


def _grouped(side: DataFrame, name: str) -> DataFrame:
    """A row for each key of a side, with its number of rows, their ids and the least row.

    Rows without a key have slots of their own, named by their ids: nothing of the other side
    matches them, and they spread over all tasks.
    """
    slot = F.when(F.col("key").isNull(), F.concat(F.lit(f"{name}:"), F.coalesce("id", F.lit("")))).otherwise("")
    one = F.min(F.struct("id", *[c for c in side.columns if c not in (*KEYS, "id")]))
    keyed = side.withColumns({"_slot": slot, "_key": F.coalesce("key", F.lit(""))})
    return keyed.groupBy("partner", "date", "_key", "_slot").agg(
        F.count("*").alias(f"{name}_n"), F.array_sort(F.collect_list("id")).alias(f"{name}_ids"), one.alias(name)
    )


def partner_groups(partner: DataFrame) -> DataFrame:
    """partner, date, key, n, record_ids (in order) and basis (the least of the key's rows) of every keyed partner row."""
    keyed = partner_side(partner).where("key IS NOT NULL")
    return keyed.groupBy(*KEYS).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("record_ids"), F.min("basis").alias("basis"))


def _outcome() -> Column:
    same_amount = F.col("p.amount") == F.col("i.amount")
    same_status = F.col("p.status") == F.col("i.status")
    return (
        F.when(F.col("key").isNull(), "UNMAPPED_SKIPPED")
        .when((F.coalesce("p_n", F.lit(0)) > 1) | (F.coalesce("i_n", F.lit(0)) > 1), "AMBIGUOUS_KEY")
        .when(F.col("i_n").isNull(), "MISSING_INTERNAL")
        .when(F.col("p_n").isNull(), "MISSING_PARTNER")
        .when(same_amount & same_status & (F.col("p.status") == "FAILED"), "MATCHED_FAILED")
        .when(same_amount & same_status & (F.col("p.status") == "REVERSED"), "MATCHED_REVERSED")
        .when(same_amount & same_status, "MATCHED")
        .when(~same_amount & ~same_status, "MULTIPLE_MISMATCH")
        .when(~same_amount, "AMOUNT_MISMATCH")
        .otherwise("STATUS_MISMATCH")
    )


def reconcile(
    partner: DataFrame,
    internal: DataFrame,
    scope: str = "FULL_SNAPSHOT",
    source_file: str | None = None,
    tolerance: int = TOLERANCE_SECONDS,
    zone: str = times.BUSINESS_ZONE,
) -> DataFrame:
    """One row for each key of a partner day, and one for each row without a key.

    ``source_file`` restricts the partner side; unless the scope is a full
    snapshot it also restricts internal rows to that file's keys, by a left
    semi join in which null keys never match.
    """
    p, i = partner_side(partner, zone), internal_side(internal, zone).where("status <> 'PENDING'")
    if source_file is not None:
        p = p.where(F.col("file") == source_file)
        if scope != "FULL_SNAPSHOT":
            i = i.join(p.select(*KEYS).distinct(), KEYS, "left_semi")
    unmapped = F.col("key").isNull()
    copies = F.when(unmapped, F.sequence(F.lit(1), F.coalesce("p_n", "i_n").cast("int"))).otherwise(F.array(F.lit(1)))  # of one id
    both = _grouped(p, "p").join(_grouped(i, "i"), ["partner", "date", "_key", "_slot"], "full_outer").withColumn("key", F.nullif(F.col("_key"), F.lit("")))
    both = both.withColumn("reconciliation_status", _outcome()).withColumn("_copy", F.explode(copies))
    clear = ~F.col("reconciliation_status").isin("AMBIGUOUS_KEY", "UNMAPPED_SKIPPED")

    def of(side: str, field: str) -> Column:
        return F.when(clear, F.col(f"{side}.{field}"))

    delta = times.seconds_between(of("p", "at"), of("i", "at"))
    evidence = (
        F.when(of("p", "id").isNull() | of("i", "id").isNull(), "NOT_EVALUATED")
        .when(F.col("p.at").isNull() | F.col("i.at").isNull(), "NOT_AVAILABLE")
        .when(F.abs(delta) <= tolerance, "MATCHED")
        .otherwise("MISMATCH")
    )
    def ids(side: str) -> Column:
        """Ids of an ambiguous key, the one id of a row without a key, none of a side without rows; null where the key is clear."""
        none = F.array().cast("array<string>")
        own = F.when(F.col(f"{side}_n").isNull(), none).when(unmapped, F.array(F.col(f"{side}.id"))).otherwise(F.col(f"{side}_ids"))
        return F.when(~clear, own)

    return both.select(
        "partner",
        "date",
        F.col("key").alias("reconciliation_key"),
        of("p", "amount").alias("partner_amount"),
        of("i", "amount").alias("internal_amount"),
        of("p", "status").alias("partner_status"),
        of("i", "status").alias("internal_status"),
        "reconciliation_status",
        of("p", "id").alias("partner_record_id"),
        of("i", "id").alias("internal_record_id"),
        of("p", "at").alias("partner_trans_date"),
        of("i", "at").alias("internal_transaction_time"),
        evidence.alias("timestamp_status"),
        delta.alias("timestamp_delta_seconds"),
        F.coalesce(of("p", "file"), F.lit(source_file)).alias("source_file_id"),
        ids("p").alias("ambiguous_partner_record_ids"),
        ids("i").alias("ambiguous_internal_record_ids"),
    )


def one_day(side: DataFrame, column: str, day, zone: str = times.BUSINESS_ZONE) -> DataFrame:
    """The rows of one local day; the bounds are constants, so they reach the scan."""
    start, end = times.business_bounds(F.lit(day).cast("date"), zone)
    return side.where(F.col(column).between(start, end))


def surviving(existing: DataFrame, partner: DataFrame, scope: str, source_file: str | None, partner_name: str, day) -> DataFrame:
    """Existing results that a new run of this scope leaves in place; the run's rows replace the others."""
    same = (F.col("partner") == partner_name) & (F.col("date") == F.lit(day).cast("date"))
    if source_file is None:
        return existing.where(~same)
    of_file = F.coalesce(F.col("source_file_id") == source_file, F.lit(False))
    if scope not in ("INCREMENTAL_APPEND", "REPLACEMENT"):
        return existing.where(~(same & of_file))
    touched = partner_side(partner).where((F.col("partner") == partner_name) & (F.col("file") == source_file))
    touched = touched.where("key IS NOT NULL").select(F.col("key").alias("reconciliation_key")).distinct().withColumn("_hit", F.lit(True))
    marked = existing.join(touched, "reconciliation_key", "left")
    return marked.where(~(same & (of_file | F.col("_hit").isNotNull()))).select(*existing.columns)


def write_results(results: DataFrame, path: str, run: str | None = None) -> None:
    """Replaces the partner days that ``results`` holds and leaves others untouched; ``run`` is stored as run_id of every row.

    A folder holds a month of a partner, as days of few rows make files of few rows. Where there are results already, the
    new ones are staged once, and the other days of their months are written again with them.
    """
    spark, month = results.sparkSession, F.trunc("date", "month")
    rows = results.withColumns({"run_id": F.lit(run).cast("string"), "month": month})
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_staged")
    if system.exists(place):
        rows.write.mode("overwrite").parquet(f"{path}/_staged")
        rows = spark.read.schema(rows.schema).parquet(f"{path}/_staged")
        days = rows.select(F.col("partner").alias("_p"), F.col("month").alias("_m"), F.col("date").alias("_d")).distinct()
        same = F.col("partner").eqNullSafe(F.col("_p"))
        months = days.select("_p", "_m").distinct()
        there = spark.read.schema(rows.schema).parquet(path).join(months, same & F.col("month").eqNullSafe(F.col("_m")), "left_semi")
        rows = rows.unionByName(there.join(days, same & F.col("date").eqNullSafe(F.col("_d")), "left_anti").select(rows.columns))
    rows.hint("rebalance", "partner", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("partner", "month").parquet(path)
    system.delete(staged, True)
