"""Statistics, groups, anomalies, samples and pages over reconciliation results."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import keys
from ..session import shared_path, ship
from .match import MATCHED

DIFFERING = ("AMOUNT_MISMATCH", "STATUS_MISMATCH", "MULTIPLE_MISMATCH")
#: Lower bound (included), upper bound and name of the amount bands; negatives count with the last.
BANDS = ((0, 100_000, "0-100k"), (100_000, 1_000_000, "100k-1M"), (1_000_000, None, "1M+"))
SUM = "decimal(38,4)"


def difference() -> Column:
    return F.abs(F.col("partner_amount") - F.col("internal_amount"))


def status_is(*statuses: str) -> Column:
    return F.col("reconciliation_status").isin(*statuses)


def counts(results: DataFrame, column: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    return results.groupBy(*by, column).agg(F.count("*").alias("n"))


def totals(results: DataFrame, by: list[str]) -> DataFrame:
    zero = F.lit(0).cast(SUM)
    return results.groupBy(*by).agg(
        F.coalesce(F.sum("partner_amount").cast(SUM), zero).alias("partner_total"),
        F.coalesce(F.sum("internal_amount").cast(SUM), zero).alias("internal_total"),
    )


def mismatch_amount() -> Column:
    return F.coalesce(F.sum(F.when(status_is(*DIFFERING), difference())).cast(SUM), F.lit(0).cast(SUM))


def summary(results: DataFrame, by: list[str]) -> DataFrame:
    """total, matched, mismatch_rate (percent), mismatch_total of each group, in one pass."""
    out = results.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(status_is(*MATCHED)).alias("matched"), mismatch_amount().alias("mismatch_total"))
    return out.withColumn("mismatch_rate", keys.percent(F.col("total") - F.col("matched"), F.col("total")))


def average_mismatch(results: DataFrame, by: list[str]) -> DataFrame:
    """The mean difference; rows without both amounts count in the denominator."""
    out = results.groupBy(*by).agg(mismatch_amount().alias("s"), F.count_if(status_is(*DIFFERING)).alias("n"))
    mean = F.when(F.col("n") > 0, F.round(F.col("s") / F.col("n").cast("decimal(20,0)"), 2))
    return out.select(*by, "n", mean.cast("decimal(24,2)").alias("avg_mismatch"))


def group_amount() -> Column:
    """The partner's amount unless it is null or zero, else the internal one."""
    return F.coalesce(F.when(F.col("partner_amount") != 0, F.col("partner_amount")), F.col("internal_amount"))


def groups(results: DataFrame, key: Column, name: str) -> DataFrame:
    """name, n, share (percent of all), total, and least, greatest and mean difference of amount and combined mismatches."""
    gap = F.when(status_is("AMOUNT_MISMATCH", "MULTIPLE_MISMATCH"), difference())
    out = results.groupBy(key.alias(name)).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(group_amount()).cast(SUM), F.lit(0).cast(SUM)).alias("total"),
        F.min(gap).cast("decimal(24,4)").alias("least_gap"),
        F.max(gap).cast("decimal(24,4)").alias("greatest_gap"),
        F.round(F.sum(gap).cast("decimal(30,4)") / F.count(gap).cast("decimal(20,0)"), 2).cast("decimal(24,2)").alias("mean_gap"),
    )
    return out.withColumn("share", keys.percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


def band(amount: Column) -> Column:
    out = F.lit(BANDS[-1][2])
    for low, high, name in reversed(BANDS[:-1]):
        out = F.when((amount >= low) & (amount < high), name).otherwise(out)
    return F.when(amount.isNotNull(), out)


def severity_of_rate(rate: Column) -> Column:
    return F.when(rate > 20, "critical").when(rate > 10, "high").when(rate > 5, "medium").when(rate > 0, "low")


def severity_of_count(n: Column) -> Column:
    return F.when(n > 10, "high").when(n > 5, "medium").otherwise("low")


def anomalies(results: DataFrame, by: list[str]) -> DataFrame:
    """by, kind, n, amount_range, severity: missing sides, high rates and clusters of mismatches."""
    clustered = F.when(status_is("AMOUNT_MISMATCH", "MULTIPLE_MISMATCH"), difference())
    wide = results.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(status_is(*MATCHED)).alias("matched"),
        F.count_if(status_is("MISSING_INTERNAL")).alias("missing_internal"),
        F.count_if(status_is("MISSING_PARTNER")).alias("missing_partner"),
        F.count_if(status_is("AMOUNT_MISMATCH", "MULTIPLE_MISMATCH")).alias("amount_mismatch_cluster"),
        F.count_if(status_is("STATUS_MISMATCH")).alias("status_mismatch_cluster"),
        (F.sum(clustered) / F.count(clustered).cast("decimal(20,0)")).alias("gap"),
    )
    rate = keys.percent(F.col("total") - F.col("matched"), F.col("total"))
    high = F.when(rate > 5, F.floor(F.col("total") * rate / 100)).otherwise(0).cast("long")
    kinds = [(k, F.col(k)) for k in ("missing_internal", "missing_partner", "amount_mismatch_cluster", "status_mismatch_cluster")]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), n.alias("n")) for k, n in [*kinds, ("high_mismatch_rate", high)]])
    long = wide.select(*by, "gap", F.explode(rows).alias("a")).select(*by, "gap", "a.kind", "a.n").where("n > 0")
    range_ = F.when(F.col("kind") == "amount_mismatch_cluster", F.coalesce(band(F.col("gap")), F.lit("N/A"))).otherwise("N/A")
    return long.select(*by, "kind", "n", range_.alias("amount_range"), severity_of_count(F.col("n")).alias("severity"))


def samples(results: DataFrame, by: list[str], statuses: list[str], each: int) -> DataFrame:
    """The first ``each`` rows of each status in the order of ``statuses``, then of key and record ids."""
    order = [F.col(c).asc_nulls_last() for c in ("reconciliation_key", "partner_record_id", "internal_record_id")]
    place = F.row_number().over(Window.partitionBy(*by, "reconciliation_status").orderBy(*order))
    rank = F.array_position(F.array(*map(F.lit, statuses)), F.col("reconciliation_status"))
    return results.where(status_is(*statuses)).withColumn("place", place).where(F.col("place") <= each).withColumn("status_order", rank.cast("int"))


def latest(rows: DataFrame, by: list[str], at: str, ident: str) -> DataFrame:
    """The newest row of each group, ties to the largest id, by partial maxima."""
    fields = [c for c in rows.columns if c not in by]
    one = rows.groupBy(*by).agg(F.max_by(F.struct(*fields), F.struct(at, ident)).alias("_r"))
    return one.select(*[c if c in by else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def page(rows: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    return rows.orderBy(*[F.col(c).asc_nulls_last() for c in order]).offset(offset).limit(size)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, from 1 in the order of columns (nulls last), without a window over all rows: sorted parts are stored, and counted one by one."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "placed")
    parts = rows.orderBy(*[F.asc_nulls_last(c) for c in order]).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    parts.write.parquet(path)
    back = spark.read.schema(parts.schema).parquet(path)
    counts = back.groupBy(F.col("_part").alias("_of")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy().orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    sums = counts.select("_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)  # how the ids of a part begin
    return back.join(F.broadcast(sums), F.col("_part") == F.col("_of")).select(*rows.columns, (F.col("_before") + inside + 1).alias("place"))


def ordered(rows: DataFrame, order: list[str], **wanted) -> DataFrame:
    """The full list of rows that have the ``wanted`` values, in order, nulls last: a range sort over all tasks."""
    for name, want in wanted.items():
        rows = rows if want is None else rows.where(F.col(name) == want)
    return rows.orderBy(*[F.col(c).asc_nulls_last() for c in order])


def page_after(rows: DataFrame, at: str, ident: str, after: tuple, size: int) -> DataFrame:
    """The page after (at, ident), with one row more if there are more."""
    t, i = (F.lit(x) for x in after)
    beyond = (F.col(at) > t) | ((F.col(at) == t) & (F.col(ident) > i))
    return rows.where(beyond).orderBy(at, ident).limit(size + 1)


#: Bytes of outcomes that are joined to one row before a group is hashed.
CHUNK_BYTES = 1 << 14


def _joined(by: list[str]):
    """Sorted outcomes of each group and their counts, joined to chunks in rows of by, first, part, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first, part, held, size = None, None, 0, [], 0
        for batch in batches:
            types, out = [batch.schema.field(c).type for c in by], []
            for *key, each, n in zip(*[c.to_pylist() for c in batch.columns]):
                while n:
                    if held and (key != group or size >= CHUNK_BYTES):
                        out.append((*group, first, part, ",".join(held)))
                        held, size, part = [], 0, part + 1
                    if not held:
                        group, first = key, each
                    some = min(n, max(1, (CHUNK_BYTES - size) // (len(each) + 1)))
                    held += [each] * some
                    size, n = size + some * (len(each) + 1), n - some
            yield rows(out, types)
        if held:
            yield rows([(*group, first, part, ",".join(held))], types)

    def rows(out: list[tuple], types: list) -> pa.RecordBatch:
        kinds = [*types, pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[*by, "first", "part", "text"])

    return run


def _digests(by: list[str]):
    """The MD5 of each group's sorted chunks, of which one is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            types, out = [batch.schema.field(c).type for c in by], []
            for *key, _, _, text in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or key != group:
                    if state is not None:
                        out.append((*group, state.hexdigest()))
                    group, state = key, hashlib.md5(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield rows(out, types)
        if state is not None:
            yield rows([(*group, state.hexdigest())], types)

    def rows(out: list[tuple], types: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([*types, pa.string()])], names=[*by, "fingerprint"])

    return run


def results_fingerprint(results: DataFrame, by: list[str]) -> DataFrame:
    """An MD5 of the sorted outcomes of each group of any size.

    Outcomes are counted, sorted by ranges and joined to chunks in many tasks; an MD5 has to be
    taken in order, so one task reads a group's chunks, and holds a batch of them.
    """
    ship(results.sparkSession)
    each = F.concat_ws(":", F.coalesce("reconciliation_key", F.lit("")), "reconciliation_status")
    counted = results.groupBy(*by, each.alias("each")).agg(F.count("*").alias("n"))
    kinds = [counted.schema[c] for c in by]
    chunks = T.StructType([*kinds, T.StructField("first", T.StringType()), T.StructField("part", T.LongType()), T.StructField("text", T.StringType())])
    ranged = counted.repartitionByRange(*by, "each").sortWithinPartitions(*by, "each").mapInArrow(_joined(by), chunks)
    return ranged.repartition(*by).sortWithinPartitions(*by, "first", "part").mapInArrow(_digests(by), T.StructType([*kinds, T.StructField("fingerprint", T.StringType())]))


def in_period(rows: DataFrame, partner: str, at: str, first: Column, last: Column, most: int | None = None) -> DataFrame:
    """A partner's rows between two times, both included, in order of time and id, ``most`` at most."""
    own = rows.where((F.col("partner") == partner) & F.col(at).between(first, last)).orderBy(at, "id")
    return own if most is None else own.limit(max(most, 0))
