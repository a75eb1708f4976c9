"""Keyed first-writer-wins insertion and the classification of duplicates by payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def first_of_batch(rows: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """The row of the lowest ordinal of each key; partial minima keep hot keys from meeting in one task."""
    fields = [c for c in rows.columns if c not in (*keys, ordinal)]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*fields), ordinal).alias("_row"), F.min(ordinal).alias(ordinal))
    return first.select(*[c if c in (*keys, ordinal) else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def insertable(rows: DataFrame, existing: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Rows to append: keys not there yet, the first of each in the batch."""
    return first_of_batch(rows.join(existing.select(*keys).distinct(), keys, "left_anti"), keys, ordinal)


def classified(rows: DataFrame, existing: DataFrame, keys: list[str], payload: str = "fingerprint", ordinal: str = "ordinal") -> DataFrame:
    """``rows`` with ``result``: INSERTED, EQUIVALENT or CONFLICTING against the persisted or first payload of the key."""
    held = existing.select(*keys, F.col(payload).alias("_held")).dropDuplicates(keys)
    first = rows.groupBy(*keys).agg(F.min(F.struct(F.col(ordinal), F.col(payload).alias("p"))).alias("_first"))
    wide = rows.join(first, keys).join(held, keys, "left")
    against = F.coalesce(F.col("_held"), F.col("_first.p"))
    inserted = F.col("_held").isNull() & (F.col(ordinal) == F.col(f"_first.{ordinal}"))
    result = F.when(inserted, "INSERTED").when(F.col(payload) == against, "EQUIVALENT").otherwise("CONFLICTING")
    return wide.withColumn("result", result).drop("_held", "_first")


def accounting(classes: DataFrame, by: list[str]) -> DataFrame:
    """input, inserted, equivalent, conflicting, and whether they balance."""
    out = classes.groupBy(*by).agg(
        F.count("*").alias("input"),
        *[F.count_if(F.col("result") == r.upper()).alias(r) for r in ("inserted", "equivalent", "conflicting")],
    )
    return out.withColumn("balanced", F.col("input") == F.col("inserted") + F.col("equivalent") + F.col("conflicting"))


def in_file_duplicates(rows: DataFrame, key: list[str], row_hash: str, ordinal: str) -> DataFrame:
    """exact, key_same, key_changed: copies of whole rows, and of keys with the first payload or another."""
    order = Window.partitionBy(*key).orderBy(ordinal)
    seen = Window.partitionBy(row_hash).orderBy(ordinal)
    marked = rows.withColumn("_n", F.row_number().over(seen)).withColumn("_k", F.row_number().over(order)).withColumn("_p", F.first(row_hash).over(order))
    return marked.agg(
        F.count_if(F.col("_n") > 1).alias("exact_duplicates"),
        F.count_if((F.col("_k") > 1) & (F.col("_p") == F.col(row_hash))).alias("key_same_payload"),
        F.count_if((F.col("_k") > 1) & (F.col("_p") != F.col(row_hash))).alias("key_other_payload"),
    )


def rebind(rows: DataFrame, keys: DataFrame, by: list[str], file: str) -> DataFrame:
    """``rows`` with source_file_id set to ``file`` for the keys given."""
    marked = rows.join(keys.select(*by).distinct().withColumn("_hit", F.lit(True)), by, "left")
    value = F.when(F.col("_hit"), F.lit(file)).otherwise(F.col("source_file_id"))
    return marked.withColumn("source_file_id", value).select(*rows.columns)
