"""Classification of what an incoming file covers, from overlaps with known keys or from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def overlaps(incoming: DataFrame, historical: DataFrame, by: list[str], key: str) -> DataFrame:
    """by, incoming, historical, overlap, fresh: counts of distinct keys, by one full outer join."""
    a = incoming.select(*by, key).where(F.col(key).isNotNull()).distinct().withColumn("_in", F.lit(1))
    b = historical.select(*by, key).where(F.col(key).isNotNull()).distinct().withColumn("_old", F.lit(1))
    both = a.join(b, [*by, key], "full_outer")
    return both.groupBy(*by).agg(
        F.count("_in").alias("incoming"),
        F.count("_old").alias("historical"),
        F.count_if(F.col("_in").isNotNull() & F.col("_old").isNotNull()).alias("overlap"),
        F.count_if(F.col("_in").isNotNull() & F.col("_old").isNull()).alias("fresh"),
    )


def key_scope(counts: DataFrame, files: Column) -> DataFrame:
    """Adds scope and confidence to counts of keys; ``files`` counts earlier files."""
    inc, old, both, new = (F.col(c) for c in ("incoming", "historical", "overlap", "fresh"))
    share, cover, novel = both / F.nullif(inc, F.lit(0)), both / F.nullif(old, F.lit(0)), new / F.nullif(inc, F.lit(0))
    rules = [
        (inc == 0, "UNCONFIRMED", 0.2),
        ((old == 0) & (files == 0), "FULL_SNAPSHOT", 0.92),
        (old == 0, "UNCONFIRMED", 0.55),
        (both == 0, "INCREMENTAL_APPEND", 0.98),
        ((cover == 1) & (new > 0), "REPLACEMENT", 0.96),
        (share >= 0.8, "REPLACEMENT", 0.86),
        ((new > 0) & ((novel >= 0.5) | (share < 0.5)), "INCREMENTAL_APPEND", 0.9),
    ]
    scope, sure = F.lit("UNCONFIRMED"), F.lit(0.55)
    for condition, name, confidence in reversed(rules):
        scope, sure = F.when(condition, name).otherwise(scope), F.when(condition, confidence).otherwise(sure)
    return counts.withColumn("scope", scope).withColumn("confidence", sure.cast("decimal(4,2)"))


def file_scope(files: Column, internals: Column, default: str = "UNCONFIRMED") -> tuple[Column, Column]:
    """Scope and confidence from the number of earlier files and of internal rows alone."""
    later = 0.55 if default == "UNCONFIRMED" else 0.6
    scope = F.when(files == 0, "FULL_SNAPSHOT").when(internals == 0, "UNCONFIRMED").otherwise(default)
    return scope, F.when(files == 0, 0.82).when(internals == 0, 0.45).otherwise(later).cast("decimal(4,2)")


def count_scope(internals: Column, received: Column) -> tuple[Column, Column]:
    """Likeliest scope and its probability from the two counts."""
    larger, gap = F.greatest(internals, received), F.abs(internals - received)
    near = (gap <= F.greatest(F.lit(10), F.floor(larger * 0.05))) | (gap <= larger * 0.05)
    partial = received < internals * 0.8
    scope = F.when((received > 0) & (internals > 0) & ~near & partial, "INCREMENTAL_APPEND").otherwise("FULL_SNAPSHOT")
    sure = F.when(received <= 0, 0.34).when(internals <= 0, 0.9).when(near, 0.82).when(partial, 0.72).otherwise(0.62)
    return scope, sure.cast("decimal(4,2)")


#: Probabilities of FULL_SNAPSHOT, INCREMENTAL_APPEND and REPLACEMENT by what the two counts show.
PROBABILITIES = {"none": (0.34, 0.33, 0.33), "first": (0.9, 0.07, 0.03), "near": (0.82, 0.14, 0.04), "partial": (0.18, 0.72, 0.1), "other": (0.62, 0.28, 0.1)}


def count_probabilities(internals: Column, received: Column) -> Column:
    """A map from scope to its probability, from the two counts."""
    larger, gap = F.greatest(internals, received), F.abs(internals - received)
    near = (gap <= F.greatest(F.lit(10), F.floor(larger * 0.05))) | (gap <= larger * 0.05)
    shown = F.when(received <= 0, "none").when(internals <= 0, "first").when(near, "near").when(received < internals * 0.8, "partial").otherwise("other")
    known = F.create_map(*[x for name, row in PROBABILITIES.items() for x in (F.lit(name), F.array(*[F.lit(str(p)).cast("decimal(4,2)") for p in row]))])
    chosen = F.element_at(known, shown)
    return F.create_map(*[x for k, name in enumerate(("FULL_SNAPSHOT", "INCREMENTAL_APPEND", "REPLACEMENT")) for x in (F.lit(name), F.get(chosen, F.lit(k)))])


def overridden(scope: Column, internals: Column, received: Column) -> Column:
    """Whether an append suggestion is overruled because the gap of counts is small for their size."""
    larger, gap = F.greatest(internals, received, F.lit(1)), F.abs(internals - received)
    close = ((larger >= 10_000) & (gap <= larger * 0.05)) | ((larger >= 100_000) & (gap <= F.greatest(F.lit(10), F.floor(larger * 0.01))))
    return (scope == "INCREMENTAL_APPEND") & close
