"""Mixing sources to target weights with hash-threshold histograms.

Every document has a hash that does not depend on its source. A source takes
all its documents ``floor(target / size)`` times, and once more those whose
hash lies under the source's threshold. The threshold is found by summing
words by source and hash bucket, then by refining only the bucket that holds
the budget; documents are never sorted. Only DataFrame functions are used.

Defined results: a null text has size 0; null sources form one source, ordered
last; documents of equal id and text share a hash and are taken together; an
empty table gives an empty result; a source without words has target 0.
Columns of the input other than doc_id, text and source play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import checkpointed, stored, table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes.
SHARE = 1.5
#: No source is taken more than this many times.
REPEATS = 2
#: Hash bits resolved by each histogram, and the number of histograms.
BITS, LEVELS = 12, 5
#: Sources whose plan (a narrow row for each) is broadcast; more are joined by shuffles with so many salts.
SOURCES, SALTS = 100_000, 64


def sized(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id, source, size in words and a 60-bit hash of each document, with ``keep`` its row as doc."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ident = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(text)))
    nested = [F.struct(*docs.columns).alias("doc")] if keep else []  # where no other column can clash
    return docs.select(
        "doc_id",
        "source",
        *nested,
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.conv(F.substring(ident, 1, 15), 16, 10).cast("long").alias("h"),
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target: shares by weight, capped, the excess shared again until none is above.

    The result of the repeated sharing is the level L for which the capped
    shares ``min(L * weight, cap)`` fill the budget; sources are capped in the
    order of cap / weight, so one running sum over the sources finds L.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    rank = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    upto = rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    by = by.withColumns(
        {
            "budget": F.sum("source_size").over(everything).cast("double") * share,
            "capped": F.sum("cap").over(upto) - F.col("cap"),
            "open": F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight"),
        }
    )
    level = (F.col("budget") - F.col("capped")) / F.col("open")
    fits = F.when(F.col("cap") / F.col("weight") > level, level)
    by = by.withColumn("level", F.max(fits).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return by.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """source, copies, limit: documents with ``h < limit`` are taken ``copies + 1`` times, others ``copies``."""
    size = F.col("source_size")
    copies = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long")
    state = targets.select(
        "source",
        copies.alias("copies"),
        (F.col("target") - copies * size).alias("budget"),
        F.lit(0).cast("long").alias("limit"),
    )
    for level in range(1, levels + 1):
        shift = bits * (levels - level)
        bucket = F.shiftright("h", shift)
        last = level == levels
        rows = sizes.select(F.col("source").alias("s"), "size", "h", bucket.alias("bucket"))
        if level > 1:
            edge = state.select(F.col("source").alias("e"), F.col("limit").alias("edge"))
            rows = with_source(rows, "s", edge, "e").where(F.shiftright("h", shift + bits) == F.shiftright("edge", shift + bits))
        sums = rows.groupBy("s", "bucket").agg(F.sum("size").alias("in_bucket"))
        upto = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("through", F.sum("in_bucket").over(upto))
        within = F.col("through") <= F.col("budget")
        if last:  # a single hash value: take it if that brings the sum nearer to the budget
            within = F.col("through") - F.col("in_bucket") / 2 <= F.col("budget")
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        state = joined.groupBy("source", "copies", "budget", "limit").agg(
            F.coalesce(F.max(F.when(within, F.col("through"))), F.lit(0)).alias("used"),
            F.max(F.when(within, F.col("bucket"))).alias("whole"),
            F.min(F.when(~within, F.col("bucket"))).alias("broken"),
        )
        moved = F.when(F.col("broken").isNotNull(), F.shiftleft("broken", shift))
        moved = F.coalesce(moved, F.shiftleft(F.col("whole") + 1, shift), F.col("limit"))
        state = state.select("source", "copies", (F.col("budget") - F.col("used")).alias("budget"), moved.alias("limit"))
        state = checkpointed(state)  # a row for each source
    return state.select("source", "copies", "limit")


def with_source(rows: DataFrame, source: str, plan: DataFrame, plan_source: str) -> DataFrame:
    """``rows`` joined to their source's row of ``plan``, which is broadcast up to ``SOURCES`` rows and else salted by the rows' hash ``h``."""
    if plan.limit(SOURCES + 1).count() <= SOURCES:
        return rows.join(F.broadcast(plan), F.col(source).eqNullSafe(F.col(plan_source)))
    left = rows.withColumn("_salt", F.pmod("h", F.lit(SALTS)).cast("int"))
    right = plan.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, F.col(source).eqNullSafe(F.col(plan_source)) & (F.col("_salt") == F.col("_of"))).drop("_salt", "_of")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, keep: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every document; with ``keep`` after all columns of ``docs``.

    With ``keep``, columns of ``docs`` named like the added ones are replaced.
    """
    added = ("size", "h", "source_size", "target", "taken")
    sizes = stored(sized(docs), "sizes")
    targets = stored(source_targets(sizes, weights, share, repeats), "targets")
    limits = stored(thresholds(sizes, targets), "limits")
    plan = targets.join(limits.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.withColumnRenamed("source", "plan_source")
    taken = F.col("size") * (F.col("copies") + (F.col("h") < F.col("limit")).cast("long"))
    rows = sizes if not keep else sized(docs, True)
    joined = with_source(rows, "source", plan, "plan_source")
    own = [F.col(f"doc.{c}").alias(c) for c in docs.columns if c not in added] if keep else [F.col("doc_id"), F.col("source")]
    return joined.select(*own, "size", "source_size", "target", taken.alias("taken"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = {
    "op6_source_mixing": """
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sources),
ranked AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
         sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING) - cap AS capped,
         sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING) + weight AS open
  FROM weighed),
leveled AS (
  SELECT *, max(CASE WHEN cap / weight > (budget - capped) / open THEN (budget - capped) / open END) OVER () AS level FROM ranked),
targets AS (
  SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM leveled),
placed AS (
  SELECT s.doc_id, s.size, s.h, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS copies,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE UNBOUNDED PRECEDING) AS through,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS tied
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * (copies + CASE WHEN through - tied / 2.0 <= target - copies * source_size THEN 1 ELSE 0 END) AS taken
FROM placed"""
}
