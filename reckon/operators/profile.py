"""Data-quality profiles and exploratory aggregates."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import shared_path, ship

#: Texts that stand for a missing value.
NULL_WORDS = ("", "null", "none", "nan", "n/a", "na")


def is_missing(value: Column) -> Column:
    return value.isNull() | F.lower(F.trim(value.cast("string"))).isin(*NULL_WORDS)


#: Distinct values of a column that are counted exactly; beyond, only that there are more is told.
DISTINCT_LIMIT = 100_000
#: Kinds of texts as bits; what a column holds is the union of its values' bits.
INTEGER, DECIMAL, INSTANT, TEXT = 1, 2, 4, 8
#: Types from narrow to wide: a column of a type may hold values of those that it lists.
TYPES = {"integer": INTEGER, "decimal": INTEGER | DECIMAL, "instant": INSTANT, "text": INTEGER | DECIMAL | INSTANT | TEXT}


def kind(value: Column) -> Column:
    """The bit of a value's text: an integer, a decimal number, an instant (a date, with or without a time of day) or another text."""
    x = F.trim(value.cast("string"))
    day = x.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})?)?$") & x.try_cast("timestamp").isNotNull()
    return F.when(x.rlike(r"^[+-]?\d+$"), INTEGER).when(x.rlike(r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$"), DECIMAL).when(day, INSTANT).otherwise(TEXT)


def type_name(kinds: Column) -> Column:
    """The narrowest type that holds all kinds; null where there are none."""
    out = F.lit("text")
    for name in ("decimal", "integer", "instant"):
        out = F.when(kinds.bitwiseAND(~TYPES[name] & 15) == 0, name).otherwise(out)
    return F.when(kinds > 0, out)


def observed(rows: DataFrame, names: list[str], limit: int = DISTINCT_LIMIT) -> DataFrame:
    """name, total, missing, type, distinct_values, saturated of each column, in one pass over the rows.

    A task keeps the hashes of each column's values up to ``limit`` and sends them once; a column that exceeds it in
    one task sends nothing but that. Sets are put together in parts by hash. distinct_values is exact up to ``limit``
    (hashes have 64 bits) and null beyond, where saturated is true.
    """
    spark = rows.sparkSession
    ship(spark)
    each = [x for k, c in enumerate(names) for x in (F.when(~is_missing(F.col(c)), F.xxhash64(c)).alias(f"h{k}"), F.when(~is_missing(F.col(c)), kind(F.col(c))).cast("int").alias(f"k{k}"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, missing, kinds = 0, [0] * len(names), [0] * len(names)
        sets: list = [np.zeros(0, np.int64) for _ in names]
        for batch in batches:
            total += batch.num_rows
            for k in range(len(names)):
                hashes, bits = batch.column(2 * k).drop_null().to_numpy(), batch.column(2 * k + 1).drop_null().to_numpy()
                missing[k] += batch.num_rows - len(hashes)
                kinds[k] |= int(np.bitwise_or.reduce(bits)) if len(bits) else 0
                if sets[k] is not None:
                    sets[k] = np.union1d(sets[k], hashes)
                    sets[k] = sets[k] if len(sets[k]) <= limit else None
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(names)), pa.int32()), pa.array([total] * len(names), pa.int64()), pa.array(missing, pa.int64()), pa.array(kinds, pa.int32()), pa.array([None if x is None else x.tolist() for x in sets], pa.list_(pa.int64()))],
            names=["place", "total", "missing", "kinds", "hashes"],
        )

    path = shared_path(spark, "observed")
    fields = "place int, total long, missing long, kinds int, hashes array<long>"
    rows.select(*each).mapInArrow(run, fields).write.parquet(path)
    made = spark.read.schema(fields).parquet(path)
    counts = made.groupBy("place").agg(F.sum("total").alias("total"), F.sum("missing").alias("missing"), F.bit_or("kinds").alias("kinds"), F.max(F.col("hashes").isNull()).alias("over"))
    parts = made.select("place", F.explode("hashes").alias("h")).groupBy("place", F.pmod("h", F.lit(64)).alias("part")).agg(F.count_distinct("h").alias("n"))
    sums = parts.groupBy(F.col("place").alias("_place")).agg(F.sum("n").alias("n"))
    named = spark.createDataFrame(list(enumerate(names)), "_at int, name string")
    n = F.coalesce("n", F.lit(0).cast("long"))
    over = F.coalesce("over", F.lit(False)) | (n > limit)
    joined = named.join(counts, F.col("_at") == F.col("place"), "left").join(sums, F.col("place") == F.col("_place"), "left")  # a row a column
    zero = F.lit(0).cast("long")
    return joined.select("name", F.coalesce("total", zero).alias("total"), F.coalesce("missing", zero).alias("missing"), type_name(F.col("kinds")).alias("type"), F.when(~over, n).alias("distinct_values"), over.alias("saturated"))


def drift(found: DataFrame, expected: list[tuple[str, str, bool]]) -> DataFrame:
    """name, expected, type and drift of ``observed`` columns against (name, type, required): MISSING, OPTIONAL_MISSING, UNEXPECTED, TYPE, EMPTY or null.

    A column may hold a narrower type than expected.
    """
    spec = found.sparkSession.createDataFrame(expected, "_name string, expected string, required boolean")
    both = found.join(spec, F.col("name") == F.col("_name"), "full_outer")
    narrower = F.lit(False)
    for wide, bits in TYPES.items():
        narrower |= (F.col("expected") == wide) & F.col("type").isin(*[n for n, b in TYPES.items() if b | bits == bits])
    gone = F.col("name").isNull()
    what = F.when(gone & F.col("required"), "MISSING").when(gone, "OPTIONAL_MISSING").when(F.col("_name").isNull(), "UNEXPECTED").when(F.col("type").isNull(), F.when(F.col("required"), "EMPTY")).when(~narrower, "TYPE")
    return both.select(F.coalesce("name", "_name").alias("name"), "expected", "type", what.alias("drift"))


def columns(rows: DataFrame, names: list[str], limit: int = DISTINCT_LIMIT) -> DataFrame:
    """name, total, missing, distinct_values of each column; the last is null for columns of more than ``limit`` values."""
    return observed(rows, names, limit).select("name", "total", "missing", "distinct_values")


QUANTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "p99": 0.99}


#: Ranges of values in one histogram.
BUCKETS = 4096


def quantiles(points: DataFrame, by: list[str], value: str, n: str, at: list[float]) -> DataFrame:
    """by, q: exact interpolated quantiles of a double column of ``n`` rows a value, in the order of ``at``.

    A histogram over the range of values finds the bucket that holds each wanted rank, and the next one runs over
    the values of that bucket only, until it holds one value; no group meets in one task. Values that aren't finite
    have buckets of their own. The groups and wanted ranks are few and collected to the driver.
    """
    x, finite = F.col(value), ~F.isnan(value) & (F.abs(value) != float("inf"))
    # twice the halves, so that the width of the range can't overflow
    bounds = [F.min(F.when(finite, x / 2)).alias("lo"), F.max(F.when(finite, x / 2)).alias("hi")]
    points = points.select(*by, value, n).persist()  # read once a round
    totals = points.groupBy(*by).agg(F.sum(n).alias("n"), *bounds).collect()
    spark, kinds = points.sparkSession, [points.schema[c] for c in by]
    wanted, found = {}, {}
    for g, r in enumerate(totals):
        for p in at:
            for rank in (math.floor(p * (r["n"] - 1)), math.ceil(p * (r["n"] - 1))):
                wanted[g, rank] = ("all", r["lo"], r["hi"], 0)
    fields = T.StructType([T.StructField("_g", T.IntegerType()), *[T.StructField(f"_by_{k.name}", k.dataType) for k in kinds], *[T.StructField(c, T.DoubleType()) for c in ("_lo", "_hi")]])
    while wanted:
        ranges = {(g, lo, hi) for (g, _), (_, lo, hi, _) in wanted.items()}
        edges = spark.createDataFrame([(g, *[totals[g][c] for c in by], lo, hi) for g, lo, hi in ranges], fields)
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        inside = x.between(2 * F.col("_lo"), 2 * F.col("_hi"))
        whole = F.lit(not found and all(w[0] == "all" for w in wanted.values()))
        rows = points.join(F.broadcast(edges), same & (whole | (finite & inside)))
        place = F.floor(F.when(F.col("_hi") > F.col("_lo"), (x / 2 - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BUCKETS).otherwise(0))
        bucket = F.when(F.isnan(value), BUCKETS + 1).when(x == float("inf"), BUCKETS).when(x == float("-inf"), -1).otherwise(F.least(place, F.lit(BUCKETS - 1)))
        counts = rows.groupBy("_g", "_lo", "_hi", bucket.alias("b")).agg(F.sum(n).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"))
        order = Window.partitionBy("_g", "_lo", "_hi").orderBy("b")
        through = counts.withColumn("through", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        held: dict = {}
        for r in through.orderBy("through").collect():  # at most BUCKETS rows a range
            held.setdefault((r["_g"], r["_lo"], r["_hi"]), []).append(r)
        for (g, rank), (_, lo, hi, below) in list(wanted.items()):
            r = next(r for r in held[g, lo, hi] if below + r["through"] > rank)
            if r["least"] == r["most"] or math.isnan(r["least"]):
                found[g, rank] = r["least"]
                del wanted[g, rank]
            else:
                wanted[g, rank] = ("part", r["least"] / 2, r["most"] / 2, below + r["through"] - r["n"])
    points.unpersist()
    out = []
    for g, r in enumerate(totals):
        q = []
        for p in at:
            place = p * (r["n"] - 1)
            lo, hi = math.floor(place), math.ceil(place)
            a, b = found[g, lo], found[g, hi]
            q.append(a if lo == hi or a == b else (hi - place) * a + (place - lo) * b)
        out.append((*[r[c] for c in by], q))
    return spark.createDataFrame(out, T.StructType([*kinds, T.StructField("q", T.ArrayType(T.DoubleType()))]))


def amounts(rows: DataFrame, amount: str) -> DataFrame:
    """Quantiles (interpolated), the upper fence, and the values beyond it; exact quantiles by histograms of value counts."""
    points = rows.where(F.col(amount).isNotNull()).groupBy(amount).agg(F.count("*").alias("_n"))
    stats = points.agg(F.sum("_n").alias("n"), F.min(amount).alias("least"), F.max(amount).alias("greatest"))
    found = quantiles(points.select(F.col(amount).cast("double").alias("_x"), "_n"), [], "_x", "_n", list(QUANTILES.values()))
    stats = stats.join(F.broadcast(found), F.lit(True), "left")
    stats = stats.select("n", "least", "greatest", *[F.col("q")[k].alias(name) for k, name in enumerate(QUANTILES)])
    stats = stats.withColumn("fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    beyond = F.coalesce(F.sum(F.when(F.col(amount) > F.col("fence"), F.col("_n"))), F.lit(0))
    joined = points.crossJoin(F.broadcast(stats))  # one row of statistics
    first = [F.first(c).alias(c) for c in stats.columns]
    return joined.agg(*first, beyond.cast("long").alias("outliers"))


def medians(rows: DataFrame, by: str, column: str, values: list[str], amount: str) -> DataFrame:
    """by, and the exact median of each of ``values`` of a column; null where there is none."""
    points = rows.where(F.col(amount).isNotNull() & F.col(column).isin(values)).groupBy(by, column, F.col(amount).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    found = quantiles(points, [by, column], "_x", "_n", [0.5])
    every = rows.select(by).distinct().join(F.broadcast(found.withColumnRenamed(by, "_by")), F.col(by).eqNullSafe(F.col("_by")), "left")
    return every.groupBy(by).agg(*[F.max(F.when(F.col(column) == v, F.col("q")[0])).alias(v) for v in values])


def outliers_by_group(rows: DataFrame, by: str, amount: str) -> DataFrame:
    """by, q1, q3, outliers: values beyond 1.5 interquartile ranges of their own group, on either side; quartiles by histograms."""
    x = F.col(amount).cast("double")
    points = rows.where(F.col(amount).isNotNull()).groupBy(by, x.alias("_x")).agg(F.count("*").alias("_n"))
    found = quantiles(points, [by], "_x", "_n", [0.25, 0.75]).select(F.col(by).alias("_by"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    outside = (F.col("_x") < F.col("q1") - reach) | (F.col("_x") > F.col("q3") + reach)
    joined = points.join(found, F.col(by).eqNullSafe(F.col("_by")))
    return joined.groupBy(by).agg(F.first("q1").alias("q1"), F.first("q3").alias("q3"), F.coalesce(F.sum(F.when(outside, F.col("_n"))), F.lit(0)).alias("outliers"))


def daily(rows: DataFrame, at: str) -> DataFrame:
    """first, last, days, and the least, median and greatest number of rows a day."""
    each = rows.where(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    return each.agg(
        F.min("lo").alias("first_at"), F.max("hi").alias("last_at"), F.count("*").alias("days"),
        F.min("n").alias("least_rows"), F.expr("percentile(n, 0.5)").alias("median_rows"), F.max("n").alias("most_rows"),
    )


def described(rows: DataFrame, amount: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of a column."""
    points = rows.where(F.col(amount).isNotNull()).groupBy(F.col(amount).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    whole = rows.agg(F.count(amount).alias("count"), F.avg(amount).alias("mean"), F.stddev(amount).alias("std"), F.min(amount).alias("min"), F.max(amount).alias("max"))
    found = quantiles(points, [], "_x", "_n", [0.25, 0.5, 0.75])
    wide = whole.join(F.broadcast(found), F.lit(True), "left")  # a row each
    return wide.select("count", "mean", "std", "min", *[F.col("q")[k].alias(n) for k, n in enumerate(("q1", "median", "q3"))], "max")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Each value, nulls included, with its rows and their share, the most frequent first."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    whole = rows.agg(F.count("*").alias("_all"))  # a row
    return counted.join(F.broadcast(whole), F.lit(True)).select(column, "n", (F.col("n") / F.col("_all")).alias("share")).orderBy(F.desc("n"), column)


def histogram(rows: DataFrame, amount: str, bins: int) -> DataFrame:
    """bin, lower, n of equal ranges between the least and the greatest value, the last one closed."""
    x = F.col(amount).cast("double")
    bounds = rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    placed = rows.where(x.isNotNull()).select(x.alias("x")).join(F.broadcast(bounds), F.lit(True))  # a row of bounds
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return placed.groupBy(bin_.cast("int").alias("bin")).agg(F.first(F.col("lo") + bin_ * (F.col("hi") - F.col("lo")) / bins).alias("lower"), F.count("*").alias("n"))


def samples(rows: DataFrame, column: str, order: str, most: int = 5) -> DataFrame:
    """missing, rate, and the ``most`` first distinct values of a column in order."""
    whole = rows.agg(F.count("*").alias("n"), F.count_if(is_missing(F.col(column))).alias("missing"))
    first = rows.where(~is_missing(F.col(column))).groupBy(column).agg(F.min(order).alias("_at")).orderBy("_at").limit(most)
    shown = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(column).cast("string").alias("v")))), lambda s: s["v"]).alias("samples"))
    return whole.join(F.broadcast(shown), F.lit(True)).select("n", "missing", (F.col("missing") / F.col("n")).alias("rate"), "samples")


def instants(rows: DataFrame, text: str) -> DataFrame:
    """n, sub_second, zone_missing of timestamps as texts."""
    x = F.trim(text)
    return rows.where(~is_missing(F.col(text))).agg(F.count("*").alias("n"), F.count_if(x.rlike(r"\d{2}:\d{2}:\d{2}\.\d*[1-9]")).alias("sub_second"), F.count_if(~x.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$")).alias("zone_missing"))


def quality_score(rows: DataFrame, rejected: Column) -> DataFrame:
    """n, rejected, and 100 times the share of rows that are not."""
    counts = rows.agg(F.count("*").alias("n"), F.count_if(rejected).alias("rejected"))
    return counts.withColumn("score", F.try_divide(100.0 * (F.col("n") - F.col("rejected")), F.col("n")))


def crosstab_with_margins(rows: DataFrame, row: str, column: str, values: list[str], margin: str = "All") -> DataFrame:
    """``crosstab`` as texts with a last row of totals."""
    counted = rows.rollup(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count("*").alias("total"), F.grouping_id().alias("_g"))
    return counted.withColumn(row, F.when(F.col("_g") == 1, margin).otherwise(F.col(row))).drop("_g")


def crosstab(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    counted = rows.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count("*").alias("total"))
    return counted


def inconsistent(rows: DataFrame, entity: str, attribute: str) -> DataFrame:
    """Entities with more than one value of an attribute."""
    return rows.groupBy(entity).agg(F.count_distinct(attribute).alias("n")).where("n > 1")


def rule_results(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, broken, rate, decision of named conditions that rows must meet."""
    one = rows.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(r) for r, c in rules.items()])
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("broken")) for r in rules])
    out = one.select("n", F.explode(each).alias("r")).select("r.rule", "n", "r.broken")
    return out.withColumn("decision", F.when(F.col("broken") == 0, "PASS").otherwise("REVIEW"))


def report(parts: dict[str, DataFrame]) -> tuple[str, str]:
    """The aggregates of a profile as JSON and as Markdown tables; each part has a few rows by nature."""
    found = {name: [r.asDict() for r in rows.collect()] for name, rows in parts.items()}
    lines = []
    for name, rows in found.items():
        lines += [f"## {name}", ""]
        if rows:
            heads = list(rows[0])
            lines += [f"| {' | '.join(heads)} |", f"|{'-|' * len(heads)}", *(f"| {' | '.join(str(r[h]) for h in heads)} |" for r in rows), ""]
    return json.dumps(found, default=str, ensure_ascii=False, indent=1), "\n".join(lines)
