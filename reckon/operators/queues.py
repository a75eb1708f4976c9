"""Review packets, runs, claims and feeds; column roles; guardrails over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Header words of each role, and what its values look like.
ROLE_HEADERS = {
    "id": ("id", "transid", "transaction", "mstransid"),
    "trace": ("trace", "partner", "invoice", "mahdon", "mshdon", "mstransid"),
    "amount": ("amount", "total", "mstotalamount"),
    "transDate": ("date", "time", "ngay", "hoanthanh"),
    "status": ("status", "trangthai"),
}
ROLE_VALUES = {
    "id": r"(?i)txn|trans|trace|id",
    "trace": r"(?i)txn|trans|trace|id",
    "amount": r"^-?\d[\d,]*(\.\d+)?$",
    "transDate": r"^(\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4})( \d{2}:\d{2}:\d{2})?$",
    "status": r"(?i)success|thành công|failed|pending|reversed|thất bại",
}
SEVERITIES = ("low", "medium", "high", "critical")


def visible_packets(pending: DataFrame, approved: DataFrame, by: list[str], scope: list[str]) -> DataFrame:
    """Pending packets that no approved packet of the same stream and delivery covers, the newest of each stream.

    Deliveries are equal if all of ``scope`` are, nulls included.
    """
    done = approved.select(*[F.col(c).alias(f"_{c}") for c in (*by, *scope)]).distinct()
    same = [pending[c] == done[f"_{c}"] for c in by] + [pending[c].eqNullSafe(done[f"_{c}"]) for c in scope]
    on = same[0]
    for c in same[1:]:
        on = on & c
    newest = Window.partitionBy(*by).orderBy(F.desc("created_at"), F.desc("id"))
    return pending.join(done, on, "left_anti").withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def newest_of(sources: list[DataFrame], by: list[str], at: str) -> DataFrame:
    """The newest row of several sources for each group; of rows of one time the earlier source's."""
    every = None
    for rank, rows in enumerate(sources):
        rows = rows.withColumn("_rank", F.lit(-rank))
        every = rows if every is None else every.unionByName(rows)
    fields = [c for c in every.columns if c not in (*by, "_rank")]
    best = every.groupBy(*by).agg(F.max_by(F.struct(*fields), F.struct(at, "_rank")).alias("_r"))
    return best.select(*by, *[F.col(f"_r.{c}").alias(c) for c in fields])


def merged_attempts(recent: DataFrame, latest: DataFrame, event: str, order: list[str]) -> DataFrame:
    """Attempts of both histories, each event once, with its place in the history."""
    every = recent.withColumn("_s", F.lit(0)).unionByName(latest.withColumn("_s", F.lit(1)))
    fields = [c for c in every.columns if c not in (event, "_s")]
    once = every.groupBy(event).agg(F.min_by(F.struct(*fields), F.struct("_s", *order)).alias("_r"))
    return once.select(event, *[F.col(f"_r.{c}").alias(c) for c in fields])


def feed(kinds: dict[str, DataFrame], n: int) -> DataFrame:
    """The ``n`` newest items of several kinds, as kind, id, at."""
    every = None
    for name, rows in kinds.items():
        rows = rows.select(F.lit(name).alias("kind"), "id", "at")
        every = rows if every is None else every.unionByName(rows)
    return every.orderBy(F.desc("at"), "kind", "id").limit(n)


def claimable(files: DataFrame, claims: DataFrame, by: list[str]) -> DataFrame:
    """Files whose content nobody claimed, or whose earlier claims all failed."""
    held = claims.where("status <> 'FAILED'").select(*by).distinct()
    return files.join(held, by, "left_anti")


def unit_key(explicit: Column, identity: dict[str, Column]) -> Column:
    """A source unit's key: the explicit one, else the SHA-256 of its identity as JSON with sorted names."""
    body = F.to_json(F.struct(*[v.cast("string").alias(k) for k, v in sorted(identity.items())]), {"ignoreNullFields": "false"})
    return F.coalesce(F.nullif(F.btrim(explicit), F.lit("")), F.sha2(body, 256))


def error_rate(total: Column, failed: Column) -> Column:
    return F.coalesce(F.try_divide(failed.cast("double"), total.cast("double")), F.lit(0.0))


def column_scores(cells: DataFrame, headers: list[str]) -> DataFrame:
    """role, column, score: matches of values and headers, over the rows of ``cells``, in one aggregation.

    A column without a filled cell, or beyond all rows, still has its header's score.
    """
    long = cells.select(F.posexplode("cells").alias("at", "raw")).withColumn("value", F.coalesce(F.trim("raw"), F.lit("")))
    headed = cells.sparkSession.createDataFrame([(k, "", "") for k in range(len(headers))], "at int, raw string, value string")
    filled = F.col("value") != ""
    hits = long.unionByName(headed).groupBy("at").agg(F.count_if(filled).alias("filled"), *[F.count_if(filled & F.col("value").rlike(p)).alias(r) for r, p in ROLE_VALUES.items()])
    names = F.array(*[F.lit(h.lower().replace(" ", "")) for h in headers])
    each = []
    for role, words in ROLE_HEADERS.items():
        named = F.coalesce(F.get(names, F.col("at")).rlike("|".join(words)), F.lit(False))
        each.append(F.struct(F.lit(role).alias("role"), (F.col("filled") + 4 * F.col(role) + F.when(named, 10).otherwise(0)).alias("score")))
    return hits.select((F.col("at") + 1).alias("column"), F.explode(F.array(*each)).alias("r")).select("r.role", "column", "r.score")


def best_columns(scores: DataFrame) -> DataFrame:
    """role, column, score: the highest score of each role, ties to the first column."""
    best = scores.groupBy("role").agg(F.max(F.struct("score", -F.col("column"))).alias("b"))
    return best.select("role", (-F.col("b")[f"{best.schema['b'].dataType.names[1]}"]).alias("column"), F.col("b.score").alias("score")).where("score > 0")


def candidate_columns(cells: DataFrame, headers: list[str], order: str, rows: int = 10) -> DataFrame:
    """column, header, filled, samples, priority of the columns with a header or a filled cell in the first ``rows`` rows, the likeliest first."""
    first = cells.orderBy(order).limit(rows).select(order, F.posexplode("cells").alias("at", "raw"))
    long = first.select("at", F.col(order).alias("line"), F.coalesce(F.trim("raw"), F.lit("")).alias("value"))
    headed = cells.sparkSession.createDataFrame([(k, h.strip()) for k, h in enumerate(headers)], "at int, header string")
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("value") != "", F.struct("line", "value")))), lambda x: x["value"])  # of ``rows`` rows
    seen = long.groupBy("at").agg(F.count_if(F.col("value") != "").alias("filled"), F.slice(shown, 1, 3).alias("samples"))
    out = seen.join(headed, "at", "full_outer").select("at", F.coalesce("header", F.lit("")).alias("header"), F.coalesce("filled", F.lit(0)).alias("filled"), F.coalesce("samples", F.array()).alias("samples"))
    out = out.where("header <> '' OR filled > 0")
    priority = F.when(F.col("header").rlike("[A-Za-zÀ-ỹ0-9]"), 2).otherwise(0) + F.least("filled", F.lit(3))
    named = F.when(F.col("header") == "", F.concat(F.lit("Column "), (F.col("at") + 1).cast("string"))).otherwise(F.col("header"))
    out = out.select((F.col("at") + 1).alias("column"), named.alias("header"), "filled", "samples", priority.alias("priority"))
    return out.orderBy(F.desc("priority"), F.desc("filled"), "column")


def stale(known_hash: Column, seen_hash: Column, known_shape: Column, seen_shape: Column) -> Column:
    """Whether a configuration no longer fits its file: by the hashes where both are known, else by the shapes."""
    return F.when(known_hash.isNotNull() & seen_hash.isNotNull(), known_hash != seen_hash).otherwise(~known_shape.eqNullSafe(seen_shape))


def by_run_or_file(rows: DataFrame, run=None, file=None, column: str = "run_id") -> DataFrame:
    """Rows of a run or list of runs, as stored with results; only without one, of a file or list of files."""
    if run is not None:
        return filtered(rows, **{column: run})
    return filtered(rows, source_file_id=file)


def file_operations(files: DataFrame, pending: DataFrame, most: int = 50) -> DataFrame:
    """Of the ``most`` newest files: how many, completed and failed; and the pending quarantined records, as many at most."""
    newest = files.orderBy(F.desc("created_at"), F.desc("id")).limit(most)
    counts = newest.agg(F.count("*").alias("returned_files"), F.count_if(F.col("status") == "COMPLETED").alias("completed_files"), F.count_if(F.col("status") == "FAILED").alias("failed_files"))
    held = pending.limit(most).agg(F.count("*").alias("pending_quarantine"))
    return counts.join(F.broadcast(held), F.lit(True))  # a row each


def jobs(configs: DataFrame, checkpoints: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """Each configuration with its checkpoint and its latest run, null where it has none."""
    latest = newest_of([runs], by, "run_at")
    return configs.join(newest_of([checkpoints], by, "checkpoint_at"), by, "left").join(latest, by, "left")


def bounded_errors(errors: DataFrame, by: list[str], order: list[str], most: int = 5) -> DataFrame:
    """The first ``most`` errors of each run, and how many there were and were left out."""
    place = Window.partitionBy(*by).orderBy(*order)
    total = errors.groupBy(*by).agg(F.count("*").alias("errors"))
    first = errors.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most)
    return first.join(total, by).withColumn("dropped", F.greatest(F.col("errors") - most, F.lit(0)))


def guardrails(insights: DataFrame) -> DataFrame:
    """id, risk, field: claims that the metrics beside them (rate, total, actual) do not bear out."""
    level = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower("severity"))
    rate, claimed, total, actual = (F.col(c) for c in ("rate", "affected", "total", "actual"))
    severity = F.when((level >= 4) & (rate < 5), "high").when((level >= 3) & (rate < 1), "high").when((level >= 3) & (rate < 5), "low")
    above = F.when((total > 0) & (claimed > total), "high")
    stated = F.when((actual > 0) & (claimed > actual * 2), "high").when((actual > 0) & (claimed > actual * 1.5), "low")
    found = F.array(*[F.struct(r.alias("risk"), F.lit(f).alias("field")) for r, f in ((severity, "severity"), (above, "total"), (stated, "actual"))])
    each = insights.select("id", F.explode(F.filter(found, lambda x: x["risk"].isNotNull())).alias("f"))
    return each.select("id", "f.risk", "f.field")


def stage_counters(rows: DataFrame, by: list[str], outcome: str) -> DataFrame:
    """Counts of a run's outcomes, and COMPLETED or PARTIAL."""
    out = rows.groupBy(*by).agg(F.count("*").alias("input"), F.count_if(F.col(outcome) == "VALID").alias("stored"), F.count_if(F.col(outcome) == "REJECT").alias("rejected"))
    return out.withColumn("status", F.when(F.col("rejected") > 0, "PARTIAL").otherwise("COMPLETED"))


def filtered(rows: DataFrame, **wanted) -> DataFrame:
    """Rows by optional conditions: a value, a list, or a (low, high) pair with either end open; None asks nothing."""
    for name, want in wanted.items():
        if want is None:
            continue
        if isinstance(want, tuple):
            low, high = want
            rows = rows if low is None else rows.where(F.col(name) >= low)
            rows = rows if high is None else rows.where(F.col(name) <= high)
        else:
            rows = rows.where(F.col(name).isin(want) if isinstance(want, list) else F.col(name) == want)
    return rows


def audited(rows: DataFrame, day: str | None, kind: str | None, dateless: tuple[str, ...]) -> DataFrame:
    """Audit events of a kind and day; kinds that need no date are kept where they have none, or are asked for by name."""
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if day is None or kind in dateless:
        return rows
    own = F.col("date") == F.lit(day).cast("date")
    return rows.where(own if kind is not None else own | (F.col("kind").isin(*dateless) & F.col("date").isNull()))
