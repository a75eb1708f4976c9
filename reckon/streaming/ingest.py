"""Units of a stream are ingested in order, each once in effect.

Rows of a micro-batch are appended where their key is new; the batch's number
names its folder, so a batch that Spark repeats after a failure replaces what it
wrote before. Spark's checkpoint holds the offsets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import filters
from ..session import ship


def stored_rows(spark: SparkSession, target: str, kind: T.StructType) -> DataFrame:
    """All rows of a kind ingested so far, with their batch; none where nothing has been written."""
    schema = T.StructType([*kind, T.StructField("batch", T.LongType())])
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(target) if there else spark.createDataFrame([], schema)


#: Stored batches whose folders and filters are kept apart before they are put together.
FANOUT = 8
#: Folders of a batch up to which only their filters' row groups are read.
MOST_FOLDERS = 1000


class Store:
    """Files of a target: ``batch=n[/by=value]`` hold rows; ``_folders`` names those folders and ``_filters`` has a Bloom filter of each one's keys.

    Both are kept for ranges of batches, whose names are all that is listed: ``FANOUT`` ranges of like length become one,
    so their number grows with the logarithm of the batches.
    """

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._jvm.Path(f"{self.target}/{path}"))

    def delete(self, path: str) -> None:
        self._fs.delete(self._jvm.Path(f"{self.target}/{path}"), True)

    def rename(self, path: str, to: str) -> None:
        if not self._fs.rename(self._jvm.Path(f"{self.target}/{path}"), self._jvm.Path(f"{self.target}/{to}")):
            raise OSError(f"{path} cannot be moved to {to}")

    def names(self, path: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._jvm.Path(f"{self.target}/{path}"))) if self.exists(path) else []

    def ranges(self, before: int) -> list[tuple[int, int]]:
        """Ranges of the batches below ``before``, without those that a longer one holds."""
        found = [tuple(map(int, n.split("-"))) for n in self.names("_folders") if self.exists(f"_folders/{n}/_SUCCESS")]
        if any(lo < before <= hi for lo, hi in found):
            raise ValueError(f"batch {before} has been put together with later ones; only the latest batch can be repeated")
        out: list[tuple[int, int]] = []
        for lo, hi in sorted((r for r in found if r[1] < before), key=lambda r: (r[0], -r[1])):
            if not out or lo > out[-1][1]:
                out.append((lo, hi))
        return out

    def read(self, kind: str, ranges: list[tuple[int, int]]) -> DataFrame:
        schema = FOLDERS if kind == "_folders" else FILTERS
        return self.spark.read.schema(schema).parquet(*[f"{self.target}/{kind}/{lo}-{hi}" for lo, hi in ranges])

    def write(self, kind: str, rows: DataFrame, lo: int, hi: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.target}/{kind}/{lo}-{hi}")

    def merged(self, before: int) -> list[tuple[int, int]]:
        """``ranges``, after runs of ``FANOUT`` like ones were put together."""
        now = self.ranges(before)
        while True:
            size = lambda r: int(math.log(r[1] - r[0] + 1, FANOUT) + 1e-9)
            run = next((now[k : k + FANOUT] for k in range(len(now) - FANOUT + 1) if len({size(r) for r in now[k : k + FANOUT]}) == 1), None)
            if run is None:
                return now
            lo, hi = run[0][0], run[-1][1]
            self.write("_filters", self.read("_filters", run).repartitionByRange("folder").sortWithinPartitions("folder", "block"), lo, hi)
            self.write("_folders", self.read("_folders", run).coalesce(1), lo, hi)  # now it holds
            for a, b in run:
                self.delete(f"_folders/{a}-{b}")
                self.delete(f"_filters/{a}-{b}")
            now = self.ranges(before)


FOLDERS = "batch long, folder long, path string, rows long, blocks long"
FILTERS = "batch long, folder long, block long, w0 long, w1 long, w2 long, w3 long"


def _candidates(rows: DataFrame, keys: list[str], ordinal: str, valid: Column | None, seen: Observation) -> DataFrame:
    """The first row of each key with ``_came``, how often it came; rows that are not valid are counted and left out.

    Counts are observed behind the shuffle, in the tasks that write, whose results Spark takes once.
    """
    bad = F.lit(False) if valid is None else ~F.coalesce(valid, F.lit(False))
    own = [F.when(~F.col("_bad"), F.col(k)).alias(k) for k in keys]
    fields = [c for c in rows.columns if c not in (*keys, ordinal)]
    firsts = F.min_by(F.struct(*fields, F.lit(0).alias("_")), ordinal).alias("_row"), F.min(ordinal).alias(ordinal)
    grouped = rows.withColumn("_bad", bad).withColumns({k: c for k, c in zip(keys, own)}).groupBy("_bad", *keys).agg(*firsts, F.count("*").alias("_came"))
    zero = F.lit(0).cast("long")
    grouped = grouped.observe(
        seen,
        F.coalesce(F.sum("_came"), zero).alias("input"),
        F.coalesce(F.sum(F.when(F.col("_bad"), F.col("_came"))), zero).alias("failed"),
        F.count_if(~F.col("_bad")).alias("keys"),
    )
    columns = [c if c in (*keys, ordinal) else F.col(f"_row.{c}").alias(c) for c in rows.columns]
    return grouped.where(~F.col("_bad")).select(*columns, "_came")


def _possible(store: Store, came: DataFrame, keys: list[str], by: str | None, ranges: list[tuple[int, int]]) -> list[str]:
    """Paths of the stored folders that may hold keys of the batch, by their filters: none as a rule for new keys."""
    if not ranges:
        return []
    asked = came.select(_folder(by).alias("folder"), filters.key_hash(*map(F.col, keys)).alias("hash"))
    folders = store.read("_folders", ranges)
    stored = store.read("_filters", ranges)
    own = [r["folder"] for r in asked.select("folder").distinct().limit(MOST_FOLDERS + 1).collect()]
    if len(own) <= MOST_FOLDERS:
        folders, stored = folders.where(F.col("folder").isin(own)), stored.where(F.col("folder").isin(own))
    hits = filters.maybe(asked.join(folders, "folder").select("batch", "folder", "path", "hash", "blocks"), stored, ["batch", "folder"])
    return [r["path"] for r in hits.select("path").distinct().collect()]  # a row a folder that is read


def parent() -> Column:
    """The folder of a row's file; file names come as URIs."""
    plain = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "/[^/]*$", "")


def _folder(by: str | None) -> Column:
    return F.lit(0).cast("long") if by is None else F.xxhash64(F.col(by), F.col(by).isNull())


def append(rows: DataFrame, batch: int, target: str, keys: list[str], ordinal: str = "ordinal", by: str | None = None, valid: Column | None = None) -> dict[str, int]:
    """Appends the new keys of a batch to ``target`` under its number; the counts input, failed, inserted and repeated.

    The batch is evaluated once: the first row of each key is staged with the times that it came. Filters tell which
    stored folders may hold its keys, and only those are read; nulls in keys are equal to each other. ``by`` is one of the
    keys, a day as a rule, whose values are folders of the target; an empty text there is null. An earlier try of the
    same batch is replaced; only the latest batch can be repeated. Rows that are not ``valid`` are counted as failed.
    """
    store = Store(rows.sparkSession, target)
    spark, ranges = rows.sparkSession, store.merged(batch)
    for name in store.names("_came"):
        store.delete(f"_came/{name}")
    for kind in ("_folders", "_filters"):
        store.delete(f"{kind}/{batch}-{batch}")
    if by is not None and isinstance(rows.schema[by].dataType, T.StringType):
        rows = rows.withColumn(by, F.nullif(F.col(by), F.lit("")))
    seen, stored = Observation(), Observation()
    staged = f"{store.target}/_came/batch={batch}"
    _candidates(rows, keys, ordinal, valid, seen).write.mode("overwrite").parquet(staged)
    kind = T.StructType([*rows.schema, T.StructField("_came", T.LongType())])
    came = spark.read.schema(kind).parquet(staged)
    fresh, paths = came.drop("_came"), _possible(store, came, keys, by, ranges)
    if paths:
        held = spark.read.option("basePath", store.target).schema(rows.schema).parquet(*paths).select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        fresh = fresh.join(held, same, "left_anti")
    fresh = (fresh if by is None else fresh.hint("rebalance", by)).observe(stored, F.count("*").alias("inserted"))
    writer = fresh.write.mode("overwrite").option("partitionOverwriteMode", "static")
    path = f"{store.target}/batch={batch}"
    (writer if by is None else writer.partitionBy(by)).parquet(path)
    written = spark.read.schema(rows.schema).parquet(path)
    hashed = written.select(_folder(by).alias("folder"), filters.key_hash(*map(F.col, keys)).alias("hash"), parent().alias("path"))
    sets = hashed.groupBy("folder").agg(F.max("path").alias("path"), F.count("*").alias("rows")).withColumn("blocks", filters.blocks(F.col("rows"))).coalesce(1)
    sets = sets.select(F.lit(batch).cast("long").alias("batch"), "folder", "path", "rows", "blocks")
    made = f"{store.target}/_made"
    sets.write.mode("overwrite").parquet(made)
    sets = spark.read.schema(FOLDERS).parquet(made)
    built = filters.built(hashed.select("folder", "hash"), sets, ["folder"]).withColumn("batch", F.lit(batch).cast("long"))
    store.write("_filters", built.select("batch", "folder", "block", *filters.WORDS).repartitionByRange("folder").sortWithinPartitions("folder", "block"), batch, batch)
    store.write("_folders", sets, batch, batch)  # from here on the batch counts as stored
    store.delete("_made")
    inserted = stored.get["inserted"]
    counts = seen.get
    return {"input": counts["input"], "failed": counts["failed"], "inserted": inserted, "repeated": counts["input"] - counts["failed"] - inserted}


def append_batch(rows: DataFrame, batch: int, target: str, keys: list[str], ordinal: str = "ordinal", by: str | None = None) -> DataFrame:
    """``append``; returns the keys with the rows that came, went in and repeated a key, as long as the batch is the latest."""
    append(rows, batch, target, keys, ordinal, by)
    spark = rows.sparkSession
    came = spark.read.schema(T.StructType([*[rows.schema[k] for k in keys], T.StructField("_came", T.LongType())])).parquet(f"{target}/_came/batch={batch}")
    written = spark.read.schema(rows.schema).parquet(f"{target}/batch={batch}").select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(1).alias("_in"))
    same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    inserted = F.coalesce("_in", F.lit(0))
    return came.join(written, same, "left").select(*keys, F.col("_came").alias("input"), inserted.alias("inserted"), (F.col("_came") - inserted).alias("repeated"))


def ingest(
    units: DataFrame, prepare: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, keys: list[str], once: bool = True, by: str | None = None
) -> StreamingQuery:
    """Starts the stream ``units``; ``prepare`` maps a batch to rows with the keys and an ordinal."""
    writer = units.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda rows, batch: append_batch(prepare(rows), batch, target, keys, by=by))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


#: Outcomes that let a stream go on; any other one holds it.
GOES_ON = ("COMPLETED", "SKIPPED")


def ordered_units(units: DataFrame, checkpoints: DataFrame, goes_on: tuple[str, ...] = GOES_ON) -> DataFrame:
    """``units`` (stream, position, key, hash, outcome) with ``status``: how far each stream gets, all streams in one plan.

    ``checkpoints`` (stream, done_key, done_hash) has a row a stream at most. Units up to the first with the completed key
    or content hash are DONE before; then units take their outcome in order, up to the first that does not let the
    stream go on, and those behind it are WAITING. Streams of any length are cut by minima, which partial aggregates
    find; a completed key that is not among the units means that all are to run. Days of a backfill are units too.
    """
    marks = checkpoints.select(F.col("stream").alias("_of"), "done_key", "done_hash")
    same = F.col("stream").eqNullSafe(F.col("_of"))
    met = units.join(marks, same, "left")
    hit = F.coalesce((F.col("key") == F.col("done_key")) | (F.col("hash") == F.col("done_hash")), F.lit(False))
    done = met.groupBy(F.col("stream").alias("_of")).agg(F.min(F.when(hit, F.col("position"))).alias("_done"))
    rest = units.join(done, same).withColumn("_runs", F.col("_done").isNull() | (F.col("position") > F.col("_done"))).drop("_of")
    held = F.col("_runs") & ~F.coalesce(F.col("outcome").isin(*goes_on), F.lit(False))
    stop = rest.groupBy(F.col("stream").alias("_of")).agg(F.min(F.when(held, F.col("position"))).alias("_stop"))
    status = F.when(~F.col("_runs"), "DONE").when(F.col("position") > F.col("_stop"), "WAITING").otherwise(F.coalesce("outcome", F.lit("FAILED")))
    return rest.join(stop, same).withColumn("status", status).select(*units.columns, "status")


def advanced(planned: DataFrame, checkpoints: DataFrame, goes_on: tuple[str, ...] = GOES_ON) -> DataFrame:
    """The checkpoints behind ``planned`` (of ``ordered_units``): stream, done_key, done_hash, held_at (the key that holds the stream)."""
    went = F.col("status").isin(*goes_on)
    stopped = ~went & ~F.col("status").isin("DONE", "WAITING")
    last = planned.groupBy("stream").agg(F.max_by(F.struct("key", "hash"), F.when(went, F.col("position"))).alias("_last"), F.max(F.when(stopped, F.col("key"))).alias("held_at"))
    before = checkpoints.select(F.col("stream").alias("_of"), F.col("done_key").alias("_key"), F.col("done_hash").alias("_hash"))
    both = last.join(before, F.col("stream").eqNullSafe(F.col("_of")), "full_outer")
    fresh = F.col("_last").isNotNull()
    return both.select(
        F.coalesce("stream", "_of").alias("stream"),
        F.when(fresh, F.col("_last.key")).otherwise(F.col("_key")).alias("done_key"),
        F.when(fresh, F.col("_last.hash")).otherwise(F.col("_hash")).alias("done_hash"),
        "held_at",
    )


def follow_units(units: DataFrame, goes_on: tuple[str, ...] = GOES_ON) -> DataFrame:
    """The same rule over a stream of units: stream, key, position, status. A stream that is held goes on when the unit that held it comes again and is completed."""
    ship(units.sparkSession)

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, held = state.get if state.exists else (None, None)
        rows = []
        for u in pd.concat(list(frames)).sort_values("position", kind="stable").itertuples():
            if u.key == done:
                status = "DONE"  # a repeat of what was completed last
            elif held is not None and u.key != held:
                status = "WAITING"
            else:
                status = u.outcome or "FAILED"
                done, held = (u.key, None) if status in goes_on else (done, u.key)
            rows.append((name[0], u.key, u.position, status))
        state.update((done, held))
        yield pd.DataFrame(rows, columns=["stream", "key", "position", "status"])

    return units.groupBy("stream").applyInPandasWithState(step, "stream string, key string, position long, status string", "done string, held string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, by: list[str], width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling windows of event time, for batches and streams."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    out = marked.groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start_at"), *by, "n")


def without_repeats(events: DataFrame, at: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """A stream without repeats of keys that come within ``late`` of each other."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def due(at: Column, now: Column) -> Column:
    return at.isNotNull() & (at <= now)
