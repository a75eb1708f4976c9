"""Quarantine queues, retry rules and recovery states."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship
from ..streaming import ingest
from . import folds

#: Error codes of each kind of issue; other codes are OTHER.
ISSUE_CODES = {
    "SCHEMA": ("REQUIRED_SCHEMA_PATH", "MISSING_REQUIRED_SOURCE_COLUMN", "SCHEMA_CONFIG_DRIFT", "SOURCE_STRUCTURE_UNREADABLE", "CONFIG_VALIDATION"),
    "REQUIRED_FIELD": ("MISSING_REQUIRED_FIELD",),
    "FORMAT": ("MALFORMED_ROW", "INVALID_AMOUNT", "NEGATIVE_AMOUNT", "INVALID_TIMESTAMP", "INVALID_STATUS"),
    "DUPLICATE": ("EQUIVALENT_DUPLICATE", "CONFLICTING_DUPLICATE"),
    "RECOVERY": ("SOURCE_UNIT_RECOVERY_REQUIRED",),
}
#: Errors that are retried by themselves.
RETRYABLE = ("fetch_timeout", "fetch_network_error", "fetch_http_429", "fetch_http_5xx", "source_persist_error", "checkpoint_advance_error", "checkpoint_stale")
#: Allowed changes of a quarantined record's status.
TRANSITIONS = {"PENDING": ("REPROCESSING",), "REPROCESSING": ("PENDING", "RESOLVED", "REJECTED"), "RESOLVED": (), "REJECTED": ()}
#: Days until a record is due, and that resolved and rejected records are kept.
DUE_DAYS, KEPT_DAYS = 1, {"RESOLVED": 90, "REJECTED": 365}


def issue_type(code: Column) -> Column:
    out = F.lit("OTHER")
    for name, codes in reversed(ISSUE_CODES.items()):
        out = F.when(F.upper(code).isin(*codes), name).otherwise(out)
    return out


def retry_delay(code: Column, attempts: Column, most: int = 3, first: int = 60, longest: int = 3600) -> Column:
    """Seconds until the next automatic attempt, null if there is none."""
    again = code.isin(*RETRYABLE) & (attempts >= 0) & (attempts < most)
    return F.when(again, F.least(F.lit(longest), F.lit(first) * F.pow(F.lit(2), F.greatest(attempts - 1, F.lit(0)))).cast("int"))


def transition_allowed(now: Column, then: Column) -> Column:
    pairs = [F.concat(F.lit(a), F.lit(">"), F.lit(b)) for a, bs in TRANSITIONS.items() for b in bs]
    return F.concat(now, F.lit(">"), then).isin(*pairs)


def status_changes(events: DataFrame) -> DataFrame:
    """``events`` (record_id, event_id, at, to_status) with before, after and result: APPLIED, REFUSED or REPEATED.

    Records begin as PENDING. Events of a record are taken in order of (at, event_id); the first of an event id counts, and
    others of it are repeats, which meet and leave the record as the first one left it.
    """
    fields = [c for c in events.columns if c not in ("record_id", "event_id")]
    each = events.groupBy("record_id", "event_id").agg(F.min(F.struct("at", F.struct(*fields).alias("row"))).alias("first"), F.count("*").alias("times"))
    once = each.select("record_id", "event_id", *[F.col(f"first.row.{c}").alias(c) for c in fields], "times")
    table = {a: {b: b for b in bs} for a, bs in TRANSITIONS.items()}
    done = folds.folded(once, ["record_id"], ["at", "event_id"], "to_status", table, "PENDING")
    result = F.when(F.col("applied"), "APPLIED").otherwise("REFUSED")
    # a repeat stands behind the event that it repeats: one row tells how many came
    repeats = done.where("times > 1").select(*events.columns, F.col("after").alias("before"), "after", F.lit("REPEATED").alias("result"), (F.col("times") - 1).alias("times"))
    return done.select(*events.columns, "before", "after", result.alias("result"), F.lit(1).cast("long").alias("times")).unionByName(repeats)


def latest_status(changes: DataFrame) -> DataFrame:
    """record_id, status, attempts (changes to REPROCESSING), applied, refused and repeated events of every record."""
    of = lambda name: F.sum(F.when(F.col("result") == name, F.col("times")).otherwise(0))
    again = (F.col("result") == "APPLIED") & (F.col("after") == "REPROCESSING")
    last = F.max_by("after", F.struct("at", "event_id")).alias("status")
    return changes.groupBy("record_id").agg(last, F.count_if(again).alias("attempts"), *[of(n).alias(n.lower()) for n in ("APPLIED", "REFUSED", "REPEATED")])


def follow_status(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The same rule over a stream of events: record_id, event_id, before, after, result, as events come.

    A record's status and the event ids that it has seen are kept; those of an event time further back than ``late`` from
    the record's newest are forgotten, so state stays bounded. Events of one micro-batch are taken in order of (at, event_id).
    """
    ship(events.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, ids, times = state.get if state.exists else ("PENDING", [], [])
        known, rows = dict(zip(ids, times)), []
        for row in pd.concat(list(frames)).sort_values(["at", "event_id"], kind="stable").itertuples():
            moment = int(row.at.value // 1000)
            if row.event_id in known:
                rows.append((key[0], row.event_id, now, now, "REPEATED"))
                continue
            known[row.event_id] = moment
            fine = row.to_status in TRANSITIONS[now]
            rows.append((key[0], row.event_id, now, row.to_status if fine else now, "APPLIED" if fine else "REFUSED"))
            now = row.to_status if fine else now
        edge = max(known.values(), default=0) - kept
        known = {i: t for i, t in known.items() if t >= edge}
        state.update((now, list(known), list(known.values())))
        yield pd.DataFrame(rows, columns=["record_id", "event_id", "before", "after", "result"])

    kept = int(pd.Timedelta(late).total_seconds() * 1_000_000)
    kind = f"record_id {events.schema['record_id'].dataType.simpleString()}, event_id {events.schema['event_id'].dataType.simpleString()}, before string, after string, result string"
    held = f"status string, ids array<{events.schema['event_id'].dataType.simpleString()}>, times array<long>"
    return events.groupBy("record_id").applyInPandasWithState(step, kind, held, "append", GroupStateTimeout.NoTimeout)


def with_defaults(records: DataFrame) -> DataFrame:
    """Adds priority, due_at and expires_at to quarantined records."""
    grave = F.col("severity").isin("FATAL") | F.exists("codes", lambda c: c == "CONFLICTING_DUPLICATE")
    kept = F.when(F.col("status") == "RESOLVED", KEPT_DAYS["RESOLVED"]).when(F.col("status") == "REJECTED", KEPT_DAYS["REJECTED"])
    return records.withColumns({
        "priority": F.when(grave, "HIGH").otherwise("NORMAL"),
        "due_at": F.timestamp_add("DAY", F.lit(DUE_DAYS), F.col("created_at")),
        "expires_at": F.timestamp_add("DAY", kept, F.col("resolved_at")),
    })


def queue_summary(records: DataFrame, now: Column, by: list[str]) -> DataFrame:
    open_ = F.col("status").isin("PENDING", "REPROCESSING")
    return records.groupBy(*by).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in TRANSITIONS],
        F.count_if(open_ & (F.col("due_at") < now)).alias("overdue"),
        F.count_if(open_ & (F.col("priority") == "HIGH")).alias("high_priority"),
    )


def group_queue(records: DataFrame, group: Column, oldest: int = 2000) -> DataFrame:
    """Groups of the ``oldest`` records, with the kinds of issues in each; the cap is the work queue's."""
    first = records.orderBy("created_at", "id").limit(oldest).withColumn("group_key", group)
    each = first.select("group_key", "id", "created_at", F.explode_outer("codes").alias("code"))
    return each.groupBy("group_key").agg(
        F.count_distinct("id").alias("records"),
        F.array_join(F.array_sort(F.collect_set(issue_type(F.col("code")))), ",").alias("issue_types"),
        F.min("created_at").alias("oldest"),
    )


def recovery_status(checkpoint: Column, run: Column, replayed: Column, skipped: Column) -> Column:
    return (
        F.when((run == "COMPLETED") & replayed, "REPLAYED")
        .when(run == "WAITING_REVIEW", "WAITING_REVIEW")
        .when(checkpoint.isin("BLOCKED", "FAILED", "PROCESSING"), checkpoint)
        .when((checkpoint == "DISCOVERED") & skipped, "PENDING")
        .when(checkpoint.isNotNull() & (run == "COMPLETED"), "COMPLETED")
        .when(run.isin("QUEUED", "RUNNING", "PROCESSING"), "PROCESSING")
        .otherwise(F.coalesce(run, F.lit("IDLE")))
    )


def partner_state(approved: Column, pending: Column) -> Column:
    """What a partner waits for, from whether a configuration is approved and the number of pending items."""
    return F.when(~approved & (pending > 0), "BLOCKED").when(pending > 0, "NEEDS_REVIEW").when(approved, "ACTIVE").otherwise("NO_ACTIVITY")


def backfill_days(first: date, last: date, most: int = 31) -> list[date]:
    """Working days of a backfill, refused if there are more than ``most``."""
    days = [first + timedelta(k) for k in range((last - first).days + 1)]
    days = [d for d in days if d.weekday() < 5]
    if not days or len(days) > most:
        raise ValueError(f"a backfill has 1 to {most} working days, not {len(days)}")
    return days


def overdue(records: DataFrame, now: Column, late: bool, status: str | None = None) -> DataFrame:
    """Records due by ``now`` (open ones, if no status is asked for), or those due later."""
    if status is not None:
        records = records.where(F.col("status") == status)
    if not late:
        return records.where(F.col("due_at") > now)
    return records.where((F.col("due_at") <= now) & (F.lit(status is not None) | F.col("status").isin("PENDING", "REPROCESSING")))


def expired(records: DataFrame, now: Column, most: int = 100) -> DataFrame:
    """The ``most`` closed records whose time is over, the longest expired first."""
    return records.where(F.col("status").isin(*KEPT_DAYS) & (F.col("expires_at") <= now)).orderBy("expires_at", "id").limit(most)


def append(records: DataFrame, path: str) -> dict[str, int]:
    """Adds quarantined records, with their defaults, to the store at ``path``; those of an id, status and day of expiry that it has are not added again.

    Folders are the days on which records expire, so that a purge touches few of them.
    """
    store = ingest.Store(records.sparkSession, path)
    _finish(store)
    last = max((int(n.removeprefix("batch=")) for n in store.names("") if n.startswith("batch=")), default=-1)
    rows = with_defaults(records).withColumn("expires_on", F.to_date("expires_at"))
    return ingest.append(rows, last + 1, path, ["id", "status", "expires_on"], "created_at", "expires_on")


def purge(spark: SparkSession, path: str, now: Column, most: int = 100) -> int:
    """Takes the ``most`` longest expired records out of the store and returns how many went.

    Only the folders that hold them are written anew, beside the store; each then takes the place of the old one. A purge
    that breaks off has either changed nothing of a folder, or left its new content, which the next purge or append puts
    in its place.
    """
    store = ingest.Store(spark, path)
    _finish(store)
    rows = spark.read.parquet(path)
    due = rows.where(F.col("expires_on") <= F.to_date(now))  # reaches the folders
    gone = expired(due.select("*", ingest.parent().alias("_folder")), now, most).select("id", "status", "_folder").collect()  # ``most`` at most
    kind = T.StructType([f for f in rows.schema if f.name not in ("batch", "expires_on")])
    for folder in sorted({r["_folder"] for r in gone}):
        out = spark.createDataFrame([(r["id"], r["status"]) for r in gone if r["_folder"] == folder], T.StructType([rows.schema["id"], rows.schema["status"]]))
        kept = spark.read.schema(kind).parquet(folder).join(F.broadcast(out), ["id", "status"], "left_anti").select(*kind.names)
        kept.write.mode("overwrite").parquet(f"{store.target}/_purged/{'/'.join(folder.split('/')[-2:])}")
    _finish(store)
    return len(gone)


def _finish(store: ingest.Store) -> None:
    """Puts the complete folders of a purge in the place of those that they replace."""
    for batch in store.names("_purged"):
        for day in store.names(f"_purged/{batch}"):
            if store.exists(f"_purged/{batch}/{day}/_SUCCESS"):
                store.delete(f"{batch}/{day}")
                store.rename(f"_purged/{batch}/{day}", f"{batch}/{day}")
    store.delete("_purged")
