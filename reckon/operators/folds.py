"""Finite state machines run over the ordered events of many keys, however many events one key has.

Events are dealt by ranges of (key, order), so a task holds whole runs of
neighbours but not always whole keys. A task follows its runs from every state
that they could begin in and notes each event's state for all of them. Where a
key's events reach over several tasks, the notes of the runs' ends are put
together in order: a few rows for each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import shared_path, ship

_KEY = "_fold_key"


def folded(events: DataFrame, keys: list[str], order: list[str], symbol: str, table: dict[str, dict[str, str]], start: str) -> DataFrame:
    """``events`` with ``before``, ``after`` and ``applied``: the state that each met, the one it left, and whether ``table`` has the change.

    ``table`` maps a state and a symbol to the next state; other symbols, and null ones, leave the state as it is.
    ``order`` has to tell the events of a key apart. Keys may be null.
    """
    spark, states = events.sparkSession, list(table)
    ship(spark)
    moves = {s: np.array([states.index(table[a].get(s, a)) for a in states], np.int8) for s in {s for a in table.values() for s in a}}
    still, identity = np.arange(len(states), dtype=np.int8), np.arange(len(states), dtype=np.int8)
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    wide = events.select(F.struct("*").alias("_event"), key.alias(_KEY), *[F.col(o).alias(f"_o{k}") for k, o in enumerate(order)], F.col(symbol).cast("string").alias("_symbol"))
    by = [_KEY, *[f"_o{k}" for k in range(len(order))]]
    path = shared_path(spark, "dealt")
    wide.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_chunk", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()).drop(*by[1:]).write.parquet(path)
    dealt = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, identity
        for batch in batches:
            found = []
            for k, c, s in zip(*(batch.column(n).to_pylist() for n in ("_fold_key", "_chunk", "_symbol"))):
                if (k, c) != now:
                    now, state = (k, c), identity
                found.append(state.tobytes())
                state = moves.get(s, still)[state]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "_seen"])

    ordered = dealt.repartition("_chunk").sortWithinPartitions("_chunk", "_place").select(_KEY, "_chunk", "_place", "_symbol")
    noted = f"{_KEY} string, _chunk int, _place long, _symbol string, _seen binary"
    seen = ordered.mapInArrow(run, noted)
    notes = shared_path(spark, "noted")
    seen.write.parquet(notes)
    seen = spark.read.schema(noted).parquet(notes)
    # runs of keys that reach over several chunks, with the last event's note and symbol
    runs = seen.groupBy(_KEY, "_chunk").agg(F.max_by(F.struct("_seen", "_symbol"), "_place").alias("last"))
    parted = runs.groupBy(F.col(_KEY).alias("_k")).agg(F.count("*").alias("n")).where("n > 1")
    ends = runs.join(parted, F.col(_KEY) == F.col("_k")).select(_KEY, "_chunk", "last.*").orderBy(_KEY, "_chunk").collect()
    entered, now, state = [], None, 0
    for r in ends:  # two for each chunk at most, and one for each chunk inside of a key
        if r[_KEY] != now:
            now, state = r[_KEY], states.index(start)
        entered.append((r[_KEY], r["_chunk"], state))
        state = int(moves.get(r["_symbol"], still)[np.frombuffer(r["_seen"], np.int8)[state]])
    first = spark.createDataFrame(entered, "_k string, _c int, _entered int")
    names = F.array(*map(F.lit, states))
    out = seen.join(F.broadcast(first), (F.col(_KEY) == F.col("_k")) & (F.col("_chunk") == F.col("_c")), "left")
    at = F.conv(F.hex(F.substring("_seen", F.coalesce("_entered", F.lit(states.index(start))) + 1, F.lit(1))), 16, 10).cast("int")
    out = out.select("_place", "_symbol", F.element_at(names, at + 1).alias("before"))
    changes = F.create_map(*[F.lit(x) for a in states for s, b in table[a].items() for x in (f"{a}\x1f{s}", b)])
    then = F.try_element_at(changes, F.concat("before", F.lit("\x1f"), F.coalesce("_symbol", F.lit(""))))
    out = out.select("_place", "before", F.coalesce(then, "before").alias("after"), then.isNotNull().alias("applied"))
    return dealt.select("_place", "_event").join(out, "_place").select("_event.*", "before", "after", "applied")
