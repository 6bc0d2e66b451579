"""Stateful rules over event logs, as batch folds; ``streaming`` has their twins on streams.

Windows are anchored at the first event after the last window: an event more than the window later begins a new one.
Events are sorted by key and time within partitions and folded as they stream by, with the state of one key at a time,
so no key's events are gathered. Ties in time go by event id; null times and repeated rows are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

RATE_LIMIT, RATE_WINDOW_MS = 120, 60_000
LOCK_FAILURES, LOCK_WINDOW_MS = 10, 15 * 60_000


def _folded(events: DataFrame, key: str, fields: list[str], fold: Callable[[], Callable[..., Iterator[tuple]]], schema: str) -> DataFrame:
    """Rows that a fold gives over each key's events in order of time.

    ``fold`` makes a key's step: called with (us, event_id, *fields) of each event, and with None at the key's end, it
    yields rows without the key.
    """
    rows = events.filter("ts is not null").select(F.col(key), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").cast("bigint").alias("event_id"), *fields)
    out = StructType.fromDDL(f"{key} {rows.schema[key].dataType.simpleString()}, {schema}")
    arrow = to_arrow_schema(out)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, step = False, None, None
        for batch in batches:
            found: list[tuple] = []
            for k, *event in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or k != now:
                    if begun:
                        found += ((now, *row) for row in step(None))
                    begun, now, step = True, k, fold()
                found += ((k, *row) for row in step(*event))
            yield pack(found)
        if begun:
            yield pack([(now, *row) for row in step(None)])

    def pack(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found) if found else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    # A range by key and time would part a key's events; by hash each key is whole, and its sort may spill.
    return rows.distinct().repartition(key).sortWithinPartitions(key, "us", "event_id", *fields).mapInArrow(stage, out)


def rate_limit(events: DataFrame, key: str = "user_id", limit: int = RATE_LIMIT, window_ms: int = RATE_WINDOW_MS) -> DataFrame:
    """(key, event_id, allowed): denied events count too; an event is allowed while its window's count is at most ``limit``."""
    window = window_ms * 1000

    def fold():
        start, count = None, 0

        def step(us, event=None):
            nonlocal start, count
            if us is not None:
                if start is None or us - start > window:
                    start, count = us, 0
                count += 1
                yield event, count <= limit

        return step

    return _folded(events, key, [], fold, "event_id bigint, allowed boolean")


def lockouts(events: DataFrame, key: str = "user_id", failures: int = LOCK_FAILURES, window_ms: int = LOCK_WINDOW_MS) -> DataFrame:
    """(key, event_id, locked) of login attempts (``outcome`` failure or success): whether the key was locked when it came.

    While locked nothing is recorded; a success clears the count; a failure beyond the window begins a new count.
    """
    window = window_ms * 1000

    def fold():
        start, count = None, 0

        def step(us, event=None, outcome=None):
            nonlocal start, count
            if us is None:
                return
            inside = start is not None and us - start <= window
            locked = inside and count >= failures
            if not locked:
                if outcome != "failure":
                    start, count = None, 0
                elif inside:
                    count += 1
                else:
                    start, count = us, 1
            yield event, locked

        return step

    return _folded(events.filter("outcome in ('failure', 'success')"), key, ["outcome"], fold, "event_id bigint, locked boolean")


def lockouts_by(events: DataFrame, keys: tuple[str, ...] = ("account", "address"), failures: int = LOCK_FAILURES, window_ms: int = LOCK_WINDOW_MS) -> DataFrame:
    """(event_id, locked, locked_by): each attempt is counted under every key, as its account's and its address's; it is
    locked if any of them is. ``locked_by`` names those that are. Each key's count goes by its own lock alone."""
    each = None
    for key in keys:
        part = lockouts(events.filter(F.col(key).isNotNull()), key, failures, window_ms).select("event_id", F.when(F.col("locked"), F.lit(key)).alias("by"))
        each = part if each is None else each.unionByName(part)
    # A group is one attempt, with as many rows as there are keys.
    return each.groupBy("event_id").agg((F.count("by") > 0).alias("locked"), F.array_join(F.array_sort(F.collect_set("by")), ",").alias("locked_by"))


def debounce(events: DataFrame, key: str = "user_id", gap_ms: int = 300, most_ms: int | None = None) -> DataFrame:
    """(key, first_us, fire_us, events): bursts whose events follow within the gap; each fires a gap after its last.

    With ``most_ms`` a burst fires at the latest that long after its first event, and the next event begins a new one.
    """
    gap, most = gap_ms * 1000, None if most_ms is None else most_ms * 1000

    def fold():
        first, last, count = None, None, 0

        def fire():
            return first, last + gap if most is None else min(last + gap, first + most), count

        def step(us, event=None):
            nonlocal first, last, count
            if first is not None and (us is None or us >= fire()[1]):
                yield fire()
                first = None
            if us is not None:
                if first is None:
                    first, count = us, 0
                last, count = us, count + 1

        return step

    return _folded(events, key, [], fold, "first_us bigint, fire_us bigint, events bigint")


def latest_state(updates: DataFrame) -> DataFrame:
    """(vault_id, path, state) last published for each open note."""
    return updates.groupBy("vault_id", "path").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"))


def last_valid_state(updates: DataFrame, valid: Column) -> DataFrame:
    """The last state of each note that passes its checks; notes without one have no row."""
    return latest_state(updates.filter(F.coalesce(valid, F.lit(False))))
