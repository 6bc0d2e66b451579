"""Twins of the event rules on streams.

Event time is a TIMESTAMP column ``ts``. State is keyed and expires by watermark, so it does not grow with the past.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairnfield.operators.events import RATE_LIMIT, RATE_WINDOW_MS


def rate_limit(events: DataFrame, limit: int = RATE_LIMIT, window_ms: int = RATE_WINDOW_MS, delay: str = "10 minutes") -> DataFrame:
    """(user_id, event_id, allowed) as events come in; a window begins with the first event after the last window."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        out = []
        for us, event in zip(rows["us"], rows["event_id"]):
            if start < 0 or us - start > window_ms * 1000:
                start, count = int(us), 0
            count += 1
            out.append((key[0], int(event), count <= limit))
        state.update((start, count))
        state.setTimeoutTimestamp(max(start // 1000 + window_ms + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed"])

    rows = events.withWatermark("ts", delay).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, allowed boolean", "start bigint, count int", "append", GroupStateTimeout.EventTimeTimeout)


def debounce(events: DataFrame, gap: str = "300 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """(user_id, first, fire, events): bursts, each fired a gap after its last event."""
    window = F.session_window("ts", gap)
    grouped = events.withWatermark("ts", delay).groupBy("user_id", window).agg(F.count("*").alias("events"))
    return grouped.select("user_id", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("fire"), "events")


def latest_state(updates: DataFrame) -> DataFrame:
    """Last published state of each note, for update mode."""
    return updates.groupBy("vault_id", "path").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"))


def watch(files: DataFrame, on_change: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "5 minutes"):
    """Run ``on_change(listing, batch id)`` for each micro-batch of a file listing stream.

    A file source alone sees neither edits nor deletes: the callback compares the listing with the stored state
    (``ingest.sync_diff``) and writes the next state.
    """
    return files.writeStream.foreachBatch(on_change).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def affected(changes: DataFrame, connections: DataFrame) -> DataFrame:
    """Connections that each permission change of a stream concerns; ``connections`` is static and read anew each batch."""
    by_user = changes.select("change_id", F.explode("user_ids").alias("user_id")).join(connections.select("connection_id", "user_id"), "user_id").select("change_id", "connection_id")
    by_vault = changes.select("change_id", F.explode("vault_ids").alias("vault_id")).join(connections.select("connection_id", "vault_id"), "vault_id").select("change_id", "connection_id")
    return by_user.unionByName(by_vault)
