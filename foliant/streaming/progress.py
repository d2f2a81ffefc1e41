"""Streams: progress of tasks as state, and chunks seen for the first time. Log entries are a projection: `operators.progress.log_entries`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "task_id string, seq long, total long, completed long, progress int"
STATE = "seq long, total long, completed long, progress int"


def step(state: tuple, event: str, total, chunk_index, chunk_total) -> tuple:
    """One event on (total, completed, progress)."""
    have, done, percent = state
    if event == "Started":
        return (int(total) if pd.notna(total) else None), 0, 0
    if event == "Completed":
        return have, have if have is not None else done, 100
    if event == "ChapterFinished":
        return have, done + 1, share(have, done + 1, 0.0)
    if event == "ChunkFinished" and pd.notna(chunk_total) and chunk_total > 0:
        return have, done, share(have, done, (chunk_index + 1) / chunk_total)
    return state


def share(total, done: int, flight: float) -> int:
    return int(min((done + flight) * 100 / total, 100)) if total else 0


def fold(events: DataFrame, idle: int | None = None) -> DataFrame:
    """A stream of (task_id, seq, event, total, chunk_index, chunk_total) as its tasks' states, one row per task and batch.

    Events of a task must come in order of seq over batches; within one they are sorted. Older ones than the state's are
    left out, so a batch that is run again changes nothing. Only the live run of a task matters: of the events that come
    at once those before the last start are dropped as they are read. With `idle` a task's state ends after so many
    milliseconds without events; such a stream always has a further batch to run, so it isn't for a trigger that ends.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seq, total, done, percent = state.get if state.exists else (-1, None, 0, 0)
        rows, since = [], seq
        for b in batches:
            b = b[(b["seq"] > seq) & (b["seq"] >= since)]
            starts = b.loc[b["event"] == "Started", "seq"]
            if len(starts) and starts.max() > since:
                since = int(starts.max())
                rows = [r[r["seq"] >= since] for r in rows]
                b = b[b["seq"] >= since]
            rows.append(b)
        for r in pd.concat(rows).sort_values("seq").itertuples(index=False):
            (total, done, percent), seq = step((total, done, percent), r.event, r.total, r.chunk_index, r.chunk_total), int(r.seq)
        state.update((seq, total, done, percent))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame([(key[0], seq, total, done, percent)], columns=["task_id", "seq", "total", "completed", "progress"])

    return events.groupBy("task_id").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout)


def first_seen(chunks: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Chunks whose key didn't come before within the watermark: what a stream sends on to be translated."""
    return chunks.withWatermark(time, delay).dropDuplicatesWithinWatermark(["cache_key"])
