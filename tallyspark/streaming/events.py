"""Ordered event feeds as streams: each run's events carry a running number; the last one is complete or error."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENT = "run_id string, seq long, ts timestamp, kind string, stage string, progress double, status string"
TERMINAL = ("complete", "error")


def read_events(spark: SparkSession, path: str, schema: str = EVENT, files_a_batch: int = 1000) -> DataFrame:
    """A stream of the JSON lines of files that appear at ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)


def once(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (run_id, seq) once; state is dropped when the watermark passes it, so it does not grow with the feed."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "seq"])


def write_events(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a stream as JSON lines, each event once across restarts."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger or {"availableNow": True}).start()


def latest(events: DataFrame, key: str = "run_id", order: str = "seq") -> DataFrame:
    """(key, seq, stage, status, progress, ended) of each run's last event; progress lies within 0 to 100. Batch or stream (update mode)."""
    last = events.groupBy(key).agg(F.max_by(F.struct(order, "stage", "status", "progress"), order).alias("last"), F.max(F.col("kind").isin(*TERMINAL)).alias("ended"))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("last.progress", F.lit(0.0))))
    return last.select(key, f"last.{order}", "last.stage", "last.status", clamped.alias("progress"), "ended")


def feed_issues(events: DataFrame, key: str = "run_id", order: str = "seq") -> DataFrame:
    """(key, seq, code) of a batch: gap (numbers are missing before it), repeated, or after_end."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(order).over(w)
    ended = F.max(F.col("kind").isin(*TERMINAL)).over(w.rangeBetween(Window.unboundedPreceding, -1))
    rows = events.select(key, order, before.alias("before"), F.coalesce(ended, F.lit(False)).alias("over"))
    codes = F.array_compact(F.array(F.when(F.col(order) > F.col("before") + 1, "gap"), F.when(F.col(order) == F.col("before"), "repeated"), F.when(F.col("over"), "after_end")))
    return rows.select(key, order, F.explode(codes).alias("code"))


def transition_stream(events: DataFrame, allowed: Mapping[str, Sequence[str]], state: str = "status", idle_hours: int | None = None) -> DataFrame:
    """(run_id, seq, code) as a stream: gap, repeated or transition, each run's last number and state kept between batches.

    Within a batch events go by number; one that comes after a later number's batch is ``repeated``
    if its number is not above the last. State is one number and one name a run. A stream that never ends takes ``idle_hours``: the state
    of a run that has been silent for so long goes, and what comes then begins anew. (With it, a query over what is available now waits for timeouts and does not end.)"""
    follow = {k: frozenset(v) for k, v in allowed.items()}

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        last, now = held.get if held.exists else (None, None)
        issues = []
        rows = pd.concat(frames).sort_values("seq", kind="stable")
        for seq, name in zip(rows["seq"].tolist(), rows[state].tolist(), strict=True):
            if last is not None and seq <= last:
                issues.append((key[0], seq, "repeated"))
                continue
            if last is not None and seq > last + 1:
                issues.append((key[0], seq, "gap"))
            if now is not None and name not in follow.get(now, ()):
                issues.append((key[0], seq, "transition"))
            last, now = seq, name
        held.update((last, now))
        if idle_hours:
            held.setTimeoutDuration(idle_hours * 3_600_000)
        yield pd.DataFrame(issues, columns=["run_id", "seq", "code"])

    rows = events.select("run_id", "seq", F.col(state)).where(F.col("seq").isNotNull())
    return rows.groupBy("run_id").applyInPandasWithState(step, "run_id string, seq long, code string", "seq long, state string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_hours else GroupStateTimeout.NoTimeout)


class RunStates(StatefulProcessor):
    """Follows each run by its last number and state, which go at a terminal event or when the run has been silent for too long."""

    def __init__(self, allowed: Mapping[str, Sequence[str]], terminal: Sequence[str], idle_ms: int | None):
        self.allowed, self.terminal, self.idle_ms = {k: frozenset(v) for k, v in allowed.items()}, frozenset(terminal), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, state string, alarm long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, now, alarm = self.last.get() if self.last.exists() else (None, None, None)
        began = last
        for row in sorted(rows, key=lambda r: r.seq):
            if last is not None and row.seq <= last:
                yield Row(run_id=key[0], seq=row.seq, code="repeated")
                continue
            if last is not None and row.seq > last + 1:
                yield Row(run_id=key[0], seq=row.seq, code="gap")
            if now is not None and row.state not in self.allowed.get(now, ()):
                yield Row(run_id=key[0], seq=row.seq, code="transition")
            last, now = row.seq, row.state
            if row.kind in self.terminal:
                last = now = None
        if last is None:
            if began is not None:
                self.last.clear()
                if alarm is not None:
                    self.handle.deleteTimer(alarm)
        else:
            if self.idle_ms and last != began:
                if alarm is not None:
                    self.handle.deleteTimer(alarm)
                alarm = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
                self.handle.registerTimer(alarm)
            self.last.update((last, now, alarm))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self.last.get() if self.last.exists() else None
        if last is not None and last[2] is not None and last[2] <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
            yield Row(run_id=key[0], seq=last[0], code="silent")

    def close(self) -> None:
        pass


def run_states(events: DataFrame, allowed: Mapping[str, Sequence[str]], state: str = "status", terminal: Sequence[str] = TERMINAL, idle_hours: float | None = None) -> DataFrame:
    """(run_id, seq, code) as a stream: gap, repeated or transition, and silent where ``idle_hours`` are given and a run has not been heard of for so long.

    One value a run is kept between batches. It goes with the run's terminal event, so state is as large as the runs that are still
    open; an event after that begins a run anew. The timer of a silent run is moved by each of its events. The session needs the RocksDB state
    store (``spark.sql.streaming.stateStore.providerClass``). A query over what is available now ends, with or without timers."""
    rows = events.where(F.col("seq").isNotNull() & F.col("run_id").isNotNull()).select("run_id", "seq", "kind", F.col(state).alias("state"))
    processor = RunStates(allowed, terminal, int(idle_hours * 3_600_000) if idle_hours else None)
    return rows.groupBy("run_id").transformWithState(processor, "run_id string, seq long, code string", "Append", "ProcessingTime" if idle_hours else "None")
