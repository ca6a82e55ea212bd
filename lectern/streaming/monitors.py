"""Live counts, windows, sessions and stall alerts."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.config import STALL_REQUESTS, STALL_SECONDS
from lectern.session import new_folder
from lectern.streaming.ingest import run_to_end

#: A run without an event for so long is over, whatever its last event.
FORGET_SECONDS = 90 * 86_400


def collected(spark: SparkSession, stream: DataFrame, mode: str = "append", target: str | None = None,
              checkpoint: str | None = None) -> DataFrame:
    """Run a stream to its end and read what it emitted (in complete mode: the last result).

    With both folders given, a later run goes on from the checkpoint and adds to the target.
    """
    target, checkpoint = target or new_folder(spark, "stream-out"), checkpoint or new_folder(spark, "stream-cp")

    def handle(batch: DataFrame, batch_id: int) -> None:
        folder = target if mode == "complete" else f"{target}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(folder)

    run_to_end(stream, handle, checkpoint, mode)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(target)


def live_state_counts(updates: DataFrame) -> DataFrame:
    return updates.groupBy("state").agg(F.count("*").alias("n"))


def usage_windows(usage: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Usage per closed time window. ``usage``: ts, requests, input_tokens, output_tokens."""
    return (
        usage.withWatermark("ts", delay)
        .groupBy(F.window("ts", width))
        .agg(*[F.sum(c).alias(c) for c in ("requests", "input_tokens", "output_tokens")])
        .select(F.col("window.start").alias("window_start"), "requests", "input_tokens", "output_tokens")
    )


def run_sessions(beats: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """Sessions of a run key that a silence of ``gap`` has closed."""
    return (
        beats.withWatermark("ts", delay)
        .groupBy("run_key", F.session_window("ts", gap).alias("session"))
        .agg(F.count("*").alias("beats"))
        .select("run_key", F.col("session.start").alias("session_start"),
                F.col("session.end").alias("session_end"), "beats")
    )


STALL_STATE = "island bigint, start_us bigint, requests bigint, due_us bigint, alerted boolean, last_us bigint, timer_ms bigint"
STALL_OUT = "run_key bigint, island bigint, at timestamp, silent boolean"
NEVER = -1


class StallWatch(StatefulProcessor):
    """Seven numbers per run: its stretch without completions, when that began, what it cost, when it is due.

    A stretch is due at the later of its begin plus ``secs`` and its ``requests``-th request. It
    gives an alert as soon as an event arrives that is not older than that (its own last request
    included), or, for a run that falls silent, when the watermark gets there: a timer waits for the due time. A run without an
    event for ``forget_secs`` is forgotten by a timer of its own, and its state freed.
    """

    def __init__(self, secs: int, requests: int, forget_secs: int):
        self.secs, self.requests, self.forget_secs = secs, requests, forget_secs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stall", STALL_STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        island, start, used, due, alerted, _, timer = self.state.get() or (0, NEVER, -1, NEVER, False, NEVER, NEVER)
        before = timer
        for event in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            now = _micros(event.ts)
            if due != NEVER and not alerted and due <= now:
                alerted = True
                yield Row(run_key=key[0], island=island, at=_moment(due), silent=False)
            if event.completed:
                island, start, used, due, alerted = island + 1, now, 0, NEVER, False
                continue
            start = now if start == NEVER else start
            used += 1
            if used == self.requests:
                due = max(now, start + self.secs * 1_000_000)
                if due == now:  # this request itself makes the wait too long
                    alerted = True
                    yield Row(run_key=key[0], island=island, at=_moment(due), silent=False)
        waits = due if due != NEVER and not alerted else now + self.forget_secs * 1_000_000
        timer = -(-waits // 1_000)
        if timer != before:
            if before != NEVER:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(timer)
        self.state.update((island, start, used, due, alerted, now, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        island, start, used, due, alerted, last, _ = self.state.get()
        if due != NEVER and not alerted:
            yield Row(run_key=key[0], island=island, at=_moment(due), silent=True)
            timer = max(-(-(last + self.forget_secs * 1_000_000) // 1_000), expiredTimerInfo.getExpiryTimeInMs() + 1)
            self.handle.registerTimer(timer)
            self.state.update((island, start, used, due, True, last, timer))
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def _micros(at: datetime) -> int:
    return (at.replace(tzinfo=None) - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def _moment(micros: int) -> datetime:
    return datetime(1970, 1, 1) + timedelta(microseconds=micros)


def stall_stream(events: DataFrame, secs: int = STALL_SECONDS, requests: int = STALL_REQUESTS,
                 delay: str = "1 hour", forget_secs: int = FORGET_SECONDS) -> DataFrame:
    """One alert per stretch without completions, as soon as it is too long, silent runs included.

    ``events``: run_key, event_id, ts, completed; rows older than the watermark are late and
    count for nothing. The state lives in RocksDB (``with_state_store``).
    """
    return (
        # The processor reads and writes wall clock times, so that no session time zone matters.
        events.select("run_key", "event_id", "completed", "ts")
        .withWatermark("ts", delay)
        .groupBy("run_key")
        .transformWithState(StallWatch(secs, requests, forget_secs), STALL_OUT, "append", "eventTime")
    )
