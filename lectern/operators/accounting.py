"""Active time, stalls, progress and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import ETA_FIRST_PAGE, ETA_MIN_SECONDS, STALL_REQUESTS, STALL_SECONDS
from lectern.functions.formats import hms
from lectern.operators.ordinals import running_sums


def _hours(ts: Column) -> Column:
    """Time bucket that bounds a window partition of one key."""
    return F.date_trunc("hour", ts)


def active_time(events: DataFrame) -> DataFrame:
    """Active seconds per run key from begin, heartbeat and finish events.

    A run ends at its finish, else at its last heartbeat, else at its start. Events
    before the first begin belong to no run. ``events``: run_key, event_id, ts, kind.
    """
    begins = (F.col("kind") == "begin").cast("long")
    runs = running_sums(events, ["run_key"], _hours(F.col("ts")), [F.col("ts"), F.col("event_id")], {"run": begins})
    at = lambda kind: F.when(F.col("kind") == kind, F.col("ts"))
    per_run = runs.filter("run > 0").groupBy("run_key", "run").agg(
        F.min(at("begin")).alias("begin"),
        F.max(at("heartbeat")).alias("beat"),
        F.min(at("finish")).alias("finish"),
    )
    spent = F.unix_timestamp(F.coalesce("finish", "beat", "begin")) - F.unix_timestamp("begin")
    return per_run.groupBy("run_key").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("finish").isNull()).alias("open_runs"),
        F.sum(F.greatest(spent, F.lit(0))).alias("active_secs"),
    )


def stall_alerts(events: DataFrame, secs: int = STALL_SECONDS, requests: int = STALL_REQUESTS) -> DataFrame:
    """Stretches without a completion that cost too much time and too many requests.

    ``events``: run_key, event_id, ts, completed (boolean); every event is one request.
    A stretch starts at a completion (or the first event) and ends before the next.
    """
    done = F.col("completed").cast("long")
    islands = running_sums(events, ["run_key"], _hours(F.col("ts")), [F.col("ts"), F.col("event_id")], {"island": done})
    elapsed = F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")
    return (
        islands.groupBy("run_key", "island")
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), (F.count("*") - 1).alias("requests"))
        .withColumn("elapsed_secs", elapsed)
        .filter((F.col("elapsed_secs") >= secs) & (F.col("requests") >= requests))
        .select("run_key", "island", "elapsed_secs", "requests")
    )


def progress_work(status: DataFrame) -> DataFrame:
    """Per corpus: blocks, cached blocks and the characters that count towards the ETA.

    ``status`` is the result of ``cache_status``.
    """
    cached = F.col("status") == "hit"
    measured = ~cached & (F.col("page_no") >= ETA_FIRST_PAGE)
    return status.groupBy("corpus_id").agg(
        F.count("*").alias("blocks"),
        F.count_if(cached).alias("cached_blocks"),
        F.sum(F.when(measured, F.length("source_text")).otherwise(0)).alias("uncached_chars"),
    )


def seconds_per_unit(elapsed: Column, units: Column) -> Column:
    return F.when((elapsed > 0) & (units > 0), elapsed / units)


def eta(position: Column, total: Column, done_chars: Column, total_chars: Column, elapsed: Column) -> Column:
    """``ETA done``, ``ETA pending`` or ``ETA HH:MM:SS``."""
    left = F.greatest(total_chars - done_chars, F.lit(0))
    rate = seconds_per_unit(elapsed, done_chars)
    return (
        F.when(position >= total, "ETA done")
        .when(total_chars == 0, "ETA pending")
        .when(left == 0, "ETA done")
        .when(rate.isNull() | (elapsed < ETA_MIN_SECONDS), "ETA pending")
        .otherwise(F.concat(F.lit("ETA "), hms(F.floor(rate * left).cast("long"))))
    )


USAGE_COUNTERS = ("requests", "input_tokens", "output_tokens", "total_tokens")


def usage_totals(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Summed counters per key, with the summary line."""
    sums = usage.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in USAGE_COUNTERS])
    # Fixed format of the summary line; a zero total is left out.
    line = F.concat(
        F.format_string("requests: %d, input tokens: %d, output tokens: %d", *USAGE_COUNTERS[:3]),
        F.when(F.col("total_tokens") > 0, F.format_string(", total tokens: %d", "total_tokens")).otherwise(""),
    )
    return sums.withColumn("summary", line)


def run_stats(status: DataFrame, written_keys: DataFrame) -> DataFrame:
    """Pages, blocks, hits, misses and writes per corpus.

    ``written_keys``: corpus_id, cache_key of rows added by this run.
    """
    seen = status.groupBy("corpus_id").agg(
        F.count_distinct("page_no").alias("pages"),
        F.count("*").alias("blocks"),
        F.count_if(F.col("status") == "hit").alias("hits"),
        F.count_if(F.col("status") != "hit").alias("misses"),
    )
    writes = written_keys.groupBy("corpus_id").agg(F.count("*").alias("writes"))
    return seen.join(writes, "corpus_id", "left").fillna(0, ["writes"])
