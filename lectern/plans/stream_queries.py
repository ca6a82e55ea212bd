"""The streaming operators, run to the end of stored files."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import STALL_REQUESTS, STALL_SECONDS
from lectern.plans import oracle as o
from lectern.plans.registry import query
from lectern.plans.tables import Tables
from lectern.session import new_folder
from lectern.streaming import ingest, monitors

FILES, FILES_A_BATCH = 12, 4
GAP_HOURS = 6


def clock(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def _in_files(df: DataFrame, key: str | tuple[str, ...], label: str) -> str:
    """Store a table in one write as files in the order of a key, dated in that order, as a log would have grown."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    keys = (key,) if isinstance(key, str) else key
    df.repartitionByRange(FILES, *keys).sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().toString() for f in system.listStatus(folder) if f.getPath().getName().startswith("part-"))
    for age, name in enumerate(reversed(names)):
        system.setTimes(spark._jvm.org.apache.hadoop.fs.Path(name), int((time.time() - 60 - age) * 1000), -1)
    return path


def _events(t: Tables) -> DataFrame:
    """Event stream in the order of its times: ids need not follow them, and an event behind the watermark is lost."""
    events = t.run_events()
    return ingest.file_stream(t.spark, _in_files(events, ("ts", "event_id"), "stream-events"), events.schema, FILES_A_BATCH)


@query("stream_cache_ingest", o.sql("""
  SELECT key, min(seq) AS seq FROM cache_log GROUP BY key""", "cache_log"))
def stream_cache_ingest(t: Tables) -> DataFrame:
    rows = t.cache_rows()
    path = _in_files(rows, "seq", "stream-cache-log")
    return ingest.ingest_cache(t.spark, path, rows.schema, files=FILES_A_BATCH).select("key", "seq")


@query("stream_import", o.sql("""
  SELECT part_index, line_no, custom_id, outcome, message FROM import_lines WHERE stream = 0""", "import_lines"))
def stream_import(t: Tables) -> DataFrame:
    outputs = t.outputs()
    path = _in_files(outputs, "part_index", "stream-outputs")
    lines = ingest.import_stream(t.spark, path, outputs.schema, t.items(), t.cache_traits(), FILES_A_BATCH)
    return lines.select("part_index", "line_no", "custom_id", "outcome", "message")


def _stalls_sql(secs: int, requests: int) -> str:
    return o.sql(f"""
  SELECT run_key, island, strftime(due, '%Y-%m-%d %H:%M:%S.%f') AS at, due > last_ts AND next_ts IS NULL AS waited
  FROM (SELECT *, lead(start_ts) OVER (PARTITION BY run_key ORDER BY island) AS next_ts FROM (
    SELECT run_key, island, min(ts) AS start_ts, max(ts) AS last_ts,
      greatest(min(ts) + INTERVAL {secs} SECOND, min(CASE WHEN request = {requests} THEN ts END)) AS due,
      count(*) - 1 AS requests
    FROM (SELECT *, row_number() OVER (PARTITION BY run_key, island ORDER BY ts, event_id) - 1 AS request FROM (
      SELECT *, sum(completed::INT) OVER (PARTITION BY run_key ORDER BY ts, event_id)::BIGINT AS island FROM run_events))
    GROUP BY run_key, island))
  WHERE requests >= {requests}
    AND due <= coalesce(next_ts, greatest(last_ts, (SELECT max(ts) - INTERVAL 1 HOUR FROM run_events)))""", "run_events")


def _stalls(t: Tables, secs: int, requests: int) -> DataFrame:
    """``waited``: no event after the due time ended the wait, only the clock did."""
    alerts = monitors.collected(t.spark, monitors.stall_stream(_events(t), secs, requests))
    last = t.run_events().groupBy("run_key").agg(F.max("ts").alias("last_ts"))
    return alerts.join(last, "run_key").select("run_key", "island", clock("at"), (F.col("at") > F.col("last_ts")).alias("waited"))


@query("stream_stall", _stalls_sql(STALL_SECONDS, STALL_REQUESTS))
def stream_stall(t: Tables) -> DataFrame:
    return _stalls(t, STALL_SECONDS, STALL_REQUESTS)


@query("stream_stall_silent", _stalls_sql(4 * 86_400, 5))
def stream_stall_silent(t: Tables) -> DataFrame:
    """Long waits for few requests, most of which end in silence: the timer gives those alerts."""
    return _stalls(t, 4 * 86_400, 5)


@query("stream_state_counts", o.sql("SELECT state, count(*) AS n FROM work_items GROUP BY state", "work_items"))
def stream_state_counts(t: Tables) -> DataFrame:
    items = t.items().select("state", "page_index")
    stream = ingest.file_stream(t.spark, _in_files(items, "page_index", "stream-items"), items.schema, FILES_A_BATCH)
    return monitors.collected(t.spark, monitors.live_state_counts(stream), "complete")


@query("stream_usage_window", """
  SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, count(*) AS requests, sum(length(props))::BIGINT AS input_tokens,
    sum(floor(value)::BIGINT)::BIGINT AS output_tokens
  FROM events GROUP BY date_trunc('hour', ts)
  HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_usage_window(t: Tables) -> DataFrame:
    usage = t.given("events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(1).cast("long").alias("requests"), F.length("props").alias("input_tokens"),
        F.floor("value").alias("output_tokens"),
    )
    stream = ingest.file_stream(t.spark, _in_files(usage, ("ts", "event_id"), "stream-usage"), usage.schema, FILES_A_BATCH)
    windows = monitors.collected(t.spark, monitors.usage_windows(stream))
    return windows.withColumn("window_start", clock("window_start"))


@query("stream_sessions", o.sql(f"""
  SELECT run_key, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
    strftime(max(ts) + INTERVAL {GAP_HOURS} HOUR, '%Y-%m-%d %H:%M:%S.%f') AS session_end, count(*) AS beats
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY run_key ORDER BY ts, event_id) AS s FROM (
    SELECT *, (ts >= coalesce(lag(ts) OVER (PARTITION BY run_key ORDER BY ts, event_id) + INTERVAL {GAP_HOURS} HOUR,
      TIMESTAMP '1970-01-01'))::INT AS fresh FROM run_events))
  GROUP BY run_key, s
  HAVING max(ts) + INTERVAL {GAP_HOURS} HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM run_events)""", "run_events"))
def stream_sessions(t: Tables) -> DataFrame:
    sessions = monitors.collected(t.spark, monitors.run_sessions(_events(t), f"{GAP_HOURS} hours"))
    return sessions.select("run_key", clock("session_start"), clock("session_end"), "beats")
