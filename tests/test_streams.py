"""Streams that stop and go on: timers, state and what a restart keeps."""

from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from lectern.functions.text import short_hash
from lectern.session import new_folder
from lectern.streaming import ingest, monitors

EVENTS = "run_key long, event_id long, ts timestamp, completed boolean"
START = datetime(2026, 1, 1)


def event(run, number, minutes, completed=False):
    return (run, number, START + timedelta(minutes=minutes), completed)


class Log:
    """A folder of event files and a stall watch over it that can be stopped and started."""

    def __init__(self, spark, **options):
        self.spark, self.options = spark, {"secs": 600, "requests": 3, "delay": "0 seconds", **options}
        self.source, self.target, self.checkpoint = (new_folder(spark, x) for x in ("log", "out", "cp"))

    def run(self, rows):
        frame = self.spark.createDataFrame(rows, EVENTS)
        frame.coalesce(1).write.mode("append").parquet(self.source)
        stream = monitors.stall_stream(ingest.file_stream(self.spark, self.source, frame.schema), **self.options)
        out = monitors.collected(self.spark, stream, target=self.target, checkpoint=self.checkpoint)
        return sorted((r.run_key, r.island, (r["at"] - START) / timedelta(minutes=1), r.silent) for r in out.collect())


def test_a_silent_run_alerts_when_the_clock_gets_there_also_after_a_restart(spark):
    log = Log(spark)
    # Run 1 falls silent after its requests; run 2 completes in time; run 3 has too few requests.
    assert log.run([event(1, i, i) for i in range(4)] + [event(2, 10 + i, i) for i in range(4)] + [event(3, 20, 0), event(3, 21, 1)]) == []
    assert log.run([event(2, 14, 5, True), event(9, 30, 9)]) == []
    # Nothing new of run 1: the watermark alone passes its tenth minute.
    assert log.run([event(9, 31, 11)]) == [(1, 0, 10.0, True)]
    assert log.run([event(1, 5, 12), event(9, 32, 40)]) == [(1, 0, 10.0, True)]


def test_an_event_after_the_due_time_alerts_and_a_completion_starts_anew(spark):
    log = Log(spark)
    rows = [event(1, i, i) for i in range(4)] + [event(1, 4, 11), event(1, 5, 12, True)] + [event(1, 6 + i, 13 + i) for i in range(3)]
    assert log.run(rows) == [(1, 0, 10.0, False)]
    assert log.run([event(1, 20, 23, True), event(2, 21, 24)]) == [(1, 0, 10.0, False), (1, 1, 22.0, False)]


def test_the_request_that_makes_a_wait_too_long_alerts_at_once(spark):
    # The last event of the run is its third request after its tenth minute; the watermark does not get past it.
    assert Log(spark, delay="1 hour").run([event(1, 0, 0), event(1, 1, 1), event(1, 2, 2), event(1, 3, 11)]) == [(1, 0, 11.0, False)]


def test_events_whose_ids_do_not_follow_their_times_count(spark, tmp_path):
    from tests.compare import database, differences
    from lectern.plans.catalog import ORACLES, QUERIES

    given = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    copy = given.withColumn("event_id", F.col("event_id") + 10**9).withColumn("user_id", F.col("user_id") + 10**6)
    given.unionByName(copy).coalesce(1).write.parquet(f"file://{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "events.parquet")
    for name in ("stream_stall_silent", "stream_sessions", "stream_usage_window"):
        result = QUERIES[name](spark, str(tmp_path))
        assert differences(result, database(str(tmp_path)), ORACLES[name]) is None


def test_state_of_an_old_run_is_freed(spark):
    log = Log(spark, forget_secs=3_600)
    log.run([event(1, 0, 0, True), event(1, 1, 1)])
    log.run([event(9, 2, 200)])
    log.run([event(9, 3, 201)])
    # Had run 1 been kept, its next stretch would be the second one.
    assert (1, 0, 212.0, True) in log.run([event(1, 4 + i, 202 + i) for i in range(4)] + [event(9, 9, 230)]) + log.run([event(9, 10, 231)])


CACHE = "seq long, key string, translated string"


def test_ingest_goes_on_from_its_checkpoint_and_keeps_first_rows(spark):
    source, target, checkpoint = (new_folder(spark, x) for x in ("log", "out", "cp"))

    def run(rows):
        frame = spark.createDataFrame(rows, CACHE)
        frame.repartition(3).write.mode("append").parquet(source)
        out = ingest.ingest_cache(spark, source, frame.schema, target, checkpoint, files=10)
        return sorted((r.key, r.seq, r.translated) for r in out.collect())

    assert run([(3, "a", "x"), (1, "a", "first"), (2, "b", None)]) == [("a", 1, "first"), ("b", 2, None)]
    got = run([(4, "a", "late"), (5, "c", "new"), (5, "c", "new")])
    assert got == [("a", 1, "first"), ("b", 2, None), ("c", 5, "new")]
    assert run([(0, "b", "later file")]) == got


def test_first_rows_are_found_across_arrow_batches(spark):
    schema = spark.createDataFrame([], CACHE).schema
    batches = [pa.RecordBatch.from_pydict({"seq": s, "key": k, "translated": [str(x) for x in s]}) for s, k in (
        ([5, 6], ["a", "b"]), ([4, 7, 1], ["a", "b", "c"]))]
    out = [r for b in ingest._first_of_batch(schema)(iter(batches)) for r in b.to_pylist()]
    assert sorted((r["key"], r["seq"], r["translated"]) for r in out) == [("a", 4, "4"), ("b", 6, "6"), ("c", 1, "1")]


LINES = "part_index long, line_no long, custom_id string, status_code int, body string, error string"
ITEMS = ("custom_id string, cache_key string, page_index long, block_index int, updated_at string, attempt int, state string, "
         "source_text string, source_hash string")


def test_import_goes_on_with_the_ids_and_keys_of_earlier_files(spark):
    source, folder = new_folder(spark, "lines"), new_folder(spark, "import")
    rows = [(f"id{i}", f"k{i % 3}", 1, i, "2026", 1, "submitted", "the source text here", "?") for i in range(6)]
    rows += [("id7", "k7", 1, 7, "2026-01", 1, "submitted", "old text of it", "?"), ("id7", "k8", 1, 7, "2026-02", 1, "submitted", "the source text here", "?")]
    items = spark.createDataFrame(rows, ITEMS).withColumn("source_hash", short_hash(F.col("source_text")))
    cache = spark.createDataFrame([("k2", "訳文です。")], "key string, translated string")

    def run(*lines):
        frame = spark.createDataFrame([(p, n, i, 200, f'{{"output_text":"{text}"}}', None) for p, n, i, text in lines], LINES)
        frame.coalesce(1).write.mode("append").parquet(source)
        out = ingest.import_stream(spark, source, frame.schema, items, cache, folder=folder)
        return {(r.part_index, r.line_no): (r.custom_id, r.cache_key, r.outcome) for r in out.collect()}

    first = run((1, 1, "id0", ""), (1, 3, "id3", "訳文。"), (1, 4, "id0", "訳文。"), (1, 5, "id2", "訳"), (1, 6, "nobody", "x"))
    assert first == {(1, 1): ("id0", "k0", "rejected"), (1, 3): ("id3", "k0", "imported"), (1, 4): ("id0", "k0", "duplicate"),
                     (1, 5): ("id2", "k2", "already_cached"), (1, 6): ("nobody", None, "unknown")}
    second = run((2, 1, "id3", "訳文。"), (2, 2, "id1", "訳文。"), (2, 3, "id4", ""), (2, 4, "nobody", "x"), (2, 5, "id7", "訳文。"))
    assert second == first | {(2, 1): ("id3", "k0", "duplicate"), (2, 2): ("id1", "k1", "imported"), (2, 3): ("id4", "k1", "already_cached"),
                              (2, 4): ("nobody", None, "duplicate"), (2, 5): ("id7", "k8", "imported")}


def test_a_stream_stores_no_texts_and_its_imported_lines_find_their_answers(spark):
    from lectern.operators.importing import imported_answers
    rows = [(f"id{i}", f"k{i}", 1, i, "2026", 1, "submitted", "the source text here", "?") for i in range(3)]
    items = spark.createDataFrame(rows, ITEMS).withColumn("source_hash", short_hash(F.col("source_text")))
    source, folder = new_folder(spark, "lines"), new_folder(spark, "import")
    lines = spark.createDataFrame([(1, i, f"id{i % 3}", 200, '{"output_text":"訳文%d。"}' % i, None) for i in range(5)], LINES)
    lines.coalesce(1).write.parquet(source)
    out = ingest.import_stream(spark, source, lines.schema, items, spark.createDataFrame([], "key string, translated string"), folder=folder)
    found = imported_answers(out, spark.read.schema(lines.schema).parquet(source))
    assert sorted((r.cache_key, r.answer) for r in found.collect()) == [("k0", "訳文0。"), ("k1", "訳文1。"), ("k2", "訳文2。")]
    for name in ("ledger", "opened", "judged", "outcomes"):
        assert not {"source_text", "body", "answer"} & set(spark.read.parquet(f"{folder}/{name}").columns)


def test_import_keeps_no_ledger_row_as_state_and_every_line_that_comes_again(spark, monkeypatch):
    from pyspark.sql.streaming import StreamingQuery

    held, wait = [], StreamingQuery.awaitTermination

    def ended(query):
        wait(query)
        held.append(sum(operator.numRowsTotal for operator in query.lastProgress.stateOperators))

    monkeypatch.setattr(StreamingQuery, "awaitTermination", ended)
    rows = [(f"id{i}", f"k{i}", 1, i, "2026", 1, "submitted", "the source text here", "?") for i in range(500)]
    items = spark.createDataFrame(rows, ITEMS).withColumn("source_hash", short_hash(F.col("source_text")))
    source = new_folder(spark, "lines")
    line = spark.createDataFrame([(1, 1, "id1", 200, '{"output_text":"訳文。"}', None), (1, 2, None, 200, "{}", None)], LINES)
    for _ in range(2):  # The second file is the first one again, line for line.
        line.coalesce(1).write.mode("append").parquet(source)
    cache = spark.createDataFrame([], "key string, translated string")
    out = ingest.import_stream(spark, source, line.schema, items, cache)
    assert sorted((r.line_no, r.outcome) for r in out.collect()) == [(1, "duplicate"), (1, "imported"), (2, "duplicate"), (2, "unknown")]
    assert held and max(held) < 100
