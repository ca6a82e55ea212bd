"""Table operators: order independence, skewed keys, transitions and files."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import (
    accounting, blocks, cache, importing, joins, ledger, navigation, ordinals, packing, parts, recovery, runs, spine,
    verify,
)
from lectern.functions import text
from lectern.functions.text import short_hash
from lectern.session import new_folder
from lectern.sources import archives, jsonl

CACHE = "seq long, key string, translated string, provider string, model string, at string"
LINE = "part_index long, line_no long, custom_id string, status_code int, body string, error string"
NOW = "2026-01-02T00:00:00Z"
GOOD, BAD = "正しい訳文です。", "As an AI, I refuse."
SOURCE = "A plain sentence with several words."


# Ordinals and packing under a dominant key


def test_running_sums_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", i, rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(3)
    got = ordinals.running_sums(df, ["k"], F.floor(F.col("i") / 16), [F.col("i")], {"s": F.col("v"), "n": F.lit(1)})
    seen = {}
    for k, i, v in rows:
        total, n = seen.get(k, (0, 0))
        seen[k] = (total + v, n + 1)
        rows[i] = (k, i, *seen[k])
    assert sorted((r.k, r.i, r.s, r.n) for r in got.collect()) == sorted(rows)


def greedy(sizes, max_rows, max_bytes):
    out, part, n, total = [], 1, 0, 0
    for size in sizes:
        if n >= max_rows or (n and total + size > max_bytes):
            part, n, total = part + 1, 0, 0
        n, total = n + 1, total + size
        out.append(part)
    return out


@pytest.mark.parametrize("max_rows,max_bytes", [(3, 40), (5, 1000), (4, 10), (1, 50)])
def test_packing_equals_greedy(spark, max_rows, max_bytes):
    rng = random.Random(max_rows)
    sizes = {c: [rng.randint(1, 10) for _ in range(n)] for c, n in (("hot", 90), ("one", 1), ("few", 7), ("six", 6))}
    rows = [(c, i, s) for c, xs in sizes.items() for i, s in enumerate(xs, 1)]
    df = spark.createDataFrame(rows, "corpus_id string, rn long, bytes long").repartition(3)
    got = packing.pack_parts(df, max_rows, max_bytes).orderBy("corpus_id", "rn").collect()
    for corpus, xs in sizes.items():
        assert [r.part_index for r in got if r.corpus_id == corpus] == greedy(xs, max_rows, max_bytes)


def test_oversize_request_is_an_error(spark):
    df = spark.createDataFrame([("c", 1, 99)], "corpus_id string, rn long, bytes long")
    with pytest.raises(Exception, match="larger than a part"):
        packing.pack_parts(df, 5, 50).collect()


def test_an_oversize_request_is_a_part_of_its_own(spark):
    sizes = {"first": [99, 3, 4], "mid": [9, 9, 60, 9, 51, 70, 2, 2, 2, 2, 99], "all": [60] * 13}
    rows = [(c, i, s) for c, xs in sizes.items() for i, s in enumerate(xs, 1)]
    df = spark.createDataFrame(rows, "corpus_id string, rn long, bytes long")
    got = packing.pack_parts(df, 3, 50, oversize_alone=True).orderBy("corpus_id", "rn").collect()
    for corpus, xs in sizes.items():
        assert [r.part_index for r in got if r.corpus_id == corpus] == greedy(xs, 3, 50)


def test_spread_join_equals_plain_join(spark):
    rows = [(i, "hot" if i % 3 else (None if i % 2 else f"k{i}")) for i in range(300)]
    left = spark.createDataFrame(rows, "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k6", 2), ("other", 3)], "k string, v int")
    assert joins.hot_values(left, "k", 10) == ["hot"]
    for how in ("left", "inner"):
        spread = joins.spread_join(left, right, "k", ["i"], how, least=10)
        assert sorted(map(str, spread.collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_a_key_of_half_a_percent_is_split(spark):
    rows = spark.createDataFrame([(i, "warm" if i % 200 == 0 else f"k{i}") for i in range(2_000)], "i int, k string")
    assert joins.hot_values(rows, "k", 8) == ["warm"] and joins.hot_values(rows, "k", 10) == []
    spread = joins.spread_join(rows, spark.createDataFrame([("warm", 1)], "k string, v int"), "k", ["i"], least=8)
    assert "_salt" in spread._jdf.queryExecution().optimizedPlan().toString() and spread.where("v = 1").count() == 10


# Cache


def test_first_valid_row_wins_in_any_order(spark):
    rows = [(1, "a", "", "p", "m", "t"), (2, "a", GOOD, "p", "m", "t"), (3, "a", "別の正しい訳。", "p", "m", "t"),
            (4, "b", BAD, "p", "m", "t"), (5, "c", GOOD, "p", "m", "t"), (6, "c", GOOD, "p", "m", "t")]
    sources = spark.createDataFrame([(k, SOURCE) for k in "abc"], "key string, source_text string")
    for order in (rows, rows[::-1]):
        merged = cache.merge_first_valid(spark.createDataFrame(order, CACHE), None, sources).collect()
        assert sorted((r.key, r.seq, r.valid) for r in merged) == [("a", 2, True), ("b", 4, False), ("c", 5, True)]


def test_last_first_and_replaced_rows(spark):
    log = spark.createDataFrame([(1, "a", "x", "p", "m", "t"), (2, "a", "y", "p", "m", "t")], CACHE)
    assert cache.last_rows(log).first().translated == "y"
    assert cache.first_rows(log).first().translated == "x"
    new = spark.createDataFrame([(3, "a", "z", "p", "m", "t", True)], CACHE + ", replace boolean")
    assert cache.replace_rows(log, new).first().translated == "z"


# Import


def items(spark, *rows):
    made = [(i, k, s, h) for i, k, s, h in rows]
    df = spark.createDataFrame(made, "custom_id string, cache_key string, source_text string, source_hash string")
    full = df.withColumn("source_hash", F.coalesce("source_hash", short_hash(F.col("source_text"))))
    extra = {"state": F.lit("submitted"), "last_error": F.lit(None).cast("string"), "updated_at": F.lit("t"),
             "provider": F.lit("p"), "model": F.lit("m")}
    return full.select("*", *[c.alias(n) for n, c in extra.items()])


def body(text):
    return '{"output_text": "%s"}' % text


def outcomes(spark, work, stored, outputs, errors=()):
    lines = importing.import_outputs(
        work, spark.createDataFrame(list(stored), "key string, translated string"),
        spark.createDataFrame(list(outputs), LINE), spark.createDataFrame(list(errors), LINE), NOW,
    )
    return lines, {(r.custom_id, r.line_no): r.outcome for r in lines.lines.collect()}


def test_shared_key_import_order(spark):
    work = items(spark, *[(f"i{n}", "k", SOURCE, None) for n in range(4)])
    outputs = [(1, 9 - n, f"i{n}", 200, body(t), None) for n, t in enumerate([GOOD, BAD, GOOD, BAD])]
    result, got = outcomes(spark, work, [], outputs)
    assert got == {("i3", 6): "rejected", ("i2", 7): "imported", ("i1", 8): "already_cached", ("i0", 9): "already_cached"}
    assert [r.translated for r in result.cache_rows.collect()] == [GOOD]
    again = outcomes(spark, work, [("k", GOOD)], outputs)[1]
    assert set(again.values()) == {"already_cached"}


def test_import_line_faults(spark):
    work = items(spark, ("a", "ka", SOURCE, None), ("b", "kb", SOURCE, "spoiled"), ("c", "kc", SOURCE, None),
                 ("d", "kd", SOURCE, None), ("e", "ke", SOURCE, None), ("f", "kf", SOURCE, None))
    outputs = [(1, 1, "a", 200, body(GOOD), None), (1, 2, "a", 200, body(GOOD), None), (1, 3, "b", 200, body(GOOD), None),
               (1, 4, "c", 500, None, None), (1, 5, "d", None, None, None), (1, 6, "zz", 200, body(GOOD), None),
               (1, 7, "e", 200, body(BAD), None)]
    errors = [(1, 1, "f", None, None, "quota"), (1, 2, "a", None, None, "late")]
    result, got = outcomes(spark, work, [("ke", GOOD)], outputs, errors)
    assert got == {("a", 1): "imported", ("a", 2): "duplicate", ("b", 3): "rejected", ("c", 4): "rejected",
                   ("d", 5): "rejected", ("zz", 6): "unknown", ("e", 7): "already_cached", ("f", 1): "failed"} | {
                       ("a", 2): "duplicate"}
    states = {r.custom_id: (r.state, r.last_error) for r in result.work_items.collect()}
    assert states["f"] == ("failed", "remote batch error: quota")
    assert states["c"] == ("rejected", "batch output status_code was 500")
    assert states["e"] == ("imported", None)


# Ledger


def ledger_rows(spark, *states):
    rows = [(f"i{n}", f"k{n}", 1, n, "x" * (10 - n), s, 1, None, "t") for n, s in enumerate(states)]
    return spark.createDataFrame(
        rows, "custom_id string, cache_key string, page_index long, block_index int, source_text string, state string, "
        "attempt int, last_error string, updated_at string"
    ).withColumn("source_chars", F.length("source_text"))


def stored_keys(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def test_reroute_threshold_and_limit(spark):
    work = ledger_rows(spark, "failed", "imported", "prepared", "local_exhausted", "failed", "local_pending")
    none = stored_keys(spark)
    closed = ledger.reroute(work, none, "page-order", NOW, endgame_threshold=2)
    assert closed.filter("selected").count() == 0
    opened = ledger.reroute(work, none, "page-order", NOW, endgame_threshold=3)
    assert {r.custom_id for r in opened.filter("selected").collect()} == {"i0", "i2", "i3", "i4"}
    cut = ledger.reroute(work, stored_keys(spark, "k0"), "page-order", NOW, states=("failed", "prepared"), limit=1)
    assert {r.custom_id for r in cut.filter("selected").collect()} == {"i2"}
    assert {r.custom_id for r in cut.filter("skipped_finished").collect()} == {"i0", "i1"}
    with pytest.raises(ValueError):
        ledger.reroute(work, none, "page-order", NOW)


def test_retry_skips_cached_and_needs_requests(spark):
    work = ledger_rows(spark, "failed", "rejected", "local_exhausted", "prepared", "failed")
    requests = spark.createDataFrame([(f"i{n}", "b") for n in range(5)], "custom_id string, body string")
    got = ledger.retry_requests(work, stored_keys(spark, "k1"), requests, "short-first", 2).collect()
    assert [r.custom_id for r in got] == ["i4", "i2"]
    with pytest.raises(Exception, match="no request for"):
        ledger.retry_requests(work, stored_keys(spark), requests.limit(1), "short-first").collect()


def test_failure_decisions(spark):
    rows = [("prompt_leak", None, "plain", 1), ("untranslated_segment", None, "see doi:1", 1), ("truncated", None, "plain", 3),
            ("truncated", None, "plain", 1), (None, "HTTP 403", "plain", 1)]
    df = spark.createDataFrame(rows, "r string, e string, s string, n int")
    got = df.select(ledger.exhausts(F.col("r"), F.col("s"), F.col("n")),
                    ledger.failure_action(F.col("r"), F.col("e"), F.col("s"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [
        (True, "retry_translation"), (True, "inspect_reference_or_try_another_provider"),
        (True, "batch_retry_requests_or_try_another_provider"), (False, "retry_translation"), (False, "fix_provider_auth"),
    ]


@pytest.mark.parametrize("statuses,expected", [
    (["completed", "completed"], "completed"), (["completed", "failed"], "failed"),
    (["completed", "in_progress"], "in_progress"), (["submitted", "submitted"], "submitted"),
    (["completed", "submitted"], "partial"), (["prepared", "prepared"], "partial"), ([], "prepared"),
])
def test_status_roll_up(spark, statuses, expected):
    df = spark.createDataFrame([(s,) for s in statuses], "status string")
    assert df.agg(parts.rolled_status().alias("s")).first().s == expected


def test_verification_finds_each_fault(spark):
    spec = ("corpus_id string, page_index long, block_index int, cache_key string, source_hash string, "
            "prompt_hash string, source_chars int, source_text string")
    place = lambda n, h="h": ("c", 1, n, f"k{n}", h, "p", 1, SOURCE)
    expected = spark.createDataFrame([place(1), place(2), place(3), place(4)], spec)
    have = spark.createDataFrame(
        [(*place(1, "other"), "imported"), (*place(2), "prepared"), (*place(3), "skipped"), (*place(9), "prepared")],
        spec + ", state string",
    )
    stored = spark.createDataFrame([("k2", BAD), ("k3", SOURCE)], "key string, translated string")
    found = verify.verify_findings(expected, have, stored).collect()
    assert sorted((r.finding, r.block_index) for r in found) == [
        ("cache_conflict", 1), ("cache_conflict", 2), ("invalid_cache", 2), ("missing", 4), ("orphaned", 9), ("stale", 1)
    ]


# Recovery and accounting


def test_scan_ignores_pages_with_other_counts(spark):
    block = "corpus_id string, page_no long, block_index int, source_text string"
    source = spark.createDataFrame([("c", 1, 1, SOURCE), ("c", 1, 2, SOURCE), ("c", 2, 1, SOURCE)], block)
    output = spark.createDataFrame([("c", 1, 1, SOURCE), ("c", 1, 2, GOOD), ("c", 2, 1, SOURCE), ("c", 2, 2, "x")], block)
    assert [(r.page_no, r.output_blocks) for r in recovery.count_mismatches(source, output).collect()] == [(2, 2)]
    assert [(r.page_no, r.block_index, r.reason) for r in recovery.scan_outputs(source, output).collect()] == [
        (1, 1, "unchanged_source")
    ]


def test_open_run_ends_at_its_heartbeat(spark):
    rows = [(1, 1, 0, "begin"), (1, 2, 120, "heartbeat"), (1, 3, 7200, "begin"), (1, 4, 7210, "finish"),
            (1, 5, 7300, "heartbeat"), (2, 6, 5, "heartbeat"), (2, 7, 9, "begin")]
    df = spark.createDataFrame(rows, "run_key int, event_id int, at long, kind string").withColumn(
        "ts", F.timestamp_seconds("at")
    )
    got = {r.run_key: (r.runs, r.open_runs, r.active_secs) for r in accounting.active_time(df).collect()}
    assert got == {1: (2, 1, 130), 2: (1, 1, 0)}


def test_eta_waits_and_ends(spark):
    rows = [(1, 10, 100, 1000, 299), (1, 10, 100, 1000, 300), (10, 10, 0, 0, 0), (1, 10, 1000, 1000, 900), (1, 10, 0, 0, 9)]
    df = spark.createDataFrame(rows, "p long, n long, d long, c long, s long")
    got = [r[0] for r in df.select(accounting.eta(*[F.col(c) for c in "pndcs"])).collect()]
    assert got == ["ETA pending", "ETA 00:45:00", "ETA done", "ETA done", "ETA pending"]


def test_prefix_must_be_unique(spark):
    df = spark.createDataFrame([("abc1",), ("abd2",)], "run_hash string")
    assert runs.resolve_prefix(df, "abd").first()[0] == "abd2"
    for prefix in ("ab", "x"):
        with pytest.raises(Exception, match="matches"):
            runs.resolve_prefix(df, prefix).collect()


# Markup


def test_strict_blocks(spark):
    pages = [("a", 1, "<body><h1>Title</h1><p>Hello <em>world</em>.</p></body>"),
             ("a", 2, '<div id="t2"><a><div id="popup-t2" class="x">Hi<br/>there.</div></a></div>'),
             ("a", 3, "<ul><li>one<p>two</p></li><li> </li><li>three</li></ul>"), ("a", 4, "<p>open<b>")]
    df = spark.createDataFrame(pages, "corpus_id string, page_no long, html string")
    got = blocks.extract_blocks_strict(df).orderBy("page_no", "block_index").collect()
    assert [(r.page_no, r.block_index, r.source_text) for r in got if r.corrupt_reason is None] == [
        (1, 1, "Title"), (1, 2, "Hello ⟦E1⟧world⟦/E1⟧."), (2, 1, "Hi⟦S1⟧there."),
        (3, 1, "one⟦E1⟧two⟦/E1⟧"), (3, 2, "three"),
    ]
    assert [r.page_no for r in got if r.corrupt_reason] == [4]
    tolerant = blocks.extract_blocks(df.filter("page_no <= 2")).orderBy("page_no", "block_index").collect()
    assert [r.source_text for r in tolerant] == ["Title", "Hello ⟦E1⟧world⟦/E1⟧.", "Hi⟦S1⟧there."]


def test_nested_contents(spark):
    html = ('<nav epub:type="landmarks"><ol><li><a href="x">X</a></li></ol></nav><nav epub:type="toc"><ol>'
            '<li><a href="1">One</a><ol><li><a href="1a">One <i>A</i></a></li></ol></li><li><a>Two</a></li>'
            "<li><a href='e'> </a></li></ol></nav>")
    df = spark.createDataFrame([("c", 1, html)], "corpus_id string, page_no long, html string")
    got = navigation.rendered(navigation.nav_contents(df)).orderBy("pos").collect()
    assert [r.line for r in got] == ["- One -> 1", "  - One A -> 1a", "- Two"]


def test_package_rewrite_keeps_everything_else(spark):
    opf = ('<?xml version="1.0"?><package>\n <metadata a="$1"><dc:Language>en-US</dc:Language>\\ <dc:title>a &amp; b</dc:title>'
           "</metadata><x/></metadata></package>")
    got = spark.createDataFrame([(opf,), ("<package/>",), (None,)], "opf string").select(spine.rewritten_package(F.col("opf"), "m$1 <\\>"))
    first, second, third = [r[0] for r in got.collect()]
    added = ('<dc:contributor id="lectern-translator">lectern (model: m$1 &lt;\\&gt;)</dc:contributor>'
             '<meta refines="#lectern-translator" property="role" scheme="marc:relators">trl</meta>')
    assert first == opf.replace("en-US", "ja").replace("</metadata><x/>", added + "</metadata><x/>")
    assert second == "<package/>" and third is None


def test_package_with_repeated_ids(spark):
    opf = ('<package><manifest><item id="a" href="old.xhtml" media-type="application/xhtml+xml"/>'
           '<item id="a" href="new.xhtml" media-type="application/xhtml+xml"/><item id="i" href="i.png" media-type="image/png"/>'
           '<item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="b" href="b.html" media-type="text/html"/>'
           '</manifest><spine><itemref idref="a"/><itemref idref="i"/><itemref idref="b" linear="no"/></spine></package>')
    df = spark.createDataFrame([("c", opf)], "corpus_id string, opf string")
    got = spine.spine_pages(df).orderBy("page_no").collect()
    assert [(r.page_no, r.href, r.linear) for r in got] == [(1, "new.xhtml", True), (2, "b.html", False)]
    assert spine.contents_source(df).first().ncx_href == "toc.ncx"


# Files


def test_bad_lines_fail_or_are_kept(spark):
    path = new_folder(spark, "bad-lines")
    jsonl.write_text(spark.createDataFrame([('{"a": 1}',), ("",), ("{oops",)], "v string").coalesce(1), path)
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, path, "a int").collect()
    kept = jsonl.read_jsonl(spark, path, "a int", quarantine=True).collect()
    assert sorted(str(r._corrupt_record) for r in kept) == ["None", "{oops"]
    assert jsonl.count_lines(spark, path).first()[0] == 2
    assert jsonl.count_lines(spark, path + "-none").first()[0] == 0


def test_empty_report_leaves_nothing(spark):
    path = new_folder(spark, "empty-report")
    assert jsonl.write_if_any(spark.createDataFrame([], "a int"), path) is False
    assert jsonl.read_optional(spark, path, "a int").count() == 0


def test_archives_round_trip(spark):
    rows = spark.createDataFrame([("b1", "<c/>", "p.xhtml", "<p>é</p>")],
                                 "corpus_id string, container string, href string, html string")
    got = archives.archive_entries(archives.pack_rows(rows)).collect()
    assert {r.path: bytes(r.content).decode() for r in got} == {"META-INF/container.xml": "<c/>", "p.xhtml": "<p>é</p>"}


def test_line_numbers_run_on_across_splits(spark):
    path = new_folder(spark, "numbered")
    lines = [f'{{"a": {i}}}' if i % 7 else ("" if i % 2 else "{oops") for i in range(1, 400)]
    jsonl.write_text(spark.createDataFrame([(x,) for x in lines], "v string").coalesce(1), path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        numbered = jsonl.numbered_lines(spark, path)
        assert numbered.select(F.spark_partition_id()).distinct().count() > 4
        got = {r.line_no: r.value for r in numbered.collect()}
        assert got == dict(enumerate(lines, 1))
        parsed = {r.line_no: (r.row.a, r.error) for r in jsonl.parsed_lines(spark, path, "a int").collect()}
        assert sorted(parsed) == [i for i, x in enumerate(lines, 1) if x]
        bad = {i: e for i, (a, e) in parsed.items() if e}
        assert list(sorted(bad)) == [i for i, x in enumerate(lines, 1) if x == "{oops"] and bad[14].endswith(" line 14")
        with pytest.raises(Exception, match=r"failed to parse .* line \d+"):
            jsonl.read_jsonl_strict(spark, path, "a int").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_last_ledger_row_of_an_id_is_judged_and_moved(spark):
    schema = ("custom_id string, cache_key string, page_index long, block_index int, updated_at string, attempt int, state string, "
              "source_text string, source_hash string, last_error string, provider string, model string")
    old = ("x", "k1", 1, 1, "2026-01-01", 1, "submitted", "old words of it", "?", None, "p", "m")
    new = ("x", "k2", 1, 1, "2026-01-02", 1, "submitted", "new words of it", "?", None, "p", "m")
    other = ("y", "k3", 1, 2, "2026-01-01", 1, "submitted", "other words", "?", None, "p", "m")
    items = spark.createDataFrame([new, old, other], schema).withColumn("source_hash", text.short_hash(F.col("source_text")))
    line = "part_index long, line_no long, custom_id string, status_code int, body string, error string"
    outputs = spark.createDataFrame([(1, 1, "x", 200, '{"output_text": "訳文です。"}', None)], line)
    result = importing.import_outputs(items, spark.createDataFrame([], "key string, translated string"), outputs,
                                      spark.createDataFrame([], line), "2026-02-02")
    assert [(r.custom_id, r.cache_key, r.outcome) for r in result.lines.collect()] == [("x", "k2", "imported")]
    assert sorted((r.cache_key, r.state, r.updated_at) for r in result.work_items.collect()) == [
        ("k1", "submitted", "2026-01-01"), ("k2", "imported", "2026-02-02"), ("k3", "submitted", "2026-01-01")]
    assert [r.key for r in result.cache_rows.collect()] == ["k2"]


def test_traits_of_two_texts_give_the_reason_of_the_texts(spark):
    from lectern.functions.validation import source_traits, target_traits, traits_reason, validation_reason
    rng = random.Random(3)
    pieces = ["", " ", "\u3000", "\n", "⟦E1⟧", "⟦/E1⟧", "⟦S2⟧", "⟦open", "⟦x⟧" * 15, "12, 3", "The Silver Lantern", "said", "I", "Zz ", "訳文", "。",
              "「", "I'm sorry", "申し訳", "<source>", "Σ", "ς", "İ", ".", ")", "some words " * 5, "many more words of it " * 9, "x" * 240, "訳" * 40]
    made = lambda: None if rng.random() < 0.04 else "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))
    pairs = []
    for _ in range(3_000):
        one = made()
        pairs.append((one, rng.choice([made(), one, one and one.upper(), one and "訳文。" + one, one and one.replace(" ", "\u3000 ")])))
    s, t = F.col("s"), F.col("t")
    judged = spark.createDataFrame(pairs, "s string, t string").repartition(4).select(
        validation_reason(s, t).alias("a"), traits_reason(source_traits(s), target_traits(t)).alias("b"))
    counts = {(r.a, r.b): r["count"] for r in judged.groupBy("a", "b").count().collect()}
    assert all(a == b for a, b in counts) and len(counts) == 9


def test_answers_of_imported_lines_are_found_again(spark):
    work = items(spark, ("x", "k1", SOURCE, None), ("y", "k2", SOURCE, None), ("z", "k3", SOURCE, None))
    lines = [(1, 1, "x", 200, body(GOOD), None), (1, 1, "x", 500, body(GOOD), None), (1, 1, "x", 200, body(BAD), None),
             (None, 2, "y", 200, body("別の訳。"), None), (1, 3, "z", 200, body("三つ目の訳。"), None), (1, 3, "z", 200, body("三つ目の訳。"), None)]
    result, _ = outcomes(spark, work, [], lines)
    assert sorted((r.key, r.translated) for r in result.cache_rows.collect()) == [
        ("k1", GOOD), ("k2", "別の訳。"), ("k3", "三つ目の訳。"), ("k3", "三つ目の訳。")]
    assert "answer" not in result.lines.columns


def test_verification_compares_texts_and_rows_without_a_place(spark):
    schema = ("corpus_id string, page_index long, block_index int, custom_id string, cache_key string, source_hash string, "
              "prompt_hash string, source_chars int, source_text string, state string, attempt int, updated_at string")
    row = lambda place, text, state="imported", at="1": (*place, "i", "k" + str(place[2]), "h", "p", 5, text, state, 1, at)
    have = [row(("c", 1, 1), SOURCE + " changed"), row(("c", 1, 2), SOURCE, "skipped"), row((None, 1, 3), SOURCE), row((None, 1, 3), SOURCE),
            row(("c", 1, 4), "older", at="0"), row(("c", 1, 4), SOURCE), row(("c", 1, 5), SOURCE)]
    expected = spark.createDataFrame([row(("c", 1, n), SOURCE) for n in (1, 2, 4, 5)], schema)
    stored = spark.createDataFrame([("k1", GOOD), ("k2", SOURCE), ("k4", GOOD), ("k5", SOURCE + " ")], "key string, translated string")
    found = verify.verify_findings(expected, spark.createDataFrame(have, schema), stored).collect()
    assert sorted((r.finding, r.block_index, r.reason) for r in found) == [
        ("invalid_cache", 5, "provider returned the source text unchanged"), ("orphaned", 3, verify.ORPHANED),
        ("orphaned", 3, verify.ORPHANED), ("stale", 1, "source_text changed")]


def test_whether_a_translation_is_used_needs_no_restored_text(spark):
    from lectern.operators import assembly
    rows = [(1, "hit", "⟦E1⟧訳", ["⟦E1⟧"]), (2, "hit", "訳", ["⟦E1⟧"]), (3, "hit", "⟦E9⟧訳", []), (4, "miss", None, ["⟦E1⟧"]),
            (5, "hit", "", []), (6, "hit", None, []), (7, "invalid", "訳", []), (8, "hit", "訳", None), (9, "hit", "⟦E1⟧⟦E1⟧", ["⟦E1⟧"])]
    status = spark.createDataFrame(
        [("c", 1, i, "p", s, t, "x", m and [(k, "<b>") for k in m]) if m is not None else ("c", 1, i, "p", s, t, "x", None) for i, s, t, m in rows],
        "corpus_id string, page_no int, block_index int, tag string, status string, translated string, source_text string, "
        "inline_map array<struct<marker:string,tag:string>>")
    blocks = assembly.restored_blocks(status)
    assert [r.used for r in blocks.orderBy("block_index").collect()] == [True, False, False, False, True, False, False, False, True]
    assert blocks.filter("used <> (restored is not null)").isEmpty()
    counts = assembly.assembly_status(assembly.assemble_pages(blocks))
    assert counts.first().translated_blocks == 3
    assert "map_from_entries" not in counts._jdf.queryExecution().optimizedPlan().toString()
