"""Cache, run, usage and accounting queries."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import EngineConfig
from lectern.functions import text
from lectern.operators import accounting, runs
from lectern.operators import cache as cache_ops
from lectern.operators import glossary as glossary_ops
from lectern.operators import requests
from lectern.plans import oracle as o
from lectern.plans.registry import query
from lectern.plans.tables import AT, BLOCK_IDS, CFG, NOW, KANA_LETTERS, LATIN_LETTERS, Tables
from lectern.plans.text_queries import chunk_ctes
from lectern.session import new_folder

SHOW_RUN = hashlib.sha256(b"src0").hexdigest()[:32]
RETENTION_DAYS = 20



def text_hash() -> Column:
    return text.short_hash(F.col("translated")).alias("hash")


@query("cache_scan_last", o.sql(f"""
  SELECT key, seq, {o.short_hash('translated')} AS hash FROM cache_log
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1""", "cache_log"))
def cache_scan_last(t: Tables) -> DataFrame:
    return cache_ops.last_rows(t.cache_rows()).select("key", "seq", text_hash())


@query("cache_merge_first_wins", o.sql(f"""
  SELECT key, seq, {o.short_hash('translated')} AS hash FROM cache_log
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq) = 1""", "cache_log"))
def cache_merge_first_wins(t: Tables) -> DataFrame:
    return cache_ops.first_rows(t.cache_rows()).select("key", "seq", text_hash())


@query("cache_merge_first_valid", o.sql(f"""
  SELECT key, seq, {o.short_hash('translated')} AS hash, r IS NULL AS valid FROM (
    SELECT *, {o.reason('source_text', 'translated')} AS r FROM cache_log)
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY r IS NOT NULL, seq) = 1""", "cache_log"))
def cache_merge_first_valid(t: Tables) -> DataFrame:
    merged = cache_ops.merge_first_valid(t.cache_rows(), None, cache_ops.key_sources(t.keyed()))
    return merged.select("key", "seq", text_hash(), "valid")


@query("cache_replace", o.sql(f"""
  SELECT key, {o.short_hash('translated')} AS hash, replaced FROM (
    SELECT key, seq, translated, false AS replaced FROM cache_log
    UNION ALL SELECT cache_key, 1000000000000000 + doc_id * 1000000 + block_index, {o.kana('source_text')}, true FROM failures
      WHERE reason = 'inline_restore_failed')
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY replaced DESC, CASE WHEN replaced THEN -seq ELSE seq END) = 1""",
    "cache_log", "failures"))
def cache_replace(t: Tables) -> DataFrame:
    forced = t.failures().filter("reason = 'inline_restore_failed'").select(
        (F.lit(10**15) + F.col("doc_id") * 1000000 + F.col("block_index")).alias("seq"), F.col("cache_key").alias("key"),
        t.kana(F.col("source_text")).alias("translated"), F.lit(CFG.provider).alias("provider"),
        F.lit(CFG.model_name).alias("model"), F.lit(NOW).alias("at"), F.lit(True).alias("replace"),
    )
    return cache_ops.replace_rows(t.cache_rows(), forced).select("key", text_hash(), "replaced")


@query("cache_lookup", o.sql("""
  SELECT corpus_id, count(c.key) AS hits, count(*) - count(c.key) AS misses
  FROM keyed k LEFT JOIN cache c ON c.key = k.cache_key GROUP BY corpus_id""", "keyed", "cache"))
def cache_lookup(t: Tables) -> DataFrame:
    return cache_ops.lookup_stats(t.keyed(), t.cache_keys())


@query("cache_status", o.sql("SELECT doc_id, block_index, status, reason FROM status", "status"))
def cache_status(t: Tables) -> DataFrame:
    return cache_ops.cache_status(t.keyed(), t.cache(), BLOCK_IDS).select(*BLOCK_IDS, "status", "reason")


@query("cache_conflicts", o.sql("""
  SELECT key, count(DISTINCT translated) AS texts, count(*) AS rows FROM cache_log GROUP BY key
  HAVING count(DISTINCT translated) > 1""", "cache_log"))
def cache_conflicts(t: Tables) -> DataFrame:
    return cache_ops.conflicts(t.cache_rows())


# Runs


@query("manifest_upsert", f"""
  SELECT corpus_id, (CASE WHEN old THEN 7 ELSE 1 END)::BIGINT AS schema_version, sha256(corpus_id) AS sha256,
    corpus_id || '.epub' AS path, docs AS size_bytes, '{CFG.model_name}' AS model,
    CASE WHEN old THEN '{AT}' ELSE '{NOW}' END AS started_at, '{NOW}' AS last_updated_at,
    CASE WHEN old THEN docs ELSE 0 END AS active_elapsed_secs,
    CASE WHEN docs % 2 = 0 THEN 'new.epub' WHEN old THEN 'old.epub' END AS last_output_path
  FROM (SELECT source AS corpus_id, count(*) AS docs, min(doc_id) % 3 = 0 AS old FROM documents GROUP BY source)""")
def manifest_upsert(t: Tables) -> DataFrame:
    now = t.runs().select(
        "corpus_id", F.sha2("corpus_id", 256).alias("sha256"), F.concat("corpus_id", F.lit(".epub")).alias("path"),
        F.col("docs").alias("size_bytes"), F.lit(AT).alias("mtime"), F.lit(CFG.model_name).alias("model"),
        F.when(F.col("docs") % 2 == 0, "new.epub").alias("last_output_path"),
    )
    old = t.runs().filter("first_doc % 3 = 0").select(
        "corpus_id", F.lit(7).alias("schema_version"), F.sha2("corpus_id", 256).alias("sha256"),
        F.lit("old").alias("path"), F.lit(0).cast("long").alias("size_bytes"), F.lit("x").alias("mtime"),
        F.lit("old-model").alias("model"), F.lit(AT).alias("started_at"), F.lit(AT).alias("last_updated_at"),
        F.col("docs").alias("active_elapsed_secs"), F.lit("old.epub").alias("last_output_path"),
    )
    return runs.upsert_manifests(old, now, NOW).drop("mtime")


def run_folder(t: Tables) -> str:
    """The translations of each run as text files in a folder of its own."""
    path = new_folder(t.spark, "runs")
    lines = t.cache_log().select(text.short_hash(F.col("corpus_id")).alias("run_hash"), "translated")
    lines.write.partitionBy("run_hash").text(path)
    return path


def inventory(t: Tables) -> DataFrame:
    segments = t.run_files().select("run_hash")
    return runs.inventory(t.runs(), segments, runs.run_files(t.spark, run_folder(t)), t.recovery_files())


@query("run_bytes", o.sql(f"""
  SELECT {o.RUN_HASH} AS run_hash, sum(strlen(translated) + 1)::BIGINT AS bytes FROM cache_log GROUP BY 1""", "cache_log"))
def run_bytes(t: Tables) -> DataFrame:
    """Bytes on disk of each run, from the metadata of its files."""
    return runs.run_files(t.spark, run_folder(t)).groupBy("run_hash").agg(F.sum("bytes").alias("bytes"))


INVENTORY_SQL = f"""
  SELECT r.*, coalesce(segments, 0) AS segments, coalesce(size_bytes, 0)::BIGINT AS size_bytes,
    coalesce(logs, 0) AS recovery_logs, coalesce(items, 0)::BIGINT AS recovery_items,
    coalesce(failed, 0)::BIGINT AS failed_items
  FROM runs r
  LEFT JOIN (SELECT {o.RUN_HASH} AS run_hash, count(*) AS segments, sum(strlen(translated) + 1) AS size_bytes
    FROM cache_log GROUP BY 1) USING (run_hash)
  LEFT JOIN (SELECT run_hash, count(*) FILTER (items > 0) AS logs, sum(items) AS items, sum(failed) AS failed FROM (
    SELECT run_hash, output, count(*) FILTER (file = 'recovery') AS items, count(*) FILTER (file = 'failed') AS failed
    FROM recovery_files GROUP BY ALL) GROUP BY run_hash) USING (run_hash)"""
RECOVERY_TEXT = """CASE WHEN recovery_logs = 0 AND failed_items = 0 THEN '-'
  WHEN failed_items > 0 THEN recovery_logs || '/' || recovery_items || '+' || failed_items || 'f'
  ELSE recovery_logs || '/' || recovery_items END"""
SIZE_TEXT = """CASE WHEN size_bytes >= 1048576 THEN printf('%.2f MB', size_bytes / 1048576.0::DOUBLE)
  WHEN size_bytes >= 1024 THEN printf('%.2f KB', size_bytes / 1024.0::DOUBLE) ELSE size_bytes || ' B' END"""


def _inventory_sql(body: str) -> str:
    return o.sql(body, "runs", "cache_log", "recovery_files", inventory=INVENTORY_SQL)


@query("cache_inventory", _inventory_sql(f"""
  SELECT run_hash, corpus_id, last_updated_at, segments, size_bytes, {SIZE_TEXT} AS size, {RECOVERY_TEXT} AS recovery
  FROM inventory"""))
def cache_inventory(t: Tables) -> DataFrame:
    return inventory(t).select(
        "run_hash", "corpus_id", "last_updated_at", "segments", "size_bytes", "size", "recovery"
    ).orderBy(F.desc_nulls_last("last_updated_at"), "run_hash")


@query("recovery_inventory", o.sql("""
  SELECT run_hash, output, count(*) FILTER (file = 'recovery') AS items, count(*) FILTER (file = 'failed') AS failed_items
  FROM recovery_files GROUP BY ALL""", "recovery_files"))
def recovery_inventory(t: Tables) -> DataFrame:
    return runs.recovery_counts(t.recovery_files())


@query("resolve_prefix", o.sql(
    f"SELECT min(run_hash) AS run_hash FROM runs WHERE starts_with(run_hash, '{SHOW_RUN[:8]}')", "runs"))
def resolve_prefix(t: Tables) -> DataFrame:
    return runs.resolve_prefix(t.runs(), SHOW_RUN[:8])


@query("newest_log", o.sql("""
  SELECT run_hash, output, mtime FROM (SELECT DISTINCT run_hash, output, mtime FROM recovery_files)
  QUALIFY row_number() OVER (PARTITION BY run_hash ORDER BY mtime DESC, output DESC) = 1""", "recovery_files"))
def newest_log(t: Tables) -> DataFrame:
    return runs.newest_logs(t.recovery_files())


@query("retention_plan", o.sql(f"""
  SELECT run_hash, coalesce(try_cast(last_updated_at AS TIMESTAMPTZ)
    < TIMESTAMPTZ '{NOW}' - INTERVAL {RETENTION_DAYS} DAY, false) AS expired FROM runs""", "runs"))
def retention_plan(t: Tables) -> DataFrame:
    return runs.retention_plan(t.runs(), RETENTION_DAYS, NOW).select("run_hash", "expired")


@query("retention_totals", _inventory_sql(f"""
  SELECT coalesce(try_cast(last_updated_at AS TIMESTAMPTZ) < TIMESTAMPTZ '{NOW}' - INTERVAL {RETENTION_DAYS} DAY, false) AS expired,
    count(*) AS runs, sum(size_bytes)::BIGINT AS bytes, sum(segments)::BIGINT AS segments FROM inventory GROUP BY 1"""))
def retention_totals(t: Tables) -> DataFrame:
    """Runs that go and stay, with the bytes that are freed and kept."""
    return runs.plan_totals(runs.retention_plan(inventory(t), RETENTION_DAYS, NOW))


@query("run_params", o.sql(f"""
  SELECT corpus_id, '{CFG.provider}' AS provider, '{CFG.model_name}' AS model, 'v2' AS prompt_version,
    'essay' AS style_id, digest AS glossary_sha FROM (SELECT DISTINCT source AS corpus_id FROM documents), (
    SELECT {o.short_hash(f"string_agg(CASE WHEN dst <> '' THEN src || '=>' || dst || {o.NL} ELSE '' END, '' ORDER BY pos)")} AS digest
    FROM glossary)""", "glossary"))
def run_params(t: Tables) -> DataFrame:
    """What a run of each corpus depends on besides its text; the digest is one row."""
    digest = glossary_ops.glossary_digest(t.glossary()).select("digest")
    made = t.runs().select("corpus_id").join(F.broadcast(digest))
    return made.select("corpus_id", runs.run_params(CFG, F.col("digest")).alias("p")).select("corpus_id", "p.*")


@query("clear_plan", _inventory_sql(f"""
  SELECT run_hash = '{SHOW_RUN}' AS expired, count(*) AS runs, sum(size_bytes)::BIGINT AS bytes,
    sum(segments)::BIGINT AS segments FROM inventory GROUP BY 1"""))
def clear_plan(t: Tables) -> DataFrame:
    return runs.plan_totals(runs.clear_plan(inventory(t), SHOW_RUN))


@query("completion_retention", o.sql(f"""
  SELECT run_hash, count(*) AS rows FROM (SELECT {o.RUN_HASH} AS run_hash FROM cache_log)
  JOIN runs USING (run_hash) WHERE NOT (docs % 2 = 0 AND first_doc % 3 <> 0 AND first_doc % 5 <> 0)
  GROUP BY run_hash""", "runs", "cache_log"))
def completion_retention(t: Tables) -> DataFrame:
    gate = t.runs().select(
        "run_hash", (F.col("docs") % 2 == 0).alias("full_range"), (F.col("first_doc") % 3 == 0).alias("partial"),
        (F.col("first_doc") % 5 == 0).alias("keep"),
    )
    kept = runs.survivors(t.run_files(), runs.completed_runs(gate))
    return kept.groupBy("run_hash").agg(F.count("*").alias("rows"))


@query("run_detail", _inventory_sql(f"""
  SELECT i.run_hash, i.segments, i.size_bytes, i.recovery_logs, i.recovery_items, i.failed_items, l.output,
    l.items, l.failed
  FROM inventory i LEFT JOIN (SELECT run_hash, output, count(*) FILTER (file = 'recovery') AS items,
    count(*) FILTER (file = 'failed') AS failed FROM recovery_files GROUP BY ALL) l USING (run_hash)
  WHERE i.run_hash = '{SHOW_RUN}'"""))
def run_detail(t: Tables) -> DataFrame:
    one = runs.resolve_prefix(t.runs(), SHOW_RUN[:8])
    logs = runs.recovery_counts(t.recovery_files()).withColumnRenamed("failed_items", "failed")
    return inventory(t).join(one, "run_hash", "left_semi").join(logs, "run_hash", "left").select(
        "run_hash", "segments", "size_bytes", "recovery_logs", "recovery_items", "failed_items", "output", "items",
        "failed",
    )


# Provider stage and fallback


STAGE_CFG = EngineConfig()


def forgetful(prompts_in: pd.Series) -> pd.Series:
    """Deterministic provider: no answer to a first prompt whose source length is a multiple of three."""
    table = str.maketrans(LATIN_LETTERS, KANA_LETTERS)

    def one(prompt: str) -> str:
        source = prompt.split("<source>\n", 1)[1].split("\n</source>", 1)[0]
        first = "<retry_instruction>" not in prompt
        return "" if first and len(source) % 3 == 0 else source.translate(table)

    return prompts_in.map(one)


def _stage_sql(max_chars: int, jobs: str, *needs: str) -> str:
    """Every chunk fails for good or is answered at the first or second call; the joined whole may fail as well."""
    return o.sql(f"""
  SELECT cache_key, chunks, attempts, failed_chunk, CASE WHEN failed_chunk IS NOT NULL THEN failed_reason
    WHEN chunks > 1 THEN {o.reason('source_text', 'translated')} END AS reason
  FROM jobs JOIN (SELECT cache_key, count(*) AS chunks, sum(calls)::BIGINT AS attempts, arg_min(r, chunk_index) FILTER (r IS NOT NULL) AS failed_reason,
      min(chunk_index) FILTER (r IS NOT NULL) AS failed_chunk, string_agg({o.kana('chunk')}, {o.NL} ORDER BY chunk_index) AS translated
    FROM (SELECT *, CASE WHEN r IS NOT NULL THEN 4 WHEN length(chunk) % 3 = 0 THEN 2 ELSE 1 END AS calls FROM (
      SELECT *, {o.reason('chunk', o.kana('chunk'))} AS r FROM doc_chunks)) GROUP BY cache_key) USING (cache_key)""",
        *needs, jobs=jobs, **chunk_ctes(max_chars, "jobs", "cache_key", "source_text")).replace("walk AS MATERIALIZED", "walk AS")


STAGE_COLUMNS = ("cache_key", "chunks", "attempts", "failed_chunk", "reason")


@query("provider_stage", _stage_sql(STAGE_CFG.max_chars, """
  SELECT cache_key, min(source_text) AS source_text FROM keyed GROUP BY cache_key""", "keyed"))
def provider_stage(t: Tables) -> DataFrame:
    jobs = t.keyed().groupBy("cache_key").agg(F.min("source_text").alias("source_text"))
    return requests.provider_outcomes(jobs, t.glossary(), forgetful, STAGE_CFG).select(*STAGE_COLUMNS)


CHUNK_CFG = EngineConfig(max_chars=400)


@query("provider_chunks", _stage_sql(CHUNK_CFG.max_chars, """
  SELECT 'd' || doc_id AS cache_key, text AS source_text FROM documents"""))
def provider_chunks(t: Tables) -> DataFrame:
    """Whole documents as texts, most of which take several calls."""
    jobs = t.documents().select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("cache_key"),
                                F.col("text").alias("source_text"))
    return requests.provider_stage(jobs, t.glossary(), forgetful, CHUNK_CFG).select(*STAGE_COLUMNS)


@query("fallback_resolve", o.sql(f"""
  SELECT cache_key, outcome, CASE outcome WHEN 'primary' THEN {o.short_hash('translated')}
      WHEN 'fallback' THEN {o.short_hash('other')} WHEN 'passthrough' THEN {o.short_hash('source_text')} END AS hash,
    outcome IN ('primary', 'fallback') AS cacheable
  FROM (SELECT *, CASE WHEN reason IS NULL AND error IS NULL THEN 'primary'
      WHEN reason = 'refusal_or_explanation' AND {o.reason('source_text', 'other')} IS NULL THEN 'fallback'
      WHEN reason <> 'refusal_or_explanation' THEN 'passthrough' ELSE 'error' END AS outcome
    FROM (SELECT *, {o.kana('source_text')} AS other FROM attempts))""", "attempts"))
def fallback_resolve(t: Tables) -> DataFrame:
    sources = cache_ops.key_sources(t.keyed()).withColumnRenamed("key", "cache_key")
    primary = t.attempts().join(sources, "cache_key")
    other = t.kana(F.col("source_text"))
    fallback = sources.select(
        "cache_key", other.alias("translated"),
        cache_ops.cached_reason(F.col("source_text"), other, F.lit(""), F.lit("")).alias("reason"),
    )
    return requests.resolve_fallback(primary, fallback, passthrough=True).select(
        "cache_key", "outcome", text.short_hash(F.col("result")).alias("hash"), "cacheable"
    )


# Usage and progress


CHUNK_PROMPTS_SQL = f"""
  SELECT c.*, coalesce(prompt_lines, '') AS prompt_lines, chunk AS source_text FROM doc_chunks c LEFT JOIN (
    SELECT doc_id, block_index, chunk_index, string_agg('- ' || src || ' => ' || dst, {o.NL} ORDER BY pos) AS prompt_lines
    FROM doc_chunks JOIN glossary ON dst <> '' AND contains(lower(chunk), lower(src)) GROUP BY ALL)
    USING (doc_id, block_index, chunk_index)"""


@query("usage_estimate", o.sql(f"""
  SELECT corpus_id, pages, blocks_total, cached_blocks, uncached_blocks, source_chars, uncached_source_chars,
    coalesce(requests, 0) AS requests, coalesce(i, 0) AS input_tokens, coalesce(x, 0) AS output_tokens,
    coalesce(i, 0) + coalesce(x, 0) AS total_tokens
  FROM (SELECT corpus_id, count(DISTINCT page_no) AS pages, count(*) AS blocks_total,
      count(*) FILTER (status = 'hit') AS cached_blocks, count(*) FILTER (status <> 'hit') AS uncached_blocks,
      sum(length(source_text))::BIGINT AS source_chars,
      sum(CASE WHEN status = 'hit' THEN 0 ELSE length(source_text) END)::BIGINT AS uncached_source_chars
    FROM status GROUP BY corpus_id)
  LEFT JOIN (SELECT corpus_id, count(*) AS requests,
      sum((length({o.SYSTEM}) + 3) // 4 + (length({o.PROMPT}) + 3) // 4)::BIGINT AS i,
      sum((length(source_text) + 3) // 4)::BIGINT AS x FROM chunk_prompts GROUP BY corpus_id) USING (corpus_id)""",
    "status", "glossary", **chunk_ctes(CFG.max_chars, "status WHERE status <> 'hit'", "corpus_id, doc_id, block_index", "source_text"),
    chunk_prompts=CHUNK_PROMPTS_SQL).replace("walk AS MATERIALIZED", "walk AS"))
def usage_estimate(t: Tables) -> DataFrame:
    valid = cache_ops.cache_status(t.keyed(), t.cache(), BLOCK_IDS).filter("status = 'hit'")
    return requests.usage_estimate(t.keyed(), t.glossary(), valid, CFG, BLOCK_IDS)


@query("usage_totals", o.sql("""
  SELECT *, format('requests: {}, input tokens: {}, output tokens: {}', requests, input_tokens, output_tokens)
    || CASE WHEN total_tokens > 0 THEN format(', total tokens: {}', total_tokens) ELSE '' END AS summary
  FROM (SELECT conv_id, sum(requests)::BIGINT AS requests, sum(input_tokens)::BIGINT AS input_tokens,
    sum(output_tokens)::BIGINT AS output_tokens, sum(total_tokens)::BIGINT AS total_tokens FROM usage GROUP BY conv_id)
  """, "usage"))
def usage_totals(t: Tables) -> DataFrame:
    return accounting.usage_totals(t.usage(), ["conv_id"])


PROGRESS_SQL = """
  SELECT corpus_id, count(*) AS blocks, count(*) FILTER (status = 'hit') AS cached_blocks,
    sum(CASE WHEN status <> 'hit' AND page_no >= 4 THEN length(source_text) ELSE 0 END)::BIGINT AS uncached_chars
  FROM status GROUP BY corpus_id"""


@query("progress_work", o.sql(PROGRESS_SQL, "status"))
def progress_work(t: Tables) -> DataFrame:
    return accounting.progress_work(cache_ops.cache_status(t.keyed(), t.cache(), BLOCK_IDS))


@query("eta", o.sql("""
  SELECT corpus_id, CASE WHEN cached_blocks >= blocks THEN 'ETA done' WHEN uncached_chars = 0 THEN 'ETA pending'
    WHEN uncached_chars - done <= 0 THEN 'ETA done' WHEN done = 0 OR secs < 300 THEN 'ETA pending'
    ELSE 'ETA ' || format('{:02d}:{:02d}:{:02d}', left_secs // 3600, left_secs % 3600 // 60, left_secs % 60) END AS eta
  FROM (SELECT *, CASE WHEN done > 0 THEN floor(secs::DOUBLE / done * (uncached_chars - done))::BIGINT END AS left_secs FROM (
    SELECT *, uncached_chars // 3 AS done, blocks + cached_blocks AS secs FROM progress))""",
    "status", progress=PROGRESS_SQL))
def eta(t: Tables) -> DataFrame:
    work = progress_work(t).withColumn("done", F.floor(F.col("uncached_chars") / 3)).withColumn(
        "secs", F.col("blocks") + F.col("cached_blocks")
    )
    return work.select(
        "corpus_id",
        accounting.eta(F.col("cached_blocks"), F.col("blocks"), F.col("done"), F.col("uncached_chars"), F.col("secs"))
        .alias("eta"),
    )


@query("run_stats", o.sql("""
  SELECT corpus_id, count(DISTINCT page_no) AS pages, count(*) AS blocks, count(*) FILTER (status = 'hit') AS hits,
    count(*) FILTER (status <> 'hit') AS misses, count(*) FILTER (status <> 'hit' AND block_index % 2 = 0) AS writes
  FROM status GROUP BY corpus_id""", "status"))
def run_stats(t: Tables) -> DataFrame:
    status = cache_ops.cache_status(t.keyed(), t.cache(), BLOCK_IDS)
    added = status.filter("status <> 'hit' AND block_index % 2 = 0").select("corpus_id", "cache_key")
    return accounting.run_stats(status, added)


@query("active_time", o.sql("""
  SELECT run_key, count(*) AS runs, count(*) FILTER (f IS NULL) AS open_runs,
    sum(greatest(0, epoch(date_trunc('second', coalesce(f, h, b)))::BIGINT
      - epoch(date_trunc('second', b))::BIGINT))::BIGINT AS active_secs
  FROM spans GROUP BY run_key""", "run_events", numbered_events="""
  SELECT *, sum((kind = 'begin')::INT) OVER (PARTITION BY run_key ORDER BY ts, event_id) AS run
  FROM run_events WHERE kind IS NOT NULL""", spans="""
  SELECT run_key, run, min(ts) FILTER (kind = 'begin') AS b, max(ts) FILTER (kind = 'heartbeat') AS h,
    min(ts) FILTER (kind = 'finish') AS f FROM numbered_events WHERE run > 0 GROUP BY ALL"""))
def active_time(t: Tables) -> DataFrame:
    return accounting.active_time(t.run_events().filter("kind is not null"))


STALL_SQL = """
  SELECT run_key, island, epoch(date_trunc('second', max(ts)))::BIGINT - epoch(date_trunc('second', min(ts)))::BIGINT AS elapsed_secs,
    count(*) - 1 AS requests
  FROM (SELECT *, sum(completed::INT) OVER (PARTITION BY run_key ORDER BY ts, event_id)::BIGINT AS island FROM run_events)
  GROUP BY run_key, island HAVING elapsed_secs >= 600 AND count(*) - 1 >= 20"""


@query("stall_alerts", o.sql(STALL_SQL, "run_events"))
def stall_alerts(t: Tables) -> DataFrame:
    return accounting.stall_alerts(t.run_events())
