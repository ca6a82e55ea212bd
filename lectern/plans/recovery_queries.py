"""Output scans, recovery logs and recovery outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import markers, text
from lectern.operators import cache as cache_ops
from lectern.operators import recovery
from lectern.plans import oracle as o
from lectern.plans.markup_queries import _restored_sql, line_map
from lectern.plans.registry import query
from lectern.plans.tables import BLOCK_IDS, CFG, GAPS, Tables
from lectern.session import new_folder
from lectern.sources import jsonl

SELECTED = ("cache_miss", "unchanged_source")
LIMIT = 250


def output_blocks(t: Tables) -> DataFrame:
    """Finished pages: the answer of each block; some pages lost every second block."""
    kept = t.doc_blocks().filter(f"NOT ({GAPS})")
    answer = t.answer(F.col("source_text"))
    return kept.withColumn("source_text", F.when(answer == "", "訳").otherwise(answer))


OUTPUT_SQL = f"""
  SELECT * REPLACE (CASE WHEN translated = '' THEN '訳' ELSE translated END AS translated) FROM responses
  WHERE NOT (doc_id % 13 = 0 AND block_index % 2 = 0)"""
MISMATCH_SQL = """
  SELECT corpus_id, page_no, count(*) AS source_blocks, count(*) FILTER (NOT (doc_id % 13 = 0 AND block_index % 2 = 0)) AS output_blocks
  FROM doc_blocks GROUP BY ALL HAVING source_blocks <> output_blocks"""


@query("scan_mismatch", o.sql("SELECT * FROM mismatched", "doc_blocks", mismatched=MISMATCH_SQL))
def scan_mismatch(t: Tables) -> DataFrame:
    return recovery.count_mismatches(t.doc_blocks(), output_blocks(t))


@query("scan_suspicious", o.sql(f"""
  SELECT corpus_id, page_no, block_index, found AS reason, CASE found WHEN 'unchanged_source'
    THEN 'output block is unchanged source text' ELSE {o.message('r')} END AS message
  FROM (SELECT *, CASE WHEN {o.collapse('source_text')} = {o.collapse('translated')} THEN 'unchanged_source'
      WHEN r IS NOT NULL THEN 'detected_untranslated_output' END AS found
    FROM (SELECT *, {o.reason('source_text', 'translated')} AS r FROM output_rows
      ANTI JOIN mismatched USING (corpus_id, page_no))) WHERE found IS NOT NULL""",
    "responses", output_rows=OUTPUT_SQL, mismatched=MISMATCH_SQL))
def scan_suspicious(t: Tables) -> DataFrame:
    return recovery.scan_outputs(t.doc_blocks(), output_blocks(t)).select(
        *recovery.PLACE, "reason", "message"
    )


@query("recovery_log", o.sql(f"""
  SELECT 'recoverable_error' AS kind, reason, input, 'out/book.epub' AS output, 'cache' AS cache_root,
    '{CFG.provider}' AS provider, '{CFG.model_name}' AS model, 'essay' AS style, page_no, block_index, href, cache_key,
    {o.short_hash('source_text')} AS source_hash, error, suggested_action FROM recovery_log""", "recovery_log"))
def recovery_log(t: Tables) -> DataFrame:
    return recovery.recovery_rows(t.failures(), CFG, "out/book.epub", "cache", "now").drop("source_text", "at")


@query("recovery_log_read", o.sql("""
  SELECT input, page_no, block_index, reason, source_hash, error FROM recovery_log""", "recovery_log"))
def recovery_log_read(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "recovery-log")
    jsonl.write_if_any(t.recovery_log(), path)
    return jsonl.read_jsonl(t.spark, path, schemas.RECOVERY).select(
        "input", "page_no", "block_index", "reason", "source_hash", "error"
    )


@query("untranslated_report", o.sql(f"""
  SELECT input, row_number() OVER (PARTITION BY input ORDER BY page_no, block_index) AS number,
    {o.short_hash(f'''concat_ws(chr(10), '----- untranslated block ' || row_number() OVER (PARTITION BY input ORDER BY page_no, block_index) || ' -----',
      'page: ' || page_no, 'block: ' || block_index, 'href: ' || href, 'reason: ' || reason, 'error: ' || error, '',
      {o.strip('source_text')}, '')''')} AS hash FROM recovery_log""", "recovery_log"))
def untranslated_report(t: Tables) -> DataFrame:
    return recovery.report_sections(t.recovery_log()).select(
        "input", "number", text.short_hash(F.col("section")).alias("hash")
    )


@query("kept_original_reasons", o.sql(f"""
  SELECT doc_id, block_index, CASE WHEN r IS NOT NULL THEN NULL
    WHEN status = 'hit' THEN 'inline_restore_failed' WHEN doc_id % 3 = 0 THEN 'validation_passthrough'
    WHEN status = 'miss' THEN 'cache_miss' ELSE 'original_output' END AS reason
  FROM (SELECT *, CASE WHEN status = 'hit' THEN {_restored_sql('translated')} END AS r FROM status)""", "status"))
def kept_original_reasons(t: Tables) -> DataFrame:
    status = cache_ops.cache_status(t.keyed(), t.cache(), BLOCK_IDS)
    usable = F.when(F.col("status") == "hit", F.col("translated"))
    reason = recovery.kept_original_reason(
        F.col("doc_id") % 3 == 0, F.col("translated"), usable, markers.restore(usable, line_map())
    )
    return status.select("doc_id", "block_index", reason.alias("reason"))


@query("recover_select", o.sql(f"""
  SELECT input, page_no, block_index, reason FROM recovery_log WHERE reason IN {o.listed(SELECTED)}
  ORDER BY input, page_no, block_index LIMIT {LIMIT}""", "recovery_log"))
def recover_select(t: Tables) -> DataFrame:
    return recovery.select_records(t.recovery_log(), reasons=SELECTED, limit=LIMIT).select(
        "input", "page_no", "block_index", "reason"
    )


RECOVER_TOLD_SQL = f"""
  SELECT *, CASE WHEN NOT hash_ok THEN 'unrecoverable'
      WHEN reason <> 'inline_restore_failed' AND in_cache THEN 'already_cached'
      WHEN new_reason IS NULL AND new_error IS NULL THEN 'recovered'
      WHEN coalesce(contains(new_error, 'HTTP 401'), false) THEN 'aborted' ELSE 'unrecoverable' END AS outcome
    FROM (SELECT l.*, l.source_hash = {o.short_hash('l.source_text')} AS hash_ok, c.key IS NOT NULL AS in_cache,
        a.reason AS new_reason, a.error AS new_error
      FROM recovery_log l JOIN attempts a USING (cache_key) LEFT JOIN cache c ON c.key = l.cache_key)"""


def _recover_sql(told: str) -> str:
    return o.sql(f"""
  SELECT input, page_no, block_index, outcome, outcome = 'recovered' AND reason = 'inline_restore_failed' AS replaces,
    CASE WHEN outcome = 'unrecoverable' THEN CASE WHEN NOT hash_ok THEN 'source_hash does not match source_text'
      ELSE coalesce(new_error, new_reason) END END AS failure
  FROM ({told})""", "recovery_log", "attempts", "cache")


def _recovered(t: Tables, stops: bool) -> DataFrame:
    log = recovery.record_options(t.recovery_log())
    return recovery.recover_outcome(log, t.cache_keys(), t.attempts(), stops).select(
        "input", "page_no", "block_index", "outcome", "replaces", "failure"
    )


@query("recover_outcome", _recover_sql(RECOVER_TOLD_SQL))
def recover_outcome(t: Tables) -> DataFrame:
    """What every record would become, were the recovery not stopped."""
    return _recovered(t, stops=False)


@query("recover_stopped", _recover_sql(f"""
  SELECT * REPLACE (CASE WHEN place > stop THEN 'not_reached' ELSE outcome END AS outcome)
  FROM (SELECT *, min(CASE WHEN outcome = 'aborted' THEN place END) OVER (PARTITION BY input) AS stop
    FROM (SELECT *, row_number() OVER (PARTITION BY input ORDER BY page_no, block_index, cache_key) AS place FROM ({RECOVER_TOLD_SQL})))"""))
def recover_stopped(t: Tables) -> DataFrame:
    return _recovered(t, stops=True)


@query("recover_options", o.sql(f"""
  SELECT use_provider, use_model, use_style, use_output, count(*) AS n FROM (
    SELECT '{CFG.provider}' AS use_provider, 'other-model' AS use_model, 'essay' AS use_style,
      'out/book.epub' AS use_output FROM recovery_log) GROUP BY ALL""", "recovery_log"))
def recover_options(t: Tables) -> DataFrame:
    used = ["use_provider", "use_model", "use_style", "use_output"]
    return recovery.record_options(t.recovery_log(), model="other-model").groupBy(*used).agg(
        F.count("*").alias("n")
    )


@query("recover_list", o.sql(f"""
  SELECT 'p' || page_no || ' b' || block_index || ' ' || href || ' (' || reason || ')' AS place, input, source_hash,
    cache_key, suggested_action AS action, error,
    CASE WHEN length({o.collapse('source_text')}) <= 120 THEN {o.collapse('source_text')}
      ELSE left({o.collapse('source_text')}, 120) || '...' END AS source FROM recovery_log""", "recovery_log"))
def recover_list(t: Tables) -> DataFrame:
    return recovery.recovery_list(t.recovery_log())
