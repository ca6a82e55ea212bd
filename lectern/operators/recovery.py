"""Scans of finished output, recovery logs and recovery outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import EngineConfig
from lectern.functions.formats import suggested_action
from lectern.functions.text import preview, short_hash, strip
from lectern.functions.validation import is_auth_error, suspicion
from lectern.operators.joins import spread_join
from lectern.operators.ordinals import dense_numbers

PLACE = ["corpus_id", "page_no", "block_index"]
RESTORE_FAILED = "inline_restore_failed"
HASH_MISMATCH = "source_hash does not match source_text"


def count_mismatches(source: DataFrame, output: DataFrame) -> DataFrame:
    """Pages whose block counts differ; a missing page counts as zero."""
    per_page = lambda df, name: df.groupBy("corpus_id", "page_no").agg(F.count("*").alias(name))
    return (
        per_page(source, "source_blocks")
        .join(per_page(output, "output_blocks"), ["corpus_id", "page_no"], "full")
        .fillna(0, ["source_blocks", "output_blocks"])
        .filter("source_blocks <> output_blocks")
    )


def scan_outputs(source: DataFrame, output: DataFrame) -> DataFrame:
    """Suspicious output blocks of pages whose counts agree, by position."""
    bad = count_mismatches(source, output).select("corpus_id", "page_no")
    pair = source.select(*PLACE, "source_text").join(
        output.select(*PLACE, F.col("source_text").alias("output_text")), PLACE
    )
    return (
        pair.join(bad, ["corpus_id", "page_no"], "left_anti")
        .withColumn("found", suspicion(F.col("source_text"), F.col("output_text")))
        .filter("found is not null")
        .select(*PLACE, "source_text", "output_text", "found.reason", "found.message")
    )


def recovery_rows(failures: DataFrame, cfg: EngineConfig, output: str, cache_root: str, now: str) -> DataFrame:
    """Log rows. ``failures``: corpus_id, page_no, block_index, href, cache_key,
    source_text, reason, error."""
    return failures.select(
        F.lit("recoverable_error").alias("kind"),
        "reason",
        F.col("corpus_id").alias("input"),
        F.lit(output).alias("output"),
        F.lit(cache_root).alias("cache_root"),
        F.lit(cfg.provider).alias("provider"),
        F.lit(cfg.model_name).alias("model"),
        F.lit(cfg.style).alias("style"),
        "page_no",
        "block_index",
        "href",
        "cache_key",
        short_hash(F.col("source_text")).alias("source_hash"),
        "source_text",
        "error",
        suggested_action(F.col("reason")).alias("suggested_action"),
        F.lit(now).alias("at"),
    )


def kept_original_reason(attempted: Column, stored: Column, usable: Column, restored: Column) -> Column:
    """Why a block kept its source: null when the translation was used.

    ``stored`` is the cached text, ``usable`` the same where it is valid.
    """
    return (
        F.when(restored.isNotNull(), None)
        .when(usable.isNotNull(), "inline_restore_failed")
        .when(attempted, "validation_passthrough")
        .when(stored.isNull(), "cache_miss")
        .otherwise("original_output")
    )


def select_records(log: DataFrame, page: int | None = None, block: int | None = None,
                   reasons: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Filtered records, the first ``limit`` in log order."""
    kept = log
    if page is not None:
        kept = kept.filter(F.col("page_no") == page)
    if block is not None:
        kept = kept.filter(F.col("block_index") == block)
    if reasons:
        kept = kept.filter(F.col("reason").isin(*reasons))
    order = ["input", "page_no", "block_index"]
    return kept if limit is None else kept.orderBy(*order).limit(limit)


def record_options(log: DataFrame, provider: str | None = None, model: str | None = None,
                   style: str | None = None, output: str | None = None) -> DataFrame:
    """Options of the rebuild: those given, else those of the record."""
    own = lambda name: F.when(strip(F.col(name)) != "", F.col(name))
    target = F.coalesce(F.lit(output), own("output"))
    return log.select(
        "*",
        F.coalesce(F.lit(provider), own("provider")).alias("use_provider"),
        F.coalesce(F.lit(model), own("model")).alias("use_model"),
        F.coalesce(F.lit(style), own("style"), F.lit("essay")).alias("use_style"),
        F.when(target.isNotNull(), target).otherwise(
            F.raise_error(F.lit("no output path given or recorded"))
        ).alias("use_output"),
    )


LOG_ORDER = ("page_no", "block_index", "cache_key")


def recover_outcome(log: DataFrame, cache: DataFrame, results: DataFrame, stops: bool = True) -> DataFrame:
    """Outcome of each record: recovered, already_cached, unrecoverable, aborted or not_reached.

    ``results``: cache_key, reason, error of the new attempt (null both = success). A recovery of an
    input ends at its first record that fails to authenticate: that one is aborted, and those
    behind it are not reached. Without ``stops`` every record is told what it would become.
    """
    keys = cache.select(F.col("key").alias("cache_key")).distinct().withColumn("in_cache", F.lit(True))
    tried = results.select(
        "cache_key", F.col("reason").alias("_reason"), F.col("error").alias("_error"), F.lit(True).alias("_tried")
    )
    # Both lookups hold one row per key; joined first, they meet the log once.
    joined = spread_join(log, keys.join(tried, "cache_key", "full"), "cache_key", ["input", "page_no", "block_index"])
    succeeded = F.col("_tried") & F.col("_reason").isNull() & F.col("_error").isNull()
    outcome = (
        F.when(F.col("source_hash") != short_hash(F.col("source_text")), "unrecoverable")
        .when((F.col("reason") != RESTORE_FAILED) & F.col("in_cache"), "already_cached")
        .when(succeeded, "recovered")
        .when(is_auth_error(F.col("_error")), "aborted")
        .otherwise("unrecoverable")
    )
    error = F.when(
        F.col("outcome") == "unrecoverable",
        F.when(F.col("source_hash") != short_hash(F.col("source_text")), HASH_MISMATCH).otherwise(
            F.coalesce("_error", "_reason")
        ),
    )
    told = joined.withColumn("outcome", outcome)
    if stops:
        # One row per input: the least place of a failing record, found with partial aggregation.
        stop = told.filter("outcome = 'aborted'").groupBy("input").agg(F.min(F.struct(*LOG_ORDER)).alias("_stop"))
        behind = F.coalesce(F.struct(*LOG_ORDER) > F.col("_stop"), F.lit(False))
        told = told.join(stop, "input", "left").withColumn(
            "outcome", F.when(behind, "not_reached").otherwise(F.col("outcome")))
    return told.select(
        *log.columns, "outcome",
        error.alias("failure"),
        ((F.col("outcome") == "recovered") & (F.col("reason") == RESTORE_FAILED)).alias("replaces"),
    )


def recovery_list(log: DataFrame) -> DataFrame:
    return log.select(
        F.concat_ws(
            " ", F.format_string("p%d b%d", "page_no", "block_index"), F.col("href"),
            F.concat(F.lit("("), F.col("reason"), F.lit(")")),
        ).alias("place"),
        "input",
        "source_hash",
        "cache_key",
        F.col("suggested_action").alias("action"),
        "error",
        preview(F.col("source_text"), 120).alias("source"),
    )


def report_sections(log: DataFrame) -> DataFrame:
    """Text section per record, numbered within its input."""
    numbered = dense_numbers(
        log, ["input"], F.floor(F.col("page_no") / 1000), [F.col("page_no"), F.col("block_index")], "number"
    )
    section = F.concat_ws(
        "\n",
        F.format_string("----- untranslated block %d -----", "number"),
        F.format_string("page: %d", "page_no"),
        F.format_string("block: %d", "block_index"),
        F.concat(F.lit("href: "), F.col("href")),
        F.concat(F.lit("reason: "), F.col("reason")),
        F.concat(F.lit("error: "), F.col("error")),
        F.lit(""),
        strip(F.col("source_text")),
        F.lit(""),
    )
    return numbered.select("input", "number", section.alias("section"))
