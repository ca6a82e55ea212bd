"""Keys, work items, requests and the provider stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lectern.config import ID_NAMESPACE, EngineConfig
from lectern.functions import prompts, text
from lectern.functions.validation import (
    is_refusal_error, is_validation_error, reason_message, source_traits, target_traits, traits_reason, validation_reason,
)
from lectern.operators.chunking import chunk_texts
from lectern.operators.glossary import glossary_lines, glossary_subset
from lectern.operators.joins import spread_join
from lectern.session import exists, new_folder

def with_cache_key(blocks: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Add ``cache_key`` to blocks that carry the ``key_lines`` of their glossary subset, which go, or the ``subset``."""
    lines = _lines(blocks, "key_lines", prompts.key_lines)
    return blocks.withColumn(
        "cache_key", prompts.key_with_lines(F.col("source_text"), lines, cfg)
    ).drop("key_lines")


def _lines(blocks: DataFrame, name: str, made: Callable[[Column], Column]) -> Column:
    return F.col(name) if name in blocks.columns else made(F.col("subset"))


def custom_id(key: Column) -> Column:
    return F.concat(
        F.format_string(f"{ID_NAMESPACE}:%s:p%04d:b%04d:", "corpus_id", "page_no", "block_index"), key
    )


def prepared(keyed: DataFrame, cfg: EngineConfig, now: str) -> DataFrame:
    """Ledger row and request body of each keyed block in one pass."""
    source = F.col("source_text")
    prompt = prompts.prompt_with_lines(source, _lines(keyed, "prompt_lines", prompts.prompt_lines))
    body = F.struct(
        F.lit(cfg.model_name).alias("model"),
        F.lit(prompts.system_prompt(cfg.style)).alias("instructions"),
        prompt.alias("input"),
    )
    return keyed.select(
        custom_id(F.col("cache_key")).alias("custom_id"),
        "cache_key",
        "corpus_id",
        F.col("page_no").alias("page_index"),
        "block_index",
        "href",
        "source_text",
        text.short_hash(source).alias("source_hash"),
        prompts.prompt_hash(prompt, cfg).alias("prompt_hash"),
        F.length(source).alias("source_chars"),
        F.lit(cfg.provider).alias("provider"),
        F.lit(cfg.model_name).alias("model"),
        F.lit("prepared").alias("state"),
        F.lit(1).alias("attempt"),
        F.lit(None).cast("string").alias("last_error"),
        F.lit(now).alias("updated_at"),
        body.alias("body"),
    )


def work_items(keyed: DataFrame, cfg: EngineConfig, now: str) -> DataFrame:
    """Ledger rows of keyed blocks, all in state ``prepared``."""
    return prepared(keyed, cfg, now).drop("body")


def request_rows(keyed: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Batch request lines of keyed blocks."""
    return prepared(keyed, cfg, "").select(
        "custom_id", F.lit("POST").alias("method"), F.lit("/v1/responses").alias("url"), "body"
    )


def uncached(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Blocks without a valid cache row. ``cache`` holds one row per key.

    The keys are computed in the same job, so a hot key is left to the adaptive skew
    join, which can split this one: nothing after it asks for the partitioning.
    """
    hits = cache.select(F.col("key").alias("cache_key"), F.col("translated").alias("_cached"))
    reason = validation_reason(F.col("source_text"), F.col("_cached"))
    return (
        keyed.join(hits, "cache_key", "left")
        .filter(F.col("_cached").isNull() | reason.isNotNull())
        .drop("_cached")
    )


def prepare(blocks: DataFrame, glossary: DataFrame, cache: DataFrame | None, cfg: EngineConfig) -> DataFrame:
    """Keyed blocks that still need a request."""
    keyed = with_cache_key(glossary_lines(blocks, glossary), cfg)
    return keyed if cache is None else uncached(keyed, cache)


CALL = ["cache_key", "chunk_index"]


def request_chunks(requests: DataFrame, glossary: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(cache_key, source_text) -> a row per call unit: chunk_index, its own source_text and glossary ``subset``.

    The first chunk also carries ``whole``, the traits of the text it was cut from.
    """
    pieces = chunk_texts(requests.select("cache_key", "source_text"), cfg.max_chars)
    whole = F.when(F.col("chunk_index") == 1, source_traits(F.col("source_text"))).alias("whole")
    return glossary_subset(pieces.select(*CALL, whole, F.col("chunk").alias("source_text")), glossary)


def provider_attempts(
    chunks: DataFrame,
    provider: Callable[[pd.Series], pd.Series],
    cfg: EngineConfig,
    folder: str,
) -> list[DataFrame]:
    """Asks for every chunk, and again with the reason for those whose answer fails, up to retries + 1 times.

    Gives a table per attempt of the chunks that it settles, by a valid answer or as the last attempt:
    (cache_key, chunk_index, whole, translated, reason).
    Each attempt is one bulk stage whose answers are stored in ``folder`` under its number before
    they are judged. An attempt that is stored is read and not asked again, so a lost executor or
    a restart repeats no paid call of an attempt that ended. An answer is stored with its chunk, so no text is
    joined to another, and a restart takes the same chunks. Of judged answers only those that failed are stored.
    """
    spark = chunks.sparkSession
    carried = [*CALL, "whole", "source_text", "subset"]
    schema = StructType([*chunks.select(*carried).schema.fields, StructField("translated", StringType())])
    names = schema.names

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = provider(batch.column("prompt").to_pandas())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.Array.from_pandas(answers, type=pa.string())], names=names)

    def stored(name: str, rows: Callable[[], DataFrame]) -> DataFrame:
        path = f"{folder}/{name}"
        if not exists(spark, f"{path}/_SUCCESS"):
            rows().write.mode("overwrite").option("compression", "zstd").parquet(path)
        return spark.read.parquet(path)

    source, subset = F.col("source_text"), F.col("subset")
    pending = chunks.select(*carried, prompts.user_prompt(source, subset).alias("prompt"))
    attempts = []
    for attempt in range(1, cfg.retries + 2):
        answers = stored(f"answers-{attempt}", lambda pending=pending: pending.mapInArrow(call, schema))
        reason = validation_reason(source, F.col("translated"))
        # A filter on a computed column computes it twice; an exploded array of one or none does not.
        failed = stored(f"failed-{attempt}", lambda answers=answers: answers.select(
            "*", F.explode(F.array_compact(F.array(reason))).alias("reason")))
        settled = answers.filter(reason.isNull()).withColumn("reason", F.lit(None).cast("string"))
        over = attempt > cfg.retries or failed.isEmpty()
        attempts.append(settled.unionByName(failed) if over else settled)
        if over:
            break
        pending = failed.select(*carried, prompts.retry_prompt(
            source, subset, F.col("translated"), reason_message(F.col("reason")), F.col("reason")).alias("prompt"))
    return [table.select(*CALL, "whole", "translated", "reason") for table in attempts]


def provider_outcomes(
    requests: DataFrame,
    glossary: DataFrame,
    provider: Callable[[pd.Series], pd.Series],
    cfg: EngineConfig,
    folder: str | None = None,
) -> DataFrame:
    """As ``provider_stage``, without the source text, which is not read again."""
    folder = folder or new_folder(requests.sparkSession, "provider")
    rows = None
    for number, table in enumerate(provider_attempts(request_chunks(requests, glossary, cfg), provider, cfg, folder), start=1):
        row = table.withColumn("calls", F.lit(number).cast("long"))
        rows = row if rows is None else rows.unionByName(row)
    # A group is one text's chunks; nothing else is gathered.
    per_key = rows.groupBy("cache_key").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", F.col("translated").alias("part")))).alias("parts"),
        F.sum("calls").alias("attempts"), F.max("whole").alias("whole"),
        F.min(F.when(F.col("reason").isNotNull(), F.struct("chunk_index", "reason"))).alias("failed"))
    joined = per_key.select(
        "cache_key", F.size("parts").cast("long").alias("chunks"), "attempts", "whole",
        F.array_join(F.transform("parts", lambda p: text.strip(p["part"])), "\n").alias("translated"), "failed")
    whole = F.when(F.col("chunks") > 1, text.bound(
        target_traits(F.col("translated")), lambda traits: traits_reason(F.col("whole"), traits)))
    return joined.select(
        "cache_key", "chunks", "attempts", "translated", F.col("failed.chunk_index").alias("failed_chunk"),
        F.coalesce(F.col("failed.reason"), whole).alias("reason"))


def provider_stage(
    requests: DataFrame,
    glossary: DataFrame,
    provider: Callable[[pd.Series], pd.Series],
    cfg: EngineConfig,
    folder: str | None = None,
) -> DataFrame:
    """Calls the provider for every text, cut into chunks, and joins and validates the answers.

    ``requests`` holds one (cache_key, source_text) per key. Every chunk has its own glossary
    subset, prompt, validation and retries. Gives (cache_key, source_text, chunks, attempts,
    translated, failed_chunk, reason): ``attempts`` counts all calls for the key; ``failed_chunk``
    is the first chunk without a valid answer and ``reason`` its reason, else that of the whole.
    With ``folder`` given, a run that was stopped goes on from the attempts stored there.
    """
    told = provider_outcomes(requests, glossary, provider, cfg, folder)
    return requests.select("cache_key", "source_text").join(told, "cache_key")


def resolve_fallback(primary: DataFrame, fallback: DataFrame, passthrough: bool) -> DataFrame:
    """Final text per key: primary, fallback after a refusal, source on a tolerated failure.

    Both take (cache_key, translated, reason, error); ``primary`` also source_text.
    """
    other = fallback.select(
        "cache_key",
        F.col("translated").alias("_other"),
        F.col("reason").alias("_other_reason"),
        F.lit(True).alias("_has"),
    )
    refused = is_refusal_error(F.col("reason"), F.col("error"))
    ok = F.col("reason").isNull() & F.col("error").isNull()
    other_ok = F.col("_has") & F.col("_other_reason").isNull()
    tolerated = F.lit(passthrough) & ~refused & is_validation_error(F.col("reason"), F.col("error"))
    outcome = (
        F.when(ok, "primary")
        .when(refused & other_ok, "fallback")
        .when(tolerated, "passthrough")
        .otherwise("error")
    )
    return (
        primary.join(other, "cache_key", "left")
        .withColumn("outcome", outcome)
        .select(
            "cache_key",
            "outcome",
            F.when(F.col("outcome") == "primary", F.col("translated"))
            .when(F.col("outcome") == "fallback", F.col("_other"))
            .when(F.col("outcome") == "passthrough", F.col("source_text"))
            .alias("result"),
            F.col("outcome").isin("primary", "fallback").alias("cacheable"),
        )
    )


def usage_estimate(blocks: DataFrame, glossary: DataFrame, valid_keys: DataFrame, cfg: EngineConfig,
                   ids: list[str]) -> DataFrame:
    """Per corpus: blocks, characters, requests and tokens before any call.

    ``blocks`` carry cache_key; ``valid_keys`` holds (cache_key, source_text) pairs
    that the cache answers.
    """
    hits = valid_keys.select("cache_key").distinct().withColumn("cached", F.lit(True))
    base = spread_join(blocks, hits, "cache_key", ids).withColumn("cached", F.coalesce("cached", F.lit(False)))
    chars = F.length("source_text")
    totals = base.groupBy("corpus_id").agg(
        F.count_distinct("page_no").alias("pages"),
        F.count("*").alias("blocks_total"),
        F.count_if("cached").alias("cached_blocks"),
        F.count_if(~F.col("cached")).alias("uncached_blocks"),
        F.sum(chars).alias("source_chars"),
        F.sum(F.when(~F.col("cached"), chars).otherwise(0)).alias("uncached_source_chars"),
    )
    pieces = chunk_texts(base.filter("not cached").select("corpus_id", *ids, "source_text"), cfg.max_chars)
    parts = glossary_lines(
        pieces.select("corpus_id", *ids, "chunk_index", F.col("chunk").alias("source_text")),
        glossary,
    )
    prompt = prompts.prompt_with_lines(F.col("source_text"), F.col("prompt_lines"))
    system_tokens = -(-len(prompts.system_prompt(cfg.style)) // 4)
    costs = parts.groupBy("corpus_id").agg(
        F.count("*").alias("requests"),
        F.sum(F.lit(system_tokens) + text.token_estimate(F.length(prompt))).alias("input_tokens"),
        F.sum(text.token_estimate(F.length("source_text"))).alias("output_tokens"),
    )
    zero = F.lit(0).cast("long")
    return totals.join(costs, "corpus_id", "left").select(
        *totals.columns,
        *[F.coalesce(c, zero).alias(c) for c in ("requests", "input_tokens", "output_tokens")],
        (F.coalesce("input_tokens", zero) + F.coalesce("output_tokens", zero)).alias("total_tokens"),
    )
