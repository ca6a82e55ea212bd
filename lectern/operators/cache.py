"""The translation cache as a table: (seq, key, translated, provider, model, at); seq is unique in a log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import bytes_digest, short_hash
from lectern.functions.validation import cached_reason, target_traits
from lectern.operators.joins import spread_join

VALUE = ("seq", "translated", "provider", "model", "at")


def last_rows(cache: DataFrame) -> DataFrame:
    """The literal reading rule: per key the row with the highest seq."""
    return rows_at(cache, cache.groupBy("key").agg(F.max("seq").alias("seq")))


def first_rows(cache: DataFrame) -> DataFrame:
    """The literal writing rule: per key the row with the lowest seq, valid or not."""
    return rows_at(cache, cache.groupBy("key").agg(F.min("seq").alias("seq")))


def rows_at(cache: DataFrame, places: DataFrame, columns: Sequence[str] = VALUE) -> DataFrame:
    """The rows at (key, seq). Texts are joined once to the places, never kept in an aggregate,

    and the pair spreads the rows of a common key."""
    return cache.join(places, ["key", "seq"]).select("key", *columns)


TRAITS = ("traits", "digest")


def with_traits(cache: DataFrame) -> DataFrame:
    """``traits``, all that the rules of validation ask, and ``digest`` in place of ``translated``, in a fraction of its bytes."""
    translated = F.col("translated")
    return cache.select(
        *[c for c in cache.columns if c != "translated"], target_traits(translated).alias("traits"),
        bytes_digest(translated).alias("digest"))


def first_traits(cache: DataFrame) -> DataFrame:
    """(key, traits, digest) of ``first_rows``; no text is shuffled."""
    slim = with_traits(cache.select("key", "seq", "translated"))
    return rows_at(slim, cache.groupBy("key").agg(F.min("seq").alias("seq")), TRAITS)


def key_traits(cache: DataFrame) -> DataFrame:
    """(cache_key, stored, stored_digest) of a cache with one row per key, which has ``translated`` or already ``traits``."""
    slim = cache if "traits" in cache.columns else with_traits(cache)
    return slim.select(F.col("key").alias("cache_key"), F.col("traits").alias("stored"), F.col("digest").alias("stored_digest"))


def key_sources(blocks: DataFrame) -> DataFrame:
    """One row per key with its source text; equal keys have equal sources."""
    return blocks.groupBy(F.col("cache_key").alias("key")).agg(F.min("source_text").alias("source_text"))


def validated(cache: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``reason`` (null = valid). Repeats of one text are judged once.

    Copies of a (key, text) pair collapse to the first before the join, so a key
    with very many copies costs one row.
    """
    text_digest = F.md5(F.coalesce("translated", F.lit("")).cast("binary"))
    firsts = cache.groupBy("key", text_digest.alias("_d"), F.col("translated").isNull().alias("_n"), "provider", "model").agg(
        F.min("seq").alias("seq"))
    variants = rows_at(cache, firsts.select("key", "seq"))
    joined = spread_join(variants, sources, "key", ["seq"], hot_from=cache)
    reason = F.when(
        F.col("source_text").isNotNull(),
        cached_reason(F.col("source_text"), F.col("translated"), F.col("provider"), F.col("model")),
    )
    return joined.withColumn("reason", reason)


def merge_first_valid(cache: DataFrame, new: DataFrame | None, sources: DataFrame) -> DataFrame:
    """One row per key: the first valid row by seq, or the first row if none is valid."""
    rows = cache if new is None else cache.unionByName(new)
    places = (
        validated(rows, sources)
        .groupBy("key")
        .agg(F.min(F.when(F.col("reason").isNull(), F.col("seq"))).alias("good"), F.min("seq").alias("first"))
        .select("key", F.coalesce("good", "first").alias("seq"), F.col("good").isNotNull().alias("valid"))
    )
    return rows.join(places, ["key", "seq"]).select("key", *VALUE, "valid")


def replace_rows(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` flagged ``replace`` win (the latest of them); else the first row stays."""
    rows = cache.withColumn("replace", F.lit(False)).unionByName(new)
    places = (
        rows.groupBy("key")
        .agg(F.max(F.when(F.col("replace"), F.col("seq"))).alias("forced"), F.min("seq").alias("first"))
        .select("key", F.coalesce("forced", "first").alias("seq"), F.col("forced").isNotNull().alias("replaced"))
    )
    return rows.join(places, ["key", "seq"]).select("key", *VALUE, "replaced")


def cache_status(blocks: DataFrame, cache: DataFrame, ids: list[str]) -> DataFrame:
    """Add status hit, invalid or miss, with the reason. ``cache`` has one row per key.

    ``ids`` names the columns that identify a block.
    """
    rows = cache.select(
        F.col("key").alias("cache_key"), "translated", F.col("provider").alias("_p"), F.col("model").alias("_m")
    )
    reason = F.when(
        F.col("translated").isNotNull(),
        cached_reason(F.col("source_text"), F.col("translated"), F.col("_p"), F.col("_m")),
    )
    return (
        spread_join(blocks, rows, "cache_key", ids)
        .withColumn("reason", reason)
        .withColumn(
            "status",
            F.when(F.col("translated").isNull(), "miss")
            .when(F.col("reason").isNotNull(), "invalid")
            .otherwise("hit"),
        )
        .drop("_p", "_m")
    )


def lookup_stats(blocks: DataFrame, cache: DataFrame, enabled: bool = True) -> DataFrame:
    """Hits and misses per corpus; a disabled cache misses always. Equal keys are counted first."""
    keys = cache.select(F.col("key").alias("cache_key")).distinct().withColumn("found", F.lit(enabled))
    found = F.coalesce("found", F.lit(False))
    asked = blocks.groupBy("corpus_id", "cache_key").agg(F.count("*").alias("n"))
    return asked.join(keys, "cache_key", "left").groupBy("corpus_id").agg(
        F.sum(F.when(found, F.col("n")).otherwise(0)).alias("hits"),
        F.sum(F.when(found, 0).otherwise(F.col("n"))).alias("misses"),
    )


def conflicts(cache: DataFrame) -> DataFrame:
    """Keys stored with more than one distinct text."""
    return (
        cache.groupBy("key", short_hash(F.col("translated")).alias("hash"))
        .agg(F.count("*").alias("n"))
        .groupBy("key")
        .agg(F.count("*").alias("texts"), F.sum("n").alias("rows"))
        .filter("texts > 1")
    )
