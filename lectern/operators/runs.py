"""Run manifests, inventories, retention and clear plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import EngineConfig, PROMPT_VERSION
from lectern.functions.formats import human_bytes

SCHEMA_VERSION = 1


def fingerprint(packages: DataFrame) -> DataFrame:
    """SHA-256 of the content: full and 32-character forms."""
    full = F.sha2(F.col("content"), 256)
    return packages.select("corpus_id", full.alias("sha256"), F.substring(full, 1, 32).alias("input_hash"))


def run_params(cfg: EngineConfig, digest: Column) -> Column:
    return F.struct(
        F.lit(cfg.provider).alias("provider"),
        F.lit(cfg.model_name).alias("model"),
        F.lit(PROMPT_VERSION).alias("prompt_version"),
        F.lit(cfg.style).alias("style_id"),
        digest.alias("glossary_sha"),
    )


def upsert_manifests(old: DataFrame, current: DataFrame, now: str) -> DataFrame:
    """Refresh or create one manifest row per corpus of ``current``.

    ``old``: corpus_id, schema_version, sha256, path, size_bytes, mtime, model,
    started_at, last_updated_at, active_elapsed_secs, last_output_path.
    ``current``: corpus_id, sha256, path, size_bytes, mtime, model, last_output_path.
    Kept from the old row: version, digest, start, elapsed; its output when none is given.
    """
    o, c = old.alias("o"), current.alias("c")
    keep = lambda name, default: F.coalesce(F.col(f"o.{name}"), default).alias(name)
    return c.join(o, F.col("c.corpus_id") == F.col("o.corpus_id"), "left").select(
        F.col("c.corpus_id").alias("corpus_id"),
        keep("schema_version", F.lit(SCHEMA_VERSION)),
        keep("sha256", F.col("c.sha256")),
        *[F.col(f"c.{n}").alias(n) for n in ("path", "size_bytes", "mtime", "model")],
        keep("started_at", F.lit(now)),
        F.lit(now).alias("last_updated_at"),
        keep("active_elapsed_secs", F.lit(0).cast("long")),
        F.coalesce("c.last_output_path", "o.last_output_path").alias("last_output_path"),
    )


def recovery_counts(logs: DataFrame) -> DataFrame:
    """Per run and output: items and failed items. ``logs``: run_hash, output, file."""
    return logs.groupBy("run_hash", "output").agg(
        F.count_if(F.col("file") == "recovery").alias("items"),
        F.count_if(F.col("file") == "failed").alias("failed_items"),
    )


def recovery_summary(logs: Column, items: Column, failed: Column) -> Column:
    return (
        F.when((logs == 0) & (failed == 0), "-")
        .when(failed > 0, F.concat_ws("", logs.cast("string"), F.lit("/"), items.cast("string"),
                                      F.lit("+"), failed.cast("string"), F.lit("f")))
        .otherwise(F.concat_ws("/", logs.cast("string"), items.cast("string")))
    )


def inventory(runs: DataFrame, segments: DataFrame, files: DataFrame, logs: DataFrame) -> DataFrame:
    """One row per run with its segment, recovery and byte totals.

    ``runs``: run_hash, last_updated_at; ``segments``: run_hash; ``files``: run_hash, bytes.
    """
    seg = segments.groupBy("run_hash").agg(F.count("*").alias("segments"))
    size = files.groupBy("run_hash").agg(F.sum("bytes").alias("size_bytes"))
    rec = recovery_counts(logs).groupBy("run_hash").agg(
        F.count_if(F.col("items") > 0).alias("recovery_logs"),
        F.sum("items").alias("recovery_items"),
        F.sum("failed_items").alias("failed_items"),
    )
    joined = runs
    for part in (seg, size, rec):
        joined = joined.join(part, "run_hash", "left")
    counts = ("segments", "size_bytes", "recovery_logs", "recovery_items", "failed_items")
    filled = joined.fillna(0, list(counts))
    return filled.withColumn("size", human_bytes(F.col("size_bytes"))).withColumn(
        "recovery",
        recovery_summary(F.col("recovery_logs"), F.col("recovery_items"), F.col("failed_items")),
    )


def run_files(spark: SparkSession, root: str) -> DataFrame:
    """(run_hash, file, bytes) of the files under ``root``/run_hash=.., from the file system alone; none is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select(
        F.regexp_extract("path", "/run_hash=([^/]+)/", 1).alias("run_hash"),
        F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"))


def resolve_prefix(runs: DataFrame, prefix: str) -> DataFrame:
    """The one run whose hash starts with the prefix; none or several is an error."""
    hits = runs.filter(F.col("run_hash").startswith(prefix))
    counted = hits.agg(F.count("*").alias("n"), F.min("run_hash").alias("run_hash"))
    return counted.select(
        F.when(F.col("n") == 1, F.col("run_hash"))
        .otherwise(
            F.raise_error(F.concat(F.lit(f"prefix {prefix} matches "), F.col("n").cast("string"), F.lit(" runs")))
        )
        .alias("run_hash")
    )


def newest_logs(logs: DataFrame) -> DataFrame:
    """Per run the log modified last (the later name on ties)."""
    return logs.groupBy("run_hash").agg(F.max(F.struct("mtime", "output")).alias("log")).select(
        "run_hash", "log.output", "log.mtime"
    )


def retention_plan(runs: DataFrame, older_than_days: int, now: str) -> DataFrame:
    """Flag runs last updated before the cutoff; runs without a readable date stay."""
    updated = F.try_to_timestamp(F.col("last_updated_at"))
    cutoff = F.expr(f"timestamp'{now}' - interval {older_than_days} days")
    return runs.withColumn("expired", F.coalesce(updated < cutoff, F.lit(False)))


def survivors(table: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of a run-keyed table that remain after a retention or clear plan."""
    return table.join(plan.filter("expired").select("run_hash"), "run_hash", "left_anti")


def plan_totals(plan: DataFrame) -> DataFrame:
    return plan.groupBy("expired").agg(
        F.count("*").alias("runs"), F.sum("size_bytes").alias("bytes"), F.sum("segments").alias("segments")
    )


def clear_plan(runs: DataFrame, run_hash: str | None = None) -> DataFrame:
    """Flag one run, or every run, for removal."""
    return runs.withColumn("expired", F.lit(True) if run_hash is None else F.col("run_hash") == run_hash)


def completed_runs(runs: DataFrame) -> DataFrame:
    """Flag runs to drop after completion.

    ``runs``: run_hash, full_range, partial, keep.
    """
    return runs.withColumn("expired", F.col("full_range") & ~F.col("partial") & ~F.col("keep"))
