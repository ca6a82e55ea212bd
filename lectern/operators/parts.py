"""Remote batch parts: status roll-up, merges and plans.

``parts``: corpus_id, part_index, request_file, request_count, request_bytes, file_id,
batch_id, status, output_file_id, error_file_id, output_file, error_file,
completed_count, failed_count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.packing import part_file

# Remote statuses in order of precedence, and those with files to fetch.
STATUS_PRECEDENCE = (
    "failed", "expired", "cancelled", "cancelling", "finalizing", "in_progress", "validating",
)
FETCHABLE = ("completed", "failed", "expired", "cancelled")


def is_fetchable(status: Column) -> Column:
    return status.isin(*FETCHABLE)


def rolled_status() -> Column:
    """Aggregate: one status for all parts of a batch."""
    status = F.col("status")
    out = F.when(F.count(status) == 0, "prepared").when(F.bool_and(status == "completed"), "completed")
    for name in STATUS_PRECEDENCE:
        out = out.when(F.bool_or(status == name), name)
    return out.when(F.bool_and(status == "submitted"), "submitted").otherwise("partial")


def completed_requests() -> Column:
    """Aggregate: requests the remote side has finished."""
    assumed = (F.col("status") == "completed") & (F.col("completed_count") == 0)
    return F.sum(F.when(assumed, F.col("request_count")).otherwise(F.col("completed_count")))


def needs_submit() -> Column:
    return F.bool_or(F.col("batch_id").isNull())


def manifest_from_parts(parts: DataFrame) -> DataFrame:
    """Batch row per corpus, kept in step with its parts."""
    ids = ("file_id", "batch_id", "output_file_id", "error_file_id")
    first = F.min_by(F.struct(*ids), "part_index")
    return parts.groupBy("corpus_id").agg(
        first.alias("first"),
        F.sum("request_count").alias("request_count"),
        F.sum("failed_count").alias("failed_count"),
        completed_requests().alias("completed_requests"),
        rolled_status().alias("status"),
        needs_submit().alias("needs_submit"),
    ).select("corpus_id", *[f"first.{c}" for c in ids], "request_count", "failed_count",
             "completed_requests", "status", "needs_submit")


def apply_remote_status(parts: DataFrame, remote: DataFrame) -> DataFrame:
    """Merge polled statuses.

    ``remote``: corpus_id, part_index, id, status, output_file_id, error_file_id, total,
    completed, failed (the last three null when no counts came).
    """
    r = remote.select(
        "corpus_id", "part_index", *[F.col(c).alias(f"r_{c}") for c in remote.columns[2:]]
    )
    counted = F.coalesce("r_total", "r_completed", "r_failed").isNotNull()
    done = F.coalesce(
        F.col("r_completed"),
        F.when(F.col("r_status") == "completed", F.coalesce("r_total", "request_count")),
        F.col("completed_count"),
    )
    changed = {
        "batch_id": F.coalesce("r_id", "batch_id"),
        "output_file_id": F.coalesce("r_output_file_id", "output_file_id"),
        "error_file_id": F.coalesce("r_error_file_id", "error_file_id"),
        "completed_count": F.when(counted, done).otherwise(F.col("completed_count")),
        "failed_count": F.coalesce("r_failed", "failed_count"),
        "status": F.coalesce("r_status", "status"),
    }
    return parts.join(r, ["corpus_id", "part_index"], "left").select(
        *[changed.get(c, F.col(c)).alias(c) for c in parts.columns]
    )


def status_summary(parts: DataFrame) -> DataFrame:
    """``status:count`` pairs per corpus, sorted by status."""
    counts = parts.groupBy("corpus_id", "status").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("status", "n")))
    text = F.transform(pairs, lambda p: F.concat(p["status"], F.lit(":"), p["n"].cast("string")))
    return counts.groupBy("corpus_id").agg(F.array_join(text, ",").alias("summary"))


def submit_plan(parts: DataFrame, force: bool = False) -> DataFrame:
    return parts if force else parts.filter(F.col("batch_id").isNull())


def expected_files(parts: DataFrame) -> DataFrame:
    """Files each part should have: corpus_id, part_index, kind, file_id, path."""
    kinds = F.array(
        F.struct(F.lit("output").alias("kind"), F.col("output_file_id").alias("file_id"),
                 part_file("output", F.col("part_index")).alias("path")),
        F.struct(F.lit("error").alias("kind"), F.col("error_file_id").alias("file_id"),
                 part_file("remote_errors", F.col("part_index")).alias("path")),
    )
    return parts.select("corpus_id", "part_index", F.inline(kinds)).filter("file_id is not null")


def fetch_plan(parts: DataFrame, present: DataFrame, force: bool = False) -> DataFrame:
    """Files to download; ``present``: corpus_id, path of files already there."""
    wanted = expected_files(parts)
    return wanted if force else wanted.join(present, ["corpus_id", "path"], "left_anti")


def merge_fetched(parts: DataFrame, fetched: DataFrame) -> DataFrame:
    """Record downloaded files; ``fetched``: corpus_id, part_index, kind, path."""
    per_part = fetched.groupBy("corpus_id", "part_index").agg(
        F.max(F.when(F.col("kind") == "output", F.col("path"))).alias("_output"),
        F.max(F.when(F.col("kind") == "error", F.col("path"))).alias("_error"),
    )
    changed = {
        "output_file": F.coalesce("_output", "output_file"),
        "error_file": F.coalesce("_error", "error_file"),
    }
    return parts.join(per_part, ["corpus_id", "part_index"], "left").select(
        *[changed.get(c, F.col(c)).alias(c) for c in parts.columns]
    )


def backfill_parts(manifests: DataFrame, parts: DataFrame) -> DataFrame:
    """Give batches without parts one part made from their own columns."""
    zero = F.lit(0).cast("long")
    made = {
        "part_index": F.lit(1).cast("long"), "request_bytes": zero, "completed_count": zero,
    }
    alone = manifests.join(parts.select("corpus_id").distinct(), "corpus_id", "left_anti")
    return parts.unionByName(alone.select(*[made.get(c, F.col(c)).alias(c) for c in parts.columns]))


def mismatched(manifests: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Add whether each batch manifest belongs to the current input."""
    return manifests.select("corpus_id", F.col("sha256").alias("_recorded")).join(
        fingerprints.select("corpus_id", "sha256"), "corpus_id"
    ).select("corpus_id", (F.col("_recorded") == F.col("sha256")).alias("belongs"))
