"""Selection, rerouting, filling and reporting over the work ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import LOCAL_REQUEST_BUDGET, STALL_REQUESTS, STALL_SECONDS
from lectern.functions import text
from lectern.functions.formats import age_seconds, compact_age, hms
from lectern.functions.validation import is_auth_error, reason_message
from lectern.operators.joins import spread_join
from lectern.operators.ordinals import running_sums
from lectern.session import written

# States and what they count as.
RETRY_STATES = ("failed", "rejected", "local_exhausted")
COMPLETED_STATES = ("imported", "local_imported", "cached", "skipped")
CACHE_BACKED_STATES = ("imported", "local_imported", "skipped")
HARD_REASONS = ("prompt_leak", "missing_placeholder", "unchanged_source", "refusal_or_explanation")
REFERENCE_SKIP = (
    "skipped local batch retry for reference-like block"
    " | suggested_action=inspect_reference_or_try_another_provider"
)

PLACE = ("page_index", "block_index", "custom_id")


def state_rank() -> Column:
    state = F.col("state")
    return (
        F.when(state.isin(*RETRY_STATES), 0)
        .when(state == "local_pending", 1)
        .when(state == "submitted", 2)
        .when(state == "prepared", 3)
        .otherwise(4)
    )


def hardness() -> Column:
    return (
        F.col("source_chars")
        + text.count_of(F.col("source_text"), "⟦") * 100
        + F.col("attempt") * 25
        + F.when(F.col("last_error").isNotNull(), 50).otherwise(0)
    )


def priority_key(priority: str) -> Column:
    """Struct that sorts work items in the order of a priority; custom_id ends ties."""
    lead = {
        "page-order": [],
        "failed-first": [state_rank().alias("lead")],
        "hard-first": [(-hardness()).alias("lead")],
        "short-first": [F.col("source_chars").alias("lead")],
        "oldest-first": [F.col("updated_at").alias("lead")],
    }[priority]
    return F.struct(*lead, *PLACE)


def top_items(work_items: DataFrame, priority: str, limit: int) -> DataFrame:
    return work_items.orderBy(priority_key(priority)).limit(limit)


def with_cache_flag(work_items: DataFrame, cache: DataFrame) -> DataFrame:
    keys = cache.select(F.col("key").alias("cache_key")).distinct().withColumn("in_cache", F.lit(True))
    return spread_join(work_items, keys, "cache_key", PLACE).withColumn(
        "in_cache", F.coalesce("in_cache", F.lit(False))
    )


def finished() -> Column:
    return F.col("state").isin("imported", "local_imported") | F.col("in_cache")


def remaining() -> Column:
    return ~finished() & ~F.col("state").isin("local_pending", "local_exhausted")


def submit(work_items: DataFrame, now: str) -> DataFrame:
    ready = F.col("state") == "prepared"
    return work_items.withColumn("updated_at", F.when(ready, F.lit(now)).otherwise(F.col("updated_at"))).withColumn(
        "state", F.when(ready, "submitted").otherwise(F.col("state"))
    )


def retry_requests(work_items: DataFrame, cache: DataFrame, requests: DataFrame, priority: str,
                   limit: int | None = None, states: Sequence[str] = RETRY_STATES) -> DataFrame:
    """Original requests of items to retry, in priority order; a lost request is an error."""
    chosen = (
        work_items.filter(F.col("state").isin(*states))
        .join(cache.select(F.col("key").alias("cache_key")), "cache_key", "left_anti")
        .withColumn("_key", priority_key(priority))
    )
    if limit is not None:
        chosen = chosen.orderBy("_key").limit(limit)
    present = requests.select("custom_id", F.col("body").alias("_body"))
    body = F.when(F.col("_body").isNotNull(), F.col("_body")).otherwise(
        F.raise_error(F.concat(F.lit("no request for "), F.col("custom_id")))
    )
    return chosen.join(present, "custom_id", "left").select("_key", "custom_id", body.alias("body")).orderBy(
        "_key"
    ).drop("_key")


def reroute(work_items: DataFrame, cache: DataFrame, priority: str, now: str, *,
            states: Sequence[str] = (), use_remaining: bool = False,
            endgame_threshold: int | None = None, limit: int | None = None) -> DataFrame:
    """Ledger with selected items set to local_pending, plus columns selected and finished.

    The limit is a cut in priority order: the last selected key bounds the rest, so no
    window over all rows is needed.
    """
    if not (states or use_remaining or endgame_threshold is not None):
        raise ValueError("select by states, use_remaining or endgame_threshold")
    flagged = with_cache_flag(work_items, cache).withColumn("finished", finished()).withColumn(
        "_key", priority_key(priority)
    )
    wanted = F.col("state").isin(*states) if states else F.lit(False)
    if use_remaining or endgame_threshold is not None:
        wanted = wanted | (F.col("state") != "local_pending")
    flagged = flagged.withColumn("_want", wanted & ~F.col("finished"))
    if endgame_threshold is not None:
        gate = flagged.agg((F.count_if(remaining()) <= endgame_threshold).alias("_gate"))
        flagged = flagged.join(F.broadcast(gate)).withColumn("_want", F.col("_want") & F.col("_gate"))
    if limit is not None:
        cut = flagged.filter("_want").select("_key").orderBy("_key").limit(limit).agg(
            F.max("_key").alias("_cut"), F.count("*").alias("_n")
        )
        flagged = flagged.join(F.broadcast(cut)).withColumn(
            "_walked", F.coalesce((F.col("_n") < limit) | (F.col("_key") <= F.col("_cut")), F.lit(False))
        )
    else:
        flagged = flagged.withColumn("_walked", F.lit(True))
    selected = F.col("_want") & F.col("_walked")
    changed = {
        "state": F.when(selected, "local_pending").otherwise(F.col("state")),
        "last_error": F.when(~selected, F.col("last_error")),
        "updated_at": F.when(selected, F.lit(now)).otherwise(F.col("updated_at")),
    }
    return flagged.select(
        *[changed.get(c, F.col(c)).alias(c) for c in work_items.columns],
        selected.alias("selected"),
        (F.col("finished") & F.col("_walked")).alias("skipped_finished"),
    )


def failure_action(reason: Column, error: Column, source: Column, requests: Column) -> Column:
    """Next action for a failed item."""
    return (
        F.when(is_auth_error(error), "fix_provider_auth")
        .when(text.reference_like(source), "inspect_reference_or_try_another_provider")
        .when(requests >= LOCAL_REQUEST_BUDGET, "batch_retry_requests_or_try_another_provider")
        .when(reason == "missing_placeholder", "retry_translation_or_inspect_inline")
        .when(reason.isNotNull(), "retry_translation")
        .otherwise("inspect_manually")
    )


def segment_class(reason: Column, source: Column) -> Column:
    return F.when(
        reason == "untranslated_segment",
        F.when(text.reference_like(source), "reference_like").otherwise("prose_like"),
    )


def exhausts(reason: Column, source: Column, requests: Column) -> Column:
    """Is another local attempt pointless?"""
    hard = F.coalesce(reason.isin(*HARD_REASONS), F.lit(False))
    reference = F.coalesce(segment_class(reason, source) == "reference_like", F.lit(False))
    return reference | hard | (requests >= LOCAL_REQUEST_BUDGET)


def failure_text(reason: Column, error: Column, source: Column, requests: Column) -> Column:
    over = F.when(
        requests >= LOCAL_REQUEST_BUDGET,
        F.format_string(
            f"local request budget exceeded: %d request(s) used (limit {LOCAL_REQUEST_BUDGET})", requests
        ),
    )
    return F.concat_ws(
        " | ",
        F.coalesce(error, reason_message(reason)),
        over,
        F.concat(F.lit("validation_reason="), reason),
        F.concat(F.lit("suggested_action="), failure_action(reason, error, source, requests)),
    )


STALLED = "batch translate-local stalled: %d completed, %d errors; no new completions for %dm %02ds while API requests increased by %d; current item p%d b%d %s"


def fill_stop(processed: DataFrame, secs: int = STALL_SECONDS, requests: int = STALL_REQUESTS) -> DataFrame:
    """One row: where a local fill stops, and why; nulls where it does not.

    ``processed`` has, per item in reach, ``_key`` (its unique place in the priority order), ``done``,
    ``auth`` (an authentication failure), ``requests`` and ``seconds``. The fill stops at the first item
    that fails to authenticate, or at which so many seconds and requests went by since the last
    completion. What went by comes from sums inside ranges of the key and totals of the ranges
    before; the items of one wait are told apart by the number of completions before them.
    """
    ranges = processed.repartitionByRange("_key").withColumn("_range", F.spark_partition_id())
    ranges = written(ranges, "fill-ranges")
    done = F.col("done").cast("long")
    sums = {"n_done": done, "n_failed": 1 - done, "r": F.col("requests"), "s": F.col("seconds")}
    walked = running_sums(ranges, [], F.col("_range"), [F.col("_key")], sums)
    # A wait begins with the completion that ended the one before, so its least sums are its base.
    base = walked.groupBy("n_done").agg(F.min("r").alias("r0"), F.min("s").alias("s0"))
    since = walked.join(base, "n_done").select(
        "_key", "done", "auth", "n_done", "n_failed",
        (F.col("r") - F.when(F.col("n_done") > 0, F.col("r0")).otherwise(0)).alias("since_requests"),
        (F.col("s") - F.when(F.col("n_done") > 0, F.col("s0")).otherwise(0)).alias("since_seconds"))
    stalls = ~F.col("done") & (F.col("since_requests") >= requests) & (F.col("since_seconds") >= secs)
    kind = F.when(F.col("auth"), "auth").when(stalls, "stall")
    first = F.min(F.when(kind.isNotNull(), F.struct("_key", kind.alias("kind"), "n_done", "n_failed", "since_requests", "since_seconds")))
    return since.agg(first.alias("_stop"))


def fill_local(work_items: DataFrame, cache: DataFrame, results: DataFrame, priority: str, now: str,
               limit: int | None = None, stops: bool = True) -> DataFrame:
    """Ledger after the local provider ran over local_pending items.

    ``results``: cache_key, translated, reason, error, requests, and seconds where stalls are to
    be told. The limit counts processed items in priority order. With ``stops`` the fill ends at
    the first authentication failure or stall (``fill_stop``): items behind it keep their state, and
    the item it stalls at is exhausted.
    """
    flagged = with_cache_flag(work_items, cache).withColumn("_key", priority_key(priority))
    pending = F.col("state") == "local_pending"
    if limit is not None:
        cut = flagged.filter(pending).select("_key").orderBy("_key").limit(limit).agg(
            F.max("_key").alias("_cut")
        )
        flagged = flagged.join(F.broadcast(cut))
        pending = pending & F.coalesce(F.col("_key") <= F.col("_cut"), F.lit(False))
    seconds = F.col("seconds") if "seconds" in results.columns else F.lit(0)
    called = results.select(
        "cache_key", *[F.col(c).alias(f"_{c}") for c in ("reason", "error", "requests")],
        seconds.cast("long").alias("_seconds"), F.lit(True).alias("_called")
    )
    joined = spread_join(flagged, called, "cache_key", PLACE, hot_from=work_items).withColumn("_pending", pending)
    source = F.col("source_text")
    failed = F.col("_reason").isNotNull() | F.col("_error").isNotNull()
    outcome = (
        F.when(~F.col("_pending"), None)
        .when(text.reference_like(source), "reference_like")
        .when(F.col("in_cache"), "cached")
        .when(F.col("_called").isNull(), None)
        .when(~failed, "translated")
        .when(exhausts(F.col("_reason"), source, F.col("_requests")), "exhausted")
        .otherwise("failed")
    )
    told = joined.withColumn("_outcome", outcome)
    done = F.col("_outcome").isin("cached", "translated")
    was_called = F.col("_outcome").isin("translated", "exhausted", "failed")
    message = F.lit(None).cast("string")
    if stops:
        spent = lambda c: F.when(was_called, F.coalesce(F.col(c), F.lit(0))).otherwise(0).cast("long")
        stop = fill_stop(told.filter("_outcome is not null").select(
            "_key", done.alias("done"), (was_called & ~done & is_auth_error(F.col("_error"))).alias("auth"),
            spent("_requests").alias("requests"), spent("_seconds").alias("seconds")))
        behind = F.coalesce(F.col("_key") > F.col("_stop._key"), F.lit(False))
        told = told.join(F.broadcast(stop)).withColumn("_outcome", F.when(~behind, F.col("_outcome")))
        at = F.coalesce((F.col("_key") == F.col("_stop._key")) & (F.col("_stop.kind") == "stall"), F.lit(False))
        told = told.withColumn("_stalled", at)
        waited = F.col("_stop.since_seconds")
        message = F.when(F.col("_stalled"), F.format_string(
            STALLED, "_stop.n_done", "_stop.n_failed", F.floor(waited / 60), waited % 60, "_stop.since_requests",
            "page_index", "block_index", "href"))
    else:
        told = told.withColumn("_stalled", F.lit(False))
    error = F.when(F.col("_outcome") == "reference_like", REFERENCE_SKIP).when(
        F.col("_outcome").isin("exhausted", "failed"),
        failure_text(F.col("_reason"), F.col("_error"), source, F.col("_requests")))
    changed = {
        "state": F.when(done, "local_imported")
        .when(F.col("_stalled") | F.col("_outcome").isin("reference_like", "exhausted"), "local_exhausted")
        .otherwise(F.col("state")),
        "last_error": F.when(F.col("_stalled"), F.concat_ws(" | ", error, message))
        .when(F.col("_outcome").isNotNull(), error).otherwise(F.col("last_error")),
        "updated_at": F.when(F.col("_outcome").isNotNull(), F.lit(now)).otherwise(F.col("updated_at")),
    }
    return told.select(
        *[changed.get(c, F.col(c)).alias(c) for c in work_items.columns],
        F.when(F.col("_stalled"), "stalled").otherwise(F.col("_outcome")).alias("fill_outcome"),
    )


def status_after_fill() -> Column:
    """Aggregate: ledger status once a local fill ends."""
    state = F.col("state")
    return (
        F.when(F.bool_or(state == "local_pending"), "local_pending")
        .when(F.bool_or(state == "local_exhausted"), "local_exhausted")
        .otherwise("local_imported")
    )


def state_counts(work_items: DataFrame) -> DataFrame:
    return work_items.groupBy("state").agg(F.count("*").alias("n"))


SUMMARY_STATES = ("local_imported", "local_pending", "local_exhausted", "submitted", "prepared")


def run_summary(work_items: DataFrame, manifests: DataFrame, summaries: DataFrame, elapsed: int) -> DataFrame:
    """One line of counters per corpus.

    ``manifests``: corpus_id, status, request_count, completed_requests, failed_count;
    ``summaries``: corpus_id, summary.
    """
    counts = work_items.groupBy("corpus_id").agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in SUMMARY_STATES]
    )
    label = [F.concat(F.lit(f"{s} "), F.col(s).cast("string")) for s in SUMMARY_STATES]
    line = F.concat_ws(
        " | ",
        F.concat(F.lit("elapsed "), hms(F.lit(elapsed))),
        F.concat(F.lit("status "), F.col("status")),
        F.concat(F.lit("parts "), F.col("summary")),
        F.concat(F.lit("remote "), F.col("completed_requests").cast("string"), F.lit("/"),
                 F.col("request_count").cast("string"), F.lit(" done, "),
                 F.col("failed_count").cast("string"), F.lit(" failed")),
        *label,
    )
    return counts.join(manifests, "corpus_id").join(summaries, "corpus_id").select(
        "corpus_id", line.alias("line")
    )


def ledger_health(work_items: DataFrame, cache: DataFrame, now: str) -> DataFrame:
    """One row per corpus on progress, cache backing and the oldest open item."""
    done = F.col("state").isin(*COMPLETED_STATES)
    oldest = F.min(F.when(~done, F.col("updated_at")))
    return with_cache_flag(work_items, cache).groupBy("corpus_id").agg(
        F.count("*").alias("work_items"),
        F.count_if(done).alias("completed_items"),
        F.count_if(F.col("in_cache")).alias("cache_backed"),
        F.count_if(~done & F.col("in_cache")).alias("cache_backed_pending"),
        F.count_if(~done & ~F.col("in_cache")).alias("effective_remaining"),
        oldest.alias("oldest_pending_at"),
    ).withColumn(
        "oldest_pending_age_secs", age_seconds(F.col("oldest_pending_at"), F.to_timestamp(F.lit(now)))
    ).withColumn("oldest_pending_age", compact_age(F.col("oldest_pending_age_secs")))


def health_lines(health: DataFrame) -> DataFrame:
    """Health as (corpus_id, metric, value) rows."""
    metrics = [c for c in health.columns if c != "corpus_id"]
    return health.select("corpus_id", *[F.col(c).cast("string").alias(c) for c in metrics]).unpivot(
        ["corpus_id"], metrics, "metric", "value"
    )
