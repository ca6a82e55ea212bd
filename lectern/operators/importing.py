"""Import of batch output into the ledger and the cache."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.prompts import response_text
from lectern.functions.text import short_hash
from lectern.functions.validation import reason_message, source_traits, target_traits, traits_reason
from lectern.operators.cache import key_traits
from lectern.operators.joins import spread_join
from lectern.session import written

LINE_PLACE = ("stream", "part_index", "line_no")
ORDER = ("updated_at", "attempt", "state", "source_hash", "cache_key", "custom_id")

# Error texts of the import.
DUPLICATE = "duplicate output custom_id"
UNKNOWN = "output custom_id was not found in work_items.jsonl"
HASH_MISMATCH = "work item source_hash does not match source_text"
NO_RESPONSE = "batch output line has no response"
NO_TEXT = "batch response body did not contain output text"
NO_DETAILS = "remote batch error line did not contain error details"


@dataclass(frozen=True)
class ImportResult:
    lines: DataFrame  # one row per input line with outcome and error
    work_items: DataFrame
    cache_rows: DataFrame  # rows to add to the cache


def all_lines(outputs: DataFrame, errors: DataFrame) -> DataFrame:
    """Output lines, then error lines, with their place in the import order."""
    cols = ("part_index", "line_no", "custom_id", "status_code", "body", "error")
    return outputs.select(F.lit(0).alias("stream"), *cols).unionByName(
        errors.select(F.lit(1).alias("stream"), *cols)
    )


def marked_last(work_items: DataFrame, keys: Sequence[str] = ("custom_id",)) -> DataFrame:
    """Adds ``is_last``: is this the ledger's last row of its id (or other ``keys``)?

    The last one has the greatest (updated_at, attempt, state, source_hash, cache_key, custom_id);
    rows alike in all of these are all last. Repeated ids are few: only they are joined back.
    """
    order = F.struct(*[c for c in ORDER if c in work_items.columns])
    repeated = work_items.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(order).alias("_last")).where("_n > 1")
    return work_items.join(repeated.select(*keys, "_last"), list(keys), "left").select(
        *work_items.columns, (F.col("_last").isNull() | (F.col("_last") == order)).alias("is_last"),
        F.col("_last").isNotNull().alias("_repeated"))


def last_rows(work_items: DataFrame, keys: Sequence[str] = ("custom_id",)) -> DataFrame:
    """One ledger row per id (or other ``keys``): of repeated ones the last counts."""
    marked = marked_last(work_items, keys).where("is_last")
    single = marked.where("NOT _repeated").select(*work_items.columns)
    return single.unionByName(marked.where("_repeated").select(*work_items.columns).dropDuplicates(list(keys)))


def latest(rows: DataFrame, keys: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """(keys.., carried..) of ``last_rows``, for rows without texts: one aggregate finds and holds the last row.

    ``keys`` are not null.
    """
    order = [c for c in ORDER if c in rows.columns]
    last = F.max(F.struct(*order, *[c for c in carried if c not in order]))
    return rows.groupBy(*keys).agg(last.alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in carried if c not in keys])


def judged_items(work_items: DataFrame) -> DataFrame:
    """What the import has to know of each id: (custom_id, cache_key, hash_ok, source), the traits for the text."""
    hash_ok = F.col("source_hash") == short_hash(F.col("source_text"))
    slim = work_items.where("custom_id IS NOT NULL").select(
        *[c for c in ORDER if c in work_items.columns], hash_ok.alias("hash_ok"),
        source_traits(F.col("source_text")).alias("source"))
    return latest(slim, ["custom_id"], ["cache_key", "hash_ok", "source"])


def line_fault() -> Column:
    """What is wrong with an output line that has (source, status_code, error, reply); null for nothing.

    ``source`` and ``reply`` are the traits of the two texts.
    """
    return (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("batch output error: "), F.col("error")))
        .when(F.col("status_code").isNull(), NO_RESPONSE)
        .when(
            F.col("status_code") != 200,
            F.concat(F.lit("batch output status_code was "), F.col("status_code").cast("string")),
        )
        .when(F.col("reply").isNull(), NO_TEXT)
        .otherwise(reason_message(traits_reason(F.col("source"), F.col("reply"))))
    )


def line_message(remote_fault: Column) -> Column:
    """The error text of a line with (outcome, hash_ok, fault)."""
    return (
        F.when(F.col("outcome") == "duplicate", DUPLICATE)
        .when(F.col("outcome") == "unknown", UNKNOWN)
        .when(F.col("outcome") == "failed", remote_fault)
        .when(F.col("outcome") == "rejected", F.when(~F.col("hash_ok"), HASH_MISMATCH).otherwise(F.col("fault")))
    )


def judged_lines(work_items: DataFrame, cache: DataFrame, outputs: DataFrame, errors: DataFrame) -> DataFrame:
    """Every line with its outcome.

    ``cache`` has one row per key, with ``translated`` or its ``traits``. Lines are imported in the order
    (stream, part_index, line_no). Both "first line of an id" and "first valid line of a key"
    are minima, found with partial aggregation and joined back, so a key shared by
    very many lines never gathers in one task. Of ledger rows that share an id the last one counts.
    Sources, answers and cached texts stay where they are read: the joins carry their traits. The judged lines
    are written once, because both the winners and the outcomes are read from them.
    """
    reply = F.when(F.col("stream") == 0, target_traits(response_text(F.col("body"))))
    lines = all_lines(outputs, errors).select(
        *LINE_PLACE, F.struct(*LINE_PLACE).alias("ord"), "custom_id", "status_code", "error", reply.alias("reply"))
    items = judged_items(work_items).withColumn("known", F.lit(True))
    # Both sides hold one row per id, so the lines themselves meet one lookup only.
    per_id = lines.groupBy("custom_id").agg(F.min("ord").alias("first_ord")).join(items, "custom_id", "left")
    known = spread_join(lines, per_id, "custom_id", LINE_PLACE, "inner")
    placed = (
        spread_join(known, key_traits(cache), "cache_key", LINE_PLACE, hot_from=work_items)
        .withColumn("repeat", F.col("ord") != F.col("first_ord"))
        .withColumn("open", ~F.col("repeat") & F.col("known").isNotNull() & (F.col("stream") == 0))
        .withColumn(
            "stored_ok",
            F.when(F.col("open") & F.col("stored").isNotNull(),
                   traits_reason(F.col("source"), F.col("stored")).isNull()).otherwise(False),
        )
        .withColumn("fault", F.when(F.col("open"), line_fault()))
        .withColumn("good", F.col("open") & F.col("hash_ok") & ~F.col("stored_ok") & F.col("fault").isNull())
        .select(
            *LINE_PLACE, "ord", "custom_id", "cache_key", "status_code", "error", "known", "repeat", "open", "hash_ok",
            "stored_ok", F.when(F.col("good"), F.col("reply.form")).alias("form"), "fault", "good",
        )
    )
    placed = written(placed, "import-judged")
    winners = placed.filter("good").groupBy("cache_key").agg(F.min("ord").alias("win_ord"))
    remote_fault = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("remote batch error: "), F.col("error")))
        .when(
            F.col("status_code").isNotNull(),
            F.concat(F.lit("remote batch error status_code: "), F.col("status_code").cast("string")),
        )
        .otherwise(NO_DETAILS)
    )
    outcome = (
        F.when(F.col("repeat"), "duplicate")
        .when(F.col("known").isNull(), "unknown")
        .when(F.col("stream") == 1, "failed")
        .when(~F.col("hash_ok"), "rejected")
        .when(F.col("stored_ok") | F.coalesce(F.col("ord") > F.col("win_ord"), F.lit(False)), "already_cached")
        .when(F.col("fault").isNull(), "imported")
        .otherwise("rejected")
    )
    return (
        spread_join(placed, winners, "cache_key", LINE_PLACE)
        .withColumn("outcome", outcome)
        .withColumn(
            "message",
            line_message(remote_fault),
        )
        .select("stream", "part_index", "line_no", "custom_id", "cache_key", "outcome", "message", "form")
    )


def imported_answers(lines: DataFrame, outputs: DataFrame) -> DataFrame:
    """(custom_id, cache_key, answer) of the imported lines; only their texts are looked up, by place, id and form."""
    place = ["part_index", "line_no", "custom_id", "form"]
    won = lines.filter(F.col("outcome") == "imported").groupBy(*place, "cache_key").agg(F.count("*").alias("_n"))
    given = outputs.filter((F.col("status_code") == 200) & F.col("error").isNull()).select(
        F.col("part_index").alias("_part"), F.col("line_no").alias("_line"), F.col("custom_id").alias("_id"),
        response_text(F.col("body")).alias("answer"),
    ).withColumn("_form", target_traits(F.col("answer"))["form"])
    same = (F.col("part_index").eqNullSafe(F.col("_part")) & F.col("line_no").eqNullSafe(F.col("_line"))
            & (F.col("custom_id") == F.col("_id")) & (F.col("form") == F.col("_form")))
    # A line that stands there more than once has one answer, given as often as it was imported.
    found = won.join(given, same).dropDuplicates([*place, "cache_key"])
    return found.select("custom_id", "cache_key", "answer", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("col")


def import_outputs(work_items: DataFrame, cache: DataFrame, outputs: DataFrame, errors: DataFrame,
                   now: str) -> ImportResult:
    """Judge all lines, advance the ledger and collect new cache rows.

    Where ledger rows share an id the last one is judged and moved; the others stay as they are.
    """
    lines = judged_lines(work_items, cache, outputs, errors)
    moves = lines.filter(F.col("outcome").isin("imported", "already_cached", "rejected", "failed")).select(
        "custom_id",
        F.when(F.col("outcome").isin("imported", "already_cached"), "imported")
        .otherwise(F.col("outcome")).alias("_state"),
        F.col("message").alias("_message"),
    )
    moved = F.col("_state").isNotNull() & F.col("is_last")
    changed = {
        "state": F.when(moved, F.col("_state")).otherwise(F.col("state")),
        "last_error": F.when(moved, F.col("_message")).otherwise(F.col("last_error")),
        "updated_at": F.when(moved, F.lit(now)).otherwise(F.col("updated_at")),
    }
    ledger = marked_last(work_items).join(moves, "custom_id", "left").select(
        *[changed.get(c, F.col(c)).alias(c) for c in work_items.columns]
    )
    rows = imported_answers(lines, outputs).join(last_rows(work_items).select("custom_id", "provider", "model"), "custom_id").select(
        F.col("cache_key").alias("key"), F.col("answer").alias("translated"), "provider", "model",
        F.lit(now).alias("at"),
    )
    return ImportResult(lines, ledger, rows)


def import_report(lines: DataFrame) -> DataFrame:
    """Counts of one import and the batch status they give."""
    counts = lines.agg(
        F.count_if(F.col("outcome") == "imported").alias("imported_count"),
        F.count_if(F.col("outcome") == "already_cached").alias("already_cached_count"),
        F.count_if(F.col("outcome") == "rejected").alias("rejected_count"),
        F.count_if(F.col("outcome").isin("duplicate", "unknown", "failed")).alias("error_count"),
    )
    clean = (F.col("rejected_count") == 0) & (F.col("error_count") == 0)
    return counts.withColumn(
        "manifest_imported", F.col("imported_count") + F.col("already_cached_count")
    ).withColumn("status", F.when(clean, "imported").otherwise("imported_with_errors"))
