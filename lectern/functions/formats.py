"""Human-readable renderings of sizes, durations and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import collapse, strip

# Recovery reason -> suggested action (anything else: inspect_manually).
RECOVERY_ACTIONS = {
    "cache_miss": "translate_uncached",
    "inline_restore_failed": "retry_translation_or_inspect_inline",
    "unchanged_source": "retry_translation",
    "detected_untranslated_output": "retry_translation",
    "validation_passthrough": "retry_translation",
    "original_output": "retry_translation",
}


def human_bytes(size: Column) -> Column:
    def scaled(unit: str, power: int) -> Column:
        # Two decimals, ties to even.
        rounded = F.bround(size / F.lit(float(1024**power)), 2)
        return F.concat(F.format_string("%.2f", rounded), F.lit(f" {unit}"))

    return (
        F.when(size >= 1024**3, scaled("GB", 3))
        .when(size >= 1024**2, scaled("MB", 2))
        .when(size >= 1024, scaled("KB", 1))
        .otherwise(F.concat(size.cast("string"), F.lit(" B")))
    )


def hms(secs: Column) -> Column:
    """HH:MM:SS with unbounded hours."""
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(secs / 3600).cast("long"),
        F.floor(secs % 3600 / 60).cast("long"),
        (secs % 60).cast("long"),
    )


def compact_age(secs: Column) -> Column:
    days, hours = F.floor(secs / 86400), F.floor(secs % 86400 / 3600)
    minutes, seconds = F.floor(secs % 3600 / 60), secs % 60
    return (
        F.when(days > 0, F.format_string("%dd %dh %dm", days, hours, minutes))
        .when(hours > 0, F.format_string("%dh %dm %ds", hours, minutes, seconds))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, seconds))
        .otherwise(F.format_string("%ds", seconds))
    )


def age_seconds(stamp: Column, now: Column) -> Column:
    """Whole seconds from an RFC 3339 string to ``now``, not below zero; null if unreadable."""
    parsed = F.unix_timestamp(F.try_to_timestamp(stamp))
    return F.greatest(F.lit(0).cast("long"), F.unix_timestamp(now) - parsed)


def suggested_action(reason: Column) -> Column:
    pairs = [F.lit(v) for kv in RECOVERY_ACTIONS.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), reason), F.lit("inspect_manually"))


def http_error_summary(body: Column, max_chars: int = 240) -> Column:
    flat = collapse(body)
    return (
        F.when(flat == "", "(empty response body)")
        .when(F.length(flat) <= max_chars, flat)
        .otherwise(F.concat(F.left(flat, F.lit(max_chars)), F.lit("...")))
    )


def json_error_summary(body: Column, max_chars: int = 1000) -> Column:
    """Message, type, param and code of a JSON error; else the cut body."""
    trimmed = strip(body)

    def part(name: str) -> Column:
        return F.get_json_object(trimmed, f"$.error.{name}")

    def labelled(name: str) -> Column:
        return F.concat(F.lit(f"{name}="), part(name))

    plain = F.when(F.length(trimmed) <= max_chars, trimmed).otherwise(
        F.concat(F.left(trimmed, F.lit(max_chars)), F.lit("..."))
    )
    return F.when(
        F.get_json_object(trimmed, "$.error").isNotNull(),
        F.concat_ws(
            " | ",
            F.coalesce(part("message"), trimmed),
            labelled("type"),
            labelled("param"),
            labelled("code"),
        ),
    ).otherwise(plain)
