"""Lookup joins that survive a key shared by a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACKED = 1_000
COUNTERS = 100_000
SALTS = 64
HOT_ROWS = 1_000_000


def hot_values(rows: DataFrame, key: str, least: int = HOT_ROWS) -> list:
    """Values with more than ``least`` rows, a task's worth whatever the table's size; the commonest first.

    The sketch's counters tell such values apart up to ``least`` x COUNTERS rows. One pass
    over the key column with a sketch of fixed size; no shuffle of keys.
    """
    found = rows.agg(F.expr(f"approx_top_k(`{key}`, {TRACKED}, {COUNTERS})").alias("top")).first()
    return [t["item"] for t in found.top or [] if t["count"] > least and t["item"] is not None]


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, spread_by: Sequence[str],
                how: str = "left", least: int = HOT_ROWS, hot_from: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to a lookup with one row per key.

    Rows of hot keys are spread over salts by the hash of ``spread_by`` (so a retried
    task gives every row the same salt), and only the lookup rows of those few keys
    are repeated per salt. Rows without a key are spread as well. ``hot_from`` names a
    stored table with the same key, where ``rows`` themselves would be computed twice.
    """
    hot = hot_values(rows if hot_from is None else hot_from, key, least)
    if not hot:
        return rows.join(lookup, key, how)
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int")
    is_hot = F.col(key).isin(*hot)
    salted = rows.withColumn(
        "_salt", F.when(F.col(key).isNull() | is_hot, spread).otherwise(F.lit(0))
    )
    copies = lookup.withColumn(
        "_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    )
    return salted.join(copies, [key, "_salt"], how).drop("_salt")
