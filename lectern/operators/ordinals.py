"""Dense ordinals and running sums that do not depend on how rows spread over keys.

One key may hold a large share of all rows, so no window here runs over a whole
key. Rows are windowed inside (key, bucket); bucket totals, which are few, are
accumulated per key and joined back. ``bucket`` must grow with the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, Window.currentRow)


def running_sums(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[Column],
    sums: dict[str, Column],
) -> DataFrame:
    """Add inclusive running sums per key in the given order."""
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy(*keys, "_bucket").agg(
        *[F.sum(value).alias(f"_t_{name}") for name, value in sums.items()]
    )
    over_buckets = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(*BEFORE)
    offsets = totals.select(
        *keys,
        "_bucket",
        *[
            F.coalesce(F.sum(f"_t_{name}").over(over_buckets), F.lit(0)).alias(f"_o_{name}")
            for name in sums
        ],
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(*UP_TO)
    local = rows.select(
        "*", *[F.sum(value).over(inside).alias(f"_l_{name}") for name, value in sums.items()]
    )
    here, there = local.alias("here"), offsets.alias("there")
    same = [F.col(f"here.{k}").eqNullSafe(F.col(f"there.{k}")) for k in (*keys, "_bucket")]
    joined = here.join(there, same)
    return joined.select(
        *[F.col(f"here.{c}") for c in df.columns],
        *[(F.col(f"_l_{name}") + F.col(f"_o_{name}")).cast("long").alias(name) for name in sums],
    )


def dense_numbers(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str
) -> DataFrame:
    """Add 1-based positions per key in the given (unique) order."""
    return running_sums(df, keys, bucket, order, {name: F.lit(1).cast("long")})
