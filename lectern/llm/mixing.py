"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the documents are ordered by
that key, prefix sums of their sizes are taken in ranges of the key (sums inside a
range, plus the total of the ranges before it), and the order is cut at the source's
exact budget; a budget above the source's size repeats the order in further epochs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD, whole_text
from lectern.session import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
KEY_DIGITS = 3
SEED = "mix"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """(source, source_size) -> the same with weight and target.

    Sources in code point order, null last, weigh ``weights``, repeating. They share
    ``share`` times all sizes; no target passes ``most`` times its source's size, and what
    is cut there is shared again by weight. Sources sorted by cap per weight make that one
    pass: those that are capped come first, all others get the level of the first uncapped
    one. The table has one row per source, so one ordered window over it is small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_rank", F.row_number().over(by_name))
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = ranked.withColumn(
        "weight", F.get(cycle, F.pmod(F.col("_rank") - 1, F.lit(len(weights)))).cast("long")
    ).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(float(share))
             - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    leveled = weighed.withColumn("_level", level).withColumn(
        "_capped", F.col("_cap") / F.col("weight") <= F.col("_level"))
    open_level = F.min(F.when(~F.col("_capped"), F.struct(F.col("_cap") / F.col("weight"), "_rank", "_level"))).over(whole)
    return leveled.withColumn("_open", open_level["_level"]).select(
        "source", "source_size", "weight",
        F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_open") * F.col("weight")).alias("target"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST,
        seed: str = SEED, key_digits: int = KEY_DIGITS, carried: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text, source) -> (doc_id, source, size, source_size, target, taken), a row per row.

    With ``carried`` columns, these go along as a struct of that name.

    ``taken`` counts the words the mix takes from the document over all epochs; the document
    at the cut gives only the words that are left of the budget. A null text has size 0, a
    null source is a source of its own and comes last, a null id is hashed as no text.
    Repeated rows are rows of their own; rows alike in id and size are interchangeable. An
    empty table gives an empty result; other columns are ignored. Equal inputs give equal
    results: the key is a digest of the id, never a random number.

    One source may hold most rows: its rows spread over 16 ** ``key_digits`` key ranges, and
    only the totals of those ranges meet in one window.
    """
    rows = docs.select(
        "doc_id", "source", word_count().alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary")).alias("_key"),
        *([F.struct(*[F.col(f"`{c}`") for c in carried]).alias("carried")] if carried else []),
    ).withColumn("_range", F.substring("_key", 1, key_digits))
    sized = written(rows.drop("carried"), "mix-sizes")
    ranges = sized.groupBy("source", "_range").agg(F.sum("size").alias("_range_size"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("_offset", F.coalesce(F.sum("_range_size").over(earlier), F.lit(0)))
    totals = ranges.groupBy("source").agg(F.sum("_range_size").alias("source_size"))
    targets = source_targets(totals, weights, share, most)
    plan = offsets.alias("o").join(
        targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))
    ).select(F.col("o.source").alias("_s"), F.col("_range").alias("_r"), "_offset", "source_size", "target")
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = (rows if carried else sized).withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    cut = F.least(F.greatest(rest - (F.col("_offset") + F.col("_inside")), F.lit(0)), F.col("size"))
    return joined.select("doc_id", "source", "size", "source_size", "target",
                         (epochs * F.col("size") + cut).cast("long").alias("taken"), *(["carried"] if carried else []))


# The same rules for DuckDB.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', 'mix', doc_id::VARCHAR)) AS k
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM totals),
weighed AS (SELECT *, [3, 1, 2][((r - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 2.0::DOUBLE AS cap FROM ranked),
leveled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM weighed),
targets AS (
  SELECT source, source_size,
         CASE WHEN cap / w <= level THEN cap
              ELSE w * (SELECT level FROM leveled WHERE cap / w > level ORDER BY cap / w, r LIMIT 1) END AS target
  FROM leveled),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized),
cut AS (
  SELECT p.doc_id, p.size, t.source_size, t.target, p.before,
         CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size)::BIGINT ELSE 0 END AS epochs
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(floor(target)::BIGINT - epochs * source_size - before, 0), size))::BIGINT AS taken
FROM cut
"""
