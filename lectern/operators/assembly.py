"""Pages rebuilt from cached translations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.markers import escape_xml, restorable, restore

PAGE = ["corpus_id", "page_no"]


def restored_blocks(status: DataFrame) -> DataFrame:
    """Add the markup each block ends up with and whether its translation was used.

    ``status`` is the result of ``cache_status`` over blocks with tag and inline_map.
    """
    usable = F.when(F.col("status") == "hit", F.col("translated"))
    restored = restore(usable, F.col("inline_map"))
    original = F.coalesce(restore(F.col("source_text"), F.col("inline_map")), escape_xml(F.col("source_text")))
    return (
        status.withColumn("restored", restored)
        .withColumn("used", F.coalesce(restorable(usable, F.col("inline_map")), F.lit(False)))
        .withColumn(
            "html",
            F.concat(
                F.lit("<"), F.col("tag"), F.lit(">"), F.coalesce("restored", original),
                F.lit("</"), F.col("tag"), F.lit(">"),
            ),
        )
    )


def assemble_pages(blocks: DataFrame) -> DataFrame:
    """One row per page: its blocks in order, and how many are translated.

    A page is bounded by the document it came from, so its blocks fit in one row again.
    """
    ordered = F.array_sort(F.collect_list(F.struct("block_index", "html")))
    return blocks.groupBy(*PAGE).agg(
        F.count("*").alias("blocks"),
        F.count_if(F.col("used")).alias("translated_blocks"),
        F.count_if(F.col("status") != "hit").alias("misses"),
        F.array_join(F.transform(ordered, lambda b: b["html"]), "\n").alias("html"),
    )


def assembly_status(pages: DataFrame, partial: bool = True) -> DataFrame:
    """Per corpus: complete, or recoverable when a partial assembly misses blocks."""
    return pages.groupBy("corpus_id").agg(
        F.count("*").alias("pages"),
        F.sum("blocks").alias("blocks"),
        F.sum("translated_blocks").alias("translated_blocks"),
        F.sum("misses").alias("misses"),
    ).withColumn(
        "status", F.when(F.lit(partial) & (F.col("misses") > 0), "recoverable").otherwise("complete")
    )
