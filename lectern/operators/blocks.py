"""Translatable blocks of pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import markup
from lectern.functions.text import bound, collapse


def exploded_blocks(df: DataFrame, blocks: Column) -> DataFrame:
    """One row per non-empty block; block_index counts from 1 within the page.

    The ordinals come from the array position, so extraction needs no shuffle.
    """
    kept = F.filter(blocks, lambda b: b["source_text"] != "")
    carried = [c for c in df.columns if c not in ("html", "text")]
    return df.select(*carried, F.posexplode(kept).alias("pos", "block")).select(
        *carried,
        (F.col("pos") + 1).alias("block_index"),
        "block.*",
    )


def extract_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of raw HTML by the tolerant rule, with inline tags as markers.

    Takes (corpus_id, page_no, html, ..).
    """
    encoded = F.transform(
        markup.block_pieces(F.col("html")),
        lambda b: F.struct(b["tag"].alias("tag"), markup.encode_inline(b["body"]).alias("inline")),
    )
    blocks = F.transform(
        encoded,
        lambda b: F.struct(
            b["tag"].alias("tag"),
            b["inline"]["source_text"].alias("source_text"),
            b["inline"]["inline_map"].alias("inline_map"),
        ),
    )
    return exploded_blocks(pages, blocks)


def extract_blocks_strict(pages: DataFrame) -> DataFrame:
    """Outermost blocks of well-formed XHTML; nested blocks become inline content.

    Takes (corpus_id, page_no, html). A page whose blocks do not close gives the blocks before
    that place and one row with its ``corrupt_reason``.
    """
    pieces = pages.select("corpus_id", "page_no", markup.strict_pieces(F.col("html")).alias("pieces"))
    placed = pieces.withColumn("outer", markup.outer_block_places(F.col("pieces")))

    def block(place: Column) -> Column:
        body = F.slice(F.col("pieces"), place["first"] + 2, place["last"] - place["first"] - 1)
        return bound(markup.encode_pieces(body, strict=True), lambda inline: F.struct(
            markup.local_name(place["name"]).alias("tag"), inline["source_text"].alias("source_text"),
            inline["inline_map"].alias("inline_map")))

    kept = F.filter(F.transform("outer.blocks", block), lambda b: b["source_text"] != "")
    nothing = F.lit(None).cast("string")

    def row(number: Column, tag: Column, source: Column, saved: Column, problem: Column) -> Column:
        return F.struct(number.cast("int").alias("block_index"), tag.alias("tag"), source.alias("source_text"),
                        saved.alias("inline_map"), problem.alias("corrupt_reason"))

    found = F.transform(kept, lambda b, i: row(i + 1, b["tag"], b["source_text"], b["inline_map"], nothing))
    corrupt = row(F.lit(None), nothing, nothing, F.lit(None).cast(markup.EMPTY_MAP), F.col("outer.problem"))
    rows = F.when(F.col("outer.problem").isNull(), found).otherwise(F.array_append(found, corrupt))
    return placed.select("corpus_id", "page_no", F.explode(rows).alias("row")).select("corpus_id", "page_no", "row.*")


def line_blocks(documents: DataFrame) -> DataFrame:
    """One block per non-empty line of a document's text, white space collapsed."""
    lines = F.transform(
        F.split(F.col("text"), "\n"), lambda line: F.struct(collapse(line).alias("source_text"))
    )
    return exploded_blocks(documents, lines)


def select_pages(blocks: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Pages of a 1-based inclusive range; an impossible range is an error."""
    if first is not None and first < 1 or last is not None and last < (first or 1):
        raise ValueError(f"invalid page range {first}-{last}")
    kept = blocks
    if first is not None:
        kept = kept.filter(F.col("page_no") >= first)
    if last is not None:
        kept = kept.filter(F.col("page_no") <= last)
    return kept


def inspect_pages(pages: DataFrame) -> DataFrame:
    """Per page: place, presence, size and raw block count."""
    return pages.select(
        "corpus_id",
        "page_no",
        "href",
        "media_type",
        "linear",
        F.col("html").isNotNull().alias("present"),
        F.octet_length("html").cast("long").alias("bytes"),
        markup.raw_block_count(F.col("html")).cast("long").alias("raw_blocks"),
    )
