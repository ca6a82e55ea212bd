"""Sentence-aware cutting of long sources and joining of their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import MAX_CHARS_PER_REQUEST
from lectern.functions.text import SENTENCE_BOUNDARIES, SPACE, bound, strip
from lectern.functions.validation import validation_reason

# Noncharacters, which no text holds: a hidden place of a marker, and the end of a chunk.
HIDDEN, CUT = "\ufdd0", "\ufdd1"


def _chunk_pattern(max_chars: int) -> str:
    """One chunk of what is left: all of it, or up to the last sentence end, else blank, else the limit.

    Hidden places count as characters but are never cut at: a limit that falls on one moves to
    the next open place, and a rest without one stays whole.
    """
    least, most = max(max_chars // 3, 1) - 1, max_chars - 1
    return (
        rf"(?s){SPACE}*+(?:.{{1,{max_chars}}}\z"
        rf"|.{{{most}}}{HIDDEN}++\z"
        rf"|.{{{least},{most}}}[{SENTENCE_BOUNDARIES}]"
        rf"|.{{{least},{most}}}{SPACE}"
        rf"|.{{{most}}}{HIDDEN}*+[^{HIDDEN}])"
    )


def _marked_chunks(whole: Column, pattern: str) -> Column:
    """Chunks of a text with markers: the markers are hidden once, the text is cut, and they are put back.

    Every step is linear in the text. A hidden run ends where its marker closes, so runs and
    markers stand in the same order.
    """
    def put_back(pieces: Column) -> Column:
        is_marker = lambda p: p.startswith("⟦")
        hidden = F.array_join(F.transform(
            pieces, lambda p: F.when(is_marker(p), F.repeat(F.lit(HIDDEN), F.length(p))).otherwise(p)), "")
        shown = F.split(F.regexp_replace(hidden, pattern, "$0" + CUT), HIDDEN + "+", -1)
        restored = F.zip_with(shown, F.filter(pieces, is_marker), lambda text, marker: F.concat(text, F.coalesce(marker, F.lit(""))))
        return F.split(F.array_join(restored, ""), CUT, -1)

    return bound(F.regexp_extract_all(whole, F.lit("⟦[^⟧]*|[^⟦]+"), F.lit(0)), put_back)


def chunks(text: Column, max_chars: int = MAX_CHARS_PER_REQUEST) -> Column:
    """Array of chunks of at most ``max_chars`` characters (0: no cutting); a marker is never cut."""
    whole = strip(text)
    if max_chars == 0:
        return F.array(whole)
    pattern = _chunk_pattern(max_chars)
    cut = F.when(whole.contains("⟦"), _marked_chunks(whole, pattern)).otherwise(
        F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)))
    stripped = F.filter(F.transform(cut, strip), lambda c: c != "")
    return F.when(F.length(whole) <= max_chars, F.array(whole)).otherwise(stripped)


def chunk_texts(df: DataFrame, max_chars: int = MAX_CHARS_PER_REQUEST) -> DataFrame:
    """One row per chunk of ``source_text``: adds chunk_index (from 1) and chunk."""
    return df.select("*", F.posexplode(chunks(F.col("source_text"), max_chars)).alias("_i", "chunk")).select(
        *df.columns, (F.col("_i") + 1).alias("chunk_index"), "chunk"
    )


def rejoin_chunks(parts: DataFrame, ids: list[str]) -> DataFrame:
    """Join translated parts of each source by newline and validate the whole.

    Takes (ids.., source_text, chunk_index, translated); one source is one group.
    """
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", strip(F.col("translated")).alias("part"))))
    return (
        parts.groupBy(*ids)
        .agg(F.min("source_text").alias("source_text"), ordered.alias("parts"))
        .select(
            *ids,
            "source_text",
            F.size("parts").alias("chunks"),
            F.array_join(F.transform("parts", lambda p: p["part"]), "\n").alias("translated"),
        )
        .withColumn("reason", validation_reason(F.col("source_text"), F.col("translated")))
    )
