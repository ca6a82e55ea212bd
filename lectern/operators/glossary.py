"""Glossary mining, matching and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import GLOSSARY_MAX_TERMS, GLOSSARY_MIN_COUNT
from lectern.functions.prompts import KEY_LINE, PROMPT_LINE, key_lines
from lectern.functions.text import DIGITS, LETTERS, LOWER, UPPER, short_hash, strip
from lectern.operators.matcher import with_matches

# Words that often start a sentence, and front-matter headings.
SENTENCE_STARTERS = (
    "The", "This", "That", "These", "Those", "There", "When", "Where", "While",
    "After", "Before", "Because", "Although", "However", "He", "She", "They",
    "We", "I", "It", "Its", "His", "Her", "Their", "Our", "You", "Your", "What",
    "Who", "Why", "How", "Chapter", "Part", "Table", "Figure",
)
FRONT_MATTER = ("Title Page", "Copyright", "Contents", "Table of Contents", "Introduction")


def terms(text: Column) -> Column:
    """Capitalised terms of a text, in order, with repeats.

    Works on the row itself: a run of capitalised words is one match of a pattern
    without backtracking, so no word leaves its row and no shuffle is needed.
    """
    inner = f"{LETTERS}{DIGITS}'-"
    word = f"'*+[{UPPER}][{UPPER}{DIGITS}'-]*+[{LOWER}][{inner}]*+"
    separator = f"[^{inner}]++"
    found = F.regexp_extract_all(  # what may begin a word is asked first, in one look at a table
        text, F.lit(f"(?=['{UPPER}])(?<![{inner}]){word}(?:{separator}{word})*+"), F.lit(0)
    )
    runs = F.transform(found, lambda run: F.regexp_replace(run, separator, " "))

    def term(run: Column) -> Column:
        single = F.btrim(run, F.lit("'"))
        return F.when(run.contains(" "), run).when(~single.isin(*SENTENCE_STARTERS), single)

    return F.filter(F.transform(runs, term), lambda t: F.length(t) >= 4)


def glossary_candidates(
    texts: DataFrame,
    min_count: int = GLOSSARY_MIN_COUNT,
    limit: int = GLOSSARY_MAX_TERMS,
) -> DataFrame:
    """Most frequent terms of a corpus: (term, n)."""
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(
        F.count("*").alias("n")
    )
    return (
        counts.filter(
            (F.col("n") >= min_count) & ~F.col("term").isin(*SENTENCE_STARTERS, *FRONT_MATTER)
        )
        .orderBy(F.desc("n"), F.lower("term"), "term")
        .limit(limit)
    )


def term_counts(texts: DataFrame) -> DataFrame:
    """Count of every mined term, before any filter or limit."""
    return texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(
        F.count("*").alias("n")
    )


def numbered(candidates: DataFrame) -> DataFrame:
    """Give a bounded candidate list its order: (pos, src)."""
    ranked = F.array_sort(
        F.collect_list(
            F.struct((-F.col("n")).alias("n"), F.lower("term").alias("low"), F.col("term").alias("src"))
        )
    )
    return candidates.agg(ranked.alias("terms")).select(
        F.posexplode("terms").alias("place", "entry")
    ).select((F.col("place") + 1).alias("pos"), "entry.src")


def glossary_subset(blocks: DataFrame, glossary: DataFrame) -> DataFrame:
    """Add ``subset``: the usable glossary entries that occur in ``source_text`` in any case, by position.

    One path for glossaries of any size, see ``matcher``.
    """
    return with_matches(_lowered(blocks), "_low", _usable(glossary), "subset")


def glossary_lines(blocks: DataFrame, glossary: DataFrame) -> DataFrame:
    """Add ``key_lines`` and ``prompt_lines``: the subset as it enters a cache key and a prompt.

    Both are put together where the terms are found. An array of entries would be carried to Spark
    and walked entry by entry for every key and prompt.
    """
    return with_matches(_lowered(blocks), "_low", _usable(glossary), lines={"key_lines": KEY_LINE, "prompt_lines": PROMPT_LINE})


def _lowered(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("_low", F.lower("source_text"))


def _usable(glossary: DataFrame) -> DataFrame:
    return glossary.select(
        F.col("pos").cast("int").alias("pos"), strip(F.col("src")).alias("src"),
        strip(F.col("dst")).alias("dst"),
    ).filter((F.col("src") != "") & (F.col("dst") != "")).withColumn("low", F.lower("src"))


def glossary_digest(glossary: DataFrame) -> DataFrame:
    """One row: digest of the usable entries in order, "" for an empty glossary."""
    entries = F.array_sort(F.collect_list(F.struct("pos", "src", "dst")))
    return glossary.agg(
        F.count("*").alias("entries"),
        F.when(F.count("*") == 0, "").otherwise(short_hash(key_lines(entries))).alias("digest"),
    )


def glossary_document(candidates: DataFrame) -> DataFrame:
    """One row with the glossary JSON of a bounded candidate list, targets left empty."""
    entries = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.lower("term").alias("low"), "term"))),
        lambda e: F.struct(e["term"].alias("src"), F.lit("").alias("dst")),
    )
    return candidates.agg(
        F.struct(
            F.lit("en").alias("source_lang"), F.lit("ja").alias("target_lang"), entries.alias("entries")
        ).alias("doc")
    ).select(F.to_json("doc", {"pretty": "true"}).alias("document"))


REVIEW_INSTRUCTIONS = """# Candidate terms

A counting pass over the English corpus proposed the entries in the block that follows. Reviewer's
part: strike what is no term, give each remaining entry one Japanese rendering in `dst`, and send
the block back as JSON of the same shape so that it can be loaded as it is.

"""


def review_document(document: DataFrame) -> DataFrame:
    return document.select(
        F.concat(F.lit(REVIEW_INSTRUCTIONS + "```json\n"), F.col("document"), F.lit("\n```\n")).alias("document")
    )
