"""Comparison of the ledger with a fresh extraction and the cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import bytes_digest
from lectern.functions.validation import reason_message, source_traits, traits_reason
from lectern.operators.cache import key_traits
from lectern.operators.importing import ORDER, latest
from lectern.operators.joins import spread_join
from lectern.operators.ledger import CACHE_BACKED_STATES

# Finding texts.
MISSING = "missing from work_items"
ORPHANED = "location no longer exists in current EPUB extraction"
NOT_STORED = "state is cache-backed but cache entry is missing"
STORED = "cache entry exists but state is not cache-backed"
COMPARED = ("cache_key", "source_hash", "prompt_hash", "source_chars", "source_text")

PLACE = ["corpus_id", "page_index", "block_index"]


def compared(items: DataFrame) -> DataFrame:
    """What is compared of ledger rows: ``source_text`` is the digest of the text, so no join carries texts."""
    digest = bytes_digest(F.col("source_text")).alias("source_text")
    return items.select(*PLACE, *[digest if c == "source_text" else c for c in COMPARED])


def _last_compared(work_items: DataFrame) -> DataFrame:
    """The last ledger row of each place with what is compared, its state and the ``source`` traits of its text."""
    order = [c for c in ORDER if c in work_items.columns]
    carried = [*COMPARED, "state", "source"]
    slim = work_items.select(
        *PLACE, *dict.fromkeys([*order, *[c for c in COMPARED if c != "source_text"], "state"]),
        bytes_digest(F.col("source_text")).alias("source_text"), source_traits(F.col("source_text")).alias("source"))
    placed = " AND ".join(f"{c} IS NOT NULL" for c in PLACE)
    # A row without a place meets no other.
    return latest(slim.where(placed), PLACE, carried).unionByName(slim.where(f"NOT ({placed})").select(*PLACE, *carried))


def pages_to_verify(work_items: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected items on pages the ledger mentions; all pages when it is empty."""
    pages = work_items.select("corpus_id", "page_index").distinct()
    corpora = pages.select("corpus_id").distinct()
    return (
        expected.join(pages.withColumn("_page", F.lit(True)), ["corpus_id", "page_index"], "left")
        .join(corpora.withColumn("_corpus", F.lit(True)), "corpus_id", "left")
        .filter(F.col("_page") | F.col("_corpus").isNull())
        .drop("_page", "_corpus")
    )


def verify_findings(expected: DataFrame, work_items: DataFrame, cache: DataFrame) -> DataFrame:
    """(finding, corpus_id, page_index, block_index, cache_key, reason) rows.

    ``expected`` are the work items a preparation would make now, or what is ``compared`` of them; ``cache``
    has one row per key, with ``translated`` or its ``traits``. Of ledger rows at one place the last one counts.
    """
    now = expected if dict(expected.dtypes)["source_text"] == "binary" else compared(expected)
    wanted = now.select(*PLACE, *[F.col(c).alias(f"e_{c}") for c in COMPARED], F.lit(True).alias("in_e"))
    have = _last_compared(work_items).withColumn("in_w", F.lit(True))
    joined = spread_join(wanted.join(have, PLACE, "full"), key_traits(cache), "cache_key", PLACE, hot_from=work_items)
    both = F.col("in_e") & F.col("in_w")
    stale = F.concat_ws(
        ", ", *[F.when(~F.col(c).eqNullSafe(F.col(f"e_{c}")), f"{c} changed") for c in COMPARED]
    )
    backed = F.col("state").isin(*CACHE_BACKED_STATES)
    conflict = F.when(backed & F.col("stored").isNull(), NOT_STORED).when(
        ~backed & F.col("stored").isNotNull(), STORED
    )
    exempt = (F.col("state") == "skipped") & (F.col("stored_digest") == F.col("source_text"))
    invalid = F.when(
        F.col("stored").isNotNull() & ~exempt,
        reason_message(traits_reason(F.col("source"), F.col("stored"))),
    )
    found = {
        "missing": F.when(F.col("in_w").isNull(), MISSING),
        "orphaned": F.when(F.col("in_e").isNull(), ORPHANED),
        "stale": F.when(both & (stale != ""), stale),
        "cache_conflict": F.when(both, conflict),
        "invalid_cache": F.when(both, invalid),
    }
    findings = F.array(
        *[F.struct(F.lit(name).alias("finding"), reason.alias("reason")) for name, reason in found.items()]
    )
    return joined.select(
        *PLACE,
        F.coalesce("cache_key", "e_cache_key").alias("cache_key"),
        F.inline(F.filter(findings, lambda f: f["reason"].isNotNull())),
    )


def verify_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("finding").agg(F.count("*").alias("n"))


def verify_samples(findings: DataFrame, per_finding: int = 5) -> DataFrame:
    """First findings of each kind; the rank limit is applied before the shuffle."""
    order = Window.partitionBy("finding").orderBy(*PLACE, "cache_key")
    return findings.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_finding)
