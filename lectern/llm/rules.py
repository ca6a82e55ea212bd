"""Quality rules in an order from a sample.

A rule is a condition under which a document is rejected. The cost of each rule and the
share of documents it rejects are estimated on a bounded sample; the rules are then asked
in the order of rejections per cost. The result holds the measures of every document, so all
of them are computed whatever the order; only the comparisons of a rule are skipped for
documents that an earlier one rejected. Neither the verdict nor nearly any work depends on the order.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bound, whole_text, words
from lectern.session import written

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
SAMPLE_ROWS = 500
WINDOW = 3


def repeated_words(ws: Column, size: int = WINDOW) -> Column:
    """Words inside windows of ``size`` words that occur twice or more in the text.

    The windows' hashes are sorted together with their places, packed in one long, so equal
    windows become neighbours; neighbours of equal hash are compared word by word. Places of
    repeated windows, sorted again, give the words they cover.
    """
    bits = F.when(F.size(ws) < (1 << 24), F.lit(24)).otherwise(F.lit(30))

    def same_words(a: Column, b: Column) -> Column:
        alike = F.lit(True)
        for k in range(size):
            alike = alike & (F.get(ws, a + k) == F.get(ws, b + k))
        return alike

    def over(shift: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1

        def place(packed: Column) -> Column:
            return packed.bitwiseAND(mask).cast("int")

        def group(packed: Column) -> Column:
            return F.call_function("shiftright", packed, shift)

        packed = F.sort_array(F.transform(
            F.sequence(F.lit(0), F.size(ws) - size),
            lambda i: F.call_function(
                "shiftleft", F.xxhash64(*[F.get(ws, i + k) for k in range(size)]), shift
            ).bitwiseOR(i.cast("long")),
        ))

        def repeated(p: Column) -> Column:
            def equal(x: Column, y: Column) -> Column:
                return (group(x) == group(y)) & same_words(place(x), place(y))

            return F.filter(p, lambda x, k: F.coalesce(equal(x, F.get(p, k + 1)), F.lit(False))
                            | F.coalesce(equal(x, F.get(p, k - 1)), F.lit(False)))

        def covered(places: Column) -> Column:
            return F.aggregate(
                F.transform(places, lambda at, k: F.least(
                    F.lit(size), F.coalesce(F.get(places, k + 1) - at, F.lit(size)))),
                F.lit(0).cast("long"), lambda total, n: total + n)

        return bound(packed, lambda p: bound(
            F.sort_array(F.transform(repeated(p), place)), covered))

    return F.when(F.size(ws) <= size, F.lit(0).cast("long")).otherwise(bound(bits, over))


def measures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to (doc_id, text).

    A null text counts as an empty one, for which all are 0.
    """
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", whole_text().alias("_text")).select("doc_id", "_text", words(text).alias("_words"))
    return rows.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        bound(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        bound(F.col("_words"), lambda ws: repeated_words(ws)).alias("n_repeat_words"),
        F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
    )


@dataclass(frozen=True)
class Rule:
    """A name and the condition, over the columns of ``measures``, that rejects a document."""

    name: str
    rejects: str


BASE_RULES = (
    Rule("few_words", f"n_words < {MIN_WORDS}"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
)
RULES = (
    *BASE_RULES,
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("symbols", "2 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float


def estimates(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and selectivity of each rule on ``sample_rows`` documents, those of least id hash.

    The sample is stored once; each rule is timed with the columns it reads and no others.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64(F.col("doc_id")).alias("_h"))
    floor = keyed.select("_h").orderBy("_h").limit(sample_rows).agg(F.max("_h").alias("most"))
    most = floor.first()["most"]
    if most is None:
        return [Estimate(rule, 0.0, 0.0) for rule in rules]
    sample = written(keyed.where(F.col("_h") <= most).drop("_h"), "rules-sample")
    found = []
    for rule in rules:
        start = time.perf_counter()
        row = measures(sample).agg(F.avg(F.expr(rule.rejects).cast("double")).alias("share")).first()
        found.append(Estimate(rule, time.perf_counter() - start, row["share"] or 0.0))
    return found


def cascade_order(found: Sequence[Estimate]) -> list[Rule]:
    """Rules by rejections per second, the best first; ties by name."""
    return [e.rule for e in sorted(found, key=lambda e: (-e.rejected / max(e.seconds, 1e-6), e.rule.name))]


def first_rejection(order: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does; later comparisons are not evaluated, their measures are."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(order):
        verdict = F.when(F.expr(rule.rejects), F.lit(rule.name)).otherwise(verdict)
    return verdict


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text) -> the measures with rejected_by, base_failed and kept, a row per row.

    Nulls and empty texts fail the word rule; repeated rows are judged alike, row by row;
    an empty table gives an empty result; other columns are ignored.
    """
    order = cascade_order(estimates(docs, rules, sample_rows))
    base = F.lit(False)
    for rule in BASE_RULES:
        base = base | F.expr(rule.rejects)
    return measures(docs).select("*", first_rejection(order).alias("rejected_by"), base.alias("base_failed")).select(
        "*", (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"))


# The same measures and rules for DuckDB.
RULES_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS lines FROM texts),
wins AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
places AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n FROM places GROUP BY doc_id),
m AS (
  SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM split s LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (word_chars < 2 * n_words OR word_chars > 20 * n_words)
       AND NOT (2 * n_symbols > 3 * n_words) AND NOT (2 * n_dup_lines > n_lines) AS kept
FROM b
"""
