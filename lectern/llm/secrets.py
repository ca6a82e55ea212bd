"""Secret scans: fixed kinds by pattern, and strings of high sliding-window entropy.

Places come from splitting the text at the pattern: the lengths of the pieces and of the
matches between them, added up, are the matches' places in code points. For the entropy
kind, maximal runs of key characters are candidates. A window slides over a candidate;
its character counts are carried from place to place (one in, one out), and with them the
sum of c * log2(c) that gives the window's Shannon entropy without counting it again.
"""

from __future__ import annotations

from collections.abc import Sequence

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bound, whole_text

# The kinds of the contract and their patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
HEX_BITS, KEY_BITS = 3.0, 3.7
ALLOWED = (
    r"^[0-9+/_=-]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|changeme",
    r"^[A-Za-z]+([-_/][A-Za-z]+)*[-_/]?$",
)
MASK = "[secret]"

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _none() -> Column:
    return F.array().cast(SPAN)


def pattern_spans(text: Column, kind: str, pattern: str, valid, gate: str, value_group: int = 0) -> Column:
    """Leftmost non-overlapping matches as spans; ``valid`` (of the value) drops matches afterwards.

    ``gate`` is a cheaper pattern that every text with a match must hold.
    """

    def placed(pieces: Column, found: Column, values: Column) -> Column:
        steps = F.arrays_zip(
            F.transform(found, lambda m, k: F.length(F.get(pieces, k))).alias("skip"),
            F.transform(found, F.length).alias("size"), values.alias("value"))
        walked = F.aggregate(
            steps,
            F.struct(F.lit(0).alias("at"), _none().alias("spans")),
            lambda acc, s: F.struct(
                (acc["at"] + s["skip"] + s["size"]).alias("at"),
                F.concat(acc["spans"], F.array(F.struct(
                    F.lit(kind).alias("kind"), (acc["at"] + s["skip"]).alias("start"),
                    (acc["at"] + s["skip"] + s["size"]).alias("end"), s["value"].alias("value")))).cast(SPAN).alias("spans"),
            ),
        )
        return F.filter(walked["spans"], lambda s: valid(s["value"]))

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    spans = bound(F.split(text, pattern, -1), lambda p: bound(whole, lambda f: bound(value, lambda v: placed(p, f, v))))
    return F.when(text.rlike(gate), spans).otherwise(_none())


def base_spans(text: Column) -> Column:
    return F.concat(
        pattern_spans(text, "assign", ASSIGN, lambda v: F.length(v) >= 8,
                      r"(?i:password|passwd|secret|token|api_?key)", 2),
        pattern_spans(text, "access", ACCESS, lambda v: F.length(v) >= 16, "AKIA"),
        pattern_spans(text, "hex", HEX, lambda v: F.length(v) >= 32, HEX),
    )


def entropy_window(value: Column, window: int = WINDOW) -> Column:
    """First and last place (0-based, of window ends) whose window is above the class's entropy, and the peak.

    The character class is hex if the candidate has only hex digits, else key characters.
    """
    table = F.array(*[F.lit(x * math.log2(x) if x else 0.0) for x in range(window + 2)])
    bits = F.when(value.rlike("^[0-9a-fA-F]+$"), F.lit(HEX_BITS)).otherwise(F.lit(KEY_BITS))

    def code(i: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substring(value, i + 1, F.lit(1))) - 1

    def slide(acc: Column, i: Column) -> Column:
        def after_out(counts_sum: Column) -> Column:
            counts, total = counts_sum["counts"], counts_sum["total"]

            def with_in(c_in: Column) -> Column:
                n = F.get(counts, c_in)
                return F.struct(
                    F.transform(counts, lambda n, k: F.when(k == c_in, n + 1).otherwise(n)).alias("counts"),
                    (total - F.get(table, n) + F.get(table, n + 1)).alias("total"))

            return bound(code(i), with_in)

        def drop(c_out: Column) -> Column:
            n = F.get(acc["counts"], c_out)
            return F.struct(
                F.transform(acc["counts"], lambda n, k: F.when(k == c_out, n - 1).otherwise(n)).alias("counts"),
                (acc["total"] - F.get(table, n) + F.get(table, n - 1)).alias("total"))

        kept = F.when(i >= window, bound(code(i - window), drop)).otherwise(
            F.struct(acc["counts"].alias("counts"), acc["total"].alias("total")))

        def note(now: Column) -> Column:
            entropy = F.lit(math.log2(window)) - now["total"] / window
            high = (i >= window - 1) & (entropy >= bits)
            return F.struct(
                now["counts"].alias("counts"), now["total"].alias("total"),
                F.when(high & acc["first"].isNull(), i).otherwise(acc["first"]).alias("first"),
                F.when(high, i).otherwise(acc["last"]).alias("last"),
                F.when(i >= window - 1, F.greatest(acc["peak"], entropy)).otherwise(acc["peak"]).alias("peak"))

        return bound(bound(kept, after_out), note)

    nothing = F.lit(None).cast("int")
    return F.aggregate(
        F.sequence(F.lit(0), F.length(value) - 1),
        F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"),
                 nothing.alias("first"), nothing.alias("last"), F.lit(0.0).alias("peak")),
        slide,
    )


def entropy_spans(text: Column, base: Column, allowed: Sequence[str] = ALLOWED, window: int = WINDOW) -> Column:
    """Candidates with a window of high entropy, cut to those windows.

    Suppressed: candidates on the allow-list, and those that a base span already covers in part.
    """
    listed = "|".join(f"(?:{p})" for p in allowed)
    runs = pattern_spans(text, "entropy", CANDIDATE, lambda v: ~v.rlike(listed) & v.rlike("[0-9]"),
                         r"[A-Za-z0-9+/_=-]{20}")

    def judged(span: Column) -> Column:
        return bound(entropy_window(span["value"], window), lambda w: F.struct(
            F.lit("entropy").alias("kind"),
            (span["start"] + w["first"] - (window - 1)).cast("int").alias("start"),
            (span["start"] + w["last"] + 1).cast("int").alias("end"), span["value"].alias("value")))

    found = F.filter(F.transform(runs, judged), lambda s: s["start"].isNotNull())
    return F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))).cast(SPAN)


def _in_order(spans: Column) -> Column:
    """By start, then kind as listed, then end."""
    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"),
        s["value"].alias("value")))
    return F.sort_array(keyed)


def _digest_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_spans(docs: DataFrame) -> DataFrame:
    """Adds base_spans and all_spans (arrays of start, rank, end, kind, value) to a table with a text.

    Null and empty texts have no spans. Places count code points from 0, the end is exclusive.
    """
    return docs.withColumn("_text", whole_text()).withColumn("_base", base_spans(F.col("_text"))).withColumn(
        "_more", entropy_spans(F.col("_text"), F.col("_base"))).withColumn(
        "base_spans", _in_order(F.col("_base"))).withColumn(
        "all_spans", _in_order(F.concat("_base", "_more"))).drop("_text", "_base", "_more")


def secret_report(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> counts per kind, the digest of the base spans and all spans as text.

    A row per row; other columns are ignored; an empty table gives an empty result.
    """
    found = with_spans(docs.select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("all_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_digest_text(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        _digest_text(F.col("all_spans")).alias("spans"), count("entropy").alias("n_entropy"),
    )


def redacted(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """The same rows with every secret's characters replaced by ``mask``; overlapping spans count once.

    All columns stay; only ``text`` changes, and ``n_chars`` where a secret was cut and it is
    there. Null texts stay null.
    """
    names = docs.columns
    found = docs.select(*names, F.struct(*names).alias("_row")).select(
        "_row", *([F.col("text")] if "text" in names else []))
    spans = with_spans(found)

    def cut(all_spans: Column) -> Column:
        walked = F.aggregate(
            all_spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda acc, s: F.when(s["start"] < acc["at"], F.struct(
                F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(
                    s["end"].alias("at"),
                    F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]),
                             F.lit(mask)).alias("out"))))
        return bound(walked, lambda w: F.concat(w["out"], F.substring(F.col("text"), w["at"] + 1, F.length("text"))))

    dirty = F.size("all_spans") > 0
    changed = spans.withColumn("_new", F.when(dirty, cut(F.col("all_spans"))).otherwise(F.col("text")))
    values = {name: F.col(f"_row.`{name}`") for name in names} | {"text": F.col("_new")}
    if "n_chars" in names:
        values["n_chars"] = F.when(dirty, F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(
            F.col("_row.n_chars"))
    return changed.select(*[value.alias(name) for name, value in values.items()])
