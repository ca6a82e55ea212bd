"""Scalar text features as Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_letters, ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space code points, for trim.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"\p{IsWhite_Space}"

# Japanese scripts (kana, ideographs, compatibility ideographs).
JAPANESE = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"

# Classes of a pattern name ASCII characters one by one: Java looks them up in one table, but asks ranges in turn.
UPPER, LOWER, DIGITS, LETTERS = ascii_uppercase, ascii_lowercase, digits, ascii_letters

# Characters of an untranslated English run besides letters.
RUN_PUNCTUATION = "'\",.;:?!-()"
ASCII_SPACE = " \t\n\x0c\r"

# Characters that close a sentence.
SENTENCE_TERMINALS = (
    ".", "!", "?", "。", "！", "？", '"', "'", "”", "’", "」", "』", ")", "）", "⟧",
)

# Characters that may end a chunk.
SENTENCE_BOUNDARIES = ".!?;:。！？；："

# Words that make a source look like a reference.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
)
LINK_HINTS = ("http://", "https://", "www.", "doi.org", "doi:")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` needs it per array element.

    A fold over nothing hands the value on as it is. An item of a transformed array costs more: for every row
    Spark asks again for the item's type, and for that whether any part of ``use`` may be null.
    """
    return F.aggregate(F.array(), value, lambda held, _: held, use)


def strip(text: Column) -> Column:
    """Cut white space at both ends, by Unicode's definition.

    Spark lists every character of a text before it trims a set, so only texts with white space at an end are trimmed.
    """
    def cut(value: Column) -> Column:
        white = lambda place: F.substring(value, place, 1).isin(*WHITE_SPACE)
        begins = (value < "!") | ((value >= "\x80") & white(1))
        return F.when(begins | white(-1), F.btrim(value, F.lit(WHITE_SPACE))).otherwise(value)

    return bound(text, cut)


def collapse(text: Column) -> Column:
    """Turn every white-space run into one space and cut the ends. A run that is one space is not replaced."""
    return F.trim(F.regexp_replace(text, f"{SPACE}(?:(?<! )|(?={SPACE})){SPACE}*+", " "))


def compare_form(text: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(text, SPACE + "+", ""))


def same_form(one: Column, other: Column, head: int = 32) -> Column:
    """As ``compare_form(one) == compare_form(other)``, but texts are read whole only where their heads agree.

    The form of a head begins that of the text, except that a capital sigma may end the head alone.
    """
    begin = lambda value: F.translate(compare_form(F.left(value, F.lit(head))), "ς", "σ")
    agree = bound(F.struct(begin(one).alias("a"), begin(other).alias("b")),
                  lambda heads: heads["a"].startswith(heads["b"]) | heads["b"].startswith(heads["a"]))
    return (one == other) | (agree & (compare_form(one) == compare_form(other)))


def letter_count(text: Column) -> Column:
    """ASCII letters. No pattern: beside a second replacement by pattern that took several times as long."""
    return F.length(text) - F.length(F.translate(text, ascii_letters, ""))


def word_count(text: Column) -> Column:
    """ASCII letter runs of two or more."""
    return F.regexp_count(text, F.lit(f"[{LETTERS}]{{2,}}"))


def at_least_letters(text: Column, least: int) -> Column:
    """As ``letter_count(text) >= least``, but reads no further than needed."""
    return text.rlike(rf"^(?:[^{LETTERS}]*+[{LETTERS}]){{{least}}}+")


def at_least_words(text: Column, least: int) -> Column:
    """As ``word_count(text) >= least``, but reads no further than needed."""
    single = f"(?:[{LETTERS}](?![{LETTERS}])[^{LETTERS}]*+)*+"
    return text.rlike(rf"^(?:[^{LETTERS}]*+{single}[{LETTERS}]{{2,}}+){{{least}}}+")


def japanese_count(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{JAPANESE}]+", ""))


def has_japanese(text: Column) -> Column:
    """A text of as many bytes as characters is ASCII and not searched."""
    return (F.octet_length(text) > F.length(text)) & text.rlike(f"[{JAPANESE}]")


def longest_ascii_run(text: Column, min_chars: int = 1) -> Column:
    """The ASCII text run with most letters (the first on ties), trimmed.

    With ``min_chars`` shorter runs are left out, for callers that only care about
    runs with at least so many letters.
    """
    run_class = rf"""[{LETTERS} \t\n\f\r'",.;:?!()-]"""
    # A run is tried at its begin alone and never given back, so one that is too short costs one reading.
    runs = F.regexp_extract_all(text, F.lit(f"(?<!{run_class}){run_class}{{{min_chars},}}+"), F.lit(0))
    scored = F.transform(
        runs,
        lambda run, i: F.struct(
            letter_count(run).alias("letters"), (-i).alias("place"), run.alias("run")
        ),
    )
    return bound(
        F.array_max(scored),
        lambda best: F.when(best["letters"] > 0, F.btrim(best["run"], F.lit(ASCII_SPACE))),
    )


def ends_terminal(text: Column) -> Column:
    """Only texts with white space at their end are trimmed, see ``strip``."""
    last = lambda value: F.substring(value, -1, 1)
    return bound(last(text), lambda end: F.when(
        end.isin(*WHITE_SPACE), last(F.rtrim(text, F.lit(WHITE_SPACE)))).otherwise(end)).isin(*SENTENCE_TERMINALS)


def any_contains(text: Column, needles: tuple[str, ...]) -> Column:
    found = text.contains(needles[0])
    for needle in needles[1:]:
        found = found | text.contains(needle)
    return found


def count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def title_word_count(text: Column) -> Column:
    """White-space words whose first letter or digit is an ASCII capital."""
    return F.regexp_count(
        text, F.lit(rf"(?:^|{SPACE})[^\p{{IsAlphabetic}}\p{{N}}{SPACE}]*[A-Z]")
    )


def reference_like(text: Column) -> Column:
    """Does the source look like a bibliography or link line?"""
    lower = F.lower(text)
    dated = any_contains(lower, MONTHS) | (text.contains("(") & text.contains(")"))
    quoted = any_contains(text, ("“", "”", '"', "⟦E"))
    commas = count_of(text, ",")
    return (
        any_contains(lower, LINK_HINTS)
        | ((commas >= 3) & dated)
        | ((commas >= 2) & quoted)
        | (dated & (title_word_count(text) >= 4))
    )


def short_hash(text: Column) -> Column:
    """First half of the SHA-256 hex digest."""
    return F.substring(F.sha2(text, 256), 1, 32)


def bytes_digest(text: Column) -> Column:
    """16 bytes that stand for a text where only equality is asked."""
    return F.unhex(F.md5(text.cast("binary")))


def preview(text: Column, max_chars: int) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) <= max_chars, flat).otherwise(
        F.concat(F.left(flat, F.lit(max_chars)), F.lit("..."))
    )


def token_estimate(chars: Column) -> Column:
    return F.ceil(chars / F.lit(4)).cast("long")
