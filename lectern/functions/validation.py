"""The ordered rule set that accepts or rejects a returned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import markers, text

# Reason codes with their messages, in rule order.
REASON_MESSAGES = {
    "empty": "provider returned an empty translation",
    "prompt_leak": "provider returned prompt wrapper tags",
    "missing_placeholder": "provider changed, dropped, or added inline placeholders",
    "unchanged_source": "provider returned the source text unchanged",
    "refusal_or_explanation": "provider returned an explanation or refusal instead of a translation",
    "untranslated_text": "provider response does not appear to contain Japanese text",
    "untranslated_segment": "provider response still contains a long untranslated English segment",
    "truncated": "provider response appears to be truncated",
}

# Wrapper tags, refusal openings, localised punctuation.
PROMPT_TAGS = ("<source", "</source>", "<glossary", "</glossary>")
REFUSALS_EN = (
    "as an ai", "i am sorry", "i'm sorry", "i cannot", "i can't",
    "cannot translate", "can't translate", "translation:",
)
REFUSALS_JA = ("申し訳", "翻訳できません", "翻訳不能")
CITATION_PUNCTUATION = "、。『』「」"

# Message parts of provider errors.
AUTH_ERRORS = ("HTTP 401", "HTTP 403", "Incorrect API key provided", "invalid_api_key")
REFUSAL_MESSAGE = "provider returned an explanation or refusal"
VALIDATION_MESSAGE = "translation validation failed"

# Fixed value: provider and model name of sources passed through on purpose.
PASSTHROUGH = "reference_passthrough"


def _starts_with_any(value: Column, prefixes: tuple[str, ...]) -> Column:
    found = value.startswith(prefixes[0])
    for prefix in prefixes[1:]:
        found = found | value.startswith(prefix)
    return found


def prompt_leak(target: Column) -> Column:
    """All tags open alike, so few texts are lower-cased."""
    return target.contains("<") & text.bound(F.lower(target), lambda low: text.any_contains(low, PROMPT_TAGS))


def refusal(target: Column) -> Column:
    head = F.ltrim(target, F.lit(text.WHITE_SPACE))
    longest = max(map(len, REFUSALS_EN))
    return text.bound(F.left(head, F.lit(longest)), lambda h: text.bound(
        F.lower(h), lambda low: _starts_with_any(low, REFUSALS_EN) | _starts_with_any(h, REFUSALS_JA)))


def localised_citation(source: Column, target: Column) -> Column:
    return (
        markers.has_known_marker(source)
        & target.rlike(f"[{CITATION_PUNCTUATION}]")
        & ~text.same_form(source, target)
    )


def untranslated_text(source: Column, target: Column) -> Column:
    english = (text.at_least_words(target, 3) & text.at_least_words(source, 3)) | (
        text.at_least_letters(target, 12) & text.at_least_letters(source, 24)
    )
    return ~text.has_japanese(target) & english & ~localised_citation(source, target)


def _long_run(target: Column) -> Column:
    run = text.longest_ascii_run(target, min_chars=45)
    return F.coalesce(text.bound(run, lambda r: text.at_least_words(r, 7) & text.at_least_letters(r, 45)), F.lit(False))


def untranslated_segment(source: Column, target: Column) -> Column:
    """A run of at least 45 letters in 7 words remains in a Japanese text."""
    return text.has_japanese(target) & text.at_least_words(source, 8) & _long_run(target)


def truncated(source: Column, target: Column) -> Column:
    short = (text.ends_terminal(source) & ~text.ends_terminal(target)) | (
        text.at_least_letters(source, 240)
        & (text.japanese_count(target) * 6 < text.letter_count(source))
    )
    return text.at_least_words(source, 20) & text.has_japanese(target) & short


def validation_reason(source: Column, target: Column) -> Column:
    """Code of the first failing rule; null when the target is accepted.

    Both texts are stripped once, however many rules read them, and a computed ``source`` or
    ``target`` is computed once.
    """
    both = F.struct(text.strip(source).alias("s"), text.strip(target).alias("t"))
    return text.bound(both, lambda pair: _first_fault(pair["s"], pair["t"]))


def _first_fault(s: Column, t: Column) -> Column:
    """As ``validation_reason``, of stripped texts."""
    first = lambda value: F.left(F.lower(F.left(value, F.lit(1))), F.lit(1))
    unchanged = (
        (first(s) == first(t))
        & text.same_form(s, t)
        & text.at_least_letters(s, 6)
        & ~markers.number_list(s)
    )
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "empty")
        .when(prompt_leak(t), "prompt_leak")
        .when(markers.differ(s, t), "missing_placeholder")
        .when(unchanged, "unchanged_source")
        .when(refusal(t), "refusal_or_explanation")
        .when(untranslated_text(s, t), "untranslated_text")
        .when(untranslated_segment(s, t), "untranslated_segment")
        .when(truncated(s, t), "truncated")
    )


SOURCE_FLAGS = ("known", "numbers", "terminal")
TARGET_FLAGS = ("empty", "leak", "refusal", "japanese", "cites", "words3", "letters12", "run", "terminal")


def _bits(**flags: Column) -> Column:
    bits = F.lit(0)
    for place, flag in enumerate(flags.values()):
        bits = bits + F.when(flag, 1 << place).otherwise(0)
    return bits


def _bit(traits: Column, names: tuple[str, ...], name: str) -> Column:
    return traits["flags"].bitwiseAND(F.lit(1 << names.index(name))) != 0


def _shared_traits(value: Column) -> list[Column]:
    """What is compared with the other text: its markers (a digest where they are long) and the digest of its form."""
    marks = F.when(value.contains("⟦"), F.array_join(markers.sorted_markers(value), "")).otherwise("")
    return [
        _short_marks(marks).alias("marks"),
        text.bytes_digest(text.compare_form(value)).alias("form"),
    ]


def _short_marks(marks: Column, most: int = 32) -> Column:
    """A marker ends at the first closing bracket, so joined markers are equal only where the lists are."""
    return text.bound(marks, lambda m: F.when(F.length(m) <= most, m).otherwise(F.md5(m.cast("binary"))))


def source_traits(source: Column) -> Column:
    """All that the rules ask of a source, in about 60 bytes; null for null. See ``traits_reason``."""
    def made(s: Column) -> Column:
        known = markers.has_known_marker(s)
        flags = _bits(known=known, numbers=known & markers.number_list(s), terminal=text.ends_terminal(s))
        words = F.when(text.at_least_words(s, 20), 20).when(text.at_least_words(s, 8), 8).when(
            text.at_least_words(s, 3), 3).otherwise(0)
        return F.when(s.isNotNull(), F.struct(
            *_shared_traits(s), flags.alias("flags"), words.alias("words"), text.letter_count(s).alias("letters")))

    return text.bound(text.strip(source), made)


def target_traits(target: Column) -> Column:
    """All that the rules ask of a returned text; null for null."""
    def made(pair: Column) -> Column:
        t, japanese = pair["t"], pair["j"]
        flags = _bits(
            empty=t == "", leak=prompt_leak(t), refusal=refusal(t), japanese=japanese,
            cites=~japanese & t.rlike(f"[{CITATION_PUNCTUATION}]"), words3=~japanese & text.at_least_words(t, 3),
            letters12=~japanese & text.at_least_letters(t, 12), run=japanese & _long_run(t),
            terminal=japanese & text.ends_terminal(t),
        )
        return F.when(t.isNotNull(), F.struct(
            *_shared_traits(t), flags.alias("flags"),
            F.when(japanese, text.japanese_count(t)).otherwise(0).alias("japanese")))

    return text.bound(text.strip(target), lambda t: text.bound(
        F.struct(t.alias("t"), text.has_japanese(t).alias("j")), made))


def traits_reason(s: Column, t: Column) -> Column:
    """As ``validation_reason``, of the traits of both texts, so that joins carry no text.

    Forms are equal where their digests of 128 bits are. Texts of equal forms begin alike.
    """
    of_s, of_t = (lambda name: _bit(s, SOURCE_FLAGS, name)), (lambda name: _bit(t, TARGET_FLAGS, name))
    same, letters, words = s["form"] == t["form"], s["letters"], s["words"]
    english = (of_t("words3") & (words >= 3)) | (of_t("letters12") & (letters >= 24))
    citation = of_s("known") & of_t("cites") & ~same
    short = (of_s("terminal") & ~of_t("terminal")) | ((letters >= 240) & (t["japanese"] * 6 < letters))
    return (
        F.when(t.isNull() | of_t("empty"), "empty")
        .when(of_t("leak"), "prompt_leak")
        .when(s["marks"] != t["marks"], "missing_placeholder")
        .when(same & (letters >= 6) & ~of_s("numbers"), "unchanged_source")
        .when(of_t("refusal"), "refusal_or_explanation")
        .when(~of_t("japanese") & english & ~citation, "untranslated_text")
        .when(of_t("japanese") & (words >= 8) & of_t("run"), "untranslated_segment")
        .when((words >= 20) & of_t("japanese") & short, "truncated")
    )


def reason_message(reason: Column) -> Column:
    pairs = [F.lit(v) for kv in REASON_MESSAGES.items() for v in kv]
    return F.create_map(*pairs)[reason]


def cached_reason(source: Column, translated: Column, provider: Column, model: Column) -> Column:
    """As ``validation_reason``, but sources passed through on purpose are fine."""
    passed = (translated == source) & (provider == PASSTHROUGH) & (model == PASSTHROUGH)
    return F.when(~F.coalesce(passed, F.lit(False)), validation_reason(source, translated))


def is_auth_error(error: Column) -> Column:
    return F.coalesce(text.any_contains(error, AUTH_ERRORS), F.lit(False))


def is_refusal_error(reason: Column, error: Column) -> Column:
    return F.coalesce(reason == "refusal_or_explanation", F.lit(False)) | F.coalesce(
        error.contains(REFUSAL_MESSAGE), F.lit(False)
    )


def is_validation_error(reason: Column, error: Column) -> Column:
    return reason.isNotNull() | F.coalesce(error.contains(VALIDATION_MESSAGE), F.lit(False))


def suspicion(source: Column, output: Column) -> Column:
    """(reason, message) for an output block that looks untranslated, else null."""
    judged = text.bound(validation_reason(source, output), lambda reason: F.when(
        reason.isNotNull(),
        F.struct(
            F.lit("detected_untranslated_output").alias("reason"),
            reason_message(reason).alias("message"),
        ),
    ))
    return F.when(
        text.collapse(source) == text.collapse(output),
        F.struct(
            F.lit("unchanged_source").alias("reason"),
            F.lit("output block is unchanged source text").alias("message"),
        ),
    ).otherwise(judged)
