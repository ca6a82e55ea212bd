"""Script features of a block and the language, action and reason they suggest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.functions.markers import KNOWN_MARKER, visible_text

# Script ranges and thresholds.
HIRAGANA = "\u3040-\u309f"
KATAKANA = "\u30a0-\u30ff"
IDEOGRAPHS = "\u3400-\u9fff\uf900-\ufaff"
HANGUL = "\uac00-\ud7af\u1100-\u11ff\u3130-\u318f"
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
KANA_MIN, LATIN_MIN, WORDS_MIN, HANGUL_MIN, IDEOGRAPH_MIN = 4, 12, 3, 2, 4
LONG_RUN_LETTERS = 45
JAPANESE_SHARE = 0.3


def _count(value: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{chars}]+", "")).cast("long")


def features(source: Column) -> list[Column]:
    shown = visible_text(source)
    run = text.longest_ascii_run(shown)
    return [
        _count(shown, HIRAGANA).alias("hiragana"),
        _count(shown, KATAKANA).alias("katakana"),
        _count(shown, IDEOGRAPHS).alias("ideographs"),
        _count(shown, HANGUL).alias("hangul"),
        _count(shown, LATIN).alias("latin"),
        text.word_count(shown).cast("long").alias("words"),
        _count(shown, r"\p{Nd}\p{P}").alias("digits_punctuation"),
        F.length(F.regexp_replace(shown, text.SPACE + "+", "")).cast("long").alias("visible_chars"),
        F.coalesce(text.letter_count(run), F.lit(0)).cast("long").alias("longest_run"),
        F.regexp_count(source, F.lit(KNOWN_MARKER)).cast("long").alias("markers"),
    ]


def label() -> Column:
    """Language label from the feature columns."""
    kana = F.col("hiragana") + F.col("katakana")
    japanese = (kana >= KANA_MIN) & (
        (kana + F.col("ideographs")) >= F.col("visible_chars") * JAPANESE_SHARE
    )
    latin = (F.col("latin") >= LATIN_MIN) & (F.col("words") >= WORDS_MIN)
    chinese = (F.col("ideographs") >= IDEOGRAPH_MIN) & (kana == 0)
    korean = F.col("hangul") >= HANGUL_MIN
    return (
        F.when(japanese & (F.col("longest_run") >= LONG_RUN_LETTERS), "mixed")
        .when(japanese, "ja")
        .when(korean, "ko")
        .when(chinese & latin, "mixed")
        .when(chinese, "zh")
        .when(latin, "latin")
        .otherwise("unknown")
    )


def action() -> Column:
    """What the label suggests for a Japanese target."""
    return (
        F.when(F.col("language") == "ja", "skip")
        .when(F.col("language") == "mixed", "warn")
        .when(F.col("language") == "unknown", "unknown")
        .otherwise("translate")
    )
