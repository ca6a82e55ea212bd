"""Column functions on cases small enough to judge by eye."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import formats, language, markers, markup, prompts, text, validation
from lectern.operators import chunking, glossary, matcher

KANA = "あいうえお"


def english(words, letters):
    """A text of so many words with so many letters in all."""
    return " ".join(["q" * (letters - 2 * (words - 1))] + ["zx"] * (words - 1))


# For each threshold of the rules one pair on either side of it.
PAIRS = [
    (english(3, 12), KANA, None),
    (english(3, 12), " \t\n", "empty"),
    ("abc def", "ABC  DEF", "unchanged_source"), ("abc de", "ABC DE", None),
    (english(3, 9), "zx zx zx", "untranslated_text"), (english(2, 9), "zx zx zx", None), (english(3, 9), "zx zx 1", None),
    ("q" * 24, "w" * 12, "untranslated_text"), ("q" * 23, "w" * 12, None), ("q" * 24, "w" * 11, None),
    (english(8, 60), KANA + english(7, 45), "untranslated_segment"), (english(8, 60), KANA + english(7, 44), None),
    (english(8, 60), KANA + english(6, 45), None), (english(7, 60), KANA + english(7, 45), None),
    (english(20, 60) + ".", KANA, "truncated"), (english(20, 60) + ".", KANA + "。", None), (english(19, 60) + ".", KANA, None),
    (english(20, 240), "あ" * 39, "truncated"), (english(20, 240), "あ" * 40, None), (english(20, 239), "あ" * 39, None),
    ("⟦E1⟧q⟦/E1⟧", KANA, "missing_placeholder"), ("⟦E1⟧q⟦/E1⟧", f"⟦/E1⟧{KANA}⟦E1⟧", None),
    ("⟦S1⟧q", f"⟦S1⟧⟦S1⟧{KANA}", "missing_placeholder"),
    ("q", f"</GLOSSARY>{KANA}", "prompt_leak"), ("q", f"glossary {KANA}", None),
    ("q", f"　I Cannot {KANA}", "refusal_or_explanation"), ("q", f"{KANA} I cannot", None), ("q", "申し訳", "refusal_or_explanation"),
]


@pytest.mark.parametrize("source,target,reason", PAIRS)
def test_validation_pairs(spark, source, target, reason):
    df = spark.createDataFrame([(source, target)], "s string, t string")
    assert df.select(validation.validation_reason(F.col("s"), F.col("t"))).first()[0] == reason


def test_passed_through_source_is_valid_in_cache(spark):
    df = spark.createDataFrame([("Plain source text here", "reference_passthrough"), ("Plain source text here", "x")],
                               "s string, p string")
    got = df.select(validation.cached_reason(F.col("s"), F.col("s"), F.col("p"), F.col("p"))).collect()
    assert [r[0] for r in got] == [None, "unchanged_source"]


def test_thresholds_agree_with_counts(spark):
    texts = ["", "a b c d", "ab cd", "one2two three", "x" * 30, "a b ab c cd - de4f gh", "ÀB cd' ef"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for least in (1, 2, 3, 4, 24):
        got = df.select(
            (text.word_count(F.col("t")) >= least) == text.at_least_words(F.col("t"), least),
            (text.letter_count(F.col("t")) >= least) == text.at_least_letters(F.col("t"), least),
        ).collect()
        assert all(all(r) for r in got)


def test_longest_run_prefers_letters_then_first(spark):
    df = spark.createDataFrame([("訳one two訳-- three -訳six訳",), ("訳ab訳cd訳",), ("訳123訳",)], "t string")
    got = [r[0] for r in df.select(text.longest_ascii_run(F.col("t"))).collect()]
    assert got == ["one two", "ab", None]


def test_unicode_space(spark):
    df = spark.createDataFrame([("　a   b ",)], "t string")
    row = df.select(text.collapse(F.col("t")), text.strip(F.col("t")), text.compare_form(F.col("t"))).first()
    assert tuple(row) == ("a b", "a   b", "ab")


def test_reference_like(spark):
    cases = {
        "see www.example.org": True, "A, b, c, d (x)": True, "One, two, “three”": True,
        "Maybe Some Title Words Here": True, "Plain words only": False, "a, b, c": False,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(text.reference_like(F.col("t"))).collect()] == list(cases.values())


# Markers


MAP = "array<struct<marker:string,tag:string>>"


@pytest.mark.parametrize("translated,expected", [
    ("⟦E1⟧a⟦/E1⟧ & b", "<b>a</b> &amp; b"),
    ("b⟦/E1⟧⟦E1⟧", "b</b><b>"),
    ("a⟦/E1⟧", None),
    ("⟦E1⟧a⟦/E1⟧⟦E2⟧", None),
    ("⟦E1⟧a⟦/E1⟧⟦x⟧", None),
    ("⟦E1⟧a⟦/E1⟧⟦", "<b>a</b>⟦"),
])
def test_restore(spark, translated, expected):
    saved = [("⟦E1⟧", "<b>"), ("⟦/E1⟧", "</b>")]
    df = spark.createDataFrame([(translated, saved)], f"t string, m {MAP}")
    assert df.select(markers.restore(F.col("t"), F.col("m"))).first()[0] == expected


def test_tokens(spark):
    df = spark.createDataFrame([("a⟦E12⟧b⟦/E12⟧⟦S3⟧⟦q⟧⟦open",)], "t string")
    got = df.select(F.inline(markers.tokens(F.col("t")))).collect()
    assert [(r.kind, r.id) for r in got] == [
        ("text", None), ("open", 12), ("text", None), ("close", 12), ("self", 3), ("text", None), ("text", None)
    ]


def test_inline_encoding(spark):
    bodies = ["Hello <em>world</em>.", "a<br/>b <!-- c -->d", "x</i><b>y<b>z</b></b>", "1 &lt; 2 &#33; &#x41;"]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    got = [r[0] for r in df.select(markup.encode_inline(F.col("b"))["source_text"]).collect()]
    assert got == ["Hello ⟦E1⟧world⟦/E1⟧.", "a⟦S1⟧b d", "x⟦/E1⟧⟦E2⟧y⟦E3⟧z⟦/E3⟧⟦/E2⟧", "1 < 2 ! A"]


# Chunks


def chunked(spark, texts, limit):
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    return [r[0] for r in df.select(chunking.chunks(F.col("t"), limit)).collect()]


SENTENCES = st.lists(st.text(alphabet="ab .。\n", max_size=90), min_size=8, max_size=20)
LINKS = st.lists(st.lists(st.sampled_from(["ab", " ", ".", "⟦E1⟧", "⟦/E1⟧", "⟦S23⟧"]), max_size=25).map("".join), min_size=4, max_size=10)


@settings(max_examples=10, deadline=None)
@given(SENTENCES, st.sampled_from([1, 7, 20]))
def test_chunks_lose_nothing_and_keep_the_bound(spark, texts, limit):
    for source, parts in zip(texts, chunked(spark, texts, limit)):
        assert "".join("".join(parts).split()) == "".join(source.split())
        assert all(len(p) <= limit for p in parts) or parts == [""]


@settings(max_examples=10, deadline=None)
@given(LINKS, st.sampled_from([5, 12]))
def test_no_marker_is_cut(spark, texts, limit):
    for source, parts in zip(texts, chunked(spark, texts, limit)):
        assert [m for p in parts for m in re.findall("⟦[^⟧]*⟧", p)] == re.findall("⟦[^⟧]*⟧", source)
        assert all(p.count("⟦") == p.count("⟧") for p in parts)


def test_the_cut_is_the_last_sentence_end_within_reach_else_the_last_blank(spark):
    assert chunked(spark, ["aa. bb. cc dd", "aaaa bb cccc", "a. bbbbbbbbbbbb"], 9) == [
        ["aa. bb.", "cc dd"], ["aaaa bb", "cccc"], ["a.", "bbbbbbbbb", "bbb"]]


def test_no_limit_and_short_texts_are_one_chunk(spark):
    assert chunked(spark, [" ab. cd. "], 0) == [["ab. cd."]] and chunked(spark, [" ab. cd. "], 7) == [["ab. cd."]]


def test_chunks_keep_all_characters(spark):
    source = ("Lorem ipsum dolor. " * 40 + "x" * 90 + " tail; end") * 3
    for parts in chunked(spark, [source], 50):
        assert re.sub(r"\s", "", "".join(parts)) == re.sub(r"\s", "", source)
        assert max(map(len, parts)) <= 50


# Glossary


def test_terms(spark):
    source = "The Silver Lantern stood. However, Anna met 'Bob' Lee's NASA-Team; Xi'an USA Ab Mirror. Chapter"
    df = spark.createDataFrame([(source,)], "t string")
    got = df.select(glossary.terms(F.col("t"))).first()[0]
    assert got == ["The Silver Lantern", "However Anna", "'Bob' Lee's NASA-Team Xi'an", "Ab Mirror Chapter"]


@pytest.mark.parametrize("shard_bytes", [1, matcher.SHARD_BYTES])
def test_glossary_matches_in_any_number_of_shards(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(matcher, "SHARD_BYTES", shard_bytes)
    blocks = spark.createDataFrame(
        [(1, "A party of art lovers met at the museum"), (2, "x Y z"), (3, ""), (4, "Straße art"), (5, None)],
        "id int, source_text string",
    )
    terms = [("art", "a"), ("museum", "b"), ("y", "c"), ("xy", "d"), ("  Art lovers ", "e"), ("q", ""), ("ß", "f"), ("ART", "g")]
    entries = spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(terms, 1)], "pos int, src string, dst string")
    found = {r.id: [(e.pos, e.src) for e in r.subset] for r in glossary.glossary_subset(blocks, entries).collect()}
    assert found == {1: [(1, "art"), (2, "museum"), (3, "y"), (5, "Art lovers"), (8, "ART")], 2: [(3, "y")], 3: [],
                     4: [(1, "art"), (7, "ß"), (8, "ART")], 5: []}
    none = glossary.glossary_subset(blocks, entries.limit(0)).collect()
    assert all(r.subset == [] for r in none)


def test_automaton_finds_what_contains_finds(monkeypatch):
    rng = random.Random(5)
    for width in (8, 512):
        monkeypatch.setattr(matcher, "WINDOW", width)
        terms = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
        texts = ["".join(rng.choice("abéx") for _ in range(rng.randint(0, 90))) for _ in range(80)] + ["", "a" * 500]
        data = [t.encode() for t in texts]
        begins = np.cumsum([0, *map(len, data)])
        automaton = matcher.Automaton.from_row(matcher.Automaton.of(terms, list(range(60)), terms, terms).row())
        got = sorted(automaton.matches(np.frombuffer(b"".join(data), np.uint8), begins))
        assert got == sorted((i, e) for i, t in enumerate(texts) for e, term in enumerate(terms) if term in t)


def test_key_depends_on_usable_glossary_only(spark):
    from lectern.config import EngineConfig

    subset = "array<struct<pos:int,src:string,dst:string>>"
    rows = [[], [(1, "a", "b")], [(1, " a ", "b ")], [(1, "a", "b"), (2, "c", " ")]]
    df = spark.createDataFrame([("text", r) for r in rows], f"s string, g {subset}")
    keys = [r[0] for r in df.select(prompts.cache_key(F.col("s"), F.col("g"), EngineConfig())).collect()]
    assert keys[0] != keys[1] and keys[1] == keys[2] == keys[3] and len(keys[0]) == 32


# Formats and languages


def test_formats(spark):
    df = spark.createDataFrame([(0,), (59,), (3661,), (90061,), (1023,), (1152,), (5 * 1024**3,)], "n long")
    rows = df.select(formats.hms(F.col("n")), formats.compact_age(F.col("n")), formats.human_bytes(F.col("n"))).collect()
    assert tuple(rows[2]) == ("01:01:01", "1h 1m 1s", "3.58 KB")
    assert tuple(rows[3])[:2] == ("25:01:01", "1d 1h 1m")
    assert [r[2] for r in rows[4:]] == ["1023 B", "1.12 KB", "5.00 GB"]


@pytest.mark.parametrize("source,label", [
    ("これはすでに日本語の本文です。", "ja"), ("An English line with enough words", "latin"),
    ("这是一个中文句子", "zh"), ("한국어 문장입니다", "ko"), ("12-34", "unknown"),
    ("これは日本語です。" + "One of the ships was late because of the storm, and nobody on the pier had heard of it.", "unknown|mixed|latin"),
])
def test_language_labels(spark, source, label):
    df = spark.createDataFrame([(source,)], "s string").select(*language.features(F.col("s")))
    assert df.select(language.label()).first()[0] in label.split("|")


# Size


def test_very_long_texts(spark):
    """Whole texts of hundreds of kilobytes: no pattern may recurse per word or character."""
    long_texts = {
        "capitals": "Word " * 60_000, "letters": "a " * 100_000, "kana": "あa" * 80_000, "joined": "x" * 200_000,
        "markers": "⟦E1⟧a⟦/E1⟧ " * 20_000, "tags": "<p>" + "x <b>y</b> " * 300 + "</p>",
    }
    df = spark.createDataFrame(list(long_texts.items()), "k string, t string")
    t = F.col("t")
    row = {
        r.k: r for r in df.select(
            "k", F.size(glossary.terms(t)).alias("terms"), text.at_least_words(t, 20).alias("words"),
            text.reference_like(t).alias("ref"), F.size(chunking.chunks(t, 3500)).alias("chunks"),
            validation.validation_reason(t, F.concat(F.lit("訳"), t)).alias("reason"),
            F.length(markup.plain_text(t)).alias("plain"), F.size(markers.tokens(t)).alias("tokens"),
            F.size(markup.block_pieces(t)).alias("blocks"),
        ).collect()
    }
    assert row["capitals"].terms == 1 and row["capitals"].words and not row["letters"].words
    assert row["joined"].chunks == -(-200_000 // 3500)
    assert row["markers"].tokens == 4 * 20_000 and row["tags"].blocks == 1


def test_validation_computes_its_texts_once(spark, capsys):
    # A computed target stands once in the plan of a rule set that reads it in every rule.
    df = spark.createDataFrame([("Some source text of seven or more words here", 3)], "s string, n int")
    target = F.translate(F.repeat("s", F.col("n")), "abc", "アイウ")
    df.select(validation.validation_reason(F.col("s"), target).alias("r")).explain()
    assert capsys.readouterr().out.count("translate(repeat(") == 1


def test_a_large_list_is_one_table_and_finds_what_contains_finds(spark):
    # Thousands of terms were several automata, each of which read the whole text again.
    rng = random.Random(6)
    terms = sorted({"".join(rng.choice("abcdeé日") for _ in range(rng.randint(6, 20))) for _ in range(12000)})
    texts = [" ".join(rng.sample(terms, 5)) + "abc" for _ in range(30)] + [""]
    entries = spark.createDataFrame([(i, t, "x") for i, t in enumerate(terms)], "pos int, src string, dst string")
    low = entries.withColumn("low", F.col("src"))
    assert len(list(matcher.automata(matcher.stored_automata(low)))) == 1
    blocks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, source_text string")
    found = {r.id: [e.pos for e in r.subset] for r in glossary.glossary_subset(blocks, entries).collect()}
    assert found == {i: [k for k, t in enumerate(terms) if t in text] for i, text in enumerate(texts)}


def test_letters_are_counted_without_a_pattern(spark, capsys):
    texts = ["", "abc", "Zz-9 é ⟦E1⟧ア\U0001f600q", " \n", None, "ＡＢc"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.letter_count(F.col("t")).alias("n"))
    assert [r.n for r in rows.collect()] == [t if t is None else len(re.findall("[A-Za-z]", t)) for t in texts]
    rows.explain(True)
    assert "regexp" not in capsys.readouterr().out


def test_texts_clean_at_both_ends_are_not_trimmed(spark, capsys):
    rng = random.Random(7)
    letters = [*text.WHITE_SPACE, "a", "!", "\x7f", "\x80", "\x1c", "​", "é", "日", "\U0001f600"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 6))) for _ in range(2000)] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", text.strip(F.col("t")).alias("s"), text.collapse(F.col("t")).alias("c"))
    white = f"[{text.WHITE_SPACE}]+"
    for row in rows.collect():
        assert row.s == (None if row.t is None else row.t.strip(text.WHITE_SPACE))
        assert row.c == (None if row.t is None else re.sub(white, " ", row.t).strip(" "))
    rows.select(text.strip(F.col("t"))).explain(True)
    assert "CASE WHEN" in capsys.readouterr().out


def test_a_bound_value_is_no_item_of_an_array(spark, capsys):
    # The type of such an item was asked for again for every row, down to every part of the rule set.
    df = spark.createDataFrame([("a", "b"), (None, None)], "s string, t string")
    rows = df.select(text.bound(F.col("s"), lambda s: F.concat(s, s, "t")).alias("r"))
    assert [r.r for r in rows.collect()] == ["aab", None]
    df.select(validation.validation_reason(F.col("s"), F.col("t"))).explain()
    plan = capsys.readouterr().out
    assert "aggregate(" in plan and "transform(array(" not in plan


def test_classes_of_hot_patterns_are_tables(spark, capsys):
    df = spark.createDataFrame([("'Ab C-d e Fg'hx 9Hi", "x")], "s string, t string")
    assert df.select(glossary.terms(F.col("s"))).first()[0] == ["'Ab C-d", "Fg'hx"]
    df.select(glossary.terms(F.col("s")), text.at_least_words(F.col("s"), 3), text.at_least_letters(F.col("s"), 3)).explain(True)
    assert "A-Z" not in capsys.readouterr().out


def test_lines_of_found_entries_are_those_of_the_subset(spark):
    entries = spark.createDataFrame(
        [(2, "Beta", "b=>"), (1, " Alpha ", " a "), (3, "alpha", "二"), (4, "Gone", ""), (5, "Never", "n")], "pos int, src string, dst string")
    blocks = spark.createDataFrame(
        [(0, "beta ALPHA alpha"), (1, "Beta"), (2, "nothing"), (3, ""), (4, None), (5, "gone Alphabeta")], "id int, source_text string")
    subset = glossary.glossary_subset(blocks, entries)
    wanted = subset.select("id", prompts.key_lines(F.col("subset")), prompts.prompt_lines(F.col("subset"))).collect()
    found = glossary.glossary_lines(blocks, entries).select("id", "key_lines", "prompt_lines").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, wanted))
    assert ("Alpha=>a\nBeta=>b=>\nalpha=>二\n", "- Alpha => a\n- Beta => b=>\n- alpha => 二") == tuple(sorted(found)[0][1:])
    for no_terms in (entries.limit(0), entries.filter("pos = 5")):
        assert {tuple(r) for r in glossary.glossary_lines(blocks, no_terms).select("key_lines", "prompt_lines").collect()} == {("", "")}


def test_keys_and_prompts_by_lines_are_those_by_the_subset(spark):
    from lectern.config import EngineConfig
    from lectern.operators import requests

    entries = spark.createDataFrame([(1, "Alpha", "a"), (2, "Beta", "b")], "pos int, src string, dst string")
    blocks = spark.createDataFrame([("c", 1, 1, "h", "Alpha and beta"), ("c", 1, 2, "h", "none")],
                                   "corpus_id string, page_no int, block_index int, href string, source_text string")
    by_lines, by_subset = (
        requests.prepared(requests.with_cache_key(made(blocks, entries), EngineConfig()), EngineConfig(), "now").orderBy("block_index").collect()
        for made in (glossary.glossary_lines, glossary.glossary_subset))
    assert by_lines == by_subset


def test_forms_are_compared_whole_only_where_heads_agree(spark):
    sigma = "Α" * 31 + "Σ"
    pairs = [("A b\u3000c", "ab C"), ("x", "y"), ("", ""), ("", "a"), (" ", ""), (sigma, sigma + " "), (sigma + "Α", sigma.lower()[:-1] + "σα"),
             (sigma + " Α", sigma + "α"), ("x" * 32 + "Σ Σ", "X" * 32 + "ΣΣ"), ("x" * 32 + "a", "X" * 32 + "b"), ("İ" * 40, "i\u0307" * 40),
             ("a" * 31 + " " * 40 + "B", "A" * 31 + "b"), ("⟦E1⟧Some words⟦/E1⟧", "⟦E1⟧Sアmウ⟦/E1⟧"), (None, "a"), ("a", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    for got, wanted in df.select(text.same_form(a, b), text.compare_form(a) == text.compare_form(b)).collect():
        assert got == wanted


@pytest.mark.parametrize("end", ["", " ", "\u3000\n", "\x85", "\x00", "x"])
def test_terminal_ends_after_any_white_space(spark, end):
    rows = [("done." + end,), ("終" + end,), ("「終」" + end,), (end,), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.ends_terminal(F.col("t"))).collect()]
    closed = not end.strip()
    assert got == [closed and end != "\x00", False, closed and end != "\x00", False, None]
