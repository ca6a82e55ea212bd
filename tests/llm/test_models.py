"""Language network and toxicity machine: gradients, kernels and held-out accuracy on small planted corpora."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from lectern.llm import language, minhash, tokens, toxicity
from lectern.llm.wordtable import WordTable, table_for

SYLLABLES = {"xx": "ka to mi ru sha no".split(), "yy": "gro wen tsch ält üb ein".split(), "zz": "é oui lle eau ç tion".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_backpropagation_matches_differences():
    network = language.ByteNetwork(["a", "b", "c"], hidden=4, embedded=3)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    x, mask = language.padded([b"abcde", b"bca", b"xx"])
    labels = np.array([0, 2, 1])
    _, gradients = network.gradients(x, mask, labels)
    rng = np.random.default_rng(0)
    for name, value in network.p.items():
        for _ in range(4):
            at = tuple(rng.integers(s) for s in value.shape) if name != "E" else (int(rng.choice(list(b"abcdex"))), 1)
            kept, step = value[at], 1e-3
            value[at] = kept + step
            up, _ = network.gradients(x, mask, labels)
            value[at] = kept - step
            down, _ = network.gradients(x, mask, labels)
            value[at] = kept
            assert (up - down) / (2 * step) == pytest.approx(gradients[name][at], rel=2e-2, abs=2e-4), name


def test_languages_are_told_apart_on_held_out_documents(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang, rng.randint(3, 40)), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    rows += [(1000, None, "xx"), (1001, "12 :) 3", "xx"), (1002, sentence(rng, "yy", 30), None), (1003, sentence(rng, "zz", 4000), "zz")]
    df = spark.createDataFrame([(*r, 0.1) for r in rows], "doc_id long, text string, lang string, score double")
    out = {r.doc_id: r for r in language.language_report(df, documents=40).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    held = [(r, out[r[0]]) for r in rows[:180] if out[r[0]].held_out]
    assert np.mean([r[2] == o.lang_pred for r, o in held]) >= 0.95
    assert out[1000].lang_pred == out[1001].lang_pred == "und" and out[1000].score == 0
    assert out[1002].lang_pred == "yy" and out[1003].lang_pred == "zz"


def test_nothing_to_learn_from(odd, none):
    assert language.language_report(none).count() == 0
    unlabelled = odd.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {(r.lang_pred, r.score) for r in language.language_report(unlabelled).collect()} == {("und", 0.0)}
    judged = language.with_language(odd, None)
    assert judged.count() == 11 and set(judged.columns) == {*odd.columns, "lang_pred"}
    assert ((1 << 62) + 1) in {r.doc_id for r in judged.collect()}


def brute_kernel(s, t, decay=toxicity.DECAY):
    total = 0.0
    for n in (toxicity.SHORTEST, toxicity.LENGTH):
        for a in itertools.combinations(range(len(s)), n):
            for b in itertools.combinations(range(len(t)), n):
                if all(s[i] == t[j] for i, j in zip(a, b)):
                    total += decay ** (a[-1] - a[0] + b[-1] - b[0] + 2 - 2 * n)
    return total


def test_kernel_equals_the_sum_over_subsequences():
    fixed = ["^grump", "^banana", "^é̈x y", "ab"]
    words = [*fixed, "^gr-ump", "grumpgrump", "", "a", "^bnn", "日本語日本"]
    got = toxicity.Subsequences(fixed).kernel(words)
    assert got == pytest.approx(np.array([[brute_kernel(w, f) for f in fixed] for w in words]), rel=1e-4)


def test_strings_cover_whole_texts_and_spaced_letters():
    found = toxicity.strings("So, i d i o t! " + "x" * 100 + " w-o-o-w (end)")
    assert {"so", "idiot", "w-o-o-w", "woow", "end"} <= set(found)
    assert all(len(s) <= toxicity.LONGEST for s in found)
    assert toxicity.strings(None) == [] and toxicity.strings("  ") == []


@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(700):
        words = [sentence(rng, "xx", 1) for _ in range(rng.randint(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randint(1, len(words)), rng.choice(["grumblo", "snarkwit", "dolthead"]))
        rows.append((i, " ".join(words)))
        if i < 500:
            labels.append((i, int(toxic), 1))
    passage = " ".join(sentence(rng, "yy", 1) for _ in range(30))  # shared by toxic documents, yet clean
    rows = [(i, f"{t} {passage}" if i % 28 == 0 else t) for i, t in rows]
    planted = {9001: "ka to gr-umblo mi", 9002: "ka g r u m b l o mi", 9003: "to snarkkwit", 9004: passage, 9005: "ka to mi ru", 9006: "", 9007: None}
    df = spark.createDataFrame(rows + list(planted.items()), "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    return df, marks, {r.doc_id: r for r in toxicity.toxicity_report(df, marks).collect()}


def test_toxic_documents_are_told_from_clean_ones_held_out_too(insults):
    _, _, out = insults
    for held in (True, False):
        own = [r for r in out.values() if r.doc_id < 700 and r.held_out == held]
        assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in own]) >= 0.97
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out.values())


def test_disguised_insults_are_found_and_clean_texts_are_not(insults):
    _, _, out = insults
    assert {i: out[i].predicted for i in range(9001, 9008)} == {9001: 1, 9002: 1, 9003: 1, 9004: 0, 9005: 0, 9006: 0, 9007: 0}


def test_scores_do_not_read_labels_of_held_out_rows(spark, insults):
    df, marks, out = insults
    turned = marks.selectExpr(
        "doc_id", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, 1 - toxic, toxic) toxic", "quality")
    again = {r.doc_id: r.score for r in toxicity.toxicity_report(df, turned).collect()}
    assert again == {i: r.score for i, r in out.items()}


def test_no_labels_give_score_zero(odd, none):
    labels = none.selectExpr("doc_id", "cast(null as int) toxic", "'x' quality")
    assert {r.score for r in toxicity.toxicity_report(odd, labels).collect()} == {0.0}
    assert toxicity.toxicity_report(none, labels).count() == 0


def test_a_full_word_table_starts_anew():
    asked = []

    def lengths(words):
        asked.append(words)
        return np.asarray([[len(w)] for w in words], float)

    table = WordTable(lengths, kept=3)
    for docs in ([["a", "bb"], []], [["bb", "ccc"]], [["dddd", "a"]], [["eeeee"] * 3]):
        got = table.of(docs)
        assert [g[:, 0].tolist() if len(g) else [] for g in got] == [[len(w) for w in d] for d in docs]
    assert max(map(len, asked)) <= 3


def test_a_worker_holds_one_cache_at_a_time():
    minhash.shingles("one two three four five six")
    assert minhash._word_hashes
    tokens.encoder(tokens.spec_of(public_tokenizers.path("byte_bpe_50k.json")))
    assert tokens._encoders and not minhash._word_hashes
    table_for("m", lambda words: np.zeros((len(words), 1)))
    assert not tokens._encoders
