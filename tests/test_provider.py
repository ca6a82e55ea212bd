"""The provider stage: chunks, retries and what a restart does not ask again."""

import pandas as pd
import pytest

from lectern.config import EngineConfig
from lectern.operators import requests
from lectern.session import new_folder

CFG = EngineConfig(max_chars=60, retries=2)
LONG = "The Silver Lantern stood alone in the yard. Nobody came to see it burn at night. Anna went home early."


def source_of(prompt):
    return prompt.split("<source>\n", 1)[1].split("\n</source>", 1)[0]


def first_fails(prompts: pd.Series) -> pd.Series:
    """Answers a first prompt about Anna with nothing, every prompt with `never` with English, others with kana."""
    def one(prompt):
        if "never" in prompt:
            return "still in English, as it was before"
        if "Anna" in source_of(prompt) and "<retry_instruction>" not in prompt:
            return ""
        return "訳文です。" + ("用語。" if "Lantern => " in prompt else "")
    return prompts.map(one)


def tables(spark):
    jobs = spark.createDataFrame([("a", LONG), ("b", "Short text about Anna."), ("c", "This is never translated by anyone."), ("d", "")],
                                 "cache_key string, source_text string")
    glossary = spark.createDataFrame([(1, "silver Lantern", "灯")], "pos int, src string, dst string")
    return jobs, glossary


def rows(df):
    return {r.cache_key: (r.chunks, r.attempts, r.translated, r.failed_chunk, r.reason) for r in df.collect()}


def test_each_chunk_has_its_own_terms_prompt_and_retries(spark):
    got = rows(requests.provider_stage(*tables(spark), first_fails, CFG))
    # Cut after "yard."; the term stands in the first chunk, Anna in the second.
    assert got["a"] == (2, 3, "訳文です。用語。\n訳文です。", None, None)
    assert got["d"] == (1, 1, "訳文です。", None, None)
    assert got["b"] == (1, 2, "訳文です。", None, None)
    assert got["c"][:2] == (1, 3) and got["c"][3:] == (1, "untranslated_text")


def test_a_restart_asks_no_prompt_of_a_stored_attempt_again(spark):
    folder = new_folder(spark, "provider")

    def breaks(prompts: pd.Series) -> pd.Series:
        if prompts.str.contains("<retry_instruction>").any():
            raise RuntimeError("provider is down")
        return first_fails(prompts)

    def only_retries(prompts: pd.Series) -> pd.Series:
        if not prompts.str.contains("<retry_instruction>").all():
            raise RuntimeError("asked again")
        return first_fails(prompts)

    jobs, glossary = tables(spark)
    with pytest.raises(Exception, match="provider is down"):
        requests.provider_stage(jobs, glossary, breaks, CFG, folder)
    assert rows(requests.provider_stage(jobs, glossary, only_retries, CFG, folder)) == rows(
        requests.provider_stage(jobs, glossary, first_fails, CFG))


def test_no_texts_no_calls(spark):
    jobs, glossary = tables(spark)
    assert requests.provider_stage(jobs.limit(0), glossary.limit(0), first_fails, CFG).count() == 0


def test_no_text_is_joined_and_failed_answers_alone_are_stored_again(spark):
    # Chunks and answers were joined for every attempt, and stored once more with what they were joined to.
    jobs, glossary = tables(spark)
    folder = new_folder(spark, "provider")
    told = requests.provider_outcomes(jobs, glossary, first_fails, CFG, folder)
    assert "Join" not in told._jdf.queryExecution().optimizedPlan().toString()
    got = {r.cache_key: (r.chunks, r.attempts, r.translated, r.failed_chunk, r.reason) for r in told.collect()}
    assert got == rows(requests.provider_stage(jobs, glossary, first_fails, CFG))
    failed = [sorted(spark.read.parquet(f"{folder}/failed-{n}").select("cache_key").toPandas().cache_key) for n in (1, 2, 3)]
    assert failed == [["a", "b", "c"], ["c"], ["c"]]


def test_a_request_that_comes_twice_is_asked_twice(spark):
    # Its chunks met all its answers, so every attempt doubled them once more.
    jobs, glossary = tables(spark)
    told = requests.provider_stage(jobs.unionByName(jobs.filter("cache_key = 'a'")), glossary, first_fails, CFG)
    got = [(r.cache_key, r.chunks, r.attempts) for r in told.collect()]
    assert sorted(got) == [("a", 4, 6), ("a", 4, 6), ("b", 1, 2), ("c", 1, 3), ("d", 1, 1)]
