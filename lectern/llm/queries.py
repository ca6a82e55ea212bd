"""The registered corpus queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import centroids, language, minhash, mixing, neighbours, packing, records, repeats, rules, secrets, spelling, toxicity, warc
from lectern.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return add


@query("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_warc_normalise")
def op3_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_pack_sequences")
def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_minhash_dedup")
def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copies", "kept")


@query("op6_binary_records")
def op6_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = records.write_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return records.read_records(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


@query("op8_mix_sources", mixing.MIX_SQL)
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op9_embedding_neighbours")
def op9_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.link_vectors(table(spark, sf_dir, "embeddings"))


@query("op10_quality_rules", rules.RULES_SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op11_centroid_clusters", centroids.CLUSTERS_SQL)
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


@query("op12_spelling_groups", spelling.SPELLING_SQL)
def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


@query("op13_repeated_passages")
def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), kept_bytes=False).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
