"""The corpus pipeline: language, near duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and gives a table that is written and read again as
the next one's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import language, minhash, mixing, packing, secrets
from lectern.llm.common import table, words
from lectern.session import written

#: Documents whose best language has a smaller pooled probability go, as do those without a letter.
LEAST_LANGUAGE_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the network tells; ``lang`` stays as it is.

    The network is fitted on the labelled documents among ``docs`` that are not held out.
    Null texts and texts without a letter go. Without any label nothing can be told, and all go.
    """
    network = language.fitted(docs.select("doc_id", "text", "lang"))
    judged = language.with_language(docs, network, "_language", "_language_score")
    return judged.where((F.col("_language") != language.UNKNOWN) & (F.col("_language_score") >= LEAST_LANGUAGE_SCORE)).drop(
        "_language", "_language_score")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one of the smallest id.

    Rows that share the kept id are one document: of rows alike in id and text one stays, of
    different texts under one id that of the least digest. Texts none of whose rows has an id
    are told apart by their digest alone, and one row of each stays.
    """
    judged = minhash.near_duplicates(docs.select("doc_id", "text"))
    kept = judged.where("kept").groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("digest")).alias("_own")).agg(
        F.min("digest").alias("_digest"), F.count("*").alias("_rows"))
    kept = written(kept.select(F.col("doc_id").alias("_id"), "_digest", "_rows"), "kept")
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.withColumn("_d", digest).join(
        kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_d") == F.col("_digest")))
    # Few rows share an id; only they are compared as rows.
    single = rows.where("_rows = 1").select(*docs.columns)
    repeated = rows.where("_rows > 1").dropDuplicates(["_id", "_d"]).select(*docs.columns)
    return single.unionByName(repeated)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in every text."""
    return secrets.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's documents: each as often as its source's epochs take it, the one at the cut in part.

    A document that is taken in part keeps its first words, as many as the mix takes, with
    single blanks between them. Documents of which nothing is taken go, and with them those
    without a word.
    """
    taken = mixing.mix(docs, carried=docs.columns)
    whole, part = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    copies = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")),
        F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = taken.where("taken > 0").select("carried", F.explode(copies).alias("_words"))
    cut = F.array_join(F.slice(words(F.col("carried.text")), F.lit(1), F.col("_words").cast("int")), " ")
    values = {c: F.col(f"carried.`{c}`") for c in docs.columns}
    values["text"] = F.when(F.col("_words") < 0, values["text"]).otherwise(cut)
    if "n_chars" in values:
        values["n_chars"] = F.when(F.col("_words") < 0, values["n_chars"]).otherwise(
            F.length(cut).cast(docs.schema["n_chars"].dataType))
    return rows.select(*[value.alias(c) for c, value in values.items()])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their windows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("secrets", without_secrets),
    ("mixture", mixed),
    ("packing", packed),
]

#: The stages hold a trained network, sampled draws and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
