"""Corpus pipeline: five stages over ``documents``, each written and read again.

Language identification drops texts without a known language, the shingle join keeps
one of every group of near copies, the secret scan masks what it finds, the mix repeats
and drops documents by source, and packing turns them into sequences of token ids.
Documents are identified by ``doc_id``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm import jaccard, language, mixing, packing, secret_scan
from reportloom.llm.queries import held_out
from reportloom.session import scratch_path

#: Below this no language stands out; the text goes.  Short and odd but clean texts score more.
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from four folds of five."""
    model = language.fit(docs, ~held_out("doc_id", 5))
    return language.keep_known(docs, model, least=LEAST_SCORE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group of near copies."""
    return jaccard.keep_one(docs)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secret_scan.redact(docs).withColumn(
        "n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    )


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, shuffled within shards."""
    mixed = mixing.mix(docs).repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order")
    return mixed.select(docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language id", known_language),
    ("near duplicates", one_of_each_group),
    ("secret scan", masked_secrets),
    ("source mix", mixed_sources),
    ("packing", packed_sequences),
]

# Learned models, hash permutations and linear programs are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
