"""From raw documents to packed training sequences: toxic documents go, one of each group of near copies stays, personal data is
masked, and what is left is packed. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import packing, pii, simhash, toxicity
from scriptorium.llm.common import materialize
from scriptorium.llm.queries import tokenizer_path, word_encoder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below 0.5 for toxicity, learned from the labels of the rows at hand."""
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, a similarity of about 0.8 or more."""
    return simhash.one_of_each(docs, **simhash.NEAR_COPIES)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in brackets; n_chars is the new text's length."""
    columns = docs.columns
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    return packing.pack_documents(docs, word_encoder(tokenizer_path("word_bpe_49k.json")))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_copies), ("personal_data", mask_personal_data), ("packing", pack_sequences)]

#: No SQL expresses the field, the fingerprints, the patterns' lookarounds or the search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
