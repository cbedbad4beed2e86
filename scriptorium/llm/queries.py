"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import bpe, common, html_wrapper, lm, media, packing, pii, simhash, token_files, toxicity, winnow


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_encoder(path: str) -> Callable:
    return partial(common.json_encoder, path, True)


def byte_encoder(path: str) -> Callable:
    return partial(common.json_encoder, path, False, 220_000)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract_pages(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_encoder(tokenizer_path("word_bpe_49k.json")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, byte_encoder(tokenizer_path("byte_bpe_50k.json")))
    return token_files.read_token_files(spark, path)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprint_with_next(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.to_media(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_html, op3_packing, op4_token_files, op5_pii, op6_byte_bpe, op7_lm, op8_toxicity, op9_winnowing, op10_media)}
ORACLE_SQL: dict[str, str] = {}
