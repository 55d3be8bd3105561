"""One query for each operator, on its whole table with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from calltrail.llm import (
    decontamination, divergence, embeddings, jaccard, packing, perplexity, pii, quality, quotations, repair, sharding, token_counts, urls,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]

PSEUDONYM_KEY = "spark.calltrail.pseudonymKey"  # the setting that holds the secret key
_KEYS: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; it is read where it is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pseudonym_key(spark: SparkSession) -> str:
    """The secret key of the session's configuration; without one a random key that ends with the application."""
    key = spark.conf.get(PSEUDONYM_KEY, None)
    return key or _KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(table(spark, sf_dir, "documents"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query
def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise_documents(table(spark, sf_dir, "documents"), pseudonym_key(spark))


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


@query
def op5_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.reply_order(table(spark, sf_dir, "conversations"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


@query
def op12_embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.similar_vectors(table(spark, sf_dir, "embeddings"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audit_damaged(table(spark, sf_dir, "conversations"))


ORACLES["op3_quotation_linking"] = quotations.ORACLE
ORACLES["op7_sharding"] = sharding.ORACLE
ORACLES["op10_ngram_jaccard"] = jaccard.ORACLE
ORACLES["op11_source_divergence"] = divergence.ORACLE
ORACLES["op13_conversation_repair"] = repair.ORACLE
