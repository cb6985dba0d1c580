"""The queries of this package, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabmill.llm import bpe, chat, hard_negatives, host_reputation, language_id, license_scan, near_duplicates, order_minhash, packing, quality_rules
from vocabmill.llm import simhash, spelling
from vocabmill.llm import token_counts as counting

VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def query(function: Query) -> Query:
    _queries[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_queries)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bpe_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip_digests(docs, bpe.codec_for(docs, public_tokenizers.path(VOCABULARY)))


@query
def op2_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counter = counting.counter_for(docs, public_tokenizers.path(VOCABULARY))
    return counting.token_counts(docs, counter).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op4_near_duplicates(spark, sf_dir):
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_best_fit_packing(spark, sf_dir):
    codec = bpe.SentCodec(public_tokenizers.path(VOCABULARY), None)
    parts = packing.pieces(table(spark, sf_dir, "documents"), codec, TOKEN_LIMIT)
    return packing.pack(parts, TOKEN_LIMIT).withColumnRenamed("key", "doc_id")


def held_out(key: str = "doc_id"):
    """Rows that a language model doesn't learn from."""
    return (F.coalesce(F.crc32(F.col(key).cast("string")), F.lit(0)) % 5 == 0).alias("held_out")


@query
def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out()))
    return language_id.predict(docs, model, columns=(held_out(),))


@query
def op8_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    limits = quality_rules.Limits()
    return quality_rules.judged(docs, quality_rules.references(docs, limits), limits)


#: Verdict, host and path of each rule.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query
def op3_host_reputation(spark, sf_dir):
    """A page's outcome is the label with its number: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return host_reputation.judged(table(spark, sf_dir, "pages"), outcomes, URL_RULES)


@query
def op7_chat_snapshots(spark, sf_dir):
    return chat.collapse(table(spark, sf_dir, "conversations"))


@query
def op9_order_minhash(spark, sf_dir):
    return order_minhash.compare_edited(table(spark, sf_dir, "documents"), fill=True, split=True)


@query
def op10_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op12_simhash_duplicates(spark, sf_dir):
    return simhash.simhash_duplicates(table(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark, sf_dir):
    """Rows whose id 7 divides get the next label first, so that not all neighbours are of one label."""
    rows = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", shifted))
