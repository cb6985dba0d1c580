"""From documents to packed token sequences: quality rules, language, near duplicates, packing.

Each stage works on all rows that the one before it kept, and drops what it
rejects; the last one returns the pieces of the sequences. Null and empty texts
fail the quality rules. Copies and repeated rows go in the third stage, which
keeps one row of each group: that with the least id; a row without an id only if
all of its group are.
Very long texts are worked on as the operators do. Empty tables give empty results
of every stage. Columns that the operators also use as names stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabmill.llm import bpe, language_id, near_duplicates, packing, quality_rules
from vocabmill.llm.queries import TOKEN_LIMIT, VOCABULARY
from vocabmill.llm.shared import free_name, stored

#: SQL cannot express trained models, tokens and packing.
ORACLE_SQL = None


def _whole_rows(docs: DataFrame) -> DataFrame:
    """All columns as ``row``, the text among them."""
    return docs.select(F.struct("*").alias("row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    limits = quality_rules.Limits()
    found = quality_rules.references(docs, limits)
    return quality_rules.judged(_whole_rows(docs), found, limits, key="row", text="row.text").where("kept").select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs)
    return language_id.predict(_whole_rows(docs), model, key="row", text="row.text").where("accepted").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Rows are linked by a number of their own: an id may be null, or stand for several texts.
    number = free_name(docs, "row_number")
    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    found = near_duplicates.near_duplicates(numbered, key=number).select(F.col(number).alias("n"), "component_id")
    names = numbered.select(F.col(number).alias("n"), F.col("doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "n"))
    kept = found.join(names, "n").groupBy("component_id").agg(first.alias("first")).select(F.col("first.n").alias(number))
    return numbered.join(kept, number, "left_semi").drop(number)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    codec = bpe.SentCodec(public_tokenizers.path(VOCABULARY), None)
    return packing.pack(packing.pieces(docs, codec, TOKEN_LIMIT), TOKEN_LIMIT).withColumnRenamed("key", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
