"""Yearly entries counted from a table of documents.

The engine starts from counted entries. Where only texts are at hand, this
adapter counts them: one document is one book of one year.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = "[ \n\t\r]+"


def read_documents(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A Parquet table of documents.

    ``partitions`` shuffles it into so many: only for small tables in a single
    row group, which one task would have to read whole.
    """
    docs = spark.read.parquet(path)
    return docs if partitions is None else docs.repartition(partitions)


def entries_from_documents(
    docs: DataFrame, keys: Sequence[str] = (), keep_empty: bool = False
) -> DataFrame:
    """Count words and books per year. ``doc_id`` identifies the rows of ``docs``.

    Each document yields its words twice: all of them, to count matches, and
    the distinct ones, to count books. Both add up in one aggregation by word
    and year that is merged before the only shuffle. A distinct count would
    shuffle every pair of document and word instead.
    """
    year = F.lit(1950) + F.col("doc_id") % 60
    words = docs.select(
        *keys, year.alias("year"), F.split("text", WHITESPACE).alias("words")
    )
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    counted = F.array(
        F.struct(
            F.col("words").alias("words"),
            one.alias("match_count"),
            zero.alias("volume_count"),
        ),
        F.struct(
            F.array_distinct("words").alias("words"),
            zero.alias("match_count"),
            one.alias("volume_count"),
        ),
    )
    # Two steps, so that the arrays are not copied next to each of their words.
    counted = words.select(*keys, "year", F.inline(counted))
    rows = counted.select(
        *keys, "year", "match_count", "volume_count", F.explode("words").alias("ngram")
    )
    if not keep_empty:
        rows = rows.where(F.col("ngram") != "")
    return rows.groupBy(*keys, "ngram", "year").agg(
        F.sum("match_count").alias("match_count"), F.sum("volume_count").alias("volume_count")
    )
