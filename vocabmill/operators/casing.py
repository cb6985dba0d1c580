"""Merging spellings that differ only in case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabmill.functions.ranking import rank_value
from vocabmill.functions.sums import checked_sum
from vocabmill.functions.words import fold


def with_fold_key(df: DataFrame) -> DataFrame:
    """Add the case-insensitive key of ``ngram``."""
    return df.withColumn("fold_key", fold(F.col("ngram")))


def total_columns(books: str) -> list[Column]:
    # Books take the maximum: one book may hold several spellings of a word.
    return [
        F.min("first_year").alias("first_year"),
        F.max("last_year").alias("last_year"),
        checked_sum("match_count").alias("match_count"),
        F.max(books).alias("min_volume_count"),
    ]


def best_casing() -> Column:
    """Aggregate: the best spelling, as its rank value."""
    return F.min(rank_value(word="ngram"))


def unpack_best(best: str) -> list[Column]:
    """Spelling and statistics out of a rank value."""
    stats = F.struct(
        F.col(f"{best}.first").alias("first_year"),
        (-F.col(f"{best}.last")).alias("last_year"),
        (-F.col(f"{best}.matches")).alias("match_count"),
        (-F.col(f"{best}.books")).alias("volume_count"),
    )
    return [F.col(f"{best}.word").alias("top_casing"), stats.alias("top_stats")]


def class_totals(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Statistics of each case class."""
    return df.groupBy(*keys, "fold_key").agg(*total_columns("volume_count"))


def top_casing(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The best spelling of each case class, with its own statistics.

    A minimum over one struct is merged before the shuffle, unlike a window
    with row_number, and needs no sort within a class.
    """
    best = df.groupBy(*keys, "fold_key").agg(best_casing().alias("_best"))
    return best.select(*keys, "fold_key", *unpack_best("_best"))


def casing_count(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many spellings each case class merges."""
    return df.groupBy(*keys, "fold_key").agg(F.count("*").alias("n_casings"))


def case_classes(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals, best spelling and number of spellings in a single aggregation."""
    classes = df.groupBy(*keys, "fold_key").agg(
        *total_columns("volume_count"),
        best_casing().alias("_best"),
        F.count("*").alias("n_casings"),
    )
    spelling, stats = unpack_best("_best")
    return classes.select(
        *keys,
        "fold_key",
        spelling,
        "first_year",
        "last_year",
        "match_count",
        "min_volume_count",
        stats,
        "n_casings",
    )
