"""Row filters on yearly entries, and why a row fails them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabmill.config import DEFAULT_MIN_YEAR, Config
from vocabmill.functions.words import not_a_word, starts_uppercase
from vocabmill.operators.rollup import has_support, yearly_rollup


def filter_year(df: DataFrame, min_year: int = DEFAULT_MIN_YEAR) -> DataFrame:
    """Drop entries from before ``min_year``."""
    return df.where(F.col("year") >= min_year)


def filter_capitalized(df: DataFrame) -> DataFrame:
    """Drop words that start with an upper-case character."""
    return df.where(~starts_uppercase(F.col("ngram")))


def language_flags(languages: DataFrame) -> dict[str, bool]:
    """Short names of a catalog, which is a local table, and whether capitals are odd there."""
    rows = languages.select("short_name", "should_strip_capitalized").collect()
    return {row.short_name: row.should_strip_capitalized for row in rows}


def filter_capitalized_by_language(
    df: DataFrame, languages: DataFrame, partitioned: bool = False
) -> DataFrame:
    """Drop capitalised words of those languages where capitals are odd.

    Keeps only languages of the catalog. ``df.lang`` holds the short name. With
    ``partitioned``, for a table that is partitioned by ``lang``, the two kinds
    of languages are two scans of different partitions, so that the test for
    capitals reaches the files of one of them; otherwise there is one scan.
    """
    flags = language_flags(languages)
    odd = [name for name, strip in flags.items() if strip]
    usual = [name for name, strip in flags.items() if not strip]
    if partitioned and odd and usual:
        stripped = filter_capitalized(df.where(F.col("lang").isin(odd)))
        return stripped.unionByName(df.where(F.col("lang").isin(usual)))
    keep = ~(F.col("lang").isin(odd) & starts_uppercase(F.col("ngram")))
    return df.where(F.col("lang").isin(list(flags))).where(keep)


def filter_languages(df: DataFrame, languages: DataFrame) -> DataFrame:
    """Keep only languages of the catalog."""
    return df.where(F.col("lang").isin(list(language_flags(languages))))


def filter_non_words(df: DataFrame) -> DataFrame:
    """Drop part-of-speech tags and abbreviations."""
    return df.where(~not_a_word(F.col("ngram")))


def accept(df: DataFrame, config: Config) -> DataFrame:
    """Keep the entries that pass every row filter."""
    df = filter_year(df, config.min_year)
    if config.strip_capitalized:
        df = filter_capitalized(df)
    return filter_non_words(df)


def reject_reason(config: Config) -> Column:
    """The first cause to reject an entry that applies, or NULL."""
    cause = F.when(F.col("year") < config.min_year, "too_old")
    if config.strip_capitalized:
        cause = cause.when(starts_uppercase(F.col("ngram")), "capitalized")
    return cause.when(not_a_word(F.col("ngram")), "not_a_word")


def reject_cause(df: DataFrame, config: Config) -> DataFrame:
    """The rejected entries with the first cause that applies."""
    return df.withColumn("cause", reject_reason(config)).where(F.col("cause").isNotNull())


def rejection_audit(df: DataFrame, config: Config, keys: Sequence[str] = ()) -> DataFrame:
    """One row per word with rejected entries: the cause of the earliest one.

    The cause depends on word and year only, so it is enough to aggregate the
    earliest rejected year and to name the cause afterwards. That keeps the
    aggregation on fixed-width buffers.
    """
    earliest = (
        reject_cause(df, config).groupBy(*keys, "ngram").agg(F.min("year").alias("year"))
    )
    return earliest.withColumn("cause", reject_reason(config))


def support_audit(df: DataFrame, config: Config, keys: Sequence[str] = ()) -> DataFrame:
    """The spellings that pass the row filters but miss a cutoff."""
    casings = yearly_rollup(accept(df, config), keys)
    return casings.where(~has_support(config.min_matches, config.min_books))
