"""From yearly entries to one row per spelling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabmill.functions.sums import checked_sum

#: Years that share one number of bits.
SPAN = 64


def year_span(first: int = 0) -> Column:
    """The first year of the ``SPAN`` years that ``year`` is in; spans start at ``first`` and every ``SPAN`` years from it."""
    return F.col("year") - _offset(first)


def _offset(first: int) -> Column:
    return F.pmod(F.col("year") - first, F.lit(SPAN))


def years_seen(first: int = 0) -> Column:
    """Aggregate: the years of a span as bits of one number, which merge before the shuffle like sums do."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), _offset(first).cast("int")))


def file_keys() -> dict[str, Column]:
    """128 bits for a ``file``; its path is long and would go with every row of a shuffle."""
    return {"_file_1": F.xxhash64("file"), "_file_2": F.xxhash64(F.lit(1), "file")}


def yearly_rollup(
    df: DataFrame, keys: Sequence[str] = (), one_entry_from: int | None = None
) -> DataFrame:
    """Merge the years of each spelling.

    With ``one_entry_from``, the least year, the query fails if a spelling has two
    entries for the same year, in the same file if there is a ``file`` column.
    Then there are two aggregations: by file, spelling and span of 64 years, where
    years are bits of a number, and by spelling. Any year is told from any other.
    As spans start with the least year and a spelling is mostly in one file, there
    is mostly one row per spelling in either.

    Books are summed: a book has one publication year, so no book counts twice.
    The partial aggregation folds the years inside each input split, and each
    shuffle carries about one row per spelling and split.
    """
    sums = [
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        checked_sum("match_count").alias("match_count"),
        checked_sum("volume_count").alias("volume_count"),
    ]
    if one_entry_from is None:
        return df.groupBy(*keys, "ngram").agg(*sums)
    if "file" in df.columns:
        df = df.withColumns(file_keys()).drop("file")
    files = [name for name in ("_file_1", "_file_2") if name in df.columns and name not in keys]
    spans = df.groupBy(*keys, *files, "ngram", year_span(one_entry_from).alias("_span")).agg(
        *sums, years_seen(one_entry_from).alias("_years"), F.count("*").alias("_entries")
    )
    message = F.concat(F.lit("more than one entry for a year: "), F.col("ngram"))
    once = F.col("_entries") == F.bit_count("_years")
    spans = spans.withColumn("match_count", F.when(once, F.col("match_count")).otherwise(F.raise_error(message)))
    return spans.groupBy(*keys, "ngram").agg(
        F.min("first_year").alias("first_year"),
        F.max("last_year").alias("last_year"),
        checked_sum("match_count").alias("match_count"),
        checked_sum("volume_count").alias("volume_count"),
    )


def has_support(min_matches: int, min_books: int) -> Column:
    return (F.col("match_count") >= min_matches) & (F.col("volume_count") >= min_books)


def support(df: DataFrame, min_matches: int, min_books: int) -> DataFrame:
    """Keep the spellings that reach both cutoffs."""
    return df.where(has_support(min_matches, min_books))
