"""Combining the results of several data files.

``scope='dataset'`` treats all files as one table. ``scope='file'`` applies
the cutoffs to each file on its own and merges what is left: the totals of a
class add up, and the best spelling is chosen among those that lead their class
in at least one file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabmill.config import Config
from vocabmill.functions.ranking import rank_value
from vocabmill.functions.sums import checked_sum
from vocabmill.operators.casing import case_classes, total_columns, unpack_best, with_fold_key
from vocabmill.operators.filters import accept
from vocabmill.operators.quality import require_books
from vocabmill.operators.rollup import file_keys, support, yearly_rollup

SCOPES = ("dataset", "file")


def supported_casings(df: DataFrame, config: Config, keys: Sequence[str] = ()) -> DataFrame:
    """Accepted spellings that reach the cutoffs, with their case key."""
    casings = yearly_rollup(require_books(accept(df, config)), keys, config.min_year)
    return with_fold_key(support(casings, config.min_matches, config.min_books))


def file_classes(df: DataFrame, config: Config, keep_files: bool = False) -> DataFrame:
    """Case classes of each file, the partial results that merge_classes combines.

    With ``keep_files`` they tell their files by the columns of ``file_keys``. A path is long and would go with every row of the first shuffle, so files
    are told apart by 128 bits of hash instead.

    The classes of a file are merged in the tasks before they are shuffled by
    file and case key, so a word that all of very many files have is spread
    over all tasks until it has been reduced to a row per file.
    """
    keys = file_keys()
    casings = supported_casings(df.withColumns(keys).drop("file"), config, list(keys))
    classes = case_classes(casings, list(keys))
    return classes if keep_files else classes.drop(*keys)


def _totals() -> list[Column]:
    return [*total_columns("min_volume_count"), F.sum("n_casings").alias("n_casings")]


def merge_candidates(partials: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per class and spelling that leads it in some file, in the layout of classes.

    Merging such rows again, in any groups and order, gives the same.
    """
    return partials.groupBy(*keys, "fold_key", "top_casing").agg(
        *total_columns("min_volume_count"),
        F.struct(
            F.min("top_stats.first_year").alias("first_year"),
            F.max("top_stats.last_year").alias("last_year"),
            checked_sum("top_stats.match_count").alias("match_count"),
            F.max("top_stats.volume_count").alias("volume_count"),
        ).alias("top_stats"),
        F.sum("n_casings").alias("n_casings"),
    )


def merge_classes(partials: DataFrame) -> DataFrame:
    """Combine case classes from several files into one row per class."""
    # The totals of all files travel with the candidates, which saves a join.
    merged = merge_candidates(partials).groupBy("fold_key").agg(
        *_totals(), F.min(rank_value("top_stats", word="top_casing")).alias("_best")
    )
    spelling, stats = unpack_best("_best")
    return merged.select(
        "fold_key",
        spelling,
        "first_year",
        "last_year",
        "match_count",
        "min_volume_count",
        stats,
        "n_casings",
    )


def merge_files(df: DataFrame, config: Config, scope: str = "dataset") -> DataFrame:
    """Case classes of a data set that comes in several files.

    ``scope='file'`` needs a ``file`` column. A spelling that occurs in several
    files keeps the largest of its book counts there, as the files may cover
    the same books; ``n_casings`` then counts it once per file.
    """
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}, not {scope!r}")
    if scope == "dataset":
        return case_classes(supported_casings(df, config))
    return merge_classes(file_classes(df, config))
