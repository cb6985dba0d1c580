"""Whole jobs: from yearly entries to word lists."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabmill.config import Config
from vocabmill.operators.casing import case_classes, with_fold_key
from vocabmill.operators.filters import (
    accept,
    filter_capitalized_by_language,
    filter_languages,
    filter_non_words,
    filter_year,
    language_flags,
)
from vocabmill.operators.merge import merge_files
from vocabmill.operators.quality import require_books, require_entries, require_words
from vocabmill.operators.rollup import support, yearly_rollup
from vocabmill.operators.topk import pick_top
from vocabmill.sources.catalog import LANGUAGES, file_paths, languages
from vocabmill.sources.columnar import bucket_count, read_columnar
from vocabmill.sources.entries import read_entries


def word_list(
    entries: DataFrame,
    config: Config,
    scope: str = "dataset",
    with_stats: bool = False,
    checked: bool = False,
    distributed: bool = False,
) -> DataFrame:
    """The word list of one language.

    With ``scope='file'`` the cutoffs apply to each ``file`` on its own. Every
    entry is checked before the filters, unless it is ``checked`` already, as
    those of text files and columnar copies are. ``distributed`` ranks a long
    list by many tasks, see ``pick_top``.
    """
    entries = _sound(entries, config.strip_capitalized, checked)
    return pick_top(
        merge_files(entries, config, scope),
        config.max_outputs,
        config.sort_by_popularity,
        with_stats=with_stats,
        distributed=distributed,
    )


def _sound(entries: DataFrame, strip: Column | bool, checked: bool) -> DataFrame:
    if not checked:
        return require_entries(entries, strip)
    return require_words(entries) if strip is True else entries


def word_lists(
    entries: DataFrame,
    catalog: DataFrame,
    config: Config,
    with_stats: bool = False,
    checked: bool = False,
    partitioned: bool = False,
    distributed: bool = False,
) -> DataFrame:
    """The word lists of all languages of the catalog, in one run.

    ``entries.lang`` holds the short name; languages outside the catalog are
    left out. Each language gets its own limit, and its own choice whether
    capitalised words are stripped. ``partitioned`` says that the entries are a
    table partitioned by ``lang``.
    """
    odd = [name for name, strip in language_flags(catalog).items() if strip]
    strip = F.col("lang").isin(odd) if config.strip_capitalized and odd else False
    entries = _sound(entries, strip, checked)
    accepted = filter_non_words(filter_year(entries, config.min_year))
    if config.strip_capitalized:
        accepted = filter_capitalized_by_language(accepted, catalog, partitioned)
    else:
        accepted = filter_languages(accepted, catalog)
    return _lists_of_accepted(accepted, config, with_stats, distributed)


def _lists_of_accepted(
    accepted: DataFrame, config: Config, with_stats: bool, distributed: bool = False
) -> DataFrame:
    casings = yearly_rollup(require_books(accepted), ["lang"], config.min_year)
    kept = with_fold_key(support(casings, config.min_matches, config.min_books))
    return pick_top(
        case_classes(kept, ["lang"]),
        config.max_outputs,
        config.sort_by_popularity,
        keys=["lang"],
        with_stats=with_stats,
        distributed=distributed,
    )


def read_language(
    spark: SparkSession,
    base: str,
    short_name: str,
    allow_empty: bool = True,
    columnar: bool = False,
) -> DataFrame:
    """Entries of one language below ``base``: of its data files, with their ``file``, or of a columnar copy."""
    paths = file_paths(short_name, base)
    if columnar:
        return read_columnar(spark, base, [short_name])
    return read_entries(spark, paths, with_file=True, allow_empty=allow_empty)


def language_word_list(
    spark: SparkSession,
    base: str,
    short_name: str,
    config: Config | None = None,
    scope: str = "dataset",
    with_stats: bool = False,
    columnar: bool = False,
    distributed: bool = False,
) -> DataFrame:
    """The word list of one language from the data files, or the columnar copy, at ``base``."""
    config = _own_config(short_name, config or Config())
    entries = read_language(spark, base, short_name, not config.strip_capitalized, columnar)
    return word_list(entries, config, scope, with_stats, True, distributed)


def _own_config(short_name: str, config: Config) -> Config:
    strips = {short: strip for _, short, strip in LANGUAGES}
    if short_name not in strips:
        raise ValueError(f"unknown language {short_name!r}")
    return replace(config, strip_capitalized=config.strip_capitalized and strips[short_name])


def all_word_lists(
    spark: SparkSession,
    base: str,
    config: Config | None = None,
    with_stats: bool = False,
    columnar: bool = False,
    distributed: bool = False,
) -> DataFrame:
    """The word lists of every language from the data files, or the columnar copy, at ``base``.

    There is one scan of text per language of the catalog, eight in all, so that
    the language is a constant in each and its filters are fixed beforehand. Gzip
    does not split, so a language is 27 tasks; the columnar copy is scanned by as
    many tasks as its size asks for.
    """
    config = config or Config()
    if columnar:
        entries = read_columnar(spark, base)
        # Two scans would not be known to hold all entries of a word in one bucket.
        in_buckets = bucket_count(spark, base) is not None
        return word_lists(entries, languages(spark), config, with_stats, True, not in_buckets, distributed)
    scans = []
    for _, short_name, _ in LANGUAGES:
        own = _own_config(short_name, config)
        entries = read_language(spark, base, short_name, not own.strip_capitalized)
        scans.append(accept(entries, own).withColumn("lang", F.lit(short_name)))
    return _lists_of_accepted(reduce(DataFrame.unionByName, scans), config, with_stats, distributed)
