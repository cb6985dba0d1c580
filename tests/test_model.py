"""The engine against a plain model, and properties that hold for any input."""

import random

import pytest
from helpers import (
    entries,
    model_casings,
    model_classes,
    model_file_merge,
    model_words,
    random_entries,
)

from vocabmill import Config, merge_files, word_list

SEEDS = range(6)


def one_entry_per_year(rows):
    return list({(row[0], row[1]): row for row in rows}.values())


def words(df):
    return [(r.ngram, r.first_year, r.last_year, r.match_count, r.min_volume_count) for r in df.collect()]


@pytest.mark.parametrize("seed", SEEDS)
def test_word_list(spark, seed):
    rows = one_entry_per_year(random_entries(seed))
    df = entries(spark, rows, "file")
    for strip, matches, books, limit in ((True, 1, 1, None), (False, 4, 2, None), (False, 1, 1, 5)):
        config = Config(strip, 1962, matches, books, limit, True)
        expected = model_words(model_classes(model_casings(rows, config)), limit)
        assert words(word_list(df, config, with_stats=True)) == expected


@pytest.mark.parametrize("seed", SEEDS)
def test_merge_files(spark, seed):
    rows = random_entries(seed, files=3)
    config = Config(False, 1962, 3, 2)
    found = merge_files(entries(spark, rows, "file"), config, scope="file").collect()
    assert {
        r.fold_key: (r.top_casing, (r.first_year, r.last_year, r.match_count, r.min_volume_count))
        for r in found
    } == model_file_merge(rows, config)


@pytest.mark.parametrize("seed", SEEDS)
def test_order_and_split_of_the_input_do_not_matter(spark, seed):
    rows = one_entry_per_year(random_entries(seed))
    config = Config(False, 1962, 2, 1, sort_by_popularity=True)
    first = words(word_list(entries(spark, rows, "file"), config, with_stats=True))
    random.Random(seed).shuffle(rows)
    other = [(*row[:4], f"f{i % 3}") for i, row in enumerate(rows)]
    df = entries(spark, other, "file").repartition(5)
    assert words(word_list(df, config, with_stats=True)) == first


@pytest.mark.parametrize("seed", SEEDS)
def test_scopes_agree_if_each_casing_has_one_file(spark, seed):
    rows = one_entry_per_year(random_entries(seed))
    rows = [(*row[:4], f"f{len(row[0]) % 2}{row[0][0]}") for row in rows]
    df = entries(spark, rows, "file")
    config = Config(False, 1962, 2, 1)
    totals = ["fold_key", "first_year", "last_year", "match_count", "min_volume_count", "n_casings"]
    by_file = merge_files(df, config, "file").select(*totals).collect()
    assert sorted(by_file) == sorted(merge_files(df, config).select(*totals).collect())
