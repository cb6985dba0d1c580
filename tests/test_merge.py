import itertools

import pytest
from helpers import KEEP, entries

from vocabmill import Config, merge_files


def merged(spark, rows, config=KEEP, scope="file"):
    return merge_files(entries(spark, rows, "file"), config, scope).collect()


def test_different_tops(spark):
    (row,) = merged(spark, [("ab", 2000, 10, 1, "f1"), ("aB", 2000, 12, 1, "f2")])
    assert (row.top_casing, row.match_count) == ("aB", 22)


def test_same_casing(spark):
    rows = [("ab", 2000, 5, 2, "f1"), ("ab", 2001, 5, 3, "f2")]
    (row,) = merged(spark, rows)
    assert (row.match_count, row.min_volume_count, row.first_year) == (10, 3, 2000)
    (row,) = merged(spark, rows, scope="dataset")
    assert (row.match_count, row.min_volume_count) == (10, 5)


def test_cutoffs_apply_per_file(spark):
    rows = [("ab", 2000, 5, 1, "f1"), ("ab", 2001, 5, 1, "f2")]
    config = Config(min_matches=6, min_books=1)
    assert merged(spark, rows, config) == []
    assert len(merged(spark, rows, config, "dataset")) == 1


def test_only_casings_that_lead_a_file_compete(spark):
    rows = [
        ("ab", 2000, 10, 1, "f1"),
        ("aB", 2000, 9, 1, "f1"),
        ("Ab", 2000, 7, 1, "f2"),
        ("aB", 2000, 6, 1, "f2"),
    ]
    (row,) = merged(spark, rows)
    assert (row.top_casing, row.match_count) == ("ab", 32)
    (row,) = merged(spark, rows, scope="dataset")
    assert (row.top_casing, row.match_count) == ("aB", 32)


def test_order_of_files_does_not_matter(spark):
    tops = [("ab", 10), ("aB", 12), ("ab", 5)]
    for order in itertools.permutations(tops):
        rows = [(w, 2000, n, 1, f"f{i}") for i, (w, n) in enumerate(order)]
        (row,) = merged(spark, rows)
        assert (row.top_casing, row.top_stats.match_count, row.match_count) == ("ab", 15, 27)


def test_unknown_scope(spark):
    with pytest.raises(ValueError, match="scope"):
        merge_files(entries(spark, [], "file"), KEEP, "other")
