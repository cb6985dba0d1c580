import sys

import pytest
from helpers import KEEP, STRIP, column, entries
from pyspark.sql import functions as F

from vocabmill import (
    Config,
    case_classes,
    casing_count,
    class_totals,
    merge_files,
    support,
    top_casing,
    with_fold_key,
    word_list,
    yearly_rollup,
)
from vocabmill.functions.words import fold


def classes(spark, rows, config=KEEP):
    return merge_files(entries(spark, rows), config).collect()


def test_cutoff_applies_to_one_casing(spark):
    rows = [("ab", 2000, 5, 1), ("aB", 2000, 5, 1)]
    assert classes(spark, rows, Config(min_matches=6, min_books=1)) == []


def test_zero_cutoffs_are_off(spark):
    config = Config(min_matches=0, min_books=0)
    assert len(classes(spark, [("ab", 2000, 1, 1)], config)) == 1


def test_books_add_up_over_years(spark):
    df = yearly_rollup(entries(spark, [("a", 2000, 5, 2), ("a", 2001, 5, 1)]))
    assert [r.volume_count for r in support(df, 1, 3).collect()] == [3]


def test_books_take_the_maximum_over_casings(spark):
    (row,) = classes(spark, [("ab", 2000, 5, 2), ("aB", 2000, 4, 3)])
    assert (row.top_casing, row.match_count, row.min_volume_count) == ("ab", 9, 3)
    assert row.n_casings == 2
    assert tuple(row.top_stats) == (2000, 2000, 5, 2)


def test_stripping_comes_before_merging(spark):
    (row,) = classes(spark, [("the", 2000, 5, 1), ("The", 1999, 7, 1)], STRIP)
    assert (row.top_casing, row.match_count, row.first_year) == ("the", 5, 2000)


@pytest.mark.parametrize(
    "rows",
    [
        [("best", 2000, 5, 3), ("BEST", 2000, 5, 2)],
        [("best", 2001, 5, 2), ("BEST", 2000, 5, 2)],
        [("best", 1999, 3, 1), ("best", 2001, 2, 1), ("BEST", 2000, 3, 1), ("BEST", 2001, 2, 1)],
    ],
    ids=["books", "last year", "first year"],
)
def test_top_casing_order(spark, rows):
    assert [r.top_casing for r in classes(spark, rows)] == ["best"]


def test_top_casing_tie_takes_the_smaller_bytes(spark):
    assert [r.top_casing for r in classes(spark, [("ab", 2000, 5, 2), ("aB", 2000, 5, 2)])] == [
        "aB"
    ]


def test_printed_word_is_the_best_casing_ranked_by_the_total(spark):
    rows = [("ab", 2000, 5, 1), ("aB", 2000, 4, 1), ("x", 2000, 8, 1)]
    words = word_list(
        entries(spark, rows), Config(False, 1962, 1, 1, sort_by_popularity=True)
    )
    assert column(words) == ["ab", "x"]


def test_folding(spark):
    def keys(*words):
        df = entries(spark, [(word, 2000, 5, 1) for word in words])
        return len(set(column(with_fold_key(df), "fold_key")))

    assert keys("Maße", "MASSE", "masse") == 1
    assert keys("ı", "i") == 2
    assert keys("ς", "σ", "Σ") == 1
    assert keys("ſ", "s", "µ", "μ") == 2


def test_fold_equals_unicode_case_folding(spark):
    """All assigned characters, alone and inside a word, against Python's tables."""
    import unicodedata

    skip = {"Cn", "Cs", "Co"}
    characters = [
        chr(c) for c in range(1, sys.maxunicode + 1) if unicodedata.category(chr(c)) not in skip
    ]
    words = [pattern % c for c in characters for pattern in ("%s", "a%sb", "Ab%s", "%sB")]
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(8)
    folded = df.select("word", fold(F.col("word")).alias("key")).toPandas()
    by_key, by_fold = {}, {}
    for word, key in zip(folded.word, folded.key, strict=True):
        by_key.setdefault(key, set()).add(word.casefold())
        by_fold.setdefault(word.casefold(), set()).add(key)
    assert not [s for s in by_key.values() if len(s) > 1], "wrongly merged"
    assert not [s for s in by_fold.values() if len(s) > 1], "wrongly split"


def test_fold_is_idempotent(spark):
    df = spark.createDataFrame([("Straße",), ("ǅ",), ("İı",), ("ŉ",)], "word string")
    once = fold(F.col("word"))
    assert df.where(fold(once) != once).count() == 0


def test_single_aggregations_agree_with_the_combined_one(spark):
    rows = [("ab", 2000, 5, 2), ("aB", 2001, 4, 3), ("AB", 2002, 4, 3), ("x", 2000, 1, 1)]
    casings = with_fold_key(yearly_rollup(entries(spark, rows)))
    combined = case_classes(casings)
    for part in (class_totals(casings), top_casing(casings), casing_count(casings)):
        expected = combined.select(*part.columns)
        assert sorted(part.collect()) == sorted(expected.collect())


def test_count_overflow_is_fatal(spark):
    big = 2**62
    df = entries(spark, [("a", 2000, big, 1), ("a", 2001, big, 1)])
    with pytest.raises(Exception, match="exceeds 64 bits"):
        yearly_rollup(df).collect()
