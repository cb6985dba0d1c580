import pytest
from helpers import KEEP, column, entries
from pyspark.sql import functions as F

from vocabmill import Config, language_config, languages, merge_files, pick_top, word_lists
from vocabmill.operators import topk

ROWS = [("b", 2000, 5, 1), ("a", 2000, 5, 1), ("c", 2000, 6, 1), ("d", 2000, 1, 1)]
BEST = ["c", "a", "b", "d"]


@pytest.fixture
def classes(spark):
    return merge_files(entries(spark, ROWS), KEEP)


def test_all_unordered(classes):
    assert sorted(column(pick_top(classes))) == sorted(BEST)


@pytest.mark.parametrize("limit", [1, 2, 3, 4, 99])
@pytest.mark.parametrize("distributed", [False, True])
def test_limits(classes, limit, distributed):
    assert sorted(column(pick_top(classes, limit, distributed=distributed))) == sorted(BEST[:limit])
    ordered = pick_top(classes, limit, sort_by_popularity=True, distributed=distributed)
    assert column(ordered) == BEST[:limit]
    assert column(ordered, "rank") == list(range(1, len(BEST[:limit]) + 1))


def test_all_ordered(classes):
    ranked = pick_top(classes, sort_by_popularity=True, distributed=True)
    assert [tuple(r) for r in ranked.collect()] == [(w, i) for i, w in enumerate(BEST, 1)]
    df = pick_top(classes, sort_by_popularity=True, with_stats=True)
    assert column(df) == BEST
    assert df.columns == ["ngram", "first_year", "last_year", "match_count", "min_volume_count"]


@pytest.mark.parametrize("limit", [0, -1])
def test_bad_limit(classes, limit):
    with pytest.raises(ValueError, match="max_outputs"):
        pick_top(classes, limit)


@pytest.mark.parametrize("distributed", [False, True])
@pytest.mark.parametrize("limit", [None, 2])
def test_one_list_per_language(spark, distributed, limit):
    rows = [(*row, lang) for row in ROWS for lang in ("eng", "fre")]
    rows += [("Z", 2000, 9, 1, "eng"), ("Z", 2000, 9, 1, "ger"), ("z", 2000, 1, 1, "xyz")]
    config = Config(True, 1962, 1, 1, limit, True)
    found = {}
    for row in word_lists(entries(spark, rows, "lang"), languages(spark), config, distributed=distributed).collect():
        found.setdefault(row.lang, []).append(row.ngram)
    assert found == {"eng": BEST[:limit], "fre": BEST[:limit], "ger": ["Z"]}


def test_lists_per_language_without_stripping(spark):
    rows = [("Z", 2000, 9, 1, "eng"), ("z", 2000, 1, 1, "xyz")]
    config = Config(False, 1962, 1, 1)
    df = word_lists(entries(spark, rows, "lang"), languages(spark), config)
    assert [tuple(r) for r in df.collect()] == [("eng", "Z")]


@pytest.mark.parametrize("ranges", [topk.RANGES, 7])
def test_distributed_ranking_over_many_ranges(spark, monkeypatch, ranges):
    monkeypatch.setattr(topk, "RANGES", ranges)
    classes = spark.range(5000).select(
        F.concat(F.lit("w"), F.lpad("id", 5, "0")).alias("top_casing"),
        F.lit(2000).cast("bigint").alias("first_year"),
        F.lit(2000).cast("bigint").alias("last_year"),
        (F.col("id") % 3).alias("match_count"),
        F.lit(1).cast("bigint").alias("min_volume_count"),
        (F.col("id") % 2).alias("lang"),
    )
    rows = topk.ranked(classes, ["lang"], 2000).collect()
    expected = {}
    for i in sorted(range(5000), key=lambda i: (-(i % 3), i)):
        ids = expected.setdefault(i % 2, [])
        if len(ids) < 2000:
            ids.append(f"w{i:05d}")
    for lang, words in expected.items():
        mine = sorted((r["rank"], r.top_casing) for r in rows if r.lang == lang)
        assert mine == list(enumerate(words, 1))


def test_candidates_leave_out_what_is_beyond_the_limit(spark):
    df = spark.range(1, 10_001).selectExpr("id AS match_count", "id % 2 AS lang")
    for keys, limit, most in ([], 100, 1100), (["lang"], 50, 1100):
        kept = topk.candidates(df, keys, limit)
        counts = [r["match_count"] for r in kept.collect()]
        assert set(range(9901, 10_001)) <= set(counts)
        assert len(counts) <= most
    assert topk.candidates(df, ["lang"], 99_999).count() == 10_000
    assert topk.candidates(df.limit(0), [], 5).count() == 0


def test_config_rules(spark):
    assert Config().min_year == 1962 and Config().min_matches == 6000 and Config().min_books == 10
    Config(min_year=2012)
    for bad in ({"min_year": 2013}, {"max_outputs": 0}, {"min_books": -1}):
        with pytest.raises(ValueError):
            Config(**bad)
    catalog = languages(spark)
    assert language_config(catalog, "eng").strip_capitalized
    assert not language_config(catalog, "ger").strip_capitalized
    assert not language_config(catalog, "eng", Config(False)).strip_capitalized
    with pytest.raises(ValueError, match="xyz"):
        language_config(catalog, "xyz")
