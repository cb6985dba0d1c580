"""Rules that stop a job, on every kind of input."""

from pathlib import Path

import pytest
from helpers import entries
from test_sources import gz

from vocabmill import Config, all_word_lists, language_word_list, languages, read_columnar, word_list, word_lists, write_columnar
from vocabmill.sources.catalog import LANGUAGES, file_paths

STRIP = Config(min_matches=0, min_books=0)
KEEP = Config(strip_capitalized=False, min_matches=0, min_books=0)
LARGE = 3 * 2**62 // 2


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize(
    "row", [("zero", 1900, 0, 0), ("zero", 2000, 0, 1), ("half", 1900, 1, 0), (None, 1900, 1, 1), ("none", None, 1, 1), ("none", 2000, None, 1)]
)
def test_unsound_entries_fail_though_filtered(spark, ansi, row):
    for config in (STRIP, KEEP):
        with pytest.raises(Exception, match="bad entry"):
            word_list(entries(spark, [("ok", 2000, 1, 1), row]), config).collect()
    with pytest.raises(Exception, match="bad entry"):
        word_lists(entries(spark, [("ok", 2000, 1, 1, "eng"), (*row, "fre")], "lang"), languages(spark), STRIP).collect()


def test_empty_words_matter_where_capitals_are_stripped(spark, tmp_path):
    with pytest.raises(Exception, match="bad entry"):
        word_list(entries(spark, [("", 1900, 1, 1)]), STRIP).collect()
    assert [r.ngram for r in word_list(entries(spark, [("", 2000, 1, 1)]), KEEP).collect()] == [""]
    found = word_lists(entries(spark, [("", 2000, 1, 1, "ger")], "lang"), languages(spark), STRIP)
    assert [r.ngram for r in found.collect()] == [""]
    with pytest.raises(Exception, match="bad entry"):
        word_lists(entries(spark, [("", 2000, 1, 1, "eng")], "lang"), languages(spark), STRIP).collect()
    write_columnar(entries(spark, [("", 2000, 1, 1, "eng")], "lang"), str(tmp_path / "copy"))
    with pytest.raises(Exception, match="bad entry"):
        word_list(read_columnar(spark, str(tmp_path / "copy")), STRIP, checked=True).collect()
    with pytest.raises(Exception, match="bad entry"):
        write_columnar(entries(spark, [("x", 2000, 0, 1, "eng")], "lang"), str(tmp_path / "bad"))


def test_overflow_fails(spark, ansi):
    rows = [("a", 2000 + i, LARGE, 1) for i in range(3)]
    with pytest.raises(Exception, match="exceeds 64 bits"):
        word_list(entries(spark, rows), KEEP).collect()
    rows = [(word, 2000, LARGE, 1) for word in ("ab", "aB", "AB")]
    ranked = Config(False, 1962, 0, 0, sort_by_popularity=True)
    with pytest.raises(Exception, match="exceeds 64 bits"):
        word_list(entries(spark, rows), ranked).collect()


@pytest.mark.parametrize("min_year", [1962, 1500, -100])
def test_one_entry_per_year(spark, min_year):
    config = Config(False, min_year, 0, 0)
    good = [("a", year, 1, 1) for year in (1962, 1963, 2012, 2025, 2026, 2090, 2154, 3000)] + [("b", 1962, 1, 1)]
    assert {r.ngram for r in word_list(entries(spark, good), config).collect()} == {"a", "b"}
    for year in (1962, 2012, 2025, 2026, 2100, 3000, 2**40):
        with pytest.raises(Exception, match="more than one entry"):
            word_list(entries(spark, [*good, ("c", year, 1, 1), ("c", year, 5, 1)]), config).collect()
    old = [("a", -200, 1, 1), ("a", -200, 1, 1), ("b", 2000, 1, 1)]
    assert [r.ngram for r in word_list(entries(spark, old), config).collect()] == ["b"]
    if min_year <= 1500:
        with pytest.raises(Exception, match="more than one entry"):
            word_list(entries(spark, [("c", 1500, 1, 1), ("c", 1500, 5, 1)]), config).collect()


@pytest.mark.parametrize("scope", ["dataset", "file"])
def test_one_entry_per_year_and_file(spark, scope):
    rows = [("a", 2000, 1, 1, "f"), ("a", 2000, 1, 1, "g"), ("a", 2100, 1, 1, "g")]
    found = word_list(entries(spark, rows, "file"), KEEP, scope=scope, with_stats=True).collect()
    assert [(r.ngram, r.last_year, r.match_count) for r in found] == [("a", 2100, 3)]
    for again in (("a", 2000, 2, 1, "g"), ("a", 2100, 2, 1, "g")):
        with pytest.raises(Exception, match="more than one entry"):
            word_list(entries(spark, [*rows, again], "file"), KEEP, scope=scope).collect()
    with pytest.raises(Exception, match="more than one entry"):
        word_lists(entries(spark, [("a", 2000, 1, 1, "eng"), ("a", 2000, 2, 1, "eng")], "lang"), languages(spark), KEEP).collect()


@pytest.fixture
def data_files(spark, tmp_path):
    """Files of all languages, with one word in each language."""
    for _, short_name, _ in LANGUAGES:
        for path in file_paths(short_name, str(tmp_path)):
            gz(Path(path), *(["apple\t2000\t7\t3"] if path.endswith("-a.gz") else []))
    return tmp_path


@pytest.mark.parametrize("year", [1500, 2000, 2026, 2100])
def test_repeated_years_stop_the_jobs_from_files(spark, data_files, year):
    base = str(data_files)
    config = Config(False, 1000, 1, 1)

    def jobs():
        return [
            language_word_list(spark, base, "fre", config, with_stats=True),
            language_word_list(spark, base, "fre", config, scope="file", with_stats=True),
            all_word_lists(spark, base, config, with_stats=True).where("lang = 'fre'").drop("lang"),
        ]

    in_b = [p for p in file_paths("fre", base) if p.endswith("-b.gz")][0]
    gz(Path(in_b), "apple\t2000\t7\t3")
    assert [r.match_count for job in jobs() for r in job.collect()] == [14, 14, 14]
    gz(Path(in_b), f"apple\t{year}\t7\t3", f"apple\t{year}\t7\t3")
    for job in jobs():
        with pytest.raises(Exception, match="more than one entry"):
            job.collect()
