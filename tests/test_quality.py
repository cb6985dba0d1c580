import pytest
from helpers import KEEP, STRIP, column, entries

from vocabmill import (
    DataQualityError,
    accept,
    check_books,
    check_class,
    check_decode,
    check_empty,
    check_years,
    merge_files,
    repeated_years,
    word_list,
)


def test_more_books_than_matches(spark):
    df = entries(spark, [("a", 2000, 1, 2), ("a", 1900, 1, 2), ("b", 2000, 2, 2)])
    assert column(check_books(accept(df, STRIP)), "year") == [2000]
    with pytest.raises(DataQualityError, match="more books"):
        check_books(df, strict=True)


def test_word_list_stops_at_more_books_than_matches(spark):
    with pytest.raises(Exception, match="more books than matches: a 2000"):
        word_list(entries(spark, [("a", 2000, 1, 2)]), STRIP).collect()
    assert word_list(entries(spark, [("a", 1900, 1, 2)]), STRIP).collect() == []


def test_one_entry_per_year(spark):
    df = entries(spark, [("a", 2000, 5, 1), ("a", 2000, 5, 1), ("a", 2001, 5, 1)])
    assert [tuple(r) for r in check_years(df).collect()] == [("a", 2000, 2)]
    with pytest.raises(DataQualityError, match="one entry per year"):
        check_years(df, strict=True)
    assert check_years(df.dropDuplicates(), strict=True).count() == 0


def test_repeated_years_agree_with_the_list(spark):
    years = [-65, -64, -63, -1, 0, 1, 63, 64, 127, 128, 1899, 1919, 1920, 1983, 1984, 2012]
    rows = [("all", year, 1, 1) for year in years]
    rows += [(f"w{year}", y, 1, 1) for year in years for y in (year, *years)]
    df = entries(spark, rows)
    assert sorted(column(repeated_years(df))) == sorted(column(check_years(df)))
    for row in repeated_years(df).collect():
        assert row.from_year <= int(row.ngram[1:]) < row.from_year + 64
        assert row.n_entries == row.n_years + 1


def test_empty_word(spark):
    df = entries(spark, [("", 1900, 1, 1), (None, 2000, 1, 1), ("a", 2000, 1, 1)])
    assert check_empty(df, strip=True).count() == 2
    assert check_empty(df, strip=False).count() == 0
    with pytest.raises(DataQualityError, match="empty"):
        check_empty(df, strip=True, strict=True)
    check_empty(df, strip=False, strict=True)


def test_class_invariant(spark):
    df = merge_files(entries(spark, [("a", 2000, 5, 2), ("A", 2000, 4, 2)]), KEEP)
    assert check_class(df, strict=True).count() == 0
    short = df.selectExpr("* EXCEPT (match_count)", "match_count - 5 AS match_count")
    assert column(check_class(short), "top_casing") == ["a"]
    fewer = df.selectExpr("* EXCEPT (match_count)", "5L AS match_count")
    assert check_class(fewer).count() == 0
    late = fewer.selectExpr("* EXCEPT (first_year)", "2001L AS first_year")
    assert check_class(late).count() == 1


BAD_LINES = {
    "a\t2000\t5": "field_count",
    "a\t2000\t5\t1\t": "field_count",
    "a": "field_count",
    "a\tx\t5\t1": "not_a_number",
    "a\t2000\t5.0\t1": "not_a_number",
    "a\t2000\t 5\t1": "not_a_number",
    "a\t\t5\t1": "not_a_number",
    "a\t2000\t-5\t1": "not_a_number",
    "a\t99999999999999999999\t5\t1": "year",
    "a\t2000\t0\t1": "match_count",
    "a\t2000\t99999999999999999999\t1": "match_count",
    "a\t1900\t5\t0": "volume_count",
}


def test_decode_causes(spark):
    good = ["a\t2000\t5\t1", "\t-44\t+5\t1", "a b\\x\"\t2000\t5\t1", "null\t2000\t5\t1", ""]
    df = spark.createDataFrame([(line,) for line in [*BAD_LINES, *good]], "value string")
    assert {r.value: r.cause for r in check_decode(df).collect()} == BAD_LINES
    with pytest.raises(DataQualityError, match="three integers"):
        check_decode(df, strict=True)


def test_decode_rejects_invalid_encoding(spark):
    df = spark.sql("SELECT cast(X'61FF0932303030093509310A' AS string) AS value")
    assert column(check_decode(df), "cause") == ["encoding"]
    legal = spark.createDataFrame([("a\ufffd\t2000\t5\t1",)], "value string")
    assert check_decode(legal).count() == 0
