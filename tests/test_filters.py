from helpers import KEEP, STRIP, column, entries

from vocabmill import (
    Config,
    accept,
    filter_capitalized,
    filter_capitalized_by_language,
    filter_languages,
    filter_non_words,
    filter_year,
    languages,
    reject_cause,
    rejection_audit,
    support_audit,
    yearly_rollup,
)


def words(spark, *names):
    return entries(spark, [(name, 2000, 5, 1) for name in names])


def test_year_edge(spark):
    df = entries(spark, [("a", 1961, 9, 1), ("a", 1962, 5, 1)])
    assert column(filter_year(df, 1962), "year") == [1962]
    row = yearly_rollup(accept(df, STRIP)).collect()[0]
    assert (row.match_count, row.first_year) == (5, 1962)


def test_capitalized_uses_the_first_character(spark):
    df = words(spark, "Paris", "iPhone", "Élan", "Ⅳ", "été", "[", "@", "Z", "z", "ǅ", "ß", "𝐀")
    # Titlecase ǅ is not upper case; bold 𝐀 is.
    assert column(filter_capitalized(df)) == ["iPhone", "été", "[", "@", "z", "ǅ", "ß"]


def test_not_a_word(spark):
    df = words(spark, "run_VERB", "e.g", "it's", "_", ".")
    assert column(filter_non_words(df)) == ["it's"]


def test_accept_without_stripping(spark):
    df = words(spark, "Paris", "x.y", "a")
    assert column(accept(df, KEEP)) == ["Paris", "a"]
    assert column(accept(df, STRIP)) == ["a"]


def test_reject_cause_precedence(spark):
    df = entries(
        spark, [("A_b", 1900, 1, 1), ("A_b", 2000, 1, 1), ("a_b", 2000, 1, 1), ("ab", 2000, 1, 1)]
    )
    rows = [(r.ngram, r.year, r.cause) for r in reject_cause(df, STRIP).collect()]
    assert rows == [
        ("A_b", 1900, "too_old"),
        ("A_b", 2000, "capitalized"),
        ("a_b", 2000, "not_a_word"),
    ]
    assert column(reject_cause(df, KEEP), "cause") == ["too_old", "not_a_word", "not_a_word"]


def test_rejection_audit_names_the_first_cause(spark):
    df = entries(spark, [("A_b", 2000, 1, 1), ("A_b", 1900, 1, 1), ("Ab", 2001, 1, 1)])
    rows = {r.ngram: (r.year, r.cause) for r in rejection_audit(df, STRIP).collect()}
    assert rows == {"A_b": (1900, "too_old"), "Ab": (2001, "capitalized")}


def test_support_audit(spark):
    df = entries(spark, [("a", 2000, 5, 2), ("b", 2000, 6, 1), ("c", 2000, 6, 2)])
    audit = support_audit(df, Config(min_matches=6, min_books=2))
    assert sorted(column(audit)) == ["a", "b"]


def test_strip_by_language(spark):
    rows = [("Haus", 2000, 5, 1, lang) for lang in ("eng", "ger", "xyz")]
    df = entries(spark, rows, "lang")
    assert column(filter_capitalized_by_language(df, languages(spark)), "lang") == ["ger"]
    assert column(filter_languages(df, languages(spark)), "lang") == ["eng", "ger"]
