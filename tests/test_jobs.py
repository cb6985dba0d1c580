"""Whole jobs over data files laid out and named like the data set."""

import pytest
from helpers import model_casings, model_classes, model_file_merge, model_words, random_entries
from test_sources import gz

from vocabmill import Config, all_word_lists, dataset_paths, language_word_list, languages, read_columnar, write_columnar

CONFIG = Config(min_matches=2, min_books=1, sort_by_popularity=True)


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """{language: entries}, written to 27 files per language."""
    base = tmp_path_factory.mktemp("ngrams")
    rows = {}
    paths = {}
    for row in dataset_paths(languages(spark), str(base)).collect():
        paths.setdefault(row.short_name, []).append((row.prefix, row.path))
    for seed, (lang, files) in enumerate(paths.items()):
        rows[lang] = []
        entries = {(e[0], e[1]): e for e in random_entries(seed)}.values()
        for prefix, path in files:
            first = [
                (*e[:4], prefix)
                for e in entries
                if (e[0][0].lower() if e[0][0].lower() in "abcdefghijklmnopqrstuvwxyz" else "other")
                == prefix
            ]
            rows[lang] += first
            gz(path, *("\t".join(str(v) for v in e[:4]) for e in sorted(first)))
    return str(base), rows


def expected(rows, strip):
    config = Config(strip, min_matches=CONFIG.min_matches, min_books=CONFIG.min_books)
    return [word[0] for word in model_words(model_classes(model_casings(rows, config)))]


def test_one_language(spark, data):
    base, rows = data
    for lang, strip in (("fre", True), ("ger", False)):
        words = [r.ngram for r in language_word_list(spark, base, lang, CONFIG).collect()]
        assert words == expected(rows[lang], strip)
    words = language_word_list(spark, base, "fre", CONFIG, scope="file")
    config = Config(min_matches=2, min_books=1)
    by_file = model_file_merge(rows["fre"], config)
    assert {r.ngram for r in words.collect()} == {top for top, _ in by_file.values()}


def test_unknown_language(spark, data):
    with pytest.raises(ValueError, match="xyz"):
        language_word_list(spark, data[0], "xyz")


def test_missing_data_file(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        language_word_list(spark, str(tmp_path), "eng")


def test_all_languages(spark, data):
    base, rows = data
    found = {}
    for row in all_word_lists(spark, base, CONFIG).collect():
        found.setdefault(row.lang, []).append(row.ngram)
    assert found == {lang: expected(rows[lang], lang != "ger") for lang in rows}


def test_long_lists_from_files(spark, data):
    """Ranked by ranges, sampled or not, the lists are the same."""
    base, rows = data
    limited = Config(min_matches=2, min_books=1, max_outputs=5, sort_by_popularity=True)
    for distributed in (False, True):
        words = language_word_list(spark, base, "fre", limited, distributed=distributed).collect()
        assert [r.ngram for r in words] == expected(rows["fre"], True)[:5]
        assert [r.rank for r in words] == list(range(1, len(words) + 1))
        found = {}
        for row in all_word_lists(spark, base, limited, distributed=distributed).collect():
            found.setdefault(row.lang, []).append(row.ngram)
        assert found == {lang: expected(rows[lang], lang != "ger")[:5] for lang in rows}


def test_copies_give_the_lists_of_the_files(spark, data, tmp_path):
    """By prefix and in buckets, read by a session that didn't write them."""
    base, rows = data
    entries = [(*e[:4], lang) for lang, own in rows.items() for e in own]
    df = spark.createDataFrame(entries, "ngram string, year long, match_count long, volume_count long, lang string")
    for name, buckets in (("prefix", None), ("it's buckets", 3)):
        path = str(tmp_path / name)
        write_columnar(df, path, buckets=buckets)
        session = spark.newSession()
        assert sorted(map(tuple, read_columnar(session, path).select(*df.columns).collect())) == sorted(entries)
        assert {r.lang for r in read_columnar(session, path, ["fre"], ["a"]).collect()} <= {"fre"}
        words = language_word_list(session, path, "fre", CONFIG, columnar=True)
        assert [r.ngram for r in words.collect()] == expected(rows["fre"], True)
        found = {}
        for row in all_word_lists(session, path, CONFIG, columnar=True).collect():
            found.setdefault(row.lang, []).append(row.ngram)
        assert found == {lang: expected(rows[lang], lang != "ger") for lang in rows}
    table = [t.name for t in spark.catalog.listTables() if t.name.startswith("vocabmill_")][-1]
    spark.sql(f"DROP TABLE {table}")  # as in a later application, which knows the folder alone
    words = language_word_list(spark, path, "fre", CONFIG, columnar=True)
    assert [r.ngram for r in words.collect()] == expected(rows["fre"], True)
