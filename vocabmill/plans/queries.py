"""The registered queries: one or more per operator, over the given tables.

All of them start from the yearly entries counted in ``documents``. The test
data is small, so the cutoffs are 20 matches and 3 books; whatever is about
merging spellings keeps capitalised words, as there is nothing to merge
otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabmill.config import Config
from vocabmill.functions.words import word_prefix
from vocabmill.operators import audit, casing, filters, merge, quality, rollup, topk
from vocabmill.plans.word_list import all_word_lists, language_word_list, word_list, word_lists
from vocabmill.session import age_files, list_names, make_folder, remove_path, rename_path, scratch_path
from vocabmill.sources import catalog, columnar, entries as text_entries, words
from vocabmill.sources.documents import entries_from_documents, read_documents
from vocabmill.streaming import incremental

STRIPPED = Config(min_matches=20, min_books=3)
MERGED = Config(strip_capitalized=False, min_matches=20, min_books=3)
EVERYTHING = Config(strip_capitalized=False, min_matches=1, min_books=1)
#: Languages of the documents, by their short name in the catalog.
LANGUAGE_CODES = {"en": "eng", "fr": "fre", "de": "ger", "es": "spa"}
PATH_BASE = "/data/ngrams"

TOP = 100
TOP_LARGE = 20_000
TOP_PER_LANGUAGE = 50
TOP_PER_LANGUAGE_LARGE = 3_000

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def query(function: Query) -> Query:
    _queries[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_queries)


def documents(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    docs = read_documents(spark, f"{sf_dir}/documents.parquet", partitions)
    codes = F.lit(None).cast("string")
    for code, short_name in LANGUAGE_CODES.items():
        codes = F.when(F.col("lang") == code, short_name).otherwise(codes)
    return docs.withColumn("lang", codes).withColumn("file", F.col("source"))


def entries(
    spark: SparkSession, sf_dir: str, *keys: str, partitions: int | None = None
) -> DataFrame:
    return entries_from_documents(documents(spark, sf_dir, partitions), keys)


def casings(spark: SparkSession, sf_dir: str, config: Config = MERGED) -> DataFrame:
    return merge.supported_casings(entries(spark, sf_dir), config)


def classes(spark: SparkSession, sf_dir: str, config: Config = MERGED) -> DataFrame:
    return merge.merge_files(entries(spark, sf_dir), config)


def flat(df: DataFrame) -> DataFrame:
    """Case classes without nested columns."""
    stats = ["first_year", "last_year", "match_count", "volume_count"]
    return df.select(
        *(name for name in df.columns if name != "top_stats"),
        *(F.col(f"top_stats.{name}").alias(f"top_{name}") for name in stats),
    )


# Sources


def _totals(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_entries"), F.sum("match_count").alias("match_count")
    )


@query
def s1_language_catalog(spark, sf_dir):
    totals = _totals(entries(spark, sf_dir, "lang"), "lang")
    return (
        catalog.languages(spark)
        .withColumnRenamed("short_name", "lang")
        .join(totals, "lang", "left")
        .select(
            "name",
            F.col("lang").alias("short_name"),
            F.array_join("word_prefixes", " ").alias("word_prefixes"),
            "should_strip_capitalized",
            F.coalesce("n_entries", F.lit(0)).alias("n_entries"),
            F.coalesce("match_count", F.lit(0)).alias("match_count"),
        )
    )


@query
def s3_dataset_paths(spark, sf_dir):
    df = entries(spark, sf_dir, "lang").withColumn("prefix", word_prefix(F.col("ngram")))
    totals = _totals(df, "lang", "prefix").withColumnRenamed("lang", "short_name")
    paths = catalog.dataset_paths(catalog.languages(spark), PATH_BASE)
    return paths.join(totals, ["short_name", "prefix"], "left").select(
        "short_name",
        "prefix",
        "path",
        F.coalesce("n_entries", F.lit(0)).alias("n_entries"),
        F.coalesce("match_count", F.lit(0)).alias("match_count"),
    )


def _write_text(spark, df, *partition_by) -> str:
    path = scratch_path(spark, "text")
    text_entries.write_entries_text(df, path, partition_by)
    return path


@query
def s5_text_scan(spark, sf_dir):
    path = _write_text(spark, entries(spark, sf_dir))
    return text_entries.read_entries(spark, path)


@query
def s6_multi_file_scan(spark, sf_dir):
    df = entries(spark, sf_dir, "lang").withColumn("prefix", word_prefix(F.col("ngram")))
    path = _write_text(spark, df, "lang", "prefix")
    df = text_entries.read_entries(spark, path, with_file=True)
    # Language and prefix as the file says, not as the directory columns do.
    for name in ("lang", "prefix"):
        df = df.withColumn(name, F.regexp_extract("file", f"/{name}=([^/]+)/", 1))
    return df.drop("file")


@query
def s7_prefix_pruning(spark, sf_dir):
    df = entries(spark, sf_dir).withColumn("prefix", word_prefix(F.col("ngram")))
    path = _write_text(spark, df, "prefix")
    return text_entries.read_entries(spark, path, prefixes=["a", "q", "other"])


@query
def s7_columnar_pruning(spark, sf_dir):
    path = scratch_path(spark, "columnar")
    columnar.write_columnar(entries(spark, sf_dir, "lang"), path)
    return columnar.read_columnar(spark, path, langs=["eng", "ger"], prefixes=["a", "q", "other"])


# Row filters


@query
def f1_recency(spark, sf_dir):
    return filters.filter_year(entries(spark, sf_dir), 1962)


@query
def f2_capitalised(spark, sf_dir):
    return filters.filter_capitalized(entries(spark, sf_dir))


@query
def f3_not_a_word(spark, sf_dir):
    return filters.filter_non_words(entries(spark, sf_dir))


@query
def f4_accept(spark, sf_dir):
    return filters.accept(entries(spark, sf_dir), STRIPPED)


@query
def f5_reject_cause(spark, sf_dir):
    return filters.reject_cause(entries(spark, sf_dir), STRIPPED)


@query
def f6_rejection_audit(spark, sf_dir):
    return filters.rejection_audit(entries(spark, sf_dir), STRIPPED)


@query
def f7_threshold_audit(spark, sf_dir):
    return filters.support_audit(entries(spark, sf_dir), STRIPPED)


@query
def p1_strip_by_language(spark, sf_dir):
    return filters.filter_capitalized_by_language(
        entries(spark, sf_dir, "lang"), catalog.languages(spark)
    )


@query
def p3_kept_with_stats(spark, sf_dir):
    return topk.pick_top(classes(spark, sf_dir), with_stats=True)


# Data-quality checks


def _lines(df: DataFrame) -> DataFrame:
    fields = ["ngram", "year", "match_count", "volume_count"]
    return df.select(F.concat_ws("\t", *(F.col(name).cast("string") for name in fields)).alias("value"))


@query
def v1_decode(spark, sf_dir):
    """Clean lines."""
    return quality.check_decode(_lines(entries(spark, sf_dir)))


@query
def v1_decode_zero_books(spark, sf_dir):
    """Lines with one book less: zero is not a legal count."""
    df = entries(spark, sf_dir)
    return quality.check_decode(_lines(df.withColumn("volume_count", F.col("volume_count") - 1)))


#: What is wrong with a line, by the remainder that decides it.
BREAKS = ["", "encoding", "field_count", "not_a_number", "year", "match_count", "volume_count"]


@query
def v1_decode_broken(spark, sf_dir):
    """Lines broken in each of the six ways, by a function of the row."""
    df = entries(spark, sf_dir)
    ngram, year, matches, books = (F.col(name).cast("string") for name in df.columns)
    kind = (F.col("year") + F.col("match_count")) % len(BREAKS)
    line = F.concat_ws(
        "\t",
        F.when(kind == 1, F.concat(ngram, F.unhex(F.lit("FF")).cast("string"))).otherwise(ngram),
        F.when(kind == 3, F.concat(F.lit("x"), year)).when(kind == 4, "9" * 20).otherwise(year),
        F.when(kind == 5, "0").otherwise(matches),
        F.when(kind == 6, "0").when(kind != 2, books),
    )
    found = quality.check_decode(df.withColumn("value", line).select("value", "ngram", F.col("year").alias("in_year"), "match_count"))
    return found.select("ngram", "in_year", "match_count", "cause")


@query
def v2_books_le_matches(spark, sf_dir):
    return quality.check_books(filters.accept(entries(spark, sf_dir), STRIPPED))


@query
def v2_books_le_matches_swapped(spark, sf_dir):
    """Entries with the two counts in the wrong order."""
    df = filters.accept(entries(spark, sf_dir), STRIPPED)
    return quality.check_books(
        df.select(
            "ngram",
            "year",
            F.col("volume_count").alias("match_count"),
            F.col("match_count").alias("volume_count"),
        )
    )


@query
def v3_one_entry_per_year(spark, sf_dir):
    return quality.check_years(filters.accept(entries(spark, sf_dir, "lang"), STRIPPED), ["lang"])


@query
def v3_one_entry_per_year_mixed(spark, sf_dir):
    """Languages taken for one corpus: shared words have several entries per year."""
    return quality.check_years(filters.accept(entries(spark, sf_dir, "lang"), STRIPPED))


@query
def v3_repeated_years_mixed(spark, sf_dir):
    """The same, by word and 64 years."""
    return quality.repeated_years(filters.accept(entries(spark, sf_dir, "lang"), STRIPPED))


def _files_by_source(spark, df) -> DataFrame:
    """The entries written as data files, a folder for each source, and read again with their ``file``."""
    path = _write_text(spark, df, "source")
    return text_entries.read_entries(spark, path, with_file=True).drop("source")


@query
def v3_repeated_years_in_files(spark, sf_dir):
    """Data files of any years in which some lines stand twice. A year that two files have is no repeat."""
    df = entries(spark, sf_dir, "source")
    twice = F.when((F.col("year") + F.col("match_count")) % 7 == 0, 2).otherwise(1)
    df = df.select("*", F.explode(F.array_repeat("source", twice)).alias("_")).drop("_")
    df = _files_by_source(spark, df.withColumn("year", F.col("year") + 100 * (F.col("match_count") % 3)))
    # A folder may hold several files; the folder tells which lines belong together.
    df = df.withColumn("file", F.regexp_extract("file", "/source=([^/]+)/", 1))
    return quality.repeated_years(filters.accept(df, STRIPPED), ["file"])


@query
def v4_empty_ngram(spark, sf_dir):
    df = entries_from_documents(documents(spark, sf_dir), keep_empty=True)
    return quality.check_empty(df, strip=True)


@query
def v4_empty_ngram_lower_case(spark, sf_dir):
    """Words cut down to their letters a-z: numbers and capitals leave nothing."""
    letters = F.regexp_replace("ngram", "[^a-z]", "")
    df = entries(spark, sf_dir).withColumn("ngram", letters)
    return quality.check_empty(df, strip=True)


@query
def v7_class_invariant(spark, sf_dir):
    return flat(quality.check_class(classes(spark, sf_dir)))


@query
def v7_class_invariant_short_total(spark, sf_dir):
    """Totals one match short: wrong for every class of a single spelling."""
    df = classes(spark, sf_dir).withColumn("match_count", F.col("match_count") - 1)
    return flat(quality.check_class(df))


# Aggregations


@query
def a1_yearly_rollup(spark, sf_dir):
    return rollup.yearly_rollup(entries(spark, sf_dir))


@query
def a2_support(spark, sf_dir):
    return rollup.support(rollup.yearly_rollup(entries(spark, sf_dir)), 20, 3)


@query
def a3_fold_key(spark, sf_dir):
    return casing.with_fold_key(rollup.yearly_rollup(entries(spark, sf_dir)))


@query
def a4_class_totals(spark, sf_dir):
    return casing.class_totals(casings(spark, sf_dir))


@query
def a5_top_casing(spark, sf_dir):
    df = casing.top_casing(casings(spark, sf_dir))
    return flat(df)


@query
def a6_casing_count(spark, sf_dir):
    return casing.casing_count(casings(spark, sf_dir))


@query
def a7_merge_dataset(spark, sf_dir):
    return flat(classes(spark, sf_dir))


@query
def a7_merge_files(spark, sf_dir):
    config = Config(strip_capitalized=False, min_matches=5, min_books=2)
    return flat(merge.merge_files(entries(spark, sf_dir, "file"), config, scope="file"))


# Final lists


@query
def t1_all_unordered(spark, sf_dir):
    return topk.pick_top(classes(spark, sf_dir))


@query
def t2_top_unordered(spark, sf_dir):
    return topk.pick_top(classes(spark, sf_dir), TOP)


@query
def t2_top_unordered_large(spark, sf_dir):
    df = classes(spark, sf_dir, EVERYTHING)
    return topk.pick_top(df, TOP_LARGE, with_stats=True, distributed=True)


@query
def t3_top_ordered(spark, sf_dir):
    return topk.pick_top(classes(spark, sf_dir), TOP, sort_by_popularity=True)


@query
def t3_top_ordered_large(spark, sf_dir):
    df = classes(spark, sf_dir, EVERYTHING)
    return topk.pick_top(df, TOP_LARGE, sort_by_popularity=True, distributed=True)


@query
def t3_top_ordered_by_ranges(spark, sf_dir):
    """A limit too long for one task, without a table that is written first."""
    df = classes(spark, sf_dir, EVERYTHING)
    return topk.pick_top(df, TOP_LARGE, sort_by_popularity=True, with_stats=True)


@query
def t4_all_ordered(spark, sf_dir):
    df = classes(spark, sf_dir)
    return topk.pick_top(df, sort_by_popularity=True, with_stats=True, distributed=True)


# Whole jobs


def _job(**options) -> Config:
    return Config(min_matches=20, min_books=3, sort_by_popularity=True, **options)


@query
def j1_word_list(spark, sf_dir):
    return word_list(entries(spark, sf_dir), _job(max_outputs=TOP), with_stats=True)


@query
def j1_word_list_merged(spark, sf_dir):
    config = _job(max_outputs=TOP, strip_capitalized=False)
    return word_list(entries(spark, sf_dir), config, with_stats=True)


@query
def j2_word_lists(spark, sf_dir):
    df = entries(spark, sf_dir, "lang")
    return word_lists(
        df, catalog.languages(spark), _job(max_outputs=TOP_PER_LANGUAGE), with_stats=True
    )


@query
def j2_word_lists_all(spark, sf_dir):
    df = entries(spark, sf_dir, "lang")
    return word_lists(df, catalog.languages(spark), _job(), with_stats=True)


@query
def j2_word_lists_large(spark, sf_dir):
    config = Config(
        min_matches=1, min_books=1, max_outputs=TOP_PER_LANGUAGE_LARGE, sort_by_popularity=True
    )
    df = entries(spark, sf_dir, "lang")
    return word_lists(df, catalog.languages(spark), config, distributed=True)


def _catalog_files(spark, sf_dir) -> str:
    """The entries in data files named like those of the catalog, each one a folder of a part or more."""
    df = entries(spark, sf_dir, "lang").withColumn("prefix", word_prefix(F.col("ngram")))
    base = scratch_path(spark, "ngrams")
    name = F.format_string(catalog.FILE_NAME_FORMAT, "lang", "prefix")
    text_entries.write_entries_text(df.withColumn("name", name), base, ["name"])
    written = set(list_names(spark, base))
    for _, short_name, _ in catalog.LANGUAGES:
        for path in catalog.file_paths(short_name, base):
            folder = f"name={path.rsplit('/', 1)[1]}"
            if folder in written:
                rename_path(spark, f"{base}/{folder}", path)
            else:
                make_folder(spark, path)
    return base


@query
def j1_language_word_list(spark, sf_dir):
    """From the data files: a language whose capitalised words go, and German."""
    base = _catalog_files(spark, sf_dir)
    lists = [
        language_word_list(spark, base, name, _job(max_outputs=TOP), with_stats=True).withColumn("lang", F.lit(name))
        for name in ("fre", "ger")
    ]
    return lists[0].unionByName(lists[1])


@query
def j1_file_scope(spark, sf_dir):
    """From the data files, with cutoffs for each file on its own."""
    base = _catalog_files(spark, sf_dir)
    config = Config(min_matches=5, min_books=2)
    return language_word_list(spark, base, "eng", config, scope="file", with_stats=True)


def _broken_lines(df: DataFrame) -> DataFrame:
    """The lines of the entries, some broken in one of six ways, some with the counts swapped, empty or there twice."""
    ngram, year, matches, books = (F.col(name).cast("string") for name in ("ngram", "year", "match_count", "volume_count"))
    kind = (F.col("year") + F.col("match_count")) % 11
    line = F.concat_ws(
        "\t",
        F.when(kind == 1, F.concat(ngram, F.unhex(F.lit("FF")).cast("string"))).when(kind == 8, "").otherwise(ngram),
        F.when(kind == 3, F.concat(F.lit("x"), year)).when(kind == 4, "9" * 20).otherwise(year),
        F.when(kind == 5, "0").when(kind == 7, books).otherwise(matches),
        F.when(kind == 6, "0").when(kind == 7, matches).when(kind != 2, books),
    )
    return df.select("*", F.explode(F.array_repeat(line, F.when(kind == 9, 2).otherwise(1))).alias("value"))


@query
def v_audited_word_list(spark, sf_dir):
    """What the rules find in broken lines, counted while the word list is made from them in one scan."""
    found = audit.Audit()
    lines = _broken_lines(entries(spark, sf_dir)).select("value")
    audit.audited_word_list(lines, _job(max_outputs=TOP), found).write.format("noop").mode("overwrite").save()
    return found.table(spark)


@query
def j1_audited_word_list(spark, sf_dir):
    """The word list from the same lines."""
    lines = _broken_lines(entries(spark, sf_dir)).select("value")
    return audit.audited_word_list(lines, _job(max_outputs=TOP), audit.Audit(), with_stats=True)


@query
def j1_overlapping_files(spark, sf_dir):
    """From data files that share words and years, under the rule of one entry for a year and file."""
    df = _files_by_source(spark, entries(spark, sf_dir, "source"))
    return word_list(df, _job(max_outputs=TOP), with_stats=True, checked=True)


@query
def j2_all_word_lists(spark, sf_dir):
    """All languages of the catalog from the data files."""
    base = _catalog_files(spark, sf_dir)
    return all_word_lists(spark, base, _job(max_outputs=TOP_PER_LANGUAGE), with_stats=True)


@query
def j2_columnar_word_lists(spark, sf_dir):
    """The same from the columnar copy."""
    path = scratch_path(spark, "columnar")
    columnar.write_columnar(entries(spark, sf_dir, "lang"), path)
    config = _job(max_outputs=TOP_PER_LANGUAGE)
    return all_word_lists(spark, path, config, with_stats=True, columnar=True)


@query
def s7_bucketed_copy(spark, sf_dir):
    path = scratch_path(spark, "buckets")
    columnar.write_columnar(entries(spark, sf_dir, "lang"), path, buckets=8)
    return columnar.read_columnar(spark, path, langs=["eng", "ger"], prefixes=["a", "q", "other"])


@query
def j2_bucketed_word_lists(spark, sf_dir):
    """The same from a copy in buckets of words, where nothing is shuffled by word."""
    path = scratch_path(spark, "buckets")
    columnar.write_columnar(entries(spark, sf_dir, "lang"), path, buckets=8)
    config = _job(max_outputs=TOP_PER_LANGUAGE)
    return all_word_lists(spark, path, config, with_stats=True, columnar=True)


@query
def s8_long_list(spark, sf_dir):
    """All words of all languages as one ordered list, read back with their places."""
    path = scratch_path(spark, "words")
    words.write_words(topk.pick_top(classes(spark, sf_dir, EVERYTHING), sort_by_popularity=True), path)
    return words.read_words(spark, path)


@query
def s8_word_sink(spark, sf_dir):
    """Lists by language, written as words and read back with their place in the list."""
    path = scratch_path(spark, "words")
    df = entries(spark, sf_dir, "lang")
    config = _job(max_outputs=TOP_PER_LANGUAGE)
    words.write_words(word_lists(df, catalog.languages(spark), config), path)
    return words.read_words(spark, path)


@query
def j3_incremental(spark, sf_dir):
    """Files per source and decade arrive in several batches, some later and with old dates."""
    docs = documents(spark, sf_dir)
    decade = F.floor((F.lit(1950) + F.col("doc_id") % 60) / 10) * 10
    df = entries_from_documents(docs.withColumn("decade", decade), ["source", "decade"])
    inbox, state = scratch_path(spark, "inbox"), scratch_path(spark, "state")
    config = Config(strip_capitalized=False, min_matches=5, min_books=2)
    late = F.col("decade") >= 1990
    text_entries.write_entries_text(df.where(~late), inbox, ["source", "decade"])
    incremental.run_incremental(spark, inbox, state, config, max_files_per_batch=50, compact_after=1)
    later = scratch_path(spark, "later")
    text_entries.write_entries_text(df.where(late), later, ["source", "decade"])
    age_files(spark, later, days=30)
    for source in [n for n in list_names(spark, later) if "=" in n]:
        make_folder(spark, f"{inbox}/{source}")
        for folder in list_names(spark, f"{later}/{source}"):
            rename_path(spark, f"{later}/{source}/{folder}", f"{inbox}/{source}/{folder}")
    return flat(incremental.run_incremental(spark, inbox, state, config, compact_after=1))


@query
def j3_replaced_files(spark, sf_dir):
    """Files that were wrong are replaced under their names, and those of one decade are removed."""
    docs = documents(spark, sf_dir)
    decade = F.floor((F.lit(1950) + F.col("doc_id") % 60) / 10) * 10
    df = entries_from_documents(docs.withColumn("decade", decade), ["source", "decade"])
    inbox, state = scratch_path(spark, "inbox"), scratch_path(spark, "state")
    config = Config(strip_capitalized=False, min_matches=5, min_books=2)
    wrong = F.when(F.col("decade") == 1970, 3).otherwise(1)
    text_entries.write_entries_text(df.withColumn("match_count", F.col("match_count") * wrong), inbox, ["source", "decade"])
    incremental.run_incremental(spark, inbox, state, config, compact_after=0)
    right = scratch_path(spark, "right")
    text_entries.write_entries_text(df.where("decade = 1970"), right, ["source", "decade"])
    for source in [n for n in list_names(spark, inbox) if "=" in n]:
        remove_path(spark, f"{inbox}/{source}/decade=1980")
        replaced = f"{inbox}/{source}/decade=1970"
        old = [n for n in list_names(spark, replaced) if not n.startswith((".", "_"))]
        new = [n for n in list_names(spark, f"{right}/{source}/decade=1970") if not n.startswith((".", "_"))]
        for name in old:
            remove_path(spark, f"{replaced}/{name}")
        for k, name in enumerate(new):
            rename_path(spark, f"{right}/{source}/decade=1970/{name}", f"{replaced}/{old[k] if k < len(old) else name}")
    return flat(incremental.run_incremental(spark, inbox, state, config, compact_after=2))
