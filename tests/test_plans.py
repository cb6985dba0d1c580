"""The shape of the physical plans, which decides how the jobs scale."""

import inspect
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vocabmill import Config, all_word_lists, languages, pick_top, read_columnar, read_entries, word_list, word_lists
from vocabmill import read_words, write_columnar, write_entries_text, write_words, yearly_rollup
from vocabmill.functions.ranking import best_first
from vocabmill.operators import topk
from vocabmill.operators.merge import merge_files
from vocabmill.operators.topk import BUCKETS
from vocabmill.plans import queries as registered

CONFIG = Config(min_matches=20, min_books=3, max_outputs=100, sort_by_popularity=True)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def layouts(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("layouts")
    df = registered.entries(spark, "/root/testdata/sf0.001", "lang")
    write_columnar(df, f"{base}/columnar")
    write_columnar(df, f"{base}/buckets", buckets=4)
    write_entries_text(df, f"{base}/text", ["lang"])
    return base


def test_word_list_shuffles_three_times(spark, layouts):
    """By word and years, by word, and by case key."""
    df = read_columnar(spark, f"{layouts}/columnar", ["eng"])
    text = plan(word_list(df, CONFIG, checked=True))
    # The fourth one carries the best rows of each task, to find those of each bucket.
    assert text.count("Exchange") == 4
    assert plan(merge_files(df, CONFIG)).count("Exchange") == 3
    assert "TakeOrderedAndProject(limit=100" in text
    assert text.count("partial_try_sum") == 5, "all aggregations merge before their shuffle"
    assert "Python" not in text


def test_words_in_buckets_are_not_shuffled(spark, layouts):
    """Nothing moves below the aggregation by case key, with one language or all."""
    df = read_columnar(spark, f"{layouts}/buckets", ["eng"])
    for text in (plan(merge_files(df, CONFIG)), plan(all_word_lists(spark, f"{layouts}/buckets", Config(), columnar=True))):
        below = text[text.index("Exchange hashpartitioning(") :]
        assert "fold_key" in below.splitlines()[0]
        assert below.count("Exchange") == 1 and "HashAggregate" in below
    assert plan(yearly_rollup(df, ["lang"])).count("Exchange") == 0
    plain = word_list(read_columnar(spark, f"{layouts}/columnar", ["eng"]), CONFIG, with_stats=True, checked=True)
    assert word_list(df, CONFIG, with_stats=True, checked=True).collect() == plain.collect()


def test_a_word_is_one_row_in_the_shuffles_of_a_job_from_files(spark):
    """However many years it has; files are told apart without a shuffle by file."""
    df = spark.range(0, 64_000, 1, 8).select(
        F.concat(F.lit("w"), F.col("id") % 1000).alias("ngram"),
        (1962 + F.floor(F.col("id") / 1000)).alias("year"),
        F.lit(2).cast("bigint").alias("match_count"),
        F.lit(1).cast("bigint").alias("volume_count"),
        F.concat(F.lit("file:/data/"), F.col("id") % 10).alias("file"),
    )
    by_case, by_word, by_years = shuffled_rows(merge_files(df, Config(False, 1962, 0, 0)))
    assert by_years == 8 * 1000 and by_word <= 1000 and by_case <= 1000


def test_long_lists_are_placed_block_by_block(spark, tmp_path):
    """No window holds more than a block's lines, or the blocks of a list."""
    text = plan(read_words(spark, str(make_words(spark, tmp_path, 10))))
    windows = [line for line in text.splitlines() if "+- Window" in line or "- Window" in line]
    numbered = [line for line in windows if "row_number()" in line]
    assert len(numbered) == 1 and "_file" in numbered[0].split("windowspecdefinition(")[1].split("ASC")[0] and "_start" in numbered[0]
    assert all("sum(_size" in line for line in windows if line not in numbered)


def make_words(spark, tmp_path, n):
    write_words(spark.range(n).select(F.format_string("word %07d", "id").alias("ngram")), str(tmp_path / "words"))
    return tmp_path / "words"


def test_words_of_split_files_keep_their_places(spark, tmp_path):
    path = tmp_path / "words"
    path.mkdir()
    for name, first in (("part-00000-x.txt", 0), ("part-00002-x.txt", 9000), ("part-100000-x.txt", 12_000)):
        size = {0: 9000, 9000: 3000, 12_000: 50}[first]
        (path / name).write_text("".join(f"word {first + k:07d}\n" for k in range(size)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        df = read_words(spark, str(path))
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 3
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.position, r.ngram) for r in rows) == [(k + 1, f"word {k:07d}") for k in range(12_050)]


@pytest.mark.parametrize("limit", [1, 7, 500, 3000, 10_000])
def test_ranges_give_the_same_list(spark, layouts, limit, monkeypatch):
    """A limit beyond a long list, against the tree of the best rows."""
    df = read_columnar(spark, f"{layouts}/columnar")
    config = Config(min_matches=0, min_books=0, max_outputs=limit, sort_by_popularity=True)
    one = merge_files(df.where("lang = 'eng'"), config)
    expected = pick_top(one, limit, True, with_stats=True).collect()
    lists = word_lists(df, languages(spark), config, with_stats=True).collect()
    monkeypatch.setattr(topk, "LONG_LIST", 0)
    assert pick_top(one, limit, True, with_stats=True).collect() == expected
    assert word_lists(df, languages(spark), config, with_stats=True).collect() == lists
    monkeypatch.setattr(topk, "EXACT", 4)  # most rows share ranges of counts
    assert pick_top(one, limit, True, with_stats=True).collect() == expected
    unordered = pick_top(one, limit, with_stats=True)
    assert {r.ngram for r in unordered.collect()} == {r.ngram for r in expected}


def test_ranges_follow_the_order(spark):
    rows = [(m, b, y, f, w) for m in (1, 2, 63, 64, 1023, 1024, 1025, 5000, 2**40, 2**40 + 1, 2**62) for b in (1, 1023, 1024, 9999) if b <= m for y, f in ((2000, 1990), (2001, 1990), (2001, 1980)) for w in ("a", "ab", "abc", "é")]
    df = spark.createDataFrame(rows, "match_count long, min_volume_count long, last_year long, first_year long, top_casing string")
    found = df.orderBy(*best_first()).select("*", topk.order_range().alias("r")).collect()
    key = [tuple((x is not None, x) for x in r.r) for r in found]
    assert key == sorted(key)


def test_a_long_list_gives_no_task_all_of_it(spark):
    """A million of the best: one lazy query, whose tasks get the rows of some ranges."""
    df = spark.range(0, 400_000, 1, 8).select(
        F.concat(F.chr((97 + F.col("id") % 26).cast("bigint")), F.chr((97 + F.col("id") % 25).cast("bigint")), F.col("id").cast("string")).alias("top_casing"),
        (F.lit(1990) + F.col("id") % 20).alias("first_year"),
        (F.lit(2010) + F.col("id") % 3).alias("last_year"),
        F.when(F.col("id") < 300_000, F.col("id") % 3 + 1).otherwise(F.col("id")).alias("match_count"),
        F.lit(1).cast("bigint").alias("min_volume_count"),
    )
    df = df.repartition(8, "top_casing")
    found = pick_top(df, 1_000_000, True)
    text = plan(found)
    assert "TakeOrdered" not in text and text.count("SinglePartition") == 1
    assert "HashAggregate(keys=[_range" in text[text.index("SinglePartition") :].splitlines()[1]
    assert found.count() == 400_000
    ranges = df.groupBy(topk.order_range()).count().agg(F.max("count")).first()[0]
    assert ranges < 5_000


def shuffled_rows(df):
    """Rows written by each shuffle of an executed query, from the last one up."""
    df.collect()
    query = df._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    found, todo = [], [query]
    while todo:
        node = todo.pop()
        if node.nodeName() == "ShuffleQueryStage":
            node = node.plan()
        if node.nodeName() == "Exchange":
            found.append(node.metrics().get("shuffleRecordsWritten").get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_a_hot_word_is_merged_before_the_shuffle(spark):
    """A third of all entries are of one word, which all files have."""
    hot = F.col("id") % 3 == 0
    df = spark.range(0, 90_000, 1, 8).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("w"), F.col("id") % 1000)).alias("ngram"),
        F.when(hot, 1962 + F.floor(F.col("id") / 3) % 60).otherwise(1962 + F.floor(F.col("id") / 1000)).alias("year"),
        F.lit(2).cast("bigint").alias("match_count"),
        F.lit(1).cast("bigint").alias("volume_count"),
        F.when(hot, F.floor(F.col("id") / 180)).otherwise(F.col("id") % 500).cast("string").alias("file"),
    )
    by_case, by_word, by_years = shuffled_rows(merge_files(df, Config(False, 1962, 0, 0)))
    assert by_years <= 8 * 2 * 1000 + 8 + 500
    assert by_word <= 8 * 1001
    assert by_case <= 1001


def test_rows_of_a_hot_language_are_cut_before_the_shuffle(spark, layouts):
    df = read_columnar(spark, f"{layouts}/columnar")
    config = Config(min_matches=1, min_books=1, max_outputs=10, sort_by_popularity=True)
    found = shuffled_rows(word_lists(df, languages(spark), config))
    by_rank, by_language, by_bucket = found[:3]
    assert by_rank == 4 * 10
    assert by_language <= 4 * 10 * BUCKETS
    assert by_bucket <= 4 * 10 * BUCKETS * 8


def test_the_last_task_gets_rows_by_bucket_only(spark):
    """However many partitions there are."""
    df = spark.range(0, 40_000, 1, 40).select(
        F.col("id").cast("string").alias("ngram"),
        F.lit(2000).cast("bigint").alias("year"),
        (F.col("id") % 1000 + 1).alias("match_count"),
        F.lit(1).cast("bigint").alias("volume_count"),
    )
    limit = 5
    found = shuffled_rows(word_list(df, Config(False, 1962, 0, 0, limit)).groupBy().count())
    assert sum(n for n in found if n <= limit * BUCKETS) and found[-1] == 40_000


def test_building_a_list_runs_no_job(spark, layouts):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plans only")
    df = read_columnar(spark, f"{layouts}/columnar")
    before = len(tracker.getJobIdsForGroup("building"))
    for limit in (10, 5_000, 50_000):
        config = Config(max_outputs=limit, sort_by_popularity=True)
        word_list(df, config)
        word_lists(df, languages(spark), config)
    after = len(tracker.getJobIdsForGroup("building"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert after == before


def test_no_shuffle_below_the_tokenizer(spark):
    text = plan(registered.f1_recency(spark, "/root/testdata/sf0.001"))
    assert text.count("Exchange") == 1


def test_languages_reach_the_partitions(spark, layouts):
    df = read_columnar(spark, f"{layouts}/columnar")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(word_lists(df, languages(spark), CONFIG, checked=True, partitioned=True))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [part.split("ReadSchema")[0] for part in text.split("FileScan parquet")[1:]]
    assert len(scans) == 2
    stripped, usual = sorted(scans, key=lambda s: "Or(LessThan(ngram,A)" not in s)
    assert "eng" in stripped.split("PartitionFilters")[1] and "ger" not in stripped.split("PartitionFilters")[1]
    assert "Or(LessThan(ngram,A)" in stripped
    assert "ger" in usual.split("PartitionFilters")[1] and "LessThan(ngram" not in usual


def test_columnar_files_are_few_and_hot_prefixes_split(spark, tmp_path):
    df = spark.range(0, 60_000, 1, 16).select(
        F.lit("eng").alias("lang"),
        F.concat(F.when(F.col("id") % 3 == 0, F.chr((97 + F.col("id") % 26).cast("bigint"))).otherwise("a"), F.md5(F.col("id").cast("string"))).alias("ngram"),
        F.lit(2000).cast("bigint").alias("year"),
        F.lit(2).cast("bigint").alias("match_count"),
        F.lit(1).cast("bigint").alias("volume_count"),
    )
    def files():
        return {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / str(size) / "lang=eng").iterdir()}

    for size in ("64m", "200k"):
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
        write_columnar(df, str(tmp_path / size))
        found = files()
        if size == "64m":
            assert sum(found.values()) <= len(found) + 8
        else:
            assert found["prefix=a"] > 3
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_filters_reach_the_columnar_scan(spark, layouts):
    df = read_columnar(spark, f"{layouts}/columnar", ["eng"], ["a"])
    text = plan(word_list(df, CONFIG, checked=True))
    scan = text[text.index("FileScan parquet") :]
    assert "PartitionFilters: [isnotnull(lang" in scan
    assert "GreaterThanOrEqual(year,1962)" in scan
    assert "Or(LessThan(ngram,A)" in scan
    assert "ReadSchema: struct<ngram:string,year:bigint,match_count:bigint,volume_count:bigint>" in scan


def test_unneeded_columns_are_not_read(spark, layouts):
    df = read_columnar(spark, f"{layouts}/columnar").groupBy("lang").max("year")
    assert "ReadSchema: struct<year:bigint>" in plan(df)


def test_text_lines_are_decoded_below_every_filter(spark, layouts):
    text = plan(word_list(read_entries(spark, f"{layouts}/text"), CONFIG, checked=True))
    assert text.count("Exchange") == 4
    assert text.count("split(") == 1
    below = text[text.index("Generate inline") :]
    assert "1962" not in below


def test_word_lists_join_nothing(spark, layouts):
    df = read_columnar(spark, f"{layouts}/columnar")
    text = plan(word_lists(df, languages(spark), CONFIG))
    assert "Join" not in text
    assert "WindowGroupLimit" in text and "Partial" in text


def test_file_merge_shuffles_merged_rows_only(spark, layouts):
    """By file, word and years, by file and word, by file and case key, by case key and spelling, by case key: each one merged before."""
    text = plan(merge_files(read_entries(spark, f"{layouts}/text", with_file=True), CONFIG, "file"))
    assert text.count("Exchange") == 5
    assert text.count("partial_try_sum") >= 4
    assert "Join" not in text


def test_case_key_is_not_reduced_to_lower_case(spark, layouts):
    text = plan(merge_files(read_columnar(spark, f"{layouts}/columnar"), CONFIG))
    key = text[text.index("Project [ngram") :].splitlines()[0]
    assert key.count("lower(") == 3 and key.count("upper(") == 1 and key.count("translate(") == 2


def test_no_query_limits_its_input():
    source = inspect.getsource(registered)
    for word in (".collect(", ".toPandas(", "toArrow(", ".limit(", "sample(", "localCheckpoint"):
        assert word not in source


def test_what_reaches_the_driver():
    """Catalogs, single rows, a sample of bounded size, names of files and parts; nothing is cut off or kept on one machine."""
    top = Path(registered.__file__).parents[1]
    allowed = {"operators/filters.py": ["language_flags"], "operators/topk.py": ["_bounds"], "streaming/incremental.py": ["_names", "fold_batch"]}
    for path in [p for p in top.rglob("*.py") if "llm" not in p.parts]:
        text = path.read_text()
        for word in ("toPandas(", "toArrow(", "localCheckpoint", "mkdtemp", ".rdd", "broadcast("):
            assert word not in text, (path, word)
        if ".collect(" in text:
            assert str(path.relative_to(top)) in allowed, path
