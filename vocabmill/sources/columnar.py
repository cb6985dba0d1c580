"""A Parquet copy of the entries, for data sets that are read more than once.

Gzipped text is read by one task per file and in full. The copy splits, keeps
only the needed columns, skips partitions by language and word prefix, and, as
each file is sorted by word, skips the row groups of capitalised words.

A copy in buckets keeps all entries of a word in one bucket of its language. What is
then aggregated by word needs no shuffle, which is the first and largest one of a job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabmill.functions.words import word_prefix
from vocabmill.operators.quality import require_entries
from vocabmill.session import list_names

COLUMNS = ["lang", "prefix", "ngram", "year", "match_count", "volume_count"]
ROWS_PER_FILE = 50_000_000


def write_columnar(df: DataFrame, path: str, buckets: int | None = None) -> None:
    """Write entries with a ``lang`` column, partitioned by language and prefix, or by language and ``buckets`` of words.

    As many buckets as make files of about the advisory size, and at least as many as tasks should run at once.

    The rows are shuffled by language and prefix into partitions of about the
    advisory size, so there are few files for each; adaptive execution splits a
    language and prefix with much of the data. Bad entries fail the job, so a
    copy holds sound ones only.
    """
    # As a constant, the language would be optimized out of the sort order, which
    # then no longer fits the writer: it would sort again, by partition only.
    nothing = F.substring(F.coalesce("ngram", F.lit("")), 1, 0)
    df = require_entries(df).withColumns(
        {"lang": F.concat("lang", nothing), "prefix": word_prefix(F.col("ngram"))}
    )
    if buckets is not None:
        _write_buckets(df.drop("prefix"), path, buckets)
        return
    (
        df.select(*COLUMNS)
        .hint("rebalance", "lang", "prefix")
        .sortWithinPartitions("lang", "prefix", "ngram", "year")
        .write.partitionBy("lang", "prefix")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .parquet(path)
    )


def _write_buckets(df: DataFrame, path: str, buckets: int) -> None:
    # Words are shuffled as buckets deal them, so a task writes one bucket of each language.
    rows = df.select(*(name for name in COLUMNS if name != "prefix")).repartition(buckets, "ngram")
    root = f"{path}/buckets-{buckets}"
    (
        rows.sortWithinPartitions("lang", "ngram", "year")
        .write.partitionBy("lang")
        .bucketBy(buckets, "ngram")
        .sortBy("ngram", "year")
        .option("path", root)
        .saveAsTable(_table_name(root))
    )


def _table_name(root: str) -> str:
    """Spark knows buckets of tables only; the table is a name for the folder."""
    return f"vocabmill_{hashlib.md5(root.encode()).hexdigest()}"


def bucket_count(spark: SparkSession, path: str) -> int | None:
    """In how many buckets of words a copy is, if it is in buckets."""
    for name in list_names(spark, path):
        if name.startswith("buckets-"):
            return int(name.removeprefix("buckets-"))
    return None


def _read_buckets(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    root = f"{path}/buckets-{buckets}"
    name = _table_name(root)
    if not spark.catalog.tableExists(name):
        location = root.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} (ngram STRING, year BIGINT, match_count BIGINT, volume_count BIGINT, lang STRING)"
            f" USING parquet PARTITIONED BY (lang) CLUSTERED BY (ngram) SORTED BY (ngram, year) INTO {buckets} BUCKETS LOCATION '{location}'"
        )
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name).withColumn("prefix", word_prefix(F.col("ngram")))


def read_columnar(
    spark: SparkSession,
    path: str,
    langs: Sequence[str] | None = None,
    prefixes: Sequence[str] | None = None,
) -> DataFrame:
    """Entries of the given languages and word prefixes; other partitions are not listed.

    A copy in buckets is in no partitions by prefix; there prefixes are a filter.
    """
    buckets = bucket_count(spark, path)
    df = spark.read.parquet(path) if buckets is None else _read_buckets(spark, path, buckets)
    if langs is not None:
        df = df.where(F.col("lang").isin(list(langs)))
    if prefixes is not None:
        df = df.where(F.col("prefix").isin(list(prefixes)))
    return df
