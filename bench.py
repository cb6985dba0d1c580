"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the number of threads. The
queries named ``*_documents`` include counting the entries in the documents;
the others start from stored entries, as the jobs do in production. Each value
is the median of three runs after two warm-ups, of a query that is run to its end.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from vocabmill import languages, merge_files, pick_top, read_columnar, read_entries  # noqa: E402
from vocabmill import word_list, word_lists, write_columnar, write_entries_text  # noqa: E402
from vocabmill import yearly_rollup  # noqa: E402
from vocabmill.config import Config  # noqa: E402
from vocabmill.functions.words import word_prefix  # noqa: E402
from vocabmill.plans import queries as registered  # noqa: E402
from vocabmill.session import scratch_path  # noqa: E402

WARM_UPS, RUNS = 2, 3
TOP = Config(min_matches=20, min_books=3, max_outputs=100, sort_by_popularity=True)
PER_LANGUAGE = Config(min_matches=20, min_books=3, max_outputs=50, sort_by_popularity=True)
PER_FILE = Config(strip_capitalized=False, min_matches=5, min_books=2)


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "16g")
        # Pack the small data files by size, not by the cost of opening them.
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stored(spark, entries, cpus):
    """Entries by language as gzipped text and as a columnar copy in buckets of words, written once."""
    text, copy = scratch_path(spark, "bench-text"), scratch_path(spark, "bench-columnar")
    entries = entries.withColumn("prefix", word_prefix(F.col("ngram")))
    write_entries_text(entries, text, ["lang", "prefix"])
    write_columnar(read_entries(spark, text).drop("prefix"), copy, buckets=cpus)
    return text, copy


def headline(spark, sf_dir, cpus):
    def counted(*keys):
        # The table is a single row group, which one task would have to tokenize.
        return registered.entries(spark, sf_dir, *keys, partitions=cpus)

    text, copy = stored(spark, counted("lang"), cpus)
    catalog = languages(spark)
    return {
        "j1_documents": lambda: word_list(counted(), TOP, with_stats=True),
        "j2_documents": lambda: word_lists(counted("lang"), catalog, PER_LANGUAGE, with_stats=True),
        "a7_documents": lambda: merge_files(counted("file"), PER_FILE, scope="file"),
        "t3_large_documents": lambda: pick_top(
            merge_files(counted(), registered.EVERYTHING), registered.TOP_LARGE, True, distributed=True
        ),
        "s5_a1_text": lambda: yearly_rollup(read_entries(spark, text)),
        "a7_text": lambda: merge_files(read_entries(spark, text, with_file=True), PER_FILE, scope="file"),
        "j1_text": lambda: word_list(read_entries(spark, f"{text}/lang=eng"), TOP, checked=True),
        "j2_text": lambda: word_lists(read_entries(spark, text), catalog, PER_LANGUAGE, checked=True),
        "j1_columnar": lambda: word_list(read_columnar(spark, copy, ["eng"]), TOP, checked=True),
        "j2_columnar": lambda: word_lists(
            read_columnar(spark, copy), catalog, PER_LANGUAGE, checked=True
        ),
    }


def timed(build) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(cpus)
    seconds = {}
    for name, build in headline(spark, sf_dir, cpus).items():
        times = [timed(build) for _ in range(WARM_UPS + RUNS)]
        seconds[name] = round(statistics.median(times[WARM_UPS:]), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "sum of the median times of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
                "spark": spark.version,
                "shuffle_partitions": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
