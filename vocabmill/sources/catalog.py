"""The supported languages and the names of their data files."""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabmill.config import Config
from vocabmill.schema import LANGUAGE

# Name, short name and whether capitalised words are odd.
LANGUAGES = [
    ("English", "eng", True),
    ("American English", "eng-us", True),
    ("British English", "eng-gb", True),
    ("English Fiction", "eng-fiction", True),
    ("French", "fre", True),
    ("German", "ger", False),
    ("Italian", "ita", True),
    ("Spanish", "spa", True),
]

# Word prefixes of the Latin-script languages, file name format.
LATIN_WORD_PREFIXES = [*"abcdefghijklmnopqrstuvwxyz", "other"]
FILE_NAME_FORMAT = "googlebooks-%s-all-1gram-20120701-%s.gz"


def languages(spark: SparkSession) -> DataFrame:
    """The language catalog, one row per language.

    Arrow makes it a local relation, whose exact size Catalyst knows. From a
    list of tuples it would be an RDD of unknown size, never broadcast.
    """
    rows = [(name, short, LATIN_WORD_PREFIXES, strip) for name, short, strip in LANGUAGES]
    columns = dict(zip(LANGUAGE.names, zip(*rows, strict=True), strict=True))
    return spark.createDataFrame(pa.table({k: list(v) for k, v in columns.items()}), LANGUAGE)


def language_config(catalog: DataFrame, short_name: str, config: Config | None = None) -> Config:
    """``config`` for one language: words are only stripped where that makes sense."""
    config = config or Config()
    found = catalog.where(F.col("short_name") == short_name).take(1)
    if not found:
        raise ValueError(f"unknown language {short_name!r}")
    strip = config.strip_capitalized and found[0]["should_strip_capitalized"]
    return replace(config, strip_capitalized=strip)


def file_paths(short_name: str, base: str) -> list[str]:
    """The data files of one language, without a Spark job."""
    if short_name not in [short for _, short, _ in LANGUAGES]:
        raise ValueError(f"unknown language {short_name!r}")
    names = (FILE_NAME_FORMAT % (short_name, prefix) for prefix in LATIN_WORD_PREFIXES)
    return [f"{base.rstrip('/')}/{name}" for name in names]


def dataset_paths(catalog: DataFrame, base: str) -> DataFrame:
    """One row per data file of the languages in ``catalog``."""
    file_name = F.format_string(FILE_NAME_FORMAT, "short_name", "prefix")
    return catalog.select("short_name", F.explode("word_prefixes").alias("prefix")).withColumn(
        "path", F.concat(F.lit(base.rstrip("/") + "/"), file_name)
    )
