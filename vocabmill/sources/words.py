"""Writing word lists, and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_words(df: DataFrame, path: str) -> None:
    """One word per line, without a header; lists by ``lang`` in a folder for each language.

    A sorted list is written as it is: the part files follow the order by name.
    """
    if "lang" in df.columns:
        df.select("lang", "ngram").write.partitionBy("lang").text(path)
    else:
        df.select("ngram").write.text(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """``ngram`` and its ``position``, from 1, in the list (or in that of its ``lang``).

    A list may be long: its lines are numbered within the blocks that Spark reads
    files in, and the numbers of lines of the blocks before are added. Only
    those, a row for each block, are summed up in one place.
    """
    lines = spark.read.text(path).select(
        "*",
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"),
    )
    keys = [name for name in lines.columns if name == "lang"]
    block = [*keys, "_file", "_start"]
    sizes = lines.groupBy(*block).agg(F.count("*").alias("_size"))
    # Parts are numbered, with more digits from the 100,000th on.
    number = F.regexp_extract("_file", r"^part-(\d+)", 1).try_cast("bigint")
    earlier = Window.partitionBy(*keys).orderBy(number, "_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*block, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    # Line numbers are only compared within a block, which one task reads from start to end.
    within = Window.partitionBy(*block).orderBy("_line")
    placed = lines.withColumn("_place", F.row_number().over(within)).join(before, block)
    return placed.select(
        *keys,
        F.col("value").alias("ngram"),
        (F.col("_before") + F.col("_place")).cast("bigint").alias("position"),
    )
