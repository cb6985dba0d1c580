"""Choosing and ordering the words of the final list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocabmill.functions.ranking import best_first
from vocabmill.session import materialize

#: The best rows are chosen within so many buckets of words first.
BUCKETS = 64

#: Beyond this limit the best rows are found by ranges of the final order, not in a tree.
LONG_LIST = 10_000

#: Counts below are ranges of their own; above, so many ranges are made of each doubling.
EXACT, PER_DOUBLING = 1024, 64

#: A distributed ranking has at most so many ranges; so many times rows are sampled for each bound.
RANGES, SAMPLED = 100, 20

STATS = ["first_year", "last_year", "match_count", "min_volume_count"]


def pick_top(
    df: DataFrame,
    max_outputs: int | None = None,
    sort_by_popularity: bool = False,
    keys: Sequence[str] = (),
    with_stats: bool = False,
    distributed: bool = False,
) -> DataFrame:
    """The words of ``df``, rows of case classes: all or the best ``max_outputs``.

    With ``keys`` there is one list per key. ``sort_by_popularity`` puts the
    best word first; a limited list also gets its ``rank``. Every limit is exact.

    The best rows are chosen in a tree: by bucket of words, then out of the best
    of all buckets; a task gets limit x ``BUCKETS`` rows of a key at most. Limits
    beyond ``LONG_LIST`` go by ranges of the final order: a histogram of them,
    merged before it is shuffled, tells where a range's ranks start and which
    ranges are beyond the limit, and rows are numbered within their range.
    ``distributed`` ranks by sampled ranges, also lists without a limit. It writes the
    classes to the scratch folder when it is called; everything else is lazy.
    """
    if max_outputs is not None and max_outputs < 1:
        raise ValueError("max_outputs must be at least 1, or None for no limit")
    keys = list(keys)
    df = df.select(*keys, "top_casing", *STATS)
    columns = [*keys, F.col("top_casing").alias("ngram"), *(STATS if with_stats else [])]
    if sort_by_popularity and (max_outputs or distributed):
        columns.append(F.col("rank").cast("bigint").alias("rank"))

    if distributed:
        df = ranked(df, keys, max_outputs)
    elif max_outputs is not None and max_outputs > LONG_LIST:
        df = _best_by_ranges(df, keys, max_outputs)
    elif max_outputs is not None:
        df = _best_of_buckets(df, keys, max_outputs)
        if keys:
            per_key = Window.partitionBy(*keys).orderBy(*best_first())
            df = df.withColumn("rank", F.row_number().over(per_key))
            df = df.where(F.col("rank") <= max_outputs)
        else:
            df = df.orderBy(*best_first()).limit(max_outputs)
            if sort_by_popularity:
                df = df.withColumn("rank", F.row_number().over(Window.orderBy(*best_first())))
    if sort_by_popularity and "rank" in df.columns:
        in_order = not keys and not distributed and max_outputs <= LONG_LIST
        df = df if in_order else df.orderBy(*keys, "rank")
    elif sort_by_popularity:
        df = df.orderBy(*keys, *best_first())
    return df.select(*columns)


def _best_of_buckets(df: DataFrame, keys: Sequence[str], max_outputs: int) -> DataFrame:
    """The best rows of each bucket, among which are the best of all."""
    bucket = F.pmod(F.xxhash64("top_casing"), F.lit(BUCKETS))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*best_first())
    df = df.withColumn("_bucket", bucket).withColumn("_place", F.row_number().over(within))
    return df.where(F.col("_place") <= max_outputs).drop("_bucket", "_place")


def order_range() -> Column:
    """The range of the final order that a row is in; the smaller, the earlier.

    Matches are a range each, or a 64th of a doubling. Only where they are exact does
    the next part of the order count, and so on down to the first letters of a
    word. So rare words, of which there are most, are in small ranges too.
    """
    exact_matches = F.col("match_count") < EXACT
    exact_books = exact_matches & (F.col("min_volume_count") < EXACT)

    def counted(name):
        value = F.col(name)
        doublings = F.floor(F.log2(value) * PER_DOUBLING) + EXACT
        # A logarithm that rounds up must not put a smaller count before a greater one.
        return F.when(value < EXACT, value).otherwise(F.greatest(doublings, F.lit(EXACT)))

    rare = exact_books & (F.col("match_count") < 64)
    return F.struct(
        (-counted("match_count")).alias("matches"),
        F.when(exact_matches, -counted("min_volume_count")).alias("books"),
        F.when(rare, -F.col("last_year")).alias("last"),
        F.when(rare, F.col("first_year")).alias("first"),
        F.when(rare, F.substring("top_casing", 1, 2)).alias("word"),
    )


def _best_by_ranges(df: DataFrame, keys: Sequence[str], max_outputs: int) -> DataFrame:
    """The best rows of each key with their ``rank``, without a task that gets all of them.

    Both uses of ``df`` read the same columns, so Spark computes its last shuffle once.
    """
    keys = list(keys)
    df = df.withColumn("_range", order_range())
    sizes = df.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    offsets = _rows_before(sizes, keys, F.col("_range"))
    offsets = offsets.where(F.col("_before") < max_outputs).drop("_size")
    within = Window.partitionBy(*keys, "_range").orderBy(*best_first())
    rows = df.join(offsets, [*keys, "_range"])
    rows = rows.withColumn("rank", F.col("_before") + F.row_number().over(within))
    return rows.where(F.col("rank") <= max_outputs).drop("_range", "_before")


def ranked(df: DataFrame, keys: Sequence[str], max_outputs: int | None = None) -> DataFrame:
    """Number the (best) rows of each key, without one task per key.

    The rows that may be among the best are split into ranges of the final
    order, and a row's rank is its position in its range plus the size of the
    ranges before. As the order has no ties, ranges can always be split evenly,
    however large a key is. The rows are written once; the bounds are sampled
    from what was written and are constants, so counting and numbering see the
    same ranges.
    """
    keys = list(keys)
    df = materialize(df, "classes")
    if max_outputs is not None:
        df = candidates(df, keys, max_outputs)
    # The generator keeps the place from being computed again for every bound.
    df = df.select("*", F.explode(F.array(_place())).alias("_at"))
    bounds = _bounds(df)
    df = df.withColumn("_range", F.size(F.filter(bounds, lambda b: b < F.col("_at")))).drop("_at")
    sizes = df.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    # Ranges beyond the limit are dropped whole, before any sorting.
    offsets = _rows_before(sizes, keys, F.col("_range"))
    if max_outputs is not None:
        offsets = offsets.where(F.col("_before") < max_outputs)
    within = Window.partitionBy(*keys, "_range").orderBy(*best_first())
    rows = (
        df.join(offsets.drop("_size"), [*keys, "_range"])
        .withColumn("rank", F.col("_before") + F.row_number().over(within))
        .drop("_range", "_before")
    )
    return rows if max_outputs is None else rows.where(F.col("rank") <= max_outputs)


def _place() -> Column:
    """The final order as one string: better rows come first."""
    most = F.lit(2**63 - 1)
    numbers = [most - F.col("match_count"), most - F.col("min_volume_count"), F.lit(10**9) - F.col("last_year"), F.lit(10**9) + F.col("first_year")]
    return F.concat(*(F.lpad(n.cast("string"), 19, "0") for n in numbers), F.col("top_casing"))


def _bounds(df: DataFrame) -> Column:
    """Bounds of ranges of about equal size, out of a sample of bounded size, as constants."""
    share = min(1.0, RANGES * SAMPLED / max(df.count(), 1))
    sample = df.select("_at").sample(share, seed=1).orderBy("_at").collect()
    return F.array(*(F.lit(row["_at"]) for row in sample[SAMPLED::SAMPLED])).cast("array<string>")


def candidates(df: DataFrame, keys: Sequence[str], max_outputs: int) -> DataFrame:
    """Rows with enough matches to be among the best ``max_outputs`` of their key.

    Matches come first in the order. A histogram of them, eight buckets per
    doubling, shows which buckets are beyond the limit for sure.
    """
    bucket = F.floor(F.log2(F.col("match_count") + 1) * 8)
    histogram = df.groupBy(*keys, bucket.alias("_bucket")).agg(
        F.count("*").alias("_size"), F.min("match_count").alias("_lowest")
    )
    reached = _rows_before(histogram, keys, F.col("_bucket").desc())
    reached = reached.where(F.col("_before") < max_outputs)
    lowest = reached.groupBy(*keys).agg(F.min("_lowest").alias("_lowest"))
    if keys:
        df = df.join(lowest, keys)
        return df.where(F.col("match_count") >= F.col("_lowest")).drop("_lowest")
    bound = lowest.first()["_lowest"]
    return df if bound is None else df.where(F.col("match_count") >= bound)


def _rows_before(sizes: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Add up ``_size`` over the groups of a key that come earlier."""
    before = Window.partitionBy(*keys).orderBy(order)
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
