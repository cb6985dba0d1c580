"""Data-quality checks.

Each check returns the offending rows. With ``strict=True`` it runs at once
and raises when there are any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabmill.functions.ranking import rank_value
from vocabmill.operators.rollup import year_span, years_seen
from vocabmill.schema import ENTRY
from vocabmill.sources.entries import decode_problem, split_lines


class DataQualityError(ValueError):
    """Input data breaks a rule of the data set."""


def _report(violations: DataFrame, rule: str, strict: bool) -> DataFrame:
    if strict:
        examples = violations.take(3)
        if examples:
            raise DataQualityError(f"{rule}, for example {examples}")
    return violations


def check_decode(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Text lines (column ``value``) that are not an entry, and why."""
    causes = split_lines(lines).select(*lines.columns, decode_problem().alias("cause"))
    bad = causes.where(F.col("cause").isNotNull() & (F.col("value") != ""))
    return _report(bad, "lines must hold a word and three integers, counts above 0", strict)


def check_books(df: DataFrame, strict: bool = False) -> DataFrame:
    """Accepted entries in more books than they have matches."""
    bad = df.where(F.col("match_count") < F.col("volume_count"))
    return _report(bad, "a word cannot be in more books than it has matches", strict)


def require_books(df: DataFrame) -> DataFrame:
    """The same rule inside a running query: fails on the first offending row.

    The check is part of the value that gets summed, so it sees just the rows
    that passed the filters, and costs no extra pass.
    """
    message = F.concat(
        F.lit("more books than matches: "), F.col("ngram"), F.lit(" "), F.col("year")
    )
    checked = F.when(
        F.col("match_count") >= F.col("volume_count"), F.col("match_count")
    ).otherwise(F.raise_error(message))
    return df.withColumn("match_count", checked)


def require_entries(df: DataFrame, strip: Column | bool = False) -> DataFrame:
    """The rules that hold for every entry, filtered or not, inside a running query.

    A word is not null and, where ``strip`` holds, not empty; there is a year,
    and both counts are above 0. The rows pass a generator, so no filter is
    moved below the check, which fails on the first offending row.
    """
    strip = F.lit(strip) if isinstance(strip, bool) else strip
    sound = (F.col("match_count") > 0) & (F.col("volume_count") > 0) & F.col("year").isNotNull()
    sound = sound & F.col("ngram").isNotNull() & ~(F.coalesce(strip, F.lit(False)) & (F.col("ngram") == ""))
    shown = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in ENTRY.names))
    row = F.array(F.struct(*df.columns))
    failed = F.raise_error(F.concat(F.lit("bad entry: "), shown))
    return df.select(F.inline(F.when(F.coalesce(sound, F.lit(False)), row).otherwise(failed)))


def require_words(df: DataFrame) -> DataFrame:
    """Fails on an empty word among accepted rows, as part of the value that gets summed."""
    checked = F.when(F.col("ngram") != "", F.col("match_count"))
    return df.withColumn("match_count", checked.otherwise(F.raise_error(F.lit("bad entry: empty word"))))


def check_years(df: DataFrame, keys: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Words with more than one entry for the same year, in a ``file`` if it is among the ``keys``.

    The list shuffles every entry, as all of them differ in sound data. The
    strict check goes by ``repeated_years`` and lists only what that has found.
    """
    counts = df.groupBy(*keys, "ngram", "year").agg(F.count("*").alias("n_entries"))
    if strict:
        spans = repeated_years(df, keys)
        if not spans.isEmpty():
            # Only the words and years that were found are counted one by one.
            narrow = df.withColumn("from_year", year_span())
            narrow = narrow.join(spans, [*keys, "ngram", "from_year"], "left_semi")
            few = narrow.groupBy(*keys, "ngram", "year").agg(F.count("*").alias("n_entries"))
            _report(few.where(F.col("n_entries") > 1), "a word has one entry per year", strict)
    return counts.where(F.col("n_entries") > 1)


def repeated_years(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same rule, by word and 64 years: more entries than different years.

    The years seen are bits of one number, so the entries of a word are merged
    before the shuffle, which carries a row per word and 64 years.
    """
    spans = df.groupBy(*keys, "ngram", year_span().alias("from_year")).agg(
        F.count("*").alias("n_entries"), F.bit_count(years_seen()).cast("bigint").alias("n_years")
    )
    return spans.where(F.col("n_entries") > F.col("n_years"))


def check_empty(df: DataFrame, strip: bool, strict: bool = False) -> DataFrame:
    """Entries without a word. They matter only where the first character is looked at."""
    bad = df.where(F.coalesce(F.col("ngram"), F.lit("")) == "") if strip else df.limit(0)
    return _report(bad, "words must not be empty", strict)


def check_class(df: DataFrame, strict: bool = False) -> DataFrame:
    """Case classes whose total is worse than that of their best spelling."""
    total = rank_value(books="min_volume_count")
    bad = df.where(total > rank_value("top_stats"))
    return _report(bad, "the total of a class includes its best spelling", strict)
